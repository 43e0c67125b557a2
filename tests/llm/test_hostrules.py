"""Host rules against a plain version."""

import re

import pytest

from equipoise.llm.hostrules import document_stats, host_rates, judge


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in seen for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one two three", "a"), (5, "a b c d e a b c d e a b c d e", "a"), (6, "x y z " * 40, "b"),
    (7, "same line\nsame line\n\n  \nsame line\nother", "b"), (8, "$$ 𝒳 é #tag <b> 50% x\x85y " * 3 + "end of it all here now", None), (None, "word " * 12, "b"),
    (9, " ".join(f"w{i}" for i in range(30_000)) + " w1 w2 w3 w4 w5", "a"), (4, "one two three", "a"), (10, "q q q q q q q q q q q q", "c"), (11, "a\rb\x0bc\x0cd e f g h i j k", "c"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, True, 5) for r in rows], "doc_id long, text string, source string, kept boolean, n_words int")


def test_counts(spark):
    small = [r for r in ROWS if r[0] != 9]
    got = sorted(str(tuple(r)[:7]) for r in document_stats(table(spark, small)).collect())
    assert got == sorted(str((k, s, *plain(t))) for k, t, s in small)
    long = document_stats(table(spark, [r for r in ROWS if r[0] == 9])).first()
    assert (long["n_words"], long["n_repeat_words"]) == (30_005, 10)


def test_verdicts(spark):
    bad = [(100 + i, "$ " * 30 + " ".join(f"t{i}x{j}" for j in range(40)), "junk") for i in range(60)]
    good = [(200 + i, " ".join(f"g{i}x{j}" for j in range(40)), f"host{i % 5}") for i in range(100)]
    odd = [(300, "$ " * 30 + " ".join(f"o{j}" for j in range(40)), "one of a kind"), (301, "too short", "host1"), (302, " ".join(f"c{j}" for j in range(40)), "junk")]
    got = {r["doc_id"]: r for r in judge(table(spark, bad + good + odd)).collect()}
    assert not any(got[k]["kept"] for k, _, s in bad) and all(got[k]["kept"] for k, _, _ in good)
    # A clean document falls with its host; a host of one failing document is not rejected on that alone.
    assert got[302]["host_rejected"] and not got[302]["kept"] and not got[302]["base_failed"]
    assert got[301]["base_failed"] and not got[301]["kept"] and not got[301]["host_rejected"]


def test_shrinking_of_small_hosts(spark):
    rows = [(i, "$ " * 30 + " ".join(f"t{i}x{j}" for j in range(40)), "few") for i in range(2)]
    rows += [(10 + i, " ".join(f"g{i}x{j}" for j in range(40)), f"host{i % 4}") for i in range(200)]
    rates = {r["_host"]: r["symbols_rate"] for r in host_rates(document_stats(table(spark, rows))).collect()}
    assert 0 < rates["host1"] < 0.02 < rates["few"] < 1


def test_edge_cases_have_defined_results(spark):
    got = judge(table(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and all(r["kept"] is not None for r in got)
    assert {r["doc_id"]: r["base_failed"] for r in got}[9] is False
    assert judge(table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op5_host_rules", "op7_mixing", "op9_secrets"])
def test_main_paths_are_native(spark, name):
    from equipoise.llm.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
