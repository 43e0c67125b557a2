"""Fill-in-the-middle against plain Python, for lines and for code points."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equipoise.llm import arrow
from equipoise.llm.arrow import text_bytes
from equipoise.llm.infill import Exceptions, fill_in_middle, line_ends, restored


def plain(key, text, unit, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (key, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (key, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}")
    return (key, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}")


def texts():
    rng = random.Random(6)
    parts = ["\n", "\n", "a", "word ", "é", "漢字", "𝒳", "<", ">", "P>", "<S", "\r", "\x00", "\u2028", "\x85", " "]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    out += [None, "", "\n", "\n\n", "x", "no end", "one\n", "a\nb", "<P>", "in <M> it\nmore", "𝒳" * 3000 + "\n" + "é\n" * 2000, "line\n" * 20_000]
    return out


@pytest.mark.parametrize("unit", ["line", "char"])
@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 100), (100, 0)])
def test_cuts_and_round_trip(spark, unit, rate, spm):
    rows = list(enumerate(texts())) + [(None, "some\ntext"), (3, "same\nkey\n"), (3, "same\nkey\n")]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, form string, _h0 int").repartition(3)
    cut = fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    got = cut.withColumn("back", restored("output", "form")).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(str(plain(k, t, unit, rate, spm)) for k, t in rows)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)


def test_steps_do_not_change_the_answer(spark, monkeypatch):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(str(plain(k, t, "line")) for k, t in rows)
    monkeypatch.setattr(arrow.text_slices, "__defaults__", (64,))
    assert sorted(str(tuple(r)) for r in fill_in_middle(docs).collect()) == want


def test_exceptions_convert_both_ways():
    text = "aé漢𝒳" * 5 + "plain" * 100 + "ß"
    data, _ = text_bytes(pa.array([text]))
    index = Exceptions(data)
    at = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    chars = np.arange(len(text) + 1)
    assert (index.bytes_of(chars) == at).all() and (index.chars_of(at) == chars).all()
    assert len(index.bytes) == 16 and len(Exceptions(np.frombuffer(b"ascii only", np.uint8)).bytes) == 0


def test_lines_of_rows_without_text():
    data, offsets = text_bytes(pa.array([None, "", "a\nb", "", "\n\n", None, "x"]))
    ends, first = line_ends(data, offsets)
    assert np.diff(first).tolist() == [0, 0, 2, 0, 2, 0, 1] and ends.tolist() == [2, 3, 4, 5, 6]


def test_empty_table_and_bad_unit(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert fill_in_middle(empty).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(empty, unit="word")


def test_query(spark):
    from equipoise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = QUERIES["op12_fill_in_middle"](spark, sf).collect()
    assert len(got) == len(docs) and {r["form"] for r in got} >= {"psm", "spm"}
    for r in got:
        want = plain(r["doc_id"], docs[r["doc_id"]], "line")
        assert tuple(r) == (*want[:5], sha(want[5]), sha(docs[r["doc_id"]] or ""))


def test_only_the_cuts_run_in_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = fill_in_middle(docs).select(F.sha2(restored("output", "form"), 256))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
