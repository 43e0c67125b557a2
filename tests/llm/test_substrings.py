"""Removal of repeated word sequences against a plain version over all windows."""

import random
import re

import numpy as np
import pytest

from equipoise.llm import substrings
from equipoise.llm.substrings import _pack, _unpack, remove_repeats

TOP = 1 << 62


def plain(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(TOP if k is None else k, first.get(g, TOP))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (TOP if k is None else k):
                gone.update(range(i, i + window))
        spans, i = [], 0
        while i < len(w):
            j = i
            while j < len(w) and j in gone:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((str(k), len(w), len(gone), spans, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def got(df, **how):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept"]) for r in remove_repeats(df, **how).collect())


def corpus(seed, docs=60):
    rng = random.Random(seed)
    passages = [[f"p{p}w{i}" for i in range(rng.choice([5, 12, 13, 14, 20, 60]))] for p in range(6)]
    rows = []
    for k in range(docs):
        words = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                words += passages[rng.randrange(6)]
            else:
                words += [rng.choice(["a", "b", "é", "x\x85y", f"u{rng.random()}"]) for _ in range(rng.randint(0, 30))]
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("unit", [200, 8 << 20])
def test_against_all_windows(spark, monkeypatch, unit):
    monkeypatch.setattr(substrings, "UNIT", unit)
    monkeypatch.setattr(substrings, "STEP", 150)
    rows = corpus(unit)
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "same " * 40), (103, "same " * 60), (104, "z " * 13 + "q " * 13 + "z " * 13)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_words int")
    assert got(df) == plain(rows)
    assert got(df, window=5) == plain(rows, 5)


def test_edge_cases_have_defined_results(spark):
    line = " ".join(f"w{i}" for i in range(13))
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, line), (2, None), (3, ""), (9, "\n \t"), (None, line), (7, line + " end"), (5, line), (1, long), (4, long + " " + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    result = got(df)
    assert result == plain(rows)
    assert [r[2] for r in result if r[0] in ("None", "7", "4", "5")] == [60_000, 13, 13, 13, 13]
    assert remove_repeats(df.limit(0)).count() == 0


def test_packing_keeps_all_bits():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    values[-1] = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (_unpack(_pack(values), 1000) == values).all()


def test_even_windows_are_refused(spark):
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), window=12)


def test_rows_that_share_a_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(substrings, "UNIT", 200)
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, t) for k, t in corpus(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == plain(rows)
    units = df.where("doc_id = 7 OR doc_id IS NULL").select("doc_id", substrings.unit_of("doc_id", "text", 16).alias("unit")).distinct()
    assert all(r["count"] >= 8 for r in units.groupBy("doc_id").count().collect())


def test_words_that_collide_in_the_anchor_hash_are_kept(spark):
    """Thue-Morse words: a polynomial modulo 2**64 cannot tell one from its complement, whatever its odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    data = np.frombuffer((a + b).encode(), np.uint8)
    one, other = substrings._word_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert one == other
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same} {a}")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
