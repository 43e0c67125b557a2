"""SimHash fingerprints and their trie join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from equipoise.llm import simhash
from equipoise.llm.components import connected_components
from equipoise.llm.simhash import fingerprints_of, keep_one, linked_sets, links, near_duplicates


def plain_fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values, distance):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(values):
        for y in values[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= distance:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {v: find(v) for v in values}


def signed(x):
    return int(np.uint64(x).view(np.int64))


def close_values(rng, n, seeds=6):
    base = rng.integers(0, 1 << 63, seeds, dtype=np.uint64)
    out = set(map(int, rng.integers(0, 1 << 64, n, dtype=np.uint64)))
    for _ in range(n):
        v = int(rng.choice(base))
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            v ^= 1 << int(b)
        out.add(v)
    return sorted(out)


def test_fingerprints_are_those_of_the_definition():
    texts = ["", None, " \t", "One", "one two", "a b c d a b c", "É a\nb  c\x0bd " * 9, "Wort" * 400, "x\x85y z\xa0w q r"]
    got = fingerprints_of(pa.array(texts, pa.string()), 3, 42)
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_walk_links_what_all_pairs_link(distance):
    values = close_values(np.random.default_rng(distance), 300)
    want = plain_roots(values, distance)
    array = np.array(values, np.uint64)
    turned = np.sort(array << np.uint64(32) | array >> np.uint64(32))
    u, v = linked_sets(array, None, 0, distance)
    x, y = (z << np.uint64(32) | z >> np.uint64(32) for z in linked_sets(turned, None, 0, distance))
    root = {k: k for k in values}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip([*u, *x], [*v, *y], strict=True):
        a, b = sorted((find(int(a)), find(int(b))))
        root[b] = a
    assert {k: find(k) for k in values} == want


@pytest.mark.parametrize(("cell", "chunk"), [(8, 4096), (8, 3), (1 << 20, 16)])
def test_spark_links_over_cells_and_chunks(spark, monkeypatch, cell, chunk):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    values = close_values(np.random.default_rng(9), 120)
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    got = {r["node"]: r["root"] for r in connected_components(links(df, 3)).collect()}
    want = plain_roots([signed(v) for v in values], 3)
    sizes = {r: sum(x == r for x in want.values()) for r in want.values()}
    assert got == {k: r for k, r in want.items() if sizes[r] > 1}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id string")


def test_edge_cases_have_defined_results(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (1, "a b c d"), (2, "A b c D"), (7, "zz"), (None, "zz"), (2, "A b c D"), (8, "w " * 30_000)]
    docs = documents(spark, [(k, t, "x", "y") for k, t in rows])
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = {None: 7, 5: 3, 3: 3, 9: 3, 1: 1, 2: 1, 7: 7, 8: 8}
    zero = {r["doc_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {5, 3, 9} and {r["doc_id"]: r["component_id"] for r in got} == want
    kept = keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7, 8] and kept.columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    from equipoise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash"](spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in docs.items()}
    root = plain_roots(sorted(set(prints.values())), 3)
    least = {}
    for k, p in prints.items():
        least[root[p]] = min(k, least.get(root[p], k))
    assert got == {k: (f"{p:016x}", least[root[p]]) for k, p in prints.items()}


def test_rows_that_repeat_leave_one(spark):
    one, two = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    rows = [*[(7, one, "x")] * 30, (9, one, "x"), (3, two, "y"), *[(3, one.upper() + " A90", "y")] * 5, *[(None, "alone " * 20, "z")] * 4]
    table = spark.createDataFrame(rows, "doc_id long, text string, _kept string").repartition(5)
    got = keep_one(table, distance=0)
    assert got.columns == table.columns
    got = [tuple(r) for r in got.collect()]
    assert set(got) <= set(rows) and len(got) == len(set(got))
    assert {k for k, _, _ in got} == {7, 3, None}


@pytest.mark.parametrize("words", [1, 2, 3, 5])
def test_long_texts_in_pieces(monkeypatch, words):
    rng = random.Random(words)
    texts = []
    for _ in range(120):
        some = [rng.choice(["a", "Bc", "ü漢", "x" * rng.randint(1, 90)]) + rng.choice([" ", "  ", "\n\t", "\x0b"]) for _ in range(rng.randint(0, 40))]
        texts.append(rng.choice(["", "  ", "\n" * 70]) + "".join(some) + rng.choice(["", "z", " " * 90]))
    texts = pa.array([*texts, None, "y" * 500, " " * 500, "p q" + " " * 300])
    whole = fingerprints_of(texts, words, 42)
    monkeypatch.setattr(simhash, "PIECE", 37)
    assert (fingerprints_of(texts, words, 42) == whole).all()
    assert [int(x) for x in whole] == [plain_fingerprint(t, words) for t in texts.to_pylist()]
