"""Mixing: targets, quotas by highest quotients, and what documents give."""

import random
from collections import Counter, defaultdict

import pytest

from equipoise.llm import mixing
from equipoise.llm.mixing import mix, mixed_rows, shard_quotas, source_quotas


def highest(votes, rooms, seats):
    found = sorted(((-v / (2 * k + 1), i) for i, (v, c) in enumerate(zip(votes, rooms, strict=True)) for k in range(c)))
    return Counter(i for _, i in found[:seats])


@pytest.mark.parametrize("seed", range(4))
def test_quotas_are_those_of_the_highest_quotients(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "SORTED", 3)
    rng = random.Random(seed)
    votes = [rng.choice([0.0, 7.0, 7.0, 100.0 / 3, rng.random() * 500, 1e6]) for _ in range(40)]
    rooms = [rng.choice([0, 1, 5, 60]) for _ in votes]
    seats = rng.randint(0, sum(c for v, c in zip(votes, rooms, strict=True) if v))
    rows = [(i, v, c) for i, (v, c) in enumerate(zip(votes, rooms, strict=True))]
    got = {r["rank"]: r["quota"] for r in source_quotas(spark.createDataFrame(rows, "rank long, target double, capacity long"), seats).collect()}
    assert {k: n for k, n in got.items() if n} == dict(highest(votes, rooms, seats))
    sizes = [rng.choice([0, 10, 10, 31, 1000, 77_777]) for _ in range(50)]
    shards = [(i % 2, i, s, s // 7) for i, s in enumerate(sizes)]
    total = [sum(s // 7 for r, _, s, _ in shards if r == x) for x in (0, 1)]
    quota = [rng.randint(0, total[0]), total[1]]
    frame = spark.createDataFrame(shards, "rank long, shard long, shard_size long, room long")
    got = {r["shard"]: r["blocks"] for r in shard_quotas(frame, spark.createDataFrame(list(enumerate(quota)), "rank long, quota long")).collect()}
    for x in (0, 1):
        mine = [(i, s) for r, i, s, _ in shards if r == x]
        want = highest([float(s) for _, s in mine], [s // 7 for _, s in mine], quota[x])
        assert {i: got[i] for i, _ in mine if got[i]} == {mine[i][0]: n for i, n in want.items()}


def targets(sizes, share=1.5, weights=(3, 1, 2), cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, out = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        level = left / sum(weight[s] for s in names if s not in full) if len(full) < len(names) else 0
        more = {s for s in names if s not in full and weight[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")


def corpus():
    rng = random.Random(3)
    hosts = ["b", "a", "ü", "Z", None, "tiny", "none"]
    rows = [(k, "w " * rng.randint(0, 300), rng.choice(hosts[:5] if k % 3 else ["big"])) for k in range(700)]
    return rows + [(1000, "one two three", "tiny"), (1001, None, "none"), (1002, "", "none"), (None, "no id " * 30, "a"), (5, "again " * 50, "a"), (5, "again " * 50, "a"), (1003, "x " * 60_000, "big")]


def test_mix_keeps_the_contract(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5000)
    rows = corpus()
    got = mix(documents(spark, rows).repartition(5), shard_words=5000).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    source = defaultdict(set)
    for k, t, s in rows:
        sizes[s] += len((t or "").split())
        source[k].add(s)
    want = targets({s: sizes[s] for s in {r[2] for r in rows}})
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        (mine,) = {s for s in source[r["doc_id"]] if sizes[s] == r["source_size"]} or {None}
        assert r["target"] == pytest.approx(want[mine])
        taken[r["target"]] += r["taken"]
    for s, t in want.items():
        shards = -(-sizes[s] // 5000)
        assert abs(taken[[r["target"] for r in got if r["source_size"] == sizes[s]][0]] - t) <= 32 * (shards + 2)
    again = mix(documents(spark, rows).repartition(2), shard_words=5000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_and_ranks_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 2)
    rows = [r for r in corpus() if r[0] is not None and r[0] < 1000]
    whole = mix(documents(spark, rows)).select("doc_id", "target").collect()
    monkeypatch.setattr(mixing, "RANKED", 100_000)
    assert sorted(map(str, whole)) == sorted(map(str, mix(documents(spark, rows)).select("doc_id", "target").collect()))


def test_mixed_rows_repeat_whole_documents(spark):
    rows = [(k, "w " * 40, "a" if k < 300 else "b") for k in range(400)]
    docs = documents(spark, rows)
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    n = Counter(r["doc_id"] for r in mixed.collect())
    taken = {r["doc_id"]: r["taken"] for r in mix(docs).collect()}
    assert all(n[k] == round(t / 40) for k, t in taken.items() if t % 40 != 20)


def test_a_source_of_a_few_words_is_taken(spark):
    rows = [(1, "one two three four five", "tiny"), (2, "six", "tiny"), (3, "w " * 9, "tiny"), *((k, "w " * 200, "big") for k in range(10, 40))]
    got = mix(documents(spark, rows)).collect()
    tiny = [r for r in got if r["source_size"] == 15]
    assert {r["target"] for r in tiny} == {30.0} and sum(r["taken"] for r in tiny) == 30
    assert all(r["taken"] <= 2 * r["size"] for r in got)


@pytest.mark.parametrize("fan", [2, 3])
def test_quotas_in_levels(spark, monkeypatch, fan):
    rows = [(k, "w " * (20 + k % 80), "a" if k % 3 else "b") for k in range(400)]
    flat = mix(documents(spark, rows), shard_words=900).collect()
    monkeypatch.setattr(mixing, "FAN", fan)
    deep = mix(documents(spark, rows), shard_words=900).collect()
    assert {r["target"] for r in deep} == {r["target"] for r in flat}
    for found in (flat, deep):
        for t in {r["target"] for r in found}:
            mine = [r for r in found if r["target"] == t]
            shards = -(-mine[0]["source_size"] // 900)
            assert shards > 2 * fan and abs(sum(r["taken"] for r in mine) - t) <= 32 * (shards + 2)
            assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)


def test_rows_without_a_key_are_spread_over_shards(spark):
    rows = [(None, f"a{k} " + "w " * 50, "a") for k in range(300)] + [(7, f"b{k} " + "w " * 50, "a") for k in range(300)]
    got = mix(documents(spark, rows), share=0.5, shard_words=1000).collect()
    assert len(got) == 600
    # A shard's run cuts the documents at its two ends: one shard would cut two of those that share a key.
    for key in (None, 7):
        assert sum(0 < r["taken"] < r["size"] for r in got if r["doc_id"] == key) > 10


def test_empty_table_and_texts_without_words(spark):
    assert mix(documents(spark, []).limit(0)).count() == 0
    got = mix(documents(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_mixed_rows_take_texts_without_words(spark):
    import corpus_pipeline

    rows = [(1, "w " * 200, "a"), (2, "", "a"), (3, None, "a"), (4, " \n\t", "b"), (5, "w " * 200, "b"), (None, "", None)]
    mixed = corpus_pipeline.mix_sources(spark, documents(spark, rows), "")
    assert {r["doc_id"] for r in mixed.collect()} == {1, 5}
    assert corpus_pipeline.mix_sources(spark, documents(spark, rows[1:4]), "").count() == 0
