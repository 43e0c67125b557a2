import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equipoise.functions.randomness import FastSeed, gaussians, normal_sources, normals_from, poisson, uniform
from equipoise.operators.profile import class_profile, class_weights
from equipoise.operators.resample import random_balance, random_balance_sizes, random_oversample, random_undersample
from equipoise.operators import sampling
from equipoise.operators.sampling import exact_sample
from equipoise.operators.tables import shuffle_rows


def counts(df, label="label"):
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def small(spark, sizes, kind="int"):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label, float(i), f"extra{i}"))
            i += 1
    return spark.createDataFrame(rows, f"id long, label {kind}, x double, note string")


def test_uniform_is_the_documented_hash(spark):
    rows = spark.range(20).select("id", uniform(["id"], 3, "tag").alias("u")).collect()
    for r in rows:
        want = int(hashlib.md5(f"tag|3|{r['id']}".encode()).hexdigest()[:12], 16) / 2**48
        assert r["u"] == want


@pytest.mark.parametrize("seed", [9, FastSeed(9)])
def test_draws_are_uniform_normal_and_poisson(spark, seed):
    df = spark.range(20000).select(
        uniform(["id"], seed, "a").alias("u"), gaussians(["id"], seed, "g", 5)[4].alias("g"),
        poisson(uniform(["id"], seed, "p"), 6.5).alias("p"), poisson(uniform(["id"], seed, "w"), 400.0).alias("w"),
        poisson(uniform(["id"], seed, "z"), 20000.0).alias("z"),
    )
    m = df.agg(*[f(c).alias(f"{c}_{n}") for c in "ugpwz" for n, f in (("m", F.avg), ("v", F.var_samp))]).first()
    assert abs(m["u_m"] - 0.5) < 0.01 and abs(m["u_v"] - 1 / 12) < 0.005
    assert abs(m["g_m"]) < 0.03 and abs(m["g_v"] - 1) < 0.04
    assert abs(m["p_m"] - 6.5) < 0.1 and abs(m["p_v"] - 6.5) < 0.4
    assert abs(m["w_m"] - 400) < 1 and abs(m["w_v"] - 400) < 20
    assert abs(m["z_m"] - 20000) < 5 and abs(m["z_v"] / 20000 - 1) < 0.05


@pytest.mark.parametrize("seed", [4, FastSeed(4)])
def test_written_out_normals_equal_the_array(spark, seed):
    sources = normal_sources(["id"], seed, "g", 7)
    both = spark.range(50).select(
        gaussians(["id"], seed, "g", 7).alias("a"), F.array(*normals_from(sources, seed, 7)).alias("b")
    )
    for r in both.collect():
        assert np.allclose(r["a"], r["b"], atol=0, rtol=1e-12)


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 900])
def test_exact_sample_size(spark, n):
    df = spark.range(500)
    assert exact_sample(df, n, ["id"], 1).count() == min(n, 500)


def test_exact_sample_narrows_until_few_rows_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr("equipoise.operators.sampling._BUCKETS", 4)
    monkeypatch.setattr("equipoise.operators.sampling._RANKED_ROWS", 5)
    df = spark.range(1000)
    got = {r["id"] for r in exact_sample(df, 333, ["id"], 2).collect()}
    ranked = df.select("id", uniform(["id"], 2, "exact").alias("u")).orderBy("u", "id").limit(333)
    assert got == {r["id"] for r in ranked.collect()}


@pytest.mark.parametrize("n", [1, 40, 777, 2999])
@pytest.mark.parametrize("reach", [6.0, 0.0])
def test_exact_sample_of_a_known_size_reads_one_window(spark, monkeypatch, n, reach):
    """The window holds the cut-off: no pass over buckets of the whole table. Without reach it misses, and they are read."""
    asked, plain = [], sampling._edge_by_buckets
    monkeypatch.setattr(sampling, "_DEVIATIONS", reach)
    monkeypatch.setattr(sampling, "_PER_BUCKET", 4)
    monkeypatch.setattr(sampling, "_edge_by_buckets", lambda *a: asked.append(1) or plain(*a))
    df = spark.range(3000)
    got = {r["id"] for r in exact_sample(df, n, ["id"], 2, rows=3000).collect()}
    ranked = df.select("id", uniform(["id"], 2, "exact").alias("u")).orderBy("u", "id").limit(n)
    assert got == {r["id"] for r in ranked.collect()}
    assert not asked if reach else True


def test_exact_sample_reads_the_table_twice(spark):
    """Once for the window, once for the rows."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        seen.add(1)
        yield from batches

    df = spark.range(0, 4000, 1, 1).mapInArrow(read, "id long")
    assert exact_sample(df, 1500, ["id"], 4, rows=4000).count() == 1500 and seen.value == 2


@pytest.mark.parametrize("bucket", [7, 100_000])
def test_places_within_classes(spark, monkeypatch, bucket):
    monkeypatch.setattr(sampling, "_RANKED_ROWS", bucket)
    rows = [(i, None if i % 50 == 0 else "rare" if i % 9 == 0 else "usual", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label string, _place int").repartition(5)
    placed = sampling.class_places(df.drop("_place"), "label", ["id"], 3, "fold1", "place")
    got = {r["id"]: r["place"] for r in placed.collect()}
    draws = {r["id"]: r["u"] for r in df.select("id", uniform(["id"], 3, "fold1").alias("u")).collect()}
    for label in (None, "rare", "usual"):
        mine = sorted((i for i, c, _ in rows if c == label), key=lambda i: (draws[i], i))
        assert [got[i] for i in mine] == list(range(len(mine)))


@settings(max_examples=5, deadline=None)
@given(seed=st.integers(0, 10**6), fast=st.booleans())
def test_sizes_and_partition_invariance(spark, seed, fast):
    seed = FastSeed(seed) if fast else seed
    df = small(spark, {0: 900, 1: 100})
    for run in (
        lambda d: random_undersample(d, ["id"], seed=seed, perc_under=0),
        lambda d: random_oversample(d, ["id"], seed=seed, perc_over=0),
    ):
        got = counts(run(df))
        assert abs(got[0] - got[1]) < 4 * 900**0.5 * 3
        a = sorted(map(tuple, run(df.repartition(1)).collect()))
        assert a == sorted(map(tuple, run(df.repartition(7)).collect()))


def test_only_the_named_class_changes(spark):
    df = small(spark, {0: 60, 1: 30, 2: 10})
    under = counts(random_undersample(df, ["id"], seed=1, perc_under=0, mode="exact"))
    assert under == {0: 10, 1: 30, 2: 10}
    over = counts(random_oversample(df, ["id"], seed=1, perc_over=0, mode="exact"))
    assert over == {0: 60, 1: 30, 2: 60}


def test_balanced_input_stays(spark):
    df = small(spark, {0: 50, 1: 50})
    want = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, random_undersample(df, ["id"], seed=1, perc_under=0).collect())) == want
    assert sorted(map(tuple, random_oversample(df, ["id"], seed=1, perc_over=0).collect())) == want


def test_extra_columns_and_string_labels(spark):
    df = small(spark, {"b": 10, "a": 10}, "string")
    p = class_profile(df, "label")
    assert (p.minority, p.majority) == ("a", "b")
    out = random_balance(df, ["id"], seed=5, mode="exact")
    assert out.columns == df.columns and out.count() == 20


def test_random_balance_bounds(spark):
    p = class_profile(small(spark, {0: 3, 1: 1}), "label")
    assert random_balance_sizes(p, 1) == (2, 2)
    with pytest.raises(ValueError, match="at least 4"):
        random_balance(small(spark, {0: 2, 1: 1}), ["id"])
    eight = class_profile(small(spark, {0: 5, 1: 3}), "label")
    drawn = {random_balance_sizes(eight, s)[1] for s in range(200)}
    assert drawn == {2, 3, 4, 5, 6}


def test_errors(spark):
    one = small(spark, {0: 10})
    with pytest.raises(ValueError, match="two classes"):
        random_balance(one, ["id"])
    with pytest.raises(ValueError, match="two classes"):
        class_weights(one, "label")
    with pytest.raises(ValueError, match="at most 100"):
        random_undersample(small(spark, {0: 2, 1: 1}), ["id"], perc_under=120)
    with pytest.raises(ValueError, match="empty"):
        class_profile(one.filter("false"), "label")


def test_shuffle_depends_on_key_and_seed_only(spark):
    df = spark.range(300)
    order = [r["id"] for r in shuffle_rows(df, ["id"], 1).collect()]
    assert order == [r["id"] for r in shuffle_rows(df.repartition(5), ["id"], 1).collect()]
    assert sorted(order) == list(range(300)) and order != list(range(300))
    assert order != [r["id"] for r in shuffle_rows(df, ["id"], 2).collect()]


@pytest.mark.parametrize("mode", ["hash", "exact"])
def test_spread_copies_are_the_same_rows(spark, monkeypatch, mode):
    df = small(spark, {0: 600, 1: 20})
    runs = (
        lambda: random_oversample(df, ["id"], seed=3, perc_over=0, mode=mode, copy_col="c"),
        lambda: random_balance(df, ["id"], seed=3, mode=mode, copy_col="c"),
    )
    monkeypatch.setattr("equipoise.operators.sampling.SPREAD_RATE", 1e9)
    plain = [sorted(map(tuple, run().collect())) for run in runs]
    monkeypatch.setattr("equipoise.operators.sampling.SPREAD_RATE", 0.5)
    monkeypatch.setattr("equipoise.operators.sampling._BLOCK", 4)
    assert [sorted(map(tuple, run().collect())) for run in runs] == plain


def test_very_large_poisson_rates_keep_their_law(spark):
    from equipoise.functions.randomness import poisson, uniform

    for rate in (9_900.0, 10_100.0, 250_000.0):
        drawn = spark.range(3000).withColumn("u", uniform(["id"], 5, "law")).select(poisson(F.col("u"), rate).alias("n"))
        r = drawn.agg(F.avg("n").alias("m"), F.var_samp("n").alias("v")).first()
        assert abs(r["m"] / rate - 1) < 4 / (rate * 3000) ** 0.5 and abs(r["v"] / rate - 1) < 0.12


def test_more_than_ten_thousand_classes(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") < 40_000, F.lit(-1)).otherwise(F.floor(F.col("id") / 2)).alias("label"))
    out = random_undersample(df, ["id"], seed=2, perc_under=0, mode="exact")
    assert out.count() == 20_000 + 2


def test_null_key_parts_draw_apart(spark):
    from equipoise.functions.randomness import uniform

    df = spark.createDataFrame([(1, None, 2), (1, 2, None)], "a int, b int, c int")
    assert df.select(uniform(["a", "b", "c"], 7, "x").alias("u")).distinct().count() == 2
