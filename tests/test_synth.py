import numpy as np
import pytest
from pyspark.sql import functions as F

from equipoise.functions.randomness import FastSeed
from equipoise.operators.knn import knn_pairs
from equipoise.operators.synth import rose, smote


def by_copy(df):
    return [(r["id"], r["c"], np.array(r["features"])) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, FastSeed(1)])
def test_smote_lies_between_same_class_rows(spark, blobs, seed):
    out = smote(blobs, ["id"], seed=seed, perc_over=250, copy_col="c")
    members = {r["id"]: np.array(r["features"]) for r in blobs.filter("label = 1").collect()}
    rows = by_copy(out.filter("label = 1 and c > 0"))
    assert abs(len(rows) - 500) < 60
    points = np.array(list(members.values()))
    for i, _, v in rows[:60]:
        a = members[i]
        step = v - a
        gap = points - a
        length = (gap**2).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap @ step) / length
        off = np.abs(step - t[:, None] * gap).sum(1)
        assert np.nanmin(np.where((t >= 0) & (t < 1), off, np.inf)) < 1e-9
    assert out.filter("c = 0").drop("c").exceptAll(blobs).count() == 0
    assert len({tuple(v) for _, _, v in rows}) == len(rows)


def test_smote_keeps_other_columns_and_reuses_neighbours(spark, blobs):
    df = blobs.withColumn("weight", F.col("id") * 2.0)
    low = blobs.filter("label = 1")
    pairs = knn_pairs(low, low, ["id"], "features", 3, aux_cols=["features"], exclude_self=True)
    out = smote(df, ["id"], seed=2, k=3, perc_over=100, neighbors=pairs.withColumnRenamed("features", "nb_features"), copy_col="c")
    made = out.filter("c > 0")
    assert made.filter("weight <> id * 2").count() == 0 and made.count() == 200


def test_smote_small_classes(spark):
    rows = [(i, int(i < 4), [float(i), 1.0]) for i in range(44)]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>")
    out = smote(df, ["id"], perc_over=0, copy_col="c")
    made = out.filter("c > 0")
    assert out.count() == 80 and made.filter("features[1] <> 1.0").count() == 0
    lonely = df.filter("label = 0 or id = 0")
    with pytest.raises(ValueError, match="two rows"):
        smote(lonely, ["id"], perc_over=100)
    even = df.filter("id < 8")
    assert smote(even, ["id"], perc_over=0).count() == 8
    with pytest.raises(ValueError, match="two classes"):
        smote(df.filter("label = 0"), ["id"])


@pytest.mark.parametrize("seed", [3, FastSeed(3)])
def test_rose_moments(spark, blobs, seed):
    out = rose(blobs, ["id"], seed=seed)
    sizes = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert abs(sizes[0] - 1700) < 200 and abs(sizes[1] - 1700) < 400
    assert out.columns == blobs.columns
    d, n = 2, 200
    h = (4 / ((d + 2) * n)) ** (1 / (d + 4))
    was = blobs.filter("label = 1").agg(F.avg(F.col("features")[0]), F.var_samp(F.col("features")[0])).first()
    now = out.filter("label = 1").agg(F.avg(F.col("features")[0]), F.var_samp(F.col("features")[0])).first()
    assert abs(was[0] - now[0]) < 0.25
    assert abs(now[1] / (was[1] * (1 + h * h)) - 1) < 0.25


def test_rose_options(spark, blobs):
    kept = rose(blobs, ["id"], seed=1, keep_orig=True, copy_col="c")
    assert kept.filter("c = 0 and label = 1").count() == 200
    assert kept.filter("c = 0").drop("c").exceptAll(blobs).count() == 0
    full = rose(blobs, ["id"], seed=1, majo_rus=True, keep_majo_size=True, copy_col="c")
    assert full.filter("label = 0").drop("c").exceptAll(blobs).count() == 0
    assert full.filter("label = 0").count() == 3200
    assert rose(blobs, ["id"], mino_prob=1.0).filter("label = 0").count() == 0
    with pytest.raises(ValueError, match="mino_prob"):
        rose(blobs, ["id"], mino_prob=0)


def test_spread_synthetics_are_the_same_rows(spark, blobs, monkeypatch):
    def both():
        made = smote(blobs, ["id"], seed=5, perc_over=0, copy_col="c"), rose(blobs, ["id"], seed=5, copy_col="c")
        return [sorted((r["id"], r["c"], tuple(r["features"])) for r in d.collect()) for d in made]

    monkeypatch.setattr("equipoise.operators.sampling.SPREAD_RATE", 1e9)
    plain = both()
    monkeypatch.setattr("equipoise.operators.sampling.SPREAD_RATE", 0.5)
    monkeypatch.setattr("equipoise.operators.sampling._BLOCK", 4)
    assert both() == plain


def test_smote_makes_every_row_it_was_asked_for(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i < 300), [float(x) for x in rng.normal(0, 1, 2)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>").repartition(3)
    out = smote(df, ["id"], seed=1, perc_over=200, tau=0.0, pivots=40, k=7, copy_col="copy")
    assert out.filter("copy > 0").count() == 600


def test_smote_of_a_class_of_one_row_is_refused(spark):
    df = spark.createDataFrame([(i, int(i == 0), [float(i)]) for i in range(51)], "id long, label int, features array<double>")
    with pytest.raises(ValueError, match="two rows"):
        smote(df, ["id"], perc_over=0)


def test_smote_repeats_rows_without_finite_features(spark):
    rows = [(i, int(i < 10), [float(i), float("nan") if i == 3 else 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    made = smote(df, ["id"], perc_over=100, copy_col="copy").filter("copy > 0").collect()
    assert len(made) == 10 and next(r["features"][0] for r in made if r["id"] == 3) == 3.0


def test_smote_needs_precomputed_pairs_of_all_rows(spark):
    df = spark.createDataFrame([(i, int(i < 10), [float(i)]) for i in range(40)], "id long, label int, features array<double>")
    pairs = spark.createDataFrame([(i, 1, [0.5]) for i in range(9)], "id long, rank int, nb_features array<double>")
    assert smote(df, ["id"], perc_over=100, neighbors=pairs.union(pairs.selectExpr("9L", "1", "array(0.5D)").limit(1))).count() == 50
    with pytest.raises(Exception, match="precomputed"):
        smote(df, ["id"], perc_over=100, neighbors=pairs).collect()
