import numpy as np
import pytest
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from equipoise.functions.losses import log_loss, signed_label
from equipoise.functions.vectors import as_vector
from equipoise.operators.boost import RebalancedGBTClassifier, evaluate_each_iteration
from equipoise.operators.ensemble import RebalancedBaggingClassifier
from equipoise.operators.plain import SummedModel


@pytest.fixture(scope="module")
def table(blobs):
    return blobs.withColumn("features", as_vector(blobs, "features")).cache()


def recall(model, df):
    r = model.transform(df.filter("label = 1")).agg(F.avg("prediction")).first()
    return r[0]


def raw(model, df):
    rows = model.transform(df).select("id", vector_to_array("rawPrediction")[1].alias("r")).orderBy("id").collect()
    return np.array([r["r"] for r in rows])


@pytest.mark.parametrize("how", ["rus", "ros", "balance"])
def test_rebalanced_bagging_finds_the_rare_class(table, how):
    plain = RandomForestClassifier(numTrees=10, maxDepth=4, seed=1).fit(table)
    bagging = RebalancedBaggingClassifier(keyCols=["id"], resampling=how, numResamples=10, maxDepth=4, seed=1).fit(table)
    assert bagging.getNumTrees == 10 and len(bagging.trees) == 10
    assert recall(bagging, table) >= recall(plain, table) - (0.1 if how == "balance" else 0)


def test_forest_score_is_the_sum_of_its_trees_and_survives_saving(table, tmp_path):
    model = RebalancedBaggingClassifier(keyCols=["id"], numResamples=3, maxDepth=3).fit(table)
    part = table.filter("id % 17 = 0")
    total = 0
    for tree in model.trees:
        scored = tree.setFeaturesCol("features").transform(part).orderBy("id").select(vector_to_array("probability")[1])
        total = total + np.array([r[0] for r in scored.collect()])
    assert np.allclose(raw(model, part), total)
    model.write().overwrite().save(str(tmp_path / "forest"))
    assert np.allclose(raw(RandomForestClassificationModel.load(str(tmp_path / "forest")), part), total)


def test_copies_as_weights_equal_copies_as_rows(table):
    """A member trained on weights equals one trained on repeated rows (single tree, no column sampling)."""
    base = dict(keyCols=["id"], resampling="ros", numResamples=1, maxDepth=3, featureSubsetStrategy="all")
    weighted = RebalancedBaggingClassifier(**base).fit(table)
    rows = RebalancedBaggingClassifier(**base, minInstancesPerNode=2).fit(table)
    a, b = raw(weighted, table), raw(rows, table)
    assert np.mean((a > 0.5) == (b > 0.5)) > 0.97


def test_bootstrap_that_loses_a_class_takes_it_whole(spark):
    rows = [(i, int(i == 0), [float(i), 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>")
    model = RebalancedBaggingClassifier(keyCols=["id"], resampling="rus", numResamples=12, maxDepth=2).fit(df)
    assert len(model.trees) == 12


def test_boosting_without_resampling_equals_spark(table):
    ours = RebalancedGBTClassifier(keyCols=["id"], resampling="none", maxIter=7, maxDepth=3, checkpointInterval=3).fit(table)
    spark_gbt = GBTClassifier(maxIter=7, maxDepth=3, stepSize=0.1, seed=1).fit(table)
    assert np.allclose(raw(ours, table), raw(spark_gbt, table), atol=1e-12)


@pytest.mark.parametrize("how", ["rus", "ros", "balance"])
@pytest.mark.parametrize("on", ["class", "residual"])
def test_rebalanced_boosting_trains(table, how, on):
    model = RebalancedGBTClassifier(keyCols=["id"], resampling=how, balanceOn=on, maxIter=3, maxDepth=3, stepSize=0.5).fit(table)
    assert list(model.treeWeights) == [1.0, 0.5, 0.5]


def test_boosting_on_classes_raises_recall(table):
    plain = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.5).fit(table)
    rus = RebalancedGBTClassifier(keyCols=["id"], resampling="rus", maxIter=8, maxDepth=3, stepSize=0.5).fit(table)
    assert recall(rus, table) > recall(plain, table)


def test_early_stopping_keeps_the_best_trees(table, tmp_path):
    df = table.withColumn("held", F.col("id") % 3 == 0)
    common = dict(keyCols=["id"], resampling="none", maxIter=12, maxDepth=3, stepSize=0.5)
    model = RebalancedGBTClassifier(**common, validationIndicatorCol="held", validationTol=0.05).fit(df)
    full = RebalancedGBTClassifier(**common).fit(df.filter("not held"))
    assert 1 <= len(model.trees) < 12
    assert np.allclose(raw(model, df), raw(_prefix(full, len(model.trees)), df))
    model.write().overwrite().save(str(tmp_path / "gbt"))
    assert len(GBTClassificationModel.load(str(tmp_path / "gbt")).trees) == len(model.trees)


def _prefix(model, n):
    from equipoise.operators.assemble import boosted_classifier

    return boosted_classifier(model.trees[:n], list(model.treeWeights)[:n]).setFeaturesCol("features")


def test_weights_and_column_subsets(table):
    df = table.withColumn("w", F.when(F.col("label") == 1, 5.0).otherwise(1.0))
    model = RebalancedGBTClassifier(
        keyCols=["id"], resampling="rus", maxIter=3, weightCol="w", featureSubsetStrategy="sqrt", subsamplingRate=0.7
    ).fit(df)
    assert len(model.trees) == 3


def test_iteration_losses(table):
    model = RebalancedGBTClassifier(keyCols=["id"], resampling="rus", maxIter=4, maxDepth=3).fit(table)
    scored = table.withColumn("y", signed_label(F.col("label")))
    for i, tree in enumerate(model.trees):
        scored = tree.setFeaturesCol("features").setPredictionCol(f"t{i}").transform(scored)
    scored = scored.withColumn("trees", F.array(*[f"t{i}" for i in range(4)]))
    got = [r["error"] for r in evaluate_each_iteration(scored, "y", "trees", list(model.treeWeights)).orderBy("iteration").collect()]
    assert np.allclose(got, model.evaluateEachIteration(table.withColumn("label", F.col("label").cast("double"))))


def test_log_loss_does_not_overflow(spark):
    row = spark.range(1).select(log_loss(F.lit(-1.0), F.lit(5000.0)).alias("a"), log_loss(F.lit(1.0), F.lit(5000.0)).alias("b")).first()
    assert row["a"] == 20000.0 and row["b"] == 0.0


def test_bad_labels(spark, table):
    with pytest.raises(ValueError, match="0 and 1"):
        RebalancedGBTClassifier(keyCols=["id"]).fit(table.withColumn("label", F.col("label") + 1))
    with pytest.raises(ValueError, match="two classes"):
        RebalancedBaggingClassifier(keyCols=["id"], numResamples=1).fit(table.filter("label = 1"))


def test_any_resampler_inside_bagging(blobs):
    from equipoise.functions.vectors import as_vector
    from equipoise.operators.synth import smote

    df = blobs.withColumn("features", as_vector(blobs, "features"))
    seen = []

    def grow(boot, seed):
        keyed = boot.withColumn("label", F.col("label").cast("int"))
        out = smote(keyed, ["id", "_copy"], seed=seed, perc_over=0)
        seen.append({r["label"]: r["count"] for r in out.groupBy("label").count().collect()})
        return out.withColumn("label", F.col("label").cast("double"))

    bagging = RebalancedBaggingClassifier(keyCols=["id"], numResamples=2, maxDepth=3, seed=1).setResampler(grow)
    model = bagging.fit(df)
    assert model.getNumTrees == 2 and all(0.9 < n[1] / n[0] < 1.1 for n in seen)


def test_models_do_not_follow_the_number_of_cores(spark, blobs):
    models = []
    for n in (2, 7):
        table = blobs.repartition(n)
        models.append(RebalancedBaggingClassifier(keyCols=["id"], numResamples=3, maxDepth=4, seed=5, partitions=4).fit(table).toDebugString)
    strip = lambda text: text.split("\n", 1)[1]
    assert strip(models[0]) == strip(models[1])


def scores(model, df):
    rows = model.transform(df).select("id", vector_to_array("rawPrediction").alias("r"), vector_to_array("probability").alias("p"), "prediction").orderBy("id").collect()
    return np.array([[*r["r"], *r["p"], r["prediction"]] for r in rows])


def test_plain_forest_scores_as_the_assembled_one(table, tmp_path):
    base = dict(keyCols=["id"], numResamples=4, numTrees=2, maxDepth=3, seed=5, partitions=2)
    assembled, plain = (RebalancedBaggingClassifier(**base, plain=p).fit(table) for p in (False, True))
    part = table.filter("id % 13 = 0").withColumn("other", F.lit("kept"))
    assert isinstance(plain, SummedModel) and len(plain.trees) == 8
    assert np.allclose(scores(plain, part), scores(assembled, part), atol=1e-12)
    assert set(plain.transform(part).columns) == {*part.columns, "rawPrediction", "probability", "prediction"}
    plain.write().overwrite().save(str(tmp_path / "plain"))
    again = SummedModel.load(str(tmp_path / "plain"))
    assert again.uid == plain.uid and np.allclose(scores(again, part), scores(plain, part), atol=0)


@pytest.mark.parametrize("interval", [2, 10])
def test_plain_boosting_scores_as_the_assembled_one(table, tmp_path, interval):
    base = dict(keyCols=["id"], resampling="rus", maxIter=5, maxDepth=3, seed=2, checkpointInterval=interval, partitions=2)
    assembled, plain = (RebalancedGBTClassifier(**base, plain=p).fit(table) for p in (False, True))
    part = table.filter("id % 13 = 0")
    assert np.allclose(scores(plain, part), scores(assembled, part), atol=1e-9)
    assert plain.treeWeights == list(assembled.treeWeights)
    plain.write().save(str(tmp_path / "plain"))
    assert np.allclose(scores(SummedModel.load(str(tmp_path / "plain")), part), scores(plain, part), atol=0)


def test_a_resampler_function_is_not_lost_in_silence(table, tmp_path):
    learner = RebalancedBaggingClassifier(keyCols=["id"], numResamples=1).setResampler(lambda df, seed: df)
    with pytest.raises(ValueError, match="resampler"):
        learner.write().save(str(tmp_path / "learner"))
    learner.setResampler(None).write().save(str(tmp_path / "learner"))


def test_losses_of_many_trees(spark):
    rng = np.random.default_rng(3)
    steps, y, w = rng.normal(0, 1, (40, 500)), rng.choice([-1.0, 1.0], 40), rng.uniform(0.5, 2, 40)
    weights = [1.0] + [0.1] * 499
    rows = [(float(a), float(b), [float(x) for x in s]) for a, b, s in zip(y, w, steps, strict=True)]
    df = spark.createDataFrame(rows, "y double, w double, trees array<double>").repartition(3)
    got = [r["error"] for r in evaluate_each_iteration(df, "y", "trees", weights, "w").orderBy("iteration").collect()]
    margin = np.cumsum(steps * weights, 1)
    want = (w[:, None] * 2 * np.logaddexp(0, -2 * y[:, None] * margin)).sum(0) / w.sum()
    assert len(got) == 500 and np.allclose(got, want)
