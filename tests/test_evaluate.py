import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from equipoise.functions.vectors import as_vector
from equipoise.operators.boost import RebalancedGBTClassifier
from equipoise.operators.ensemble import RebalancedBaggingClassifier
from equipoise.operators.stages import NoResampler, RandomBalancer, RandomOversampler, RandomUndersampler, Rose, Smote
from equipoise.plans.algorithms import experiment, grid
from equipoise.plans.evaluate import Experiment, experiment_summary, kfold_assign, repeated_cv, run_name, stratified_folds
from equipoise.sources.sinks import finished_runs
from equipoise.sources.tables import read_libsvm, with_row_key


def test_folds_partition_the_rows(blobs):
    df = kfold_assign(blobs, ["id"], 4, repetitions=2, seed=1)
    sizes = [r["count"] for r in df.groupBy("fold_1").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 3400 and max(sizes) - min(sizes) < 200
    assert 0.15 < df.filter("fold_1 = fold_2").count() / 3400 < 0.35


def test_stratified_folds_hold_classes_in_equal_parts(blobs):
    df = stratified_folds(blobs, ["id"], 7, repetitions=2, seed=1)
    for r in (1, 2):
        sizes = {(x["label"], x[f"fold_{r}"]): x["count"] for x in df.groupBy("label", f"fold_{r}").count().collect()}
        for label, rows in ((1, 200), (0, 3200)):
            mine = [sizes[label, f] for f in range(1, 8)]
            assert sum(mine) == rows and max(mine) - min(mine) <= 1
    assert df.count() == 3400 and 0.05 < df.filter("fold_1 = fold_2").count() / 3400 < 0.25


def test_stratified_runs(spark, blobs, rule, tmp_path):
    few = blobs.filter("id < 6 OR id >= 3300")  # six rare rows: a plain split may well leave a fold without any
    done = repeated_cv(few, rule, str(tmp_path), ["id"], repetitions=1, folds=3, seed=3, stratified=True)
    counts = {(r["fold"], r["true"]): r["count"] for r in done.groupBy("fold", "true").count().collect()}
    assert [counts[f, "1"] for f in (1, 2, 3)] == [2, 2, 2] and sum(counts.values()) == 106
    plain, dealt = (run_name("d", rule, ["id"], "label", "features", 3, 3, "fold", s) for s in (False, True))
    assert plain != dealt and plain == run_name("d", rule, ["id"], "label", "features", 3, 3, "fold")


@pytest.fixture
def rule():
    return Experiment("none_rf", lambda seed: RandomForestClassifier(labelCol="label_index", numTrees=2, maxDepth=3, seed=seed))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_cv_resumes(spark, blobs, rule, tmp_path, fmt):
    named = blobs.withColumn("label", F.when(F.col("label") == 1, "rare").otherwise("usual"))
    out = str(tmp_path / "runs")
    done = repeated_cv(named, rule, out, ["id"], repetitions=1, folds=2, seed=3, fmt=fmt)
    first = experiment_summary(done, "rare").orderBy("fold").collect()
    assert sum(r["tp"] + r["tn"] + r["fp"] + r["fn"] for r in first) == 3400
    assert all(r["train_time"] > 0 and r["predict_time"] > 0 for r in first)
    again = repeated_cv(named, rule, out, ["id"], repetitions=2, folds=2, seed=3, fmt=fmt)
    summary = experiment_summary(again, "rare").orderBy("repetition", "fold").collect()
    assert summary[:2] == first and len(summary) == 4
    name = run_name("dataset", rule, ["id"], "label", "features", 2, 3, "fold")
    assert finished_runs(spark, f"{out}/{name}", fmt) == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_experiments_in_one_folder_do_not_mix(blobs, rule, tmp_path):
    other = Experiment("none_rf2", lambda seed: RandomForestClassifier(labelCol="label_index", numTrees=1, maxDepth=1, seed=seed))
    out = str(tmp_path / "runs")

    def runs(experiment, **how):
        done = repeated_cv(blobs, experiment, out, ["id"], repetitions=1, **how)
        return done.groupBy("algorithm", "repetition").count().collect()

    for experiment, how in [(rule, {}), (other, {"seed": 4}), (rule, {"seed": 4}), (other, {"folds": 3}), (rule, {"folds": 3, "seed": 4}), (rule, {})]:
        assert [tuple(r) for r in runs(experiment, **how)] == [(experiment.name, 1, 3400)]


def test_training_part_without_a_class_is_refused(spark, rule, tmp_path):
    df = spark.createDataFrame([(i, int(i == 0), [float(i)]) for i in range(40)], "id long, label int, features array<double>")
    with pytest.raises(ValueError, match="lacks a class"):
        repeated_cv(df, rule, str(tmp_path / "runs"), ["id"], repetitions=1, folds=2)


@pytest.mark.parametrize("scale", ["global", None])
def test_resubstitution(blobs, rule, tmp_path, scale):
    done = repeated_cv(blobs, rule, str(tmp_path / "all"), ["id"], repetitions=1, folds=1, scale=scale)
    assert done.count() == 3400


@pytest.mark.parametrize("name", ["ros_wrf", "smote_gbt", "rose_bag", "imbbag_ranbal", "imbgbt_ros"])
def test_grid_members_run(blobs, tmp_path, name):
    done = repeated_cv(blobs, experiment(name, ["id"], size=2, depth=3), str(tmp_path / name), ["id"], repetitions=1, folds=2)
    row = experiment_summary(done, "1").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn")).first()
    assert row["tp"] + row["fn"] == 200


def test_grid_names():
    assert len(grid()) == 36
    for name in grid():
        assert experiment(name, ["id"]).name == name
    with pytest.raises(ValueError, match="unknown"):
        experiment("smote_imbbag", ["id"])


@pytest.mark.parametrize(
    "stage",
    [
        NoResampler(keyCols=["id"]),
        RandomUndersampler(keyCols=["id"], percUnder=20.0, seed=4),
        RandomOversampler(keyCols=["id"], percOver=300.0, mode="exact"),
        RandomBalancer(keyCols=["id"], seed=8),
        Smote(keyCols=["id"], percOver=50.0, k=3),
        Rose(keyCols=["id"], keepOrigSamples=True),
    ],
    ids=lambda s: type(s).__name__,
)
def test_stages_save_and_load(blobs, tmp_path, stage):
    stage.write().overwrite().save(str(tmp_path / "stage"))
    back = type(stage).load(str(tmp_path / "stage"))
    assert stage.transform(blobs).exceptAll(back.transform(blobs)).count() == 0
    assert stage.transform(blobs).columns == blobs.columns


@pytest.mark.parametrize("kind", [RebalancedBaggingClassifier, RebalancedGBTClassifier])
def test_estimators_save_and_load(tmp_path, kind):
    stage = kind(keyCols=["id"], resampling="ros", maxDepth=2, seed=3)
    stage.write().overwrite().save(str(tmp_path / "e"))
    back = kind.load(str(tmp_path / "e"))
    assert back.extractParamMap().keys() == stage.extractParamMap().keys() and back.value("resampling") == "ros"


def test_smote_needs_three_neighbours():
    with pytest.raises(TypeError, match="at least 3"):
        Smote(keyCols=["id"], k=2)


def test_libsvm(spark, blobs, tmp_path):
    df = blobs.select((F.col("label") * 5.0 + 1).alias("label"), as_vector(blobs, "features").alias("features"))
    df.write.format("libsvm").save(str(tmp_path / "data"))
    back = read_libsvm(spark, str(tmp_path / "data"), 2)
    counts = {r["label"]: r["count"] for r in back.groupBy("label").count().collect()}
    assert counts == {0.0: 3200, 1.0: 200} and back.columns == ["label", "features"]
    keyed = with_row_key(back)
    assert keyed.select("row_id").distinct().count() == 3400
