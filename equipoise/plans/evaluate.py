"""Repeated k-fold evaluation: folds, runs, confusion counts, summary."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.functions.randomness import derive_seed, uniform
from equipoise.functions.vectors import Features, as_vector, min_max, min_max_scale
from equipoise.operators.profile import class_profile, class_weights, label_decode, label_index
from equipoise.operators.sampling import class_places
from equipoise.sources.sinks import finished_runs, read_predictions, write_fold_predictions

Resampler = Transformer | Callable[[DataFrame], DataFrame] | None


def fold_of(key: Sequence[str], folds: int, seed: int, repetition: int) -> Column:
    """Fold 1 … ``folds`` of a row; a function of its key, so no shuffle and no stored split."""
    return (F.lit(1) + F.floor(uniform(key, seed, f"fold{repetition}") * folds)).cast("int")


def kfold_assign(df: DataFrame, key: Sequence[str], folds: int, repetitions: int = 1, seed: int = 0) -> DataFrame:
    """Add ``fold_1`` … ``fold_<repetitions>``."""
    return df.withColumns({f"fold_{r}": fold_of(key, folds, seed, r) for r in range(1, repetitions + 1)})


def stratified_folds(
    df: DataFrame, key: Sequence[str], folds: int, label: str = "label", repetitions: int = 1, seed: int = 0
) -> DataFrame:
    """Add ``fold_1`` … ``fold_<repetitions>``: in each, the rows of a class in the order of their draws go to the folds
    in turn, so the folds of a class differ by one row at most.  A null label is a class."""
    for r in range(1, repetitions + 1):
        df = class_places(df, label, key, seed, f"fold{r}", "_place")
        df = df.withColumn(f"fold_{r}", (F.lit(1) + F.col("_place") % folds).cast("int")).drop("_place")
    return df


def _confusion(true: str, predicted: str, positive: object) -> list[Column]:
    actual, guess = F.col(true) == F.lit(positive), F.col(predicted) == F.lit(positive)
    cells = {"tp": actual & guess, "tn": ~actual & ~guess, "fp": ~actual & guess, "fn": actual & ~guess}
    return [F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(name) for name, cond in cells.items()]


def confusion_counts(
    predictions: DataFrame,
    positive: object,
    by: Sequence[str] = ("dataset", "algorithm", "repetition", "fold"),
    true: str = "true",
    predicted: str = "predicted",
) -> DataFrame:
    """tp, tn, fp, fn per group, in one partially aggregated pass."""
    return predictions.groupBy(*by).agg(*_confusion(true, predicted, positive))


def experiment_summary(predictions: DataFrame, positive: object) -> DataFrame:
    """dataset, algorithm, repetition, fold, tp, tn, fp, fn, train_time, predict_time (nanoseconds)."""
    return predictions.groupBy("dataset", "algorithm", "repetition", "fold").agg(
        *_confusion("true", "predicted", positive),
        F.max("train_time").alias("train_time"),
        F.max("prediction_time").alias("predict_time"),
    )


@dataclass
class Experiment:
    """What to run: ``resample`` acts on each training part (None: the classifier rebalances inside)."""

    name: str
    classifier: Callable[[int], Estimator]
    resample: Callable[[int], Resampler] = field(default=lambda seed: None)
    weighted: bool = False


def _apply(resampler: Resampler, df: DataFrame) -> DataFrame:
    if resampler is None:
        return df
    return resampler.transform(df) if isinstance(resampler, Transformer) else resampler(df)


def _run(
    experiment: Experiment, train: DataFrame, test: DataFrame, scale: str | None, seed: int
) -> tuple[DataFrame, int, int]:
    """Predictions (true, predicted) of one fold with its training and per-row prediction nanoseconds.

    The predictions come back cached; the caller unpersists them.
    """
    if scale == "fold":
        bounds = min_max(train, "features")
        train, test = min_max_scale(train, "features", bounds), min_max_scale(test, "features", bounds)
    if experiment.weighted:
        train = class_weights(train, "label", "weight")
    train_rows, test = train.persist(), test.persist()  # the clocks start with both parts in place
    try:
        train_rows.count()
        test.count()
        started = time.perf_counter_ns()
        indexed, indexer = label_index(train_rows, "label", "label_index")
        sample = _apply(experiment.resample(seed), indexed).persist()  # learners pass over it several times
        try:
            model = experiment.classifier(seed).fit(sample)
        finally:
            sample.unpersist()
        train_time = time.perf_counter_ns() - started
        started = time.perf_counter_ns()
        scored = label_decode(model.transform(test), "prediction", indexer.labels, "predicted")
        scored = scored.select(F.col("label").cast("string").alias("true"), "predicted").persist()
        rows = scored.count()
        per_row = (time.perf_counter_ns() - started) // max(1, rows)
    finally:
        train_rows.unpersist()
        test.unpersist()
    return scored, train_time, per_row


def run_name(
    dataset: str, experiment: Experiment, key: Sequence[str], label: str, features: Features, folds: int, seed: int, scale: str | None,
    stratified: bool = False,
) -> str:
    """Folder of an experiment's runs: readable names and a digest of everything that changes a run."""
    parts = [dataset, experiment.name, experiment.weighted, list(key), label, features if isinstance(features, str) else list(features)]
    digest = hashlib.md5(repr([*parts, folds, type(seed).__name__, int(seed), scale, *(["stratified"] if stratified else [])]).encode()).hexdigest()[:16]
    return "-".join([*(re.sub(r"[^A-Za-z0-9_.]", "_", x) for x in (dataset, experiment.name)), digest])


def _check_folds(rows: DataFrame, fold: Callable[[int], Column], folds: int, repetitions: Sequence[int]) -> None:
    """Every training part has both classes: one count by fold and class for all repetitions."""
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), fold(r).alias("f")) for r in repetitions]))
    counts = rows.select("label", runs.alias("run")).groupBy("run.r", "run.f", "label").count().collect()  # runs x two classes
    for r in repetitions:
        for f in range(1, folds + 1):
            if len({c["label"] for c in counts if c["r"] == r and c["f"] != f}) < 2:
                raise ValueError(f"the training part of repetition {r}, fold {f} lacks a class: take fewer folds or another seed")


def repeated_cv(
    df: DataFrame,
    experiment: Experiment,
    out: str,
    key: Sequence[str],
    label: str = "label",
    features: Features = "features",
    dataset: str = "dataset",
    repetitions: int = 5,
    folds: int = 2,
    seed: int = 0,
    scale: str | None = "fold",
    resume: bool = True,
    fmt: str = "parquet",
    files: int | None = None,
    stratified: bool = False,
) -> DataFrame:
    """Repeated k-fold evaluation; every finished (repetition, fold) is written under ``out``, below a folder named by
    :func:`run_name` after the data set, the algorithm and all that changes its runs.

    Runs of the same experiment already written in full are skipped, so an interrupted job continues where it stopped;
    other experiments under ``out`` are neither skipped for nor returned.  Give ``dataset`` another name for other rows.
    A training part that lacks a class is refused before anything is trained.
    ``folds=1`` trains and tests on everything.  ``scale`` fits the min-max scaling on each training part
    (``"fold"``), once on the whole table (``"global"``), or not at all (None).
    ``files`` sets the number of files per run; by default Spark's partitions decide.
    ``stratified`` deals each class to the folds in turn (:func:`stratified_folds`).
    Returns the predictions of the runs asked for, read back from ``out``.
    """
    if repetitions < 1 or folds < 1:
        raise ValueError("repetitions and folds must be positive")
    if scale not in ("fold", "global", None):
        raise ValueError(f"unknown scale {scale!r}")
    spark = df.sparkSession
    rows = df.select(*key, F.col(label).alias("label"), as_vector(df, features).alias("features"))
    if scale == "global":
        rows = min_max_scale(rows, "features")
    class_profile(rows, "label").require_binary("an experiment")
    out = f"{out}/{run_name(dataset, experiment, key, label, features, folds, seed, scale, stratified)}"
    done = finished_runs(spark, out, fmt) if resume else set()
    asked = [(r, f) for r in range(1, repetitions + 1) for f in range(1, folds + 1)]
    pending = [run for run in asked if run not in done]
    place = (lambda r: F.col(f"fold_{r}")) if stratified else (lambda r: fold_of(key, folds, seed, r))
    dealt = stratified_folds(rows, key, folds, "label", repetitions, seed) if stratified and pending and folds > 1 else rows
    rows = dealt.persist() if pending else rows
    extra = [c for c in rows.columns if c.startswith("fold_") and c not in key]
    try:
        if pending and folds > 1:
            _check_folds(rows, place, folds, sorted({r for r, _ in pending}))
        for repetition, fold in pending:
            in_test = place(repetition) == fold if folds > 1 else F.lit(True)
            train = rows.filter(~in_test).drop(*extra) if folds > 1 else rows
            test = rows.filter(in_test).drop(*extra) if folds > 1 else rows
            scored, train_time, per_row = _run(experiment, train, test, scale, derive_seed(seed, repetition, fold))
            stamped = scored.select(
                F.lit(dataset).alias("dataset"),
                F.lit(experiment.name).alias("algorithm"),
                "true",
                "predicted",
                F.lit(train_time).cast("bigint").alias("train_time"),
                F.lit(per_row).cast("bigint").alias("prediction_time"),
            )
            write_fold_predictions(stamped, out, repetition, fold, fmt, files)
            scored.unpersist()
    finally:
        rows.unpersist()
    return read_predictions(spark, out, fmt, asked)
