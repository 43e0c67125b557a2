"""Prediction sinks: one folder per (repetition, fold), resumable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

PREDICTIONS = (
    "dataset string, algorithm string, repetition int, fold int, true string, predicted string, "
    "train_time bigint, prediction_time bigint"
)


def write_fold_predictions(
    df: DataFrame, out: str, repetition: int, fold: int, fmt: str = "parquet", files: int | None = None
) -> None:
    """Write one run, optionally as a fixed number of files; writing it again replaces it."""
    df = df.repartition(files) if files else df
    path = f"{out}/repetition={repetition}/fold={fold}"
    df.drop("repetition", "fold").write.mode("overwrite").format(fmt).save(path)


def write_all_predictions(df: DataFrame, out: str, fmt: str = "parquet") -> None:
    """All runs in one table, partitioned by (repetition, fold)."""
    df.write.mode("overwrite").partitionBy("repetition", "fold").format(fmt).save(out)


def read_predictions(spark: SparkSession, out: str, fmt: str = "parquet", runs: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """All predictions under ``out``, or those of the given (repetition, fold) pairs."""
    names = [c.split()[0] for c in PREDICTIONS.split(", ")]
    paths = [f"{out}/repetition={r}/fold={f}" for r, f in runs] or out
    return spark.read.schema(PREDICTIONS).format(fmt).option("basePath", out).load(paths).select(*names)


def finished_runs(spark: SparkSession, out: str, fmt: str = "parquet") -> set[tuple[int, int]]:
    """(repetition, fold) pairs already written in full: those whose folder carries Spark's commit marker."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/repetition=*/fold=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    runs = set()
    for status in found:
        fold_dir = status.getPath().getParent()
        runs.add((int(fold_dir.getParent().getName().split("=")[1]), int(fold_dir.getName().split("=")[1])))
    return runs

