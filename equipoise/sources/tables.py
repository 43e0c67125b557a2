"""Reading labelled tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.operators.profile import label_index
from equipoise.sources.session import checkpoint


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """(label, features) from libsvm text, labels re-indexed 0, 1, … by descending frequency.

    Give ``num_features`` for large inputs; without it Spark reads the text once more to find it.
    """
    reader = spark.read.format("libsvm")
    if num_features:
        reader = reader.option("numFeatures", num_features)
    raw = reader.load(path).withColumnRenamed("label", "_raw_label")
    indexed, _ = label_index(raw, "_raw_label", "label")
    return indexed.select("label", "features")


def read_table(
    spark: SparkSession,
    path: str,
    key: Sequence[str],
    label: Column,
    features: Mapping[str, Column] | str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key…, label, features) from parquet.

    ``features`` is an array/vector column name or named numeric expressions packed into one array.
    Only the columns used reach the scan.
    """
    values = F.col(features) if isinstance(features, str) else F.array(*[c.cast("double") for c in features.values()])
    return spark.read.parquet(path).select(*key, label.alias("label"), values.alias("features"), *carry)


def with_row_key(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Give a table without a unique key one; materialised, so that the ids stay the same on recomputation."""
    return checkpoint(df.withColumn(out, F.monotonically_increasing_id()))
