"""Feature columns: a VectorUDT column, an array column, or a list of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Features = str | Sequence[str]


def as_array(df: DataFrame, features: Features) -> Column:
    """The features as one ``array<double>`` expression."""
    if not isinstance(features, str):
        return F.array(*[F.col(c).cast("double") for c in features])
    if isinstance(df.schema[features].dataType, VectorUDT):
        return vector_to_array(F.col(features))
    return F.col(features).cast("array<double>")


def as_vector(df: DataFrame, features: Features) -> Column:
    """The features as one ML vector expression."""
    if isinstance(features, str) and isinstance(df.schema[features].dataType, VectorUDT):
        return F.col(features)
    return array_to_vector(as_array(df, features))


def dimension(df: DataFrame, features: Features) -> int:
    """Number of features: from the column list, the metadata, or one row."""
    if not isinstance(features, str):
        return len(features)
    meta = df.schema[features].metadata or {}
    size = meta.get("ml_attr", {}).get("num_attrs") or meta.get("numFeatures")
    if size:
        return int(size)
    row = df.select(F.size(as_array(df, features)).alias("d")).first()
    if row is None:
        raise ValueError("the table is empty")
    return int(row["d"])


def with_array(df: DataFrame, features: Features, values: Column) -> DataFrame:
    """Write an ``array<double>`` back in the shape the features came in."""
    if not isinstance(features, str):
        d = len(features)
        out = df.withColumn("_values", values)
        casts = {
            c: F.col("_values")[j].cast(_numeric_target(df, c)) for j, c in zip(range(d), features, strict=True)
        }
        return out.withColumns(casts).drop("_values")
    if isinstance(df.schema[features].dataType, VectorUDT):
        return df.withColumn(features, array_to_vector(values))
    return df.withColumn(features, values.cast(df.schema[features].dataType))


def _numeric_target(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType.simpleString()
    return kind if kind in ("double", "float") else "double"


def euclidean_distance(a: Column, b: Column) -> Column:
    """L2 distance between two array columns."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def min_max(df: DataFrame, features: Features) -> tuple[list[float], list[float]]:
    """Per-feature minimum and maximum, ignoring NaN (one partially aggregated pass)."""
    row = df.select(as_vector(df, features).alias("v")).agg(
        Summarizer.metrics("min", "max").summary(F.col("v")).alias("s")
    ).select("s.min", "s.max").first()
    return [float(x) for x in row["min"]], [float(x) for x in row["max"]]


def standard_deviation(df: DataFrame, features: Features) -> list[float]:
    """Per-feature sample standard deviation."""
    row = df.select(as_vector(df, features).alias("v")).agg(Summarizer.variance(F.col("v")).alias("s")).first()
    return [float(x) ** 0.5 for x in row["s"]]


def scale_array(values: Column, low: list[float], high: list[float]) -> Column:
    """Map each feature to [0, 1]; a constant feature becomes 0.5, NaN stays NaN."""
    lo, hi = F.lit(low), F.lit(high)

    def one(x: Column, j: Column) -> Column:
        a, b = F.get(lo, j), F.get(hi, j)
        return F.when(F.isnan(x), x).when(b == a, F.lit(0.5)).otherwise((x - a) / (b - a))

    return F.transform(values, one)


def unscale_array(values: Column, low: list[float], high: list[float]) -> Column:
    """Inverse of :func:`scale_array`; a constant feature becomes its minimum."""
    lo, hi = F.lit(low), F.lit(high)

    def one(x: Column, j: Column) -> Column:
        a, b = F.get(lo, j), F.get(hi, j)
        return F.when(F.isnan(x), x).when(b == a, a).otherwise(x * (b - a) + a)

    return F.transform(values, one)


def min_max_scale(df: DataFrame, features: Features, bounds: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Scale the features in place; ``bounds`` come from :func:`min_max` of the training part."""
    low, high = bounds or min_max(df, features)
    return with_array(df, features, scale_array(as_array(df, features), low, high))


def min_max_unscale(df: DataFrame, features: Features, bounds: tuple[list[float], list[float]]) -> DataFrame:
    return with_array(df, features, unscale_array(as_array(df, features), *bounds))


def feature_summary(df: DataFrame, features: Features) -> DataFrame:
    """(j, low, high, sd) per feature, from one partially aggregated pass."""
    stats = df.select(as_vector(df, features).alias("v")).agg(
        Summarizer.metrics("min", "max", "variance").summary(F.col("v")).alias("s")
    )
    parts = F.arrays_zip(
        vector_to_array("s.min").alias("low"), vector_to_array("s.max").alias("high"), vector_to_array("s.variance").alias("var")
    )
    return stats.select(F.posexplode(parts).alias("j", "f")).select(
        "j", F.col("f.low").alias("low"), F.col("f.high").alias("high"), F.sqrt("f.var").alias("sd")
    )
