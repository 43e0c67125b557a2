"""Whole-table helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from equipoise.functions.randomness import uniform


def union_with_missing_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; columns absent on one side are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows in a random order that depends on the key and the seed only (a range-partitioned sort)."""
    return df.orderBy(uniform(key, seed, "shuffle"), *key)
