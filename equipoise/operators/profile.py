"""Class counts and what follows from them: weights and label indexes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, count), one row per class."""
    return df.groupBy(label).count()


@dataclass(frozen=True)
class ClassProfile:
    """The rarest and the most frequent class (equal sizes are ordered by label), and what all classes sum up to."""

    classes: tuple[tuple[Any, int], ...]
    size: int
    count: int

    @property
    def minority(self) -> Any:
        return self.classes[0][0]

    @property
    def majority(self) -> Any:
        return self.classes[-1][0]

    @property
    def minority_size(self) -> int:
        return self.classes[0][1]

    @property
    def majority_size(self) -> int:
        return self.classes[-1][1]

    @classmethod
    def of(cls, sizes: Iterable[tuple[Any, int]]) -> ClassProfile:
        """From (class, rows) of every class."""
        ordered = sorted(sizes, key=lambda c: (c[1], c[0]))
        return cls(tuple(dict.fromkeys((ordered[0], ordered[-1]))), sum(n for _, n in ordered), len(ordered))

    def require_binary(self, what: str) -> ClassProfile:
        if self.count != 2:
            raise ValueError(f"{what} needs exactly two classes, found {self.count}")
        return self


def class_profile(df: DataFrame, label: str) -> ClassProfile:
    """The two ends of the class sizes; one row reaches the driver, however many classes there are."""
    cells = class_counts(df, label).select(F.col(label).isNull().alias("lost"), "count", F.struct("count", label).alias("c"))
    ends = F.min("c").alias("low"), F.max("c").alias("high")
    r = cells.agg(*ends, F.sum("count").alias("size"), F.count("*").alias("classes"), F.max("lost").alias("lost")).first()
    if not r["classes"]:
        raise ValueError("the table is empty")
    if r["lost"]:
        raise ValueError(f"{label!r} has null labels")
    found = [(r[end][label], int(r[end]["count"])) for end in ("low", "high")]
    return ClassProfile(tuple(dict.fromkeys(found)), int(r["size"]), int(r["classes"]))


def by_class(label: str, values: dict[Any, Column | float], default: Column | float) -> Column:
    """A per-class value as one ``CASE`` expression."""
    out = None
    for cls, value in values.items():
        cond = F.col(label) == F.lit(cls)
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def class_weights(df: DataFrame, label: str, weight: str = "weight", profile: ClassProfile | None = None) -> DataFrame:
    """Add ``weight = (N / 2) / n_class``, so both classes weigh the same in total."""
    profile = (profile or class_profile(df, label)).require_binary("class weighting")
    half = profile.size / 2.0
    return df.withColumn(weight, by_class(label, {c: half / n for c, n in profile.classes}, float("nan")))


def label_index(df: DataFrame, label: str, out: str = "label_index") -> tuple[DataFrame, StringIndexerModel]:
    """Index labels 0, 1, … by descending frequency (ties alphabetically)."""
    model = StringIndexer(inputCol=label, outputCol=out, stringOrderType="frequencyDesc").fit(df)
    return model.transform(df), model


def label_decode(df: DataFrame, index: str, labels: list[str], out: str) -> DataFrame:
    """Index back to the original label text."""
    return IndexToString(inputCol=index, outputCol=out, labels=labels).transform(df)
