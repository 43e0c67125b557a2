"""Random under-sampling, over-sampling and random balance.

Each is one pass over the table: the class sizes decide a rate per class and a
``CASE`` on the label applies it, so there are no per-class scans and no union.

``mode="hash"`` draws row by row (sizes are expectations, as with Spark's own
samplers); ``mode="exact"`` hits the target sizes exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.functions.randomness import driver_uniform, poisson, uniform
from equipoise.operators.profile import ClassProfile, class_profile
from equipoise.operators.sampling import balanced_fraction, exact_cutoff, per_growth, repeat_rows, whole_copies


def no_resample(df: DataFrame) -> DataFrame:
    return df


def _check_mode(mode: str) -> None:
    if mode not in ("hash", "exact"):
        raise ValueError(f"unknown mode {mode!r}")


def random_undersample(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    seed: int = 0,
    perc_under: float = 50,
    mode: str = "hash",
    profile: ClassProfile | None = None,
) -> DataFrame:
    """Keep ``perc_under`` per cent of the most frequent class; 0 cuts it to the rarest class's size."""
    _check_mode(mode)
    if perc_under > 100:
        raise ValueError("perc_under is the percentage kept, at most 100")
    p = profile or class_profile(df, label)
    fraction = balanced_fraction(p.minority_size, p.majority_size, perc_under)
    majority = F.col(label) == F.lit(p.majority)
    if mode == "exact":
        kept = p.minority_size if perc_under == 0 else math.floor(p.majority_size * fraction)
        return df.filter(~majority | exact_cutoff(df.filter(majority), kept, key, seed, "under", p.majority_size))
    return df.filter(~majority | (uniform(key, seed, "under") < fraction))


def random_oversample(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    seed: int = 0,
    perc_over: float = 100,
    mode: str = "hash",
    copy_col: str | None = None,
    profile: ClassProfile | None = None,
) -> DataFrame:
    """Add ``perc_over`` per cent copies of the rarest class; 0 grows it to the most frequent class's size.

    Copy 0 is the original row, copies 1, 2, … are the repeats.
    """
    _check_mode(mode)
    p = profile or class_profile(df, label)
    minority = F.col(label) == F.lit(p.minority)
    rate = balanced_fraction(p.majority_size - p.minority_size, p.minority_size, perc_over)
    if mode == "exact":
        total = p.majority_size - p.minority_size if perc_over == 0 else math.floor(p.minority_size * rate)
        each, rest = whole_copies(total, p.minority_size)
        extra = F.lit(each) + exact_cutoff(df.filter(minority), rest, key, seed, "over", p.minority_size).cast("int")
    else:
        extra = poisson(F.col("_u"), rate)
    # Only rows of the rarest class unfold; the others pass through a filter.
    part = df.filter(minority)
    drawn = part.withColumn("_u", uniform(key, seed, "over")) if mode == "hash" else part
    grown = repeat_rows(drawn, F.lit(1) + extra, copy_col, 0, key, rate).drop("_u")
    rest = df.filter(~minority)
    return (rest.withColumn(copy_col, F.lit(0)) if copy_col else rest).unionByName(grown)


def random_balance_sizes(p: ClassProfile, seed: int) -> tuple[int, int]:
    """New (minority, majority) sizes: the majority uniform on 2 … N-2, the total unchanged."""
    if p.size < 4:
        raise ValueError("random balance needs at least 4 rows")
    majority = 2 + math.floor(driver_uniform(seed, "balance") * (p.size - 3))
    return p.size - majority, majority


def random_balance(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    seed: int = 0,
    mode: str = "hash",
    copy_col: str | None = None,
    profile: ClassProfile | None = None,
) -> DataFrame:
    """Redraw the class ratio at random; the growing class is sampled with replacement, the other without."""
    _check_mode(mode)
    p = (profile or class_profile(df, label)).require_binary("random balance")
    new_min, new_maj = random_balance_sizes(p, seed)
    if new_maj == p.majority_size:
        return df.withColumn(copy_col, F.lit(1)) if copy_col else df
    if new_min > p.minority_size:
        grow, grow_old, grow_new = p.minority, p.minority_size, new_min
        shrink_old, shrink_new = p.majority_size, new_maj
    else:
        grow, grow_old, grow_new = p.majority, p.majority_size, new_maj
        shrink_old, shrink_new = p.minority_size, new_min
    grows = F.col(label) == F.lit(grow)
    if mode == "exact":
        each, rest = whole_copies(grow_new, grow_old)
        more = F.lit(each) + exact_cutoff(df.filter(grows), rest, key, seed, "grow", grow_old).cast("int")
        kept = exact_cutoff(df.filter(~grows), shrink_new, key, seed, "shrink", shrink_old).cast("int")
    else:
        more = poisson(F.col("_u"), grow_new / grow_old)
        kept = (F.col("_u") < shrink_new / shrink_old).cast("int")
    copies = F.when(grows, more).otherwise(kept)

    def redraw(part: DataFrame, expected: float) -> DataFrame:
        drawn = part.withColumn("_u", uniform(key, seed, "balance")) if mode == "hash" else part
        return repeat_rows(drawn, copies, copy_col, 1, key, expected).drop("_u")

    return per_growth(df, grows, grow_new / grow_old, redraw)
