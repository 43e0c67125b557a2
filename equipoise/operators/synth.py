"""Synthetic rows: SMOTE (interpolation between neighbours) and ROSE (smoothed bootstrap)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.functions.randomness import bind, gaussians, normal_sources, normals_from, poisson, uniform
from equipoise.functions.vectors import Features, as_array, as_vector, dimension, min_max, scale_array, with_array
from equipoise.operators.knn import knn_pairs
from equipoise.operators.profile import ClassProfile, class_profile
from equipoise.operators.sampling import balanced_fraction, per_growth, repeat_rows
from equipoise.sources.session import scratch_path

_UNROLLED = 16  # up to this many features the noise is written out as plain expressions


def smote_rate(p: ClassProfile, perc_over: float) -> float:
    """Synthetic rows per row of the class: ``perc_over`` per cent, or the class gap when 0."""
    return balanced_fraction(p.majority_size - p.minority_size, p.minority_size, perc_over)


def smote(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    features: Features = "features",
    seed: int = 0,
    k: int = 5,
    perc_over: float = 100,
    to_majority: bool = False,
    target: Any = None,
    include_self: bool = False,
    neighbors: DataFrame | None = None,
    tau: float | None = None,
    pivots: int | None = None,
    copy_col: str | None = None,
    profile: ClassProfile | None = None,
) -> DataFrame:
    """The table plus synthetic rows of one class.

    Per row ceil(rate) synthetics are considered and a rate / ceil(rate) share is kept; only rows that keep
    one are searched for neighbours.  A synthetic lies at a uniform point between its row and one of the row's
    k nearest of the same class, nearness being measured on min-max scaled features.  Min-max scaling is affine
    per feature, so the interpolation itself runs on the original values.

    Other columns, the key included, are inherited from the seed row; ``copy_col`` numbers the synthetics from 1.
    ``neighbors`` may give precomputed pairs ``(key…, rank, nb_features: array<double>)``.
    """
    if k < 1:
        raise ValueError("k must be positive")
    p = profile or class_profile(df, label)
    if target is None:
        p.require_binary("SMOTE without an explicit target class")
        target = p.majority if to_majority else p.minority
    original = df.withColumn(copy_col, F.lit(0)) if copy_col else df
    rate = smote_rate(p, perc_over)
    if rate == 0:
        return original
    considered = math.ceil(rate)
    kept_share = rate / considered
    if p.minority_size < 2 and target == p.minority and neighbors is None and not include_self:
        raise ValueError("SMOTE needs two rows of the class, since a row is not its own neighbour")
    members = df.filter(F.col(label) == F.lit(target)).withColumn("_x", as_array(df, features))
    if neighbors is None:  # the class is read several times from here on, the table only for the union
        path = scratch_path(df.sparkSession, "smote")
        members.write.parquet(path)
        members = df.sparkSession.read.parquet(path)
    seeds = members
    if kept_share < 1 and considered == 1:  # rows that keep no synthetic need no neighbours
        seeds = members.filter(uniform([*key, F.lit(1)], seed, "smote-keep") < kept_share)
    if neighbors is None:
        low, high = min_max(df, features)  # of all classes
        space = members.select(*key, "_x", scale_array(F.col("_x"), low, high).alias("_scaled"))
        queries = seeds.select(*key, scale_array(F.col("_x"), low, high).alias("_scaled"))
        pairs = knn_pairs(
            queries, space, key, "_scaled", k, aux_cols=["_x"], exclude_self=not include_self, tau=tau, pivots=pivots, seed=seed
        ).withColumnRenamed("_x", "nb_features")
    else:
        pairs = neighbors.filter(F.col("rank") <= k)
    near = pairs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", "nb_features"))).alias("_near"))

    near = near.select(*[F.col(c).alias(f"_of_{c}") for c in key], "_near")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key])
    found = seeds.join(near, same, "left").drop(*[f"_of_{c}" for c in key])
    if neighbors is not None:
        lost = F.raise_error(F.lit("a row of the class has no precomputed neighbours"))
        found = found.withColumn("_near", F.when(F.col("_near").isNull(), lost).otherwise(F.col("_near")))
    rows = repeat_rows(found, F.lit(considered), "_i", 1, key, rate)
    if kept_share < 1 and considered > 1:
        rows = rows.filter(uniform([*key, "_i"], seed, "smote-keep") < kept_share)
    pick = F.floor(uniform([*key, "_i"], seed, "smote-pick") * F.size("_near")).cast("int")
    # a row whose features are not all finite has no neighbours: its synthetics repeat it
    other = F.coalesce(F.get(F.col("_near"), pick)["nb_features"], F.col("_x"))
    values = bind(
        uniform([*key, "_i"], seed, "smote-gap"), lambda g: F.zip_with("_x", other, lambda a, b: a + g * (b - a))
    )
    synthetic = with_array(rows, features, values)
    if copy_col:
        synthetic = synthetic.withColumn(copy_col, F.col("_i"))
    return original.unionByName(synthetic.select(*original.columns))


def rose_fractions(p: ClassProfile, mino_prob: float, keep_majo_size: bool) -> tuple[float, float]:
    """Expected (minority, majority) rows per existing row."""
    size = 2 * p.majority_size if keep_majo_size else p.size
    return size * mino_prob / p.minority_size, size * (1.0 - mino_prob) / p.majority_size


def rose_bandwidth(dim: int, rows: int) -> float:
    """Silverman's kernel factor (4 / ((d + 2) n)) ^ (1 / (d + 4))."""
    return (4.0 / ((dim + 2) * rows)) ** (1.0 / (dim + 4))


def _rose_copies(u: Column, fraction: float, keep: bool) -> Column:
    """Rows made of one row: with ``keep`` the first is the row itself, all others are noisy."""
    if keep and fraction > 1:
        return F.lit(1) + poisson(u, fraction - 1)
    return (u < fraction).cast("int") if keep else poisson(u, fraction)


def rose(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    features: Features = "features",
    seed: int = 0,
    mino_prob: float = 0.5,
    shrink: float = 1.0,
    keep_orig: bool = False,
    majo_rus: bool = False,
    keep_majo_size: bool = False,
    copy_col: str | None = None,
    profile: ClassProfile | None = None,
) -> DataFrame:
    """Smoothed bootstrap of both classes, or of the minority with an under-sampled majority.

    A copy is its row plus independent N(0, (shrink · h · sd)²) noise per feature, with h and sd from the row's
    class.  One pass builds everything; the noise is a column expression on the copied row.

    ``mino_prob=1`` without ``majo_rus`` leaves no majority rows.
    """
    if not 0 < mino_prob <= 1:
        raise ValueError("mino_prob must be in (0, 1]")
    if not shrink > 0:
        raise ValueError("shrink must be positive")
    # Sizes and spreads of the classes in one pass; a third class is enough to refuse the table.
    vectors = df.select(F.col(label).alias("c"), as_vector(df, features).alias("v"))
    stats = vectors.groupBy("c").agg(F.count("*").alias("n"), Summarizer.variance(F.col("v")).alias("s")).limit(3).collect()
    if any(r["c"] is None for r in stats) or not stats:
        class_profile(df, label)  # says what is wrong
    p = (profile or ClassProfile.of((r["c"], int(r["n"])) for r in stats)).require_binary("ROSE")
    dim = dimension(df, features)
    f_min, f_maj = rose_fractions(p, mino_prob, keep_majo_size)
    spread = {r["c"]: [math.sqrt(x) for x in r["s"]] for r in stats}
    width = {c: [shrink * rose_bandwidth(dim, n) * s for s in spread[c]] for c, n in p.classes}
    minority = F.col(label) == F.lit(p.minority)

    u, keep_majority = F.col("_u"), keep_orig or majo_rus
    if majo_rus:
        majority_copies = F.lit(1) if keep_majo_size else (u < min(1.0, f_maj)).cast("int")
    else:
        majority_copies = _rose_copies(u, f_maj, keep_orig)
    copies = F.when(minority, _rose_copies(u, f_min, keep_orig)).otherwise(majority_copies)

    def draw_rows(part: DataFrame, expected: float) -> DataFrame:
        return repeat_rows(part, copies, "_i", 0, key, expected)

    drawn = df.withColumns({"_x": as_array(df, features), "_u": uniform(key, seed, "rose")})
    rows = per_growth(drawn, minority, f_min, draw_rows).drop("_u")
    # copy 0 is the row itself where originals are kept; elsewhere noisy copies count from 1
    kept = F.lit(keep_orig) if keep_orig == keep_majority else F.when(minority, keep_orig).otherwise(keep_majority)
    rows = rows.withColumn("_i", F.col("_i") + F.when(kept, 0).otherwise(1))
    draw = [*key, "_i"]
    hashes: dict[str, Column] = {}
    if dim <= _UNROLLED:
        hashes = {f"_h{b}": h for b, h in enumerate(normal_sources(draw, seed, "rose-noise", dim))}
        rows = rows.withColumns(hashes)
        noise = normals_from([F.col(h) for h in hashes], seed, dim)
        low, high = width[p.minority], width[p.majority]
        noisy = F.array(*[F.col("_x")[j] + z * F.when(minority, low[j]).otherwise(high[j]) for j, z in enumerate(noise)])
    else:
        scale = F.when(minority, F.lit(width[p.minority])).otherwise(F.lit(width[p.majority]))
        noise = F.zip_with(gaussians(draw, seed, "rose-noise", dim), scale, lambda z, s: z * s)
        noisy = F.zip_with("_x", noise, lambda x, e: x + e)
    out = with_array(rows, features, F.when(F.col("_i") == 0, F.col("_x")).otherwise(noisy))
    if copy_col:
        out = out.withColumn(copy_col, F.col("_i"))
    return out.drop("_x", "_i", *hashes)
