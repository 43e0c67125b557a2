"""Row sampling driven by row keys: Bernoulli, Poisson copies, bootstrap, exact size."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from equipoise.functions.randomness import poisson, uniform

_BUCKETS = 4096
_RANKED_ROWS = 100_000
_DEVIATIONS, _PER_BUCKET = 6.0, 32  # reach of the window around an expected cut-off; rows of its buckets
_U = "_u"
_BLOCK = 1000
SPREAD_RATE = 16.0


def bernoulli(df: DataFrame, fraction: float | Column, key: Sequence[str], seed: int, tag: str = "bernoulli") -> DataFrame:
    """Keep each row with probability ``fraction``; a plain filter, no shuffle."""
    return df.filter(uniform(key, seed, tag) < fraction)


def repeat_rows(
    df: DataFrame,
    copies: Column,
    copy_col: str | None = None,
    first: int = 1,
    key: Sequence[str] = (),
    rate: float = 1.0,
) -> DataFrame:
    """Repeat each row ``copies`` times (0 drops it), numbering the copies from ``first``.

    ``rate`` is the expected number of copies.  Above SPREAD_RATE the work is shared out by ``key``:
    rows are cut into blocks of copies and the blocks shuffled before they unfold, so a few rare rows
    stored together do not fill one task.
    """
    # posexplode over n repeated elements evaluates the count once and drops n = 0 by itself
    if rate <= SPREAD_RATE:
        out = df.select("*", F.posexplode(F.array_repeat(F.lit(True), copies.cast("int"))).alias("_pos", "_hit"))
    else:
        spark = df.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        counted = df.withColumn("_n", copies.cast("int"))
        blocks = F.ceil(F.col("_n") / F.lit(_BLOCK)).cast("int")
        cut = counted.select("*", F.posexplode(F.array_repeat(F.lit(True), blocks)).alias("_block", "_hit")).drop("_hit")
        inside = F.least(F.lit(_BLOCK), F.col("_n") - F.col("_block") * _BLOCK)
        out = (
            cut.repartition(tasks, *key, "_block")
            .select("*", F.posexplode(F.array_repeat(F.lit(True), inside)).alias("_pos", "_hit"))
            .withColumn("_pos", F.col("_pos") + F.col("_block") * _BLOCK)
            .drop("_n", "_block")
        )
    if copy_col:
        out = out.withColumn(copy_col, F.col("_pos") + F.lit(first))
    return out.drop("_pos", "_hit")


def per_growth(df: DataFrame, grows: Column, rate: float, apply: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """``apply(part, rate)`` in one pass, or the growing class on its own when its rows must be spread."""
    if rate <= SPREAD_RATE:
        return apply(df, rate)
    return apply(df.filter(~grows), 1.0).unionByName(apply(df.filter(grows), rate))


def poisson_copies(
    df: DataFrame, rate: float, key: Sequence[str], seed: int, tag: str = "poisson", copy_col: str | None = None
) -> DataFrame:
    """Sample with replacement: each row appears Poisson(rate) times."""
    drawn = df.withColumn(_U, uniform(key, seed, tag))
    return repeat_rows(drawn, poisson(F.col(_U), rate), copy_col, key=key, rate=rate).drop(_U)


def bootstrap(df: DataFrame, key: Sequence[str], seed: int, rate: float = 1.0, copy_col: str | None = None) -> DataFrame:
    """Bootstrap the whole table at ``rate``, every class alike."""
    return poisson_copies(df, rate, key, seed, "bootstrap", copy_col)


def exact_cutoff(df: DataFrame, n: int, key: Sequence[str], seed: int, tag: str, rows: int | None = None) -> Column:
    """A row predicate that is true for exactly ``n`` rows of ``df``: the n smallest draws.

    With the number of ``rows`` known, one reading finds the cut-off: the draws below a window around n / rows are only
    counted, those inside it (some multiple of the square root of the rows) are kept in small buckets.  Where the window
    misses, or the rows are not known, the value is found from bucket counts (4,096 numbers per pass, narrowing until few
    rows share the bucket).  No task ever ranks a whole class.
    """
    if n <= 0:
        return F.lit(False)
    if rows is not None and n >= rows:
        return F.lit(True)
    u = uniform(key, seed, tag)
    draws = df.select(u.alias(_U), *key)
    edge = _edge_in_window(draws, n, rows, key) if rows else None
    if edge is None:
        edge = _edge_by_buckets(draws, n, key)
    if edge is None:
        return F.lit(True)
    order = F.struct(u.alias(_U), *[F.col(k) for k in key])
    limit = F.struct(F.lit(edge[_U]).alias(_U), *[F.lit(edge[k]).cast(df.schema[k].dataType).alias(k) for k in key])
    return order <= limit


def _edge_in_window(draws: DataFrame, n: int, rows: int, key: Sequence[str]) -> Row | None:
    """The n-th smallest draw, if it is within ``_DEVIATIONS`` standard deviations of where it is expected."""
    share = n / rows
    reach = _DEVIATIONS * math.sqrt(share * (1 - share) / rows) + 2.0 / rows
    low, high = max(0.0, share - reach), min(1.0, share + reach)
    count = max(1, min(_BUCKETS, math.ceil((high - low) * rows / _PER_BUCKET)))
    inside = F.col(_U) >= low
    bucket = F.when(inside, F.least(F.floor((F.col(_U) - F.lit(low)) / F.lit((high - low) / count)), F.lit(count - 1))).otherwise(-1)
    row = F.when(inside, F.struct(_U, *key))
    found = draws.filter(F.col(_U) < high).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.collect_list(row).alias("rows")).persist()
    try:
        below = 0
        for r in found.select("b", "n").orderBy("b").collect():
            if below + r["n"] >= n:
                if r["b"] < 0:
                    return None
                return found.filter(F.col("b") == r["b"]).select(F.sort_array("rows")[n - below - 1].alias("e")).first()["e"]
            below += r["n"]
        return None
    finally:
        found.unpersist()


def _edge_by_buckets(draws: DataFrame, n: int, key: Sequence[str]) -> Row | None:
    """The n-th smallest draw; None if there are not more than n."""
    low, width, below = 0.0, 1.0, 0
    while True:
        step = width / _BUCKETS
        bucket = F.least(F.floor((F.col(_U) - F.lit(low)) / F.lit(step)), F.lit(_BUCKETS - 1))
        inside = draws if width == 1.0 else draws.filter((F.col(_U) >= low) & (F.col(_U) < low + width))
        counts = inside.groupBy(bucket.alias("b")).count().orderBy("b").collect()
        if width == 1.0 and sum(r["count"] for r in counts) <= n:
            return None
        for r in counts:
            if below + r["count"] >= n:
                break
            below += r["count"]
        low, width = low + r["b"] * step, step
        if r["count"] <= _RANKED_ROWS or width < 2.0**-44:
            break
    inside = draws.filter((F.col(_U) >= low) & (F.col(_U) < low + width))
    return inside.orderBy(_U, *key).offset(n - below - 1).limit(1).first()


def class_places(df: DataFrame, label: str, key: Sequence[str], seed: int, tag: str, out: str) -> DataFrame:
    """Add ``out``: the row's place (from 0) among the rows of its class, ordered by their draws and then by key.

    Draws are cut into buckets of about ``_RANKED_ROWS`` rows; a row's place is the number of rows of its class in the
    buckets before, which is one number per bucket, and its place in its own.  No task sees a class.
    """
    total = df.count()
    buckets = max(1, math.ceil(total / _RANKED_ROWS))
    drawn = df.withColumn(_U, uniform(key, seed, tag))
    drawn = drawn.withColumn("_bucket", F.floor(F.col(_U) * buckets).cast("int"))
    counts = drawn.groupBy(label, "_bucket").count()
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(label).alias("_class"), F.col("_bucket").alias("_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(label, "_bucket").orderBy(_U, *key)
    placed = drawn.withColumn("_here", F.row_number().over(here) - 1)
    joined = placed.join(counts, F.col(label).eqNullSafe(F.col("_class")) & (F.col("_bucket") == F.col("_part")))
    return joined.withColumn(out, F.col("_before") + F.col("_here")).drop(_U, "_bucket", "_here", "_class", "_part", "_before")


def exact_sample(df: DataFrame, n: int, key: Sequence[str], seed: int, tag: str = "exact", rows: int | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement; ``rows`` is the size of ``df``, if known."""
    return df.filter(exact_cutoff(df, n, key, seed, tag, rows))


def balanced_fraction(kept: int, of: int, perc: float) -> float:
    """``perc`` per cent, or ``kept / of`` when ``perc`` is 0 (balance the classes)."""
    if perc < 0:
        raise ValueError("a percentage cannot be negative")
    return kept / of if perc == 0 else perc / 100.0


def whole_copies(total: int, rows: int) -> tuple[int, int]:
    """``total`` copies over ``rows`` rows: (copies for each row, rows that get one more)."""
    return math.floor(total / rows), total % rows
