"""Regions of a point set: which rows belong to a pivot, and which regions a query has to visit.

A region is the rows that are nearest to its pivot.  Up to :func:`most_pivots` of them, the pivots travel to every task.
Beyond that there are two levels: as many top pivots as the square root of the regions, and pivots below each of them,
kept as a table and met by rows and queries top region by top region.  So a region stays near ``REGION`` rows however
large the table is, and a query is compared with about the square root of all pivots.

Distances to pivots are taken from the pivots' centre, and their bounds allow for rounding by the size of the numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.functions.randomness import uniform
from equipoise.sources.session import checkpoint, stored

MAX_PIVOTS = 4096
MAX_PIVOT_BYTES = 32 << 20
REGION = 2048  # rows of a region, on average
PLACED = 131_072  # rows or queries that meet the pivots below a top region in one group
_BELOW = 1 << 24  # a region's number is its top region's times this, plus its place below
_SLAB = 4_000_000  # pivot distances held at once inside a task
_DRAWN = 8  # rows drawn per pivot wanted
_MOST_BELOW = 4  # pivots below a top region, as a multiple of the first level's: they meet rows in groups, and are not sent to all


@dataclass(frozen=True)
class Regions:
    """Pivots with, per region, its rows and the largest pivot distance among them.

    With two levels these are the top regions, and ``below`` is a table (_top, _region, _pivot, _rows, _radius).
    """

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    below: DataFrame | None = None

    @property
    def several(self) -> bool:
        return len(self.pivots) > 1

    @property
    def extent(self) -> float:
        """How far from the pivots' centre a base row can be."""
        return float((np.sqrt(((self.pivots - self.pivots.mean(0)) ** 2).sum(1)) + np.where(self.rows > 0, self.radius, 0.0)).max())


def matrix(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1))


def numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


def distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, from their centre: an offset common to all data does not cost digits."""
    centre = pivots.mean(0)
    a, b = a - centre, pivots - centre
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))


def slabs(rows: int, width: int, cells: int = 0) -> Iterator[slice]:
    step = max(1, (cells or _SLAB) // max(1, width))
    return (slice(i, min(rows, i + step)) for i in range(0, rows, step))


def most_pivots(dim: int) -> int:
    """Pivots travel to every task, so their number and bytes are bounded."""
    return max(1, min(MAX_PIVOTS, MAX_PIVOT_BYTES // (8 * dim)))


def default_pivots(rows: int, small: int = 0) -> int:
    """One region per ``REGION`` rows at every size; a table of at most ``small`` rows has one, and needs no routing."""
    return 1 if rows <= small else max(1, round(rows / REGION))


def nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, its distance) of each row."""
    at, reach = np.empty(len(v), np.int64), np.empty(len(v))
    for s in slabs(len(v), len(pivots)):
        d = distances(v[s], pivots)
        at[s] = d.argmin(1)
        reach[s] = d[np.arange(len(d)), at[s]]
    return at, reach


def assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot ``_region`` and its distance ``_reach``."""
    if len(pivots) == 1:
        return df.withColumns({"_region": F.lit(0).cast("long"), "_reach": F.lit(0.0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, reach = nearest(matrix(batch, "_v"), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(reach)], [*batch.schema.names, "_region", "_reach"])

    schema = T.StructType([*df.schema.fields, T.StructField("_region", T.LongType()), T.StructField("_reach", T.DoubleType())])
    return df.mapInArrow(run, schema)


def choose_pivots(base: DataFrame, key: Sequence[str], rows: int, wanted: int, seed: int) -> np.ndarray:
    """Up to ``wanted`` distinct hash-sampled base vectors (``wanted`` is at most MAX_PIVOTS).

    The sample holds twice as many rows, since a hot vector may fill a third of it.
    """
    share = min(1.0, (float(_DRAWN) * wanted + 16.0) / rows)
    draws = base.select("_v", uniform(key, seed, "pivot").alias("_u")).filter(F.col("_u") < share)
    sample = draws.orderBy("_u").limit(2 * wanted).collect() or base.select("_v").limit(1).collect()
    _, first = np.unique(np.array([r["_v"] for r in sample], dtype=float), axis=0, return_index=True)
    return np.array([sample[i]["_v"] for i in np.sort(first)[:wanted]], dtype=float)


def levels(wanted: int, dim: int) -> tuple[int, bool]:
    """(pivots of the first level, whether there is a second one) for so many regions."""
    most = most_pivots(dim)
    return (wanted, False) if wanted <= most else (min(most, math.ceil(math.sqrt(wanted))), True)


def build_regions(base: DataFrame, key: Sequence[str], rows: int, wanted: int, seed: int, dim: int) -> tuple[DataFrame, Regions]:
    """Assign base rows to ``wanted`` regions, materialise the assignment, and measure the regions."""
    top, second = levels(wanted, dim)
    pivots = choose_pivots(base, key, rows, top, seed)
    assigned = stored(assign(base, pivots))
    regions = measured(assigned, pivots)
    return refine(assigned, key, regions, rows / wanted, seed, dim) if second else (assigned, regions)


def refine(assigned: DataFrame, key: Sequence[str], regions: Regions, region_rows: float, seed: int, dim: int) -> tuple[DataFrame, Regions]:
    """The same regions on top, and below each of them regions of about ``region_rows`` rows."""
    below = pivots_below(assigned, key, regions, region_rows, seed, dim)
    placed = stored(place(assigned, key, regions, below))
    sizes = placed.groupBy("_region").agg(F.count("*").alias("_rows"), F.max("_reach").alias("_radius"))
    below = below.join(sizes, "_region", "left").select("_top", "_region", "_pivot", F.coalesce("_rows", F.lit(0)).alias("_rows"), F.coalesce("_radius", F.lit(0.0)).alias("_radius"))
    return placed, replace(regions, below=checkpoint(below))


def measured(assigned: DataFrame, pivots: np.ndarray) -> Regions:
    """At most MAX_PIVOTS rows reach the driver."""
    rows, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in assigned.groupBy("_region").agg(F.count("*").alias("n"), F.max("_reach").alias("far")).collect():
        rows[r["_region"]], radius[r["_region"]] = r["n"], r["far"]
    return Regions(pivots, rows, radius)


def _of_top(values: Sequence[float], kind: str, top: str = "_top") -> Column:
    """A number per top region, of which there are at most MAX_PIVOTS."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), F.col(top).cast("int"))


def pivots_below(assigned: DataFrame, key: Sequence[str], regions: Regions, region_rows: float, seed: int, dim: int) -> DataFrame:
    """(_top, _region, _pivot): of each top region its own pivot and hash-drawn rows, one per ``region_rows`` of its rows."""
    wanted = np.clip(np.ceil(regions.rows / region_rows), 1, _MOST_BELOW * most_pivots(dim)).astype(int)
    share = np.minimum(1.0, (_DRAWN * wanted + 16.0) / np.maximum(regions.rows, 1))
    draws = assigned.select(F.col("_region").alias("_top"), F.col("_v").alias("_pivot"), uniform(key, seed, "below").alias("_u"))
    draws = draws.filter(F.col("_u") < _of_top(share, "double"))
    own = assigned.sparkSession.createDataFrame([(i, p.tolist(), -1.0) for i, p in enumerate(regions.pivots)], "_top long, _pivot array<double>, _u double")
    drawn = draws.unionByName(own).groupBy("_top", "_pivot").agg(F.min("_u").alias("_u"))  # a hot vector is drawn often
    place_ = F.row_number().over(Window.partitionBy("_top").orderBy("_u", "_pivot")) - 1
    kept = drawn.withColumn("_place", place_).filter(F.col("_place") < _of_top(wanted, "int"))
    return checkpoint(kept.select("_top", (F.col("_top") * _BELOW + F.col("_place")).alias("_region"), "_pivot"))


def _in_groups(rows: DataFrame, key: Sequence[str], counts: Sequence[int], below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with (_top, _chunk): rows of a top region in groups near ``PLACED``, its pivots copied to each."""
    chunks = _of_top([math.ceil(n / PLACED) for n in counts], "int")
    left = rows.withColumn("_chunk", F.pmod(F.xxhash64(*key), F.greatest(chunks, F.lit(1))).cast("int"))
    right = below.withColumn("_n", chunks).filter("_n > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left, right


def top_of(region: str = "_region") -> Column:
    """The top region of a region below it."""
    return F.shiftright(region, _BELOW.bit_length() - 1)


def homes(queries: DataFrame, key: Sequence[str], regions: Regions) -> DataFrame:
    """Queries with the nearest region that holds rows (with two levels, below the nearest top pivot) and its ``_reach``."""
    held = np.flatnonzero(regions.rows > 0)
    top = assign(queries, regions.pivots[held])
    if len(held) < len(regions.pivots):
        top = top.withColumn("_region", _of_top(held.tolist(), "long", "_region"))
    if regions.below is None:
        return top
    counts = np.zeros(len(regions.pivots), np.int64)
    for r in top.groupBy("_region").count().collect():
        counts[r["_region"]] = r["count"]
    return place(top, key, replace(regions, rows=counts), regions.below.filter("_rows > 0"))


def place(assigned: DataFrame, key: Sequence[str], regions: Regions, below: DataFrame) -> DataFrame:
    """Rows with a top ``_region`` go to the nearest pivot below it."""
    names = assigned.columns
    left, right = _in_groups(assigned.withColumn("_top", F.col("_region")), key, regions.rows.tolist(), below)
    kinds = ((f.name, f.dataType) for f in assigned.schema)

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(names)
        at, reach = nearest(matrix(rows, "_v"), matrix(pivots, "_pivot"))
        out = rows.select(names)
        out = out.set_column(names.index("_region"), "_region", pa.array(numbers(pivots, "_region")[at]))
        return out.set_column(names.index("_reach"), "_reach", pa.array(reach))

    schema = T.StructType([T.StructField(n, t) for n, t in kinds])
    return left.groupBy("_top", "_chunk").cogroup(right.groupBy("_top", "_chunk")).applyInArrow(run, schema)


def visits(
    v: np.ndarray, area: Regions, rule: str, bound: np.ndarray | None = None, slack: float = 0.0, keep: int = 1, skip_home: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, region, lower bound on what it may find there) by query and then that bound.

    ``home``: the nearest pivot with rows, at its distance.  ``within``: regions that may hold a point at most ``bound``
    away, among those that ``tau`` visits with a finite ``slack``.  ``reach``: regions that may hold a point at most ``bound + slack`` away, by their radius alone.  ``tau``: pivots
    at most ``slack`` farther than ``bound``, or than the nearest pivot without one.
    """
    pivots, rows, radius = area.pivots, area.rows, area.radius
    d = distances(v, pivots)
    every = np.arange(len(d))
    if rule == "home":
        d = np.where(rows > 0, d, np.inf)
        at = d.argmin(1)
        return every, at, d[every, at]
    home = d.argmin(1)
    near = d[every, home]
    if rule == "tau":
        from_ = near if bound is None else bound
        far, hit = d - from_[:, None], (d - from_[:, None] <= slack) & (rows > 0)
    elif rule == "reach":
        far = d - radius
        hit = (far <= (bound + slack)[:, None] * (1 + 1e-9)) & (rows > 0)
    else:
        # Both tests are lower bounds on the distance from the query to any row of the region.  A squared distance is
        # off by no more than ``lost``, which follows from the lengths of the vectors and not from their distance.
        centre = pivots.mean(0)
        lost = 1e-15 * (v.shape[1] + 8) * (np.sqrt(((v - centre) ** 2).sum(1)) + area.extent) ** 2
        error = 4.0 * np.sqrt(lost)
        open_ = (d - near[:, None] <= slack) & (rows > 0)
        reach = np.minimum(bound, np.where(open_ & (rows >= keep), d + radius, np.inf).min(1) + error)
        gap = np.sqrt(((pivots[home][:, None, :] - pivots[None, :, :]) ** 2).sum(2)) if v.shape[1] * d.size <= _SLAB else distances(pivots[home], pivots)
        with np.errstate(divide="ignore", invalid="ignore"):
            across = (d * d - (near * near)[:, None] - 8.0 * lost[:, None]) / (2.0 * gap)
        far = np.fmax(d - radius, across) - error[:, None]
        hit = ~(far > reach[:, None]) & open_
        if skip_home:
            hit[every, np.where(rows > 0, d, np.inf).argmin(1)] = False
    qi, region = np.nonzero(hit)
    far = far[qi, region]
    order = np.lexsort((far, qi))
    return qi[order], region[order], far[order]


def _turns(qi: np.ndarray) -> np.ndarray:
    return np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")


def _from_driver(queries: DataFrame, key: Sequence[str], regions: Regions, rule: str, slack: float, keep: int, skip_home: bool) -> DataFrame:
    """(key, _region, _lower, _turn) by the pivots that travel to every task; vectors stay where they are."""
    names = [*key, "_region", "_lower", "_turn"]
    area = replace(regions, below=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slabs(batch.num_rows, 4 * len(area.pivots)):
                part = batch.slice(s.start, s.stop - s.start)
                bound = numbers(part, "_bound") if "_bound" in part.schema.names else None
                qi, region, lower = visits(matrix(part, "_v"), area, rule, bound, slack, keep, skip_home)
                keys = part.select(list(key)).take(pa.array(qi))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(region), pa.array(lower), pa.array(_turns(qi))], names)

    fields = [queries.schema[c] for c in key]
    made = [T.StructField("_region", T.LongType()), T.StructField("_lower", T.DoubleType()), T.StructField("_turn", T.LongType())]
    return queries.mapInArrow(run, T.StructType([*fields, *made]))


def _from_table(queries: DataFrame, key: Sequence[str], tops: DataFrame, regions: Regions, rule: str, slack: float, keep: int) -> DataFrame:
    """(key, _region, _lower) by the pivots below the top regions that ``tops`` names for each query."""
    tops = stored(tops.select(*key, F.col("_region").alias("_top")))
    counts = np.zeros(len(regions.pivots), np.int64)
    for r in tops.groupBy("_top").count().collect():
        counts[r["_top"]] = r["count"]
    left, right = _in_groups(tops.join(queries, list(key)), key, counts.tolist(), regions.below)
    names = [*key, "_region", "_lower"]

    def run(asking: pa.Table, pivots: pa.Table) -> pa.Table:
        parts = [asking.select(list(key)).slice(0, 0)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asking.num_rows and pivots.num_rows:
            area = Regions(matrix(pivots, "_pivot"), numbers(pivots, "_rows"), numbers(pivots, "_radius"))
            ids = numbers(pivots, "_region")
            for s in slabs(asking.num_rows, 4 * len(ids)):
                part = asking.slice(s.start, s.stop - s.start)
                bound = numbers(part, "_bound") if "_bound" in part.column_names else None
                qi, region, lower = visits(matrix(part, "_v"), area, rule, bound, math.inf if rule == "within" else slack, keep)
                if "_home" in part.column_names:
                    other = ids[region] != numbers(part, "_home")[qi]
                    qi, region, lower = qi[other], region[other], lower[other]
                for known, new in zip(parts, (part.select(list(key)).take(pa.array(qi)), ids[region], lower), strict=True):
                    known.append(new)
        keys = pa.concat_tables(parts[0])
        return pa.table([*keys.columns, pa.array(np.concatenate(parts[1])), pa.array(np.concatenate(parts[2]))], names=names)

    fields = [queries.schema[c] for c in key]
    schema = T.StructType([*fields, T.StructField("_region", T.LongType()), T.StructField("_lower", T.DoubleType())])
    return left.groupBy("_top", "_chunk").cogroup(right.groupBy("_top", "_chunk")).applyInArrow(run, schema)


def route(queries: DataFrame, key: Sequence[str], regions: Regions, rule: str, slack: float = 0.0, keep: int = 1, home: DataFrame | None = None) -> DataFrame:
    """(key, _region, _lower, _turn): the regions to visit, the most promising first.

    ``rule="home"``: the nearest pivot with rows (with two levels, below the nearest top pivot).  ``"within"``: every other
    region that may hold a point nearer than the query's ``_bound``, with two levels below the top pivots at most ``slack``
    farther than the nearest one; queries have their ``_home``.  ``"tau"``: pivots at most ``slack`` farther than the home one.
    """
    if regions.below is None:
        return _from_driver(queries, key, regions, rule, slack, keep, skip_home=True)
    if rule == "home":
        tops = _from_driver(queries, key, regions, "home", 0.0, 1, False)
        best = _from_table(queries, key, tops, regions, "home", 0.0, 1)
        return best.withColumn("_turn", F.lit(0).cast("long"))
    if rule == "tau":
        home = route(queries, key, regions, "home") if home is None else home
        queries = queries.join(home.select(*key, F.col("_lower").alias("_bound")), list(key))
        tops = _from_driver(queries, key, regions, "reach", slack, 1, False)
    else:
        tops = _from_driver(queries.drop("_home"), key, regions, "within", slack, keep, False)
    found = _from_table(queries, key, tops, regions, rule, slack, keep)
    order = Window.partitionBy(*key).orderBy("_lower", "_region")
    return found.withColumn("_turn", (F.row_number().over(order) - 1).cast("long"))


def pivot_table(assigned: DataFrame, regions: Regions) -> DataFrame:
    """(_region, _pivot, _rows): all regions that hold rows."""
    if regions.below is not None:
        return regions.below.select("_region", "_pivot", "_rows")
    rows = [(i, p.tolist(), int(n)) for i, (p, n) in enumerate(zip(regions.pivots, regions.rows, strict=True))]
    return assigned.sparkSession.createDataFrame(rows, "_region long, _pivot array<double>, _rows long")
