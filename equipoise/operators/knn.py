"""k-nearest-neighbour join.

Base rows are split into regions around pivots (each row belongs to its nearest
pivot) and regions into cells of bounded size.  A query visits

* exact: its home region first, then every region that the triangle inequality
  cannot rule out given the k-th distance found at home;
* routed: every region whose pivot is at most ``tau`` farther than the nearest one.

A cell holds a bounded number of base rows and queries, whatever the skew: hot
regions are split by a key hash on both sides.  Inside a cell the distances are
one matrix product; only the k best per query leave it.  Copies of one vector are
cut to the k with the smallest keys before anything is compared; more of them can
never be among the k nearest, so the answer is unchanged.

A routed query that finds fewer than k rows although the base has them is answered exactly.

Large tables of few features are searched exactly through boxes instead (:mod:`equipoise.operators.boxes`): one shuffle
answers nearly all queries, and only those whose k-th distance reaches into other boxes go on to them.

Equal distances are ordered by base key, so the result is deterministic.  Keys must be unique and not null on either
side.  A row with a null, NaN or infinite feature is nobody's neighbour and has none.  Distances to pivots are taken
from the pivots' centre, and their bounds allow for rounding by the size of the numbers, so an offset of all data does
not matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.functions.randomness import uniform
from equipoise.functions.vectors import Features, as_array, euclidean_distance
from equipoise.operators import boxes
from equipoise.operators.regions import REGION, Regions, _of_top, assign, build_regions, default_pivots, homes, matrix, numbers, pivot_table, refine, route, slabs, top_of
from equipoise.sources.session import checkpoint, stored

BASE_CELL = 16_384
QUERY_CELL = 131_072
MIN_QUERY_CELL = 256
ROUND, WIDER = 2, 4  # regions per query in the first round after home; how many times more in each further one
ROUND_WORK = 4_000_000_000  # pairs up to which all regions are visited in one round, for each _ROUND_QUERIES
SAMPLE = 400  # queries that recall is estimated from
MOST_VISITED = 0.5  # share of all pairs beyond which an approximate search is no better than an exact one
_ROUND_QUERIES = 262_144
MOST_MET = 16_384  # base rows that a query meets in boxes, beyond which regions are searched
BOX_QUERIES, _LOOKED_AT = 131_072, 8  # queries of a box in one group; boxes that a sample of the queries is taken from
_BOX_KEYS = (T.IntegralType, T.StringType, T.DateType)  # equal and ordered alike in Spark and in Arrow
LARGE = 65_536  # base rows from which a sample of the queries says whether regions exclude anything
WIDE_CELL, WIDE_BYTES = 131_072, 64 << 20  # rows and bytes of a base cell where nothing is excluded
_REPEATED = 1_000_000  # repeated base rows a task writes
_CELL_SLAB = 1_000_000  # base distances held at once, about a core's cache
_PROBE = 2048  # base rows that bound the k-th distance
_SPARK_LIMITS, _COPY_SALTS = 1000, 64  # rows per group that Spark cuts before a shuffle; groups of a hot vector beyond
_CELL = ("_region", "_salt", "_chunk")


def nearest_in_cell(queries: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, distance) of the k nearest, ties by base row order.

    One matrix product ranks the base rows by |b|² - 2qb.  The k-th value among every
    n-th base row bounds the true k-th value, so only rows under it need sorting.
    Comparisons leave a margin for the product's rounding error; the finalists are
    then measured feature by feature in plain double arithmetic.
    """
    centre = base.mean(0)
    q, b = queries - centre, base - centre
    qn, bn = (q * q).sum(1), (b * b).sum(1)
    n, k = len(b), min(k, len(b))
    left = np.hstack([-2.0 * q, np.ones((len(q), 1))])
    right = np.ascontiguousarray(np.hstack([b, bn[:, None]]).T)
    probe = np.ascontiguousarray(right[:, :: max(1, n // max(_PROBE, 8 * k))])
    margins = 2e-12 * (b.shape[1] + 4) * (qn + bn.max())
    parts = []
    for rows in slabs(len(q), n, _CELL_SLAB):
        margin = margins[rows]
        bound = np.partition(left[rows] @ probe, k - 1, axis=1)[:, k - 1] + margin
        value = left[rows] @ right
        hit = np.flatnonzero(value <= bound[:, None])
        qi, bi = np.divmod(hit, n)
        value = value.ravel()[hit]
        order = np.lexsort((value, qi))
        qi, bi, value = qi[order], bi[order], value[order]
        first = np.searchsorted(qi, np.arange(len(margin)))
        near = value <= (value[first + k - 1] + margin)[qi]
        qi, bi = qi[near] + rows.start, bi[near]
        exact = np.zeros(len(qi))
        for j in range(b.shape[1]):
            gap = queries[qi, j] - base[bi, j]
            exact += gap * gap
        order = np.lexsort((bi, exact, qi))
        qi, bi, exact = qi[order], bi[order], exact[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
        parts.append((qi[best], bi[best], np.sqrt(exact[best])))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def nearest_in_blocks(queries: np.ndarray, base: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a base of any size: the k best of each block of it, merged."""
    if len(base) <= block:
        return nearest_in_cell(queries, base, k)
    parts = []
    for start in range(0, len(base), block):
        qi, bi, distance = nearest_in_cell(queries, base[start : start + block], k)
        parts.append((qi, bi + start, distance))
    qi, bi, distance = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((bi, distance, qi))
    qi, bi, distance = qi[order], bi[order], distance[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[best], bi[best], distance[best]


@dataclass(frozen=True)
class Visits:
    """What a search of some routed queries will do."""

    sizes: DataFrame | tuple[int, int, int]  # (_region, _salts, _chunks) of the visited regions that hold rows
    cells: int
    pairs: int  # of a query and a base row
    copied: int  # base rows, repeated for each chunk of queries
    queries: int

    @staticmethod
    def of(routed: DataFrame, regions: Regions, wanted: int, cell: int = 0) -> Visits:
        """One level: at most MAX_PIVOTS numbers reach the driver and are sent on.  Two: counts stay a table."""
        cell = cell or BASE_CELL
        counts = routed.groupBy("_region").count()
        if regions.below is None:
            rows = [(r["_region"], int(regions.rows[r["_region"]]), r["count"]) for r in counts.collect()]
            known = [(r, n, q) for r, n, q in rows if n]
            asked = sum(q for _, _, q in rows)
            # the base is repeated for each chunk, so a region of several cells is cut into fewer of them
            chunk = _chunk_rows(asked, max(1, wanted // math.ceil(known[0][1] / cell)) if len(known) == 1 else wanted)
            sized = [(r, math.ceil(n / cell), math.ceil(q / chunk)) for r, n, q in known]
            totals = (sum(s * c for _, s, c in sized), sum(n * q for _, n, q in known), sum(n * c for (_, n, _), (_, _, c) in zip(known, sized, strict=True)), asked)
            if len(sized) == 1:
                return Visits(sized[0], *totals)
            table = pa.table([pa.array(c, t) for c, t in zip(zip(*sized, strict=True) if sized else [()] * 3, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_region", "_salts", "_chunks"])
            return Visits(F.broadcast(routed.sparkSession.createDataFrame(table)), *totals)
        counts = checkpoint(counts.join(regions.below.select("_region", "_rows"), "_region").filter("_rows > 0"))
        asked = counts.agg(F.sum("count")).first()[0] or 0
        chunk = _chunk_rows(asked, wanted)
        sized = counts.select("_region", "_rows", "count", F.ceil(F.col("_rows") / cell).cast("int").alias("_salts"), F.ceil(F.col("count") / chunk).cast("int").alias("_chunks"))
        t = sized.agg(F.sum(F.col("_salts").cast("long") * F.col("_chunks")), F.sum(F.col("_rows") * F.col("count")), F.sum(F.col("_rows") * F.col("_chunks"))).first()
        return Visits(sized.select("_region", "_salts", "_chunks"), *(int(x or 0) for x in t), asked)

    def cut(self, df: DataFrame) -> DataFrame:
        """Rows of visited regions, with the (_salts, _chunks) of theirs."""
        if isinstance(self.sizes, DataFrame):
            return df.join(self.sizes, "_region")
        region, salts, chunks = self.sizes
        return df.filter(F.col("_region") == region).withColumns({"_salts": F.lit(salts), "_chunks": F.lit(chunks)})


def _chunk_rows(queries: int, wanted: int) -> int:
    return min(QUERY_CELL, max(MIN_QUERY_CELL, math.ceil(queries / wanted)))


def _wanted(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _search(
    routed: DataFrame,
    queries: DataFrame,
    base: DataFrame,
    regions: Regions,
    query_key: Sequence[str],
    base_cols: Sequence[str],
    k: int,
    visits: Visits | None = None,
) -> DataFrame:
    """The k nearest base rows per (query, cell).

    ``routed`` has (key, _region) and maybe a ``_bound`` beyond which nothing counts; it is read twice.  The vectors of
    ``queries`` join it after the counts.
    """
    spark = base.sparkSession
    bounded = "_bound" in routed.columns
    base_key = [c for c in base_cols if c.startswith("nb_")]
    visits = visits or Visits.of(routed, regions, _wanted(base))
    partitions = max(1, min(visits.cells, max(_wanted(base), int(spark.conf.get("spark.sql.shuffle.partitions")))))

    q = routed.select(*query_key, "_region", *[c for c in ("_bound", "_v") if c in routed.columns])
    q = visits.cut(q)
    q = q.withColumn("_chunk", F.pmod(F.xxhash64(*query_key), F.col("_chunks")).cast("int"))
    q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", "_chunks")
    q = q if "_v" in q.columns else q.join(queries.select(*query_key, "_v"), list(query_key))
    b = base.select(*dict.fromkeys([*base_cols, "_v", "_region"]))
    if visits.copied > _REPEATED:  # a small base against many queries: share the repetition out over tasks
        b = b.repartition(math.ceil(visits.copied / _REPEATED), *base_key)
    b = visits.cut(b)
    b = b.withColumn("_salt", F.pmod(F.xxhash64(*base_key), F.col("_salts")).cast("int"))
    b = b.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_salts", "_chunks")

    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in q.select(*query_key).schema]
        + [T.StructField(f.name, f.dataType) for f in b.select(*base_cols).schema]
        + [T.StructField("distance", T.DoubleType())]
    )
    names, block = schema.fieldNames(), BASE_CELL

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            right = right.sort_by([(c, "ascending") for c in base_key])
            qi, bi, distance = nearest_in_blocks(matrix(left, "_v"), matrix(right, "_v"), k, block)
            if bounded:  # nothing beyond the k-th distance found at home can be in the answer
                useful = distance <= left.column("_bound").to_numpy()[qi]
                qi, bi, distance = qi[useful], bi[useful], distance[useful]
        else:
            qi = bi = distance = np.empty(0)
        lt = left.select(list(query_key)).take(pa.array(qi.astype(np.int64)))
        rt = right.select(list(base_cols)).take(pa.array(bi.astype(np.int64)))
        return pa.table([*lt.columns, *rt.columns, pa.array(distance, pa.float64())], names=names)

    # an explicit partition count: the cells are small in bytes but heavy to compute, so they must not be merged
    left = q.repartition(partitions, *_CELL).groupBy(*_CELL)
    right = b.repartition(partitions, *_CELL).groupBy(*_CELL)
    return left.cogroup(right).applyInArrow(run, schema)


def _best(candidates: DataFrame, query_key: Sequence[str], base_key: Sequence[str], k: int) -> DataFrame:
    """Merge candidates: rank 1 … k per query by (distance, base key)."""
    w = Window.partitionBy(*query_key).orderBy("distance", *base_key)
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _distinct_copies(base: DataFrame, base_key: Sequence[str], keep: int) -> DataFrame:
    """At most ``keep`` rows of each identical vector, smallest keys first.

    Spark limits each task's copies before the shuffle, so a hot vector stays small; it does so up to a
    thousand copies, so for more the copies are cut in salted groups first.
    """
    ranked = base.withColumn("_hash", F.xxhash64("_v"))
    groups = [["_hash", "_v"]]
    if keep > _SPARK_LIMITS:
        ranked = ranked.withColumn("_salt", F.pmod(F.xxhash64(*base_key), F.lit(_COPY_SALTS)))
        groups.insert(0, ["_hash", "_v", "_salt"])
    for group in groups:
        w = Window.partitionBy(*group).orderBy(*base_key)
        ranked = ranked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")
    return ranked.drop("_hash", "_salt")


@dataclass(frozen=True)
class NeighbourIndex:
    """A base table assigned to regions, ready for any number of searches."""

    assigned: DataFrame
    regions: Regions
    key: tuple[str, ...]
    aux: tuple[str, ...]
    vectors: frozenset[str]
    copies: int
    rows: int
    fine: Regions | None = None  # where ``regions`` are large: two levels, ``regions`` on top; ``assigned`` has theirs

    @property
    def coarse(self) -> DataFrame:
        """``assigned`` by ``regions``."""
        return self.assigned.withColumn("_region", top_of()) if self.fine else self.assigned

    @property
    def nb(self) -> list[str]:
        return [f"nb_{c}" for c in self.key]


def _finite(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def check_key(df: DataFrame, key: Sequence[str], what: str, vector: str | None = None) -> tuple[int, int]:
    """Refuse a key that is null or shared; counts are combined before the shuffle.

    With ``vector`` also (rows whose ``vector`` is finite, its length), from the same pass.
    """
    lost = reduce(or_, [F.col(c).isNull() for c in key])
    good, size = (_finite(vector), F.size(vector)) if vector else (F.lit(True), F.lit(0))
    keys = df.groupBy(*key).agg(F.count("*").alias("n"), F.count(F.when(good, 1)).alias("good"), F.max(F.when(good, size)).alias("size"))
    r = keys.agg(F.max("n").alias("most"), F.max(lost).alias("lost"), F.sum("good").alias("good"), F.max("size").alias("size")).first()
    if r["lost"]:
        raise ValueError(f"the {what} key {list(key)} has nulls")
    if (r["most"] or 0) > 1:
        raise ValueError(f"the {what} key {list(key)} is not unique: {r['most']} rows share one")
    return r["good"] or 0, r["size"] or 0


def _base_rows(base: DataFrame, key: Sequence[str], features: Features, aux_cols: Sequence[str]) -> tuple[DataFrame, list[str], set[str]]:
    """(rows (nb_<key>…, aux_…, _v), the further columns, those of them that are vectors)."""
    aux = [c for c in aux_cols if c not in key]
    vectors = {c for c in aux if isinstance(base.schema[c].dataType, VectorUDT)}  # Arrow carries them as arrays
    rows = base.select(
        *[F.col(c).alias(f"nb_{c}") for c in key],
        *[(vector_to_array(F.col(c)) if c in vectors else F.col(c)).alias(f"aux_{c}") for c in aux],
        as_array(base, features).alias("_v"),
    )
    return rows, aux, vectors


def build_index(
    base: DataFrame,
    key: Sequence[str],
    features: Features,
    copies: int,
    aux_cols: Sequence[str] = (),
    pivots: int | None = None,
    seed: int = 0,
    routed: bool = False,
    counted: tuple[int, int] | None = None,
) -> NeighbourIndex:
    """Index ``base`` for searches that need at most ``copies`` rows of one identical vector (k, or k + 1
    when a row must not find itself).  ``pivots`` sets the number of regions; large ones have regions of ``REGION`` rows below
    them.  ``routed`` prepares for a search with ``tau``, which follows one rule at every size.  An exact search of a small
    table has one region.  ``counted`` is what :func:`check_key` said of the base."""
    nb = [f"nb_{c}" for c in key]
    b, aux, vectors = _base_rows(base, key, features, aux_cols)
    rows, dim = counted or check_key(b, nb, "base", "_v")
    b = b.filter(_finite("_v"))
    if rows == 0:
        raise ValueError("the base table has no row whose features are all finite")
    kept = _distinct_copies(b, nb, copies)
    wanted = pivots or default_pivots(rows, 0 if routed else 4 * BASE_CELL)
    if wanted == 1:
        regions = Regions(np.zeros((1, 1)), np.array([rows]), np.array([math.inf]))
        assigned = assign(kept, regions.pivots)
    else:
        assigned, regions = build_regions(kept, nb, rows, wanted, seed, dim)
        if regions.below is None and regions.rows.max() > 2 * REGION:  # regions of a given number grow with the table
            assigned, fine = refine(assigned, nb, regions, REGION, seed, dim)
            return NeighbourIndex(assigned, regions, tuple(key), tuple(aux), frozenset(vectors), copies, rows, fine)
    return NeighbourIndex(assigned, regions, tuple(key), tuple(aux), frozenset(vectors), copies, rows)


def search_index(
    query: DataFrame,
    index: NeighbourIndex,
    key: Sequence[str],
    features: Features,
    k: int = 5,
    max_distance: float = math.inf,
    exclude_self: bool = False,
    tau: float | None = None,
    checked: bool = False,
    report: dict[str, int] | None = None,
    region_col: str | None = None,
) -> DataFrame:
    """Long form: (key…, nb_<base key>…, aux…, distance, rank), k nearest first.

    ``checked`` says that the query's key is known to be unique.  ``report`` gets the number of (query, base row) ``pairs``
    that were visited, and of ``rounds`` after the home regions.  ``region_col`` names the region of each neighbour.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if not max_distance > 0:
        raise ValueError("max_distance must be positive")
    keep = k + 1 if exclude_self else k
    if keep > index.copies:
        raise ValueError(f"the index holds {index.copies} copies per vector, this search needs {keep}")
    nb, regions = index.nb, index.regions
    if not checked:
        check_key(query, key, "query")
    asked = query.select(*key, as_array(query, features).alias("_v")).filter(_finite("_v"))
    names = list(key)
    if regions.several:  # a number per query is cheaper to carry through the rounds than its key and vector
        asked = stored(asked.withColumn("_q", F.monotonically_increasing_id()))
        names = ["_q"]
    found = _Rounds(asked.select(*names, "_v"), names, index, keep, max_distance, report, region_col).run(tau)
    if regions.several:
        found = found.join(asked.drop("_v"), "_q")
    if math.isfinite(max_distance):
        found = found.filter(F.col("distance") <= max_distance)
    if exclude_self:
        found = found.filter(~_same_key(key, nb))
    return _named(_best(found, names, nb, k).drop("_q"), key, index.aux, index.vectors)


def _named(best: DataFrame, key: Sequence[str], aux: Sequence[str], vectors: frozenset[str] | set[str]) -> DataFrame:
    for c in aux:
        if c in vectors:
            best = best.withColumn(f"aux_{c}", array_to_vector(f"aux_{c}"))
        best = best.withColumnRenamed(f"aux_{c}", c if c not in key else f"aux_{c}")
    return best.select(*key, *[c for c in best.columns if c not in key])


class _Boxes:
    """An exact search through boxes.

    Queries and base rows meet in the query's box once; a query's k-th distance there tells which other boxes it reaches.
    Those are few, and only for them rows are met again and merged.  A query's neighbours travel as one row.
    """

    def __init__(self, asked: DataFrame, base: DataFrame, key: Sequence[str], nb: Sequence[str], k: int, max_distance: float, exclude_self: bool, same: bool, report: dict[str, int] | None):
        self.asked, self.base, self.key, self.nb, self.k = asked, base, list(key), list(nb), k
        self.most, self.exclude_self, self.same = float(max_distance), exclude_self, same
        self.keep, self.report = k + 1 if exclude_self else k, report if report is not None else {}
        self.kept = [c for c in base.columns if c != "_v"]

    def run(self, rows: int, dim: int) -> DataFrame | None:
        """(key…, nb…, aux…, distance, rank), or nothing where a sample says that boxes exclude too little."""
        size = min(boxes.ROWS, max(boxes.LEAST_ROWS, rows // _wanted(self.base)))
        drawn = boxes.DRAWN * min(boxes.MOST_BOXES, math.ceil(rows / size))
        sample = matrix(self.base.filter(F.pmod(F.xxhash64(F.lit("box"), *self.nb), F.lit(rows)) < drawn).filter(_finite("_v")).select("_v").toArrow(), "_v")
        if not len(sample):
            return None
        tree = boxes.cut_sample(sample, boxes.DRAWN * 3 // 2)
        base = stored(boxes.boxed(self.base, tree))
        sizes, around = boxes.box_sizes(base, dim)
        self.tree = boxes.bounded(tree, around)
        if self.same:
            asked, counts = base.select(*[F.col(n).alias(c) for n, c in zip(self.nb, self.key, strict=True)], "_v", "_box"), sizes
        else:
            asked = stored(boxes.boxed(self.asked, tree))
            counts = self.counts(asked)
        self.full = full = [box for box, n in sizes.items() if n > max(4 * size, 4 * rows // boxes.MOST_BOXES)]
        if full:  # of a hot vector, whose copies no cut parts
            few = stored(_distinct_copies(base.filter(F.col("_box").isin(full)), self.nb, self.keep))
            base = base.filter(~F.col("_box").isin(full)).unionByName(few)
        if not self.worthwhile(asked, base, counts):
            return None
        home = stored(self.search(asked, base, counts, True, whole=self.same))
        reaching = home.filter(F.size("_others") > 0)
        settled = home.filter(F.size("_others") == 0).select(*self.key, F.posexplode("_found").alias("_place", "_row"))
        found = settled.select(*self.key, "_row.*", (F.col("_place") + 1).alias("rank"))
        self.report.update(pairs=home.agg(F.sum("_met")).first()[0] or 0, rounds=0)
        pending = reaching.select(*self.key, "_v", "_bound", F.explode("_others").alias("_box"))
        counts = self.counts(pending)
        if not counts:
            return found
        visited = stored(self.search(pending, base, counts, False))
        self.report["pairs"] += visited.agg(F.sum("_met")).first()[0] or 0
        self.report["rounds"] += 1
        both = reaching.select(*self.key, "_found").unionByName(visited.select(*self.key, "_found"))
        merged = both.select(*self.key, F.explode("_found").alias("_row")).select(*self.key, "_row.*")
        return found.unionByName(_best(merged, self.key, self.nb, self.k))

    def counts(self, asked: DataFrame) -> dict[int, int]:
        """Queries of each box: at most MOST_BOXES lines reach the driver."""
        return {r["_box"]: r["count"] for r in asked.groupBy("_box").count().collect()}

    def worthwhile(self, asked: DataFrame, base: DataFrame, counts: dict[int, int]) -> bool:
        """Whether a sample of the queries meets few rows; it is taken from some boxes, drawn by their queries."""
        ids, n = np.array(sorted(counts)), np.array([counts[b] for b in sorted(counts)], float)
        if not len(ids):
            return True
        drawn = np.random.default_rng(0).choice(ids, min(_LOOKED_AT, len(ids)), replace=False, p=n / n.sum()).tolist()
        share = max(1, sum(counts[b] for b in drawn) // SAMPLE)
        few = stored(asked.filter(F.col("_box").isin(drawn) & (F.pmod(F.xxhash64(F.lit("few"), *self.key), F.lit(share)) == 0)))
        r = self.search(few, base, self.counts(few), True).agg(F.avg("_met").alias("met"), F.avg(F.size("_others")).alias("others")).first()
        return (r["met"] or 0.0) * (1.0 + (r["others"] or 0.0)) <= MOST_MET

    def search(self, asked: DataFrame, base: DataFrame, counts: dict[int, int], home: bool, whole: bool = False) -> DataFrame:
        """(key…, _found: the k nearest in the box, _others: boxes to visit after ``home``, with _bound and _v, _met: rows met).

        ``whole`` says that all base rows are asked for: then a box of one group is read once for both sides.
        """
        key, nb, kept, k, keep = self.key, self.nb, self.kept, self.k, self.keep
        most, exclude_self, tree = self.most, self.exclude_self, self.tree
        queries = min(BOX_QUERIES, 2 * max(boxes.LEAST_ROWS, math.ceil(sum(counts.values()) / _wanted(asked))))
        chunks = [math.ceil(counts.get(i, 0) / queries) for i in range(len(tree.dim))]
        if whole:  # a box whose copies are cut has fewer base rows than queries
            for box in self.full:
                chunks[box] = max(2, chunks[box])
        of_box = _of_top(chunks, "int", "_box")
        group = ["_box", "_chunk"]
        left = asked.filter(of_box > 1) if whole else asked
        left = left.withColumn("_chunk", F.pmod(F.xxhash64(*key), of_box).cast("int"))
        right = base.withColumn("_n", of_box).filter("_n > 1" if whole else "_n > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        row = T.StructType([*[base.schema[c] for c in kept], T.StructField("distance", T.DoubleType())])
        more = [T.StructField("_found", T.ArrayType(row)), *T.StructType.fromDDL("_others array<int>, _bound double, _v array<double>, _met long").fields]
        schema = T.StructType([*[asked.schema[c] for c in key], *more])

        def lists(at: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(rows + 1)), pa.int32()), values)

        def by_key(rows: pa.Table) -> pa.Table:
            return rows.sort_by([(c, "ascending") for c in nb])

        def alone(rows: pa.Table) -> pa.Table:
            rows = by_key(rows)
            return answer(rows.select([*nb, "_v", "_box"]).rename_columns([*key, "_v", "_box"]), rows)

        def visit(left: pa.Table, right: pa.Table) -> pa.Table:
            if not home and left.num_rows and right.num_rows:  # a few queries reach into a small part of the box
                v = matrix(left, "_v")
                right = right.filter(pa.array(boxes.reached(matrix(right, "_v"), v, numbers(left, "_bound"), tree.end(v))))
            return answer(left, by_key(right))

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            v, b, n = matrix(left, "_v"), matrix(right, "_v"), left.num_rows
            bound = np.minimum(numbers(left, "_bound"), most) if "_bound" in left.column_names else np.full(n, most)
            qi, bi, distance, met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(n, np.int64)
            if n and len(b):
                first = boxes.few_copies(b, keep)
                qi, bi, distance, met = boxes.Points(b[first], keep).nearest(v, keep, bound)
                bi = first[bi]
            if exclude_self:
                keys = (pc.equal(left.column(a).take(pa.array(qi)), right.column(c).take(pa.array(bi))) for a, c in zip(key, nb, strict=True))
                others = ~reduce(pc.and_, keys).to_numpy().astype(bool)
                qi, bi, distance = qi[others], bi[others], distance[others]
                best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
                qi, bi, distance = qi[best], bi[best], distance[best]
            rows = right.select(kept).take(pa.array(bi)).combine_chunks()
            found = pa.StructArray.from_arrays([*[c.combine_chunks() for c in rows.columns], pa.array(distance)], [*kept, "distance"])
            at = box = np.zeros(0, np.int64)
            if home and n:
                whole = np.flatnonzero(np.bincount(qi, minlength=n) == k)
                bound[whole] = np.minimum(bound[whole], distance[np.searchsorted(qi, whole, side="right") - 1])
                at, box = tree.met(v, bound)
                other = box != numbers(left, "_box")[at]
                at, box = at[other], box[other]
                order = np.argsort(at, kind="stable")
                at, box = at[order], box[order]
            pending = pa.array(np.isin(np.arange(n), at))
            vectors = left.column("_v").combine_chunks()
            made = [lists(qi, n, found), lists(at, n, pa.array(box.astype(np.int32))), pa.array(bound), pc.if_else(pending, vectors, pa.scalar(None, vectors.type)), pa.array(met)]
            return pa.table([*left.select(key).columns, *made], names=schema.fieldNames())

        def partitions(cells: int) -> int:
            return max(1, min(4 * cells, 8 * _wanted(asked)), min(cells, 1024), cells // 4)

        cut = sum(n for n in chunks if n > 1 or not whole)
        parts = []
        if cut or not whole:
            left, right = (side.repartition(partitions(cut), *group).groupBy(*group) for side in (left, right))
            parts.append(left.cogroup(right).applyInArrow(visit, schema))
        if whole and 1 in chunks:
            parts.append(base.filter(of_box == 1).repartition(partitions(chunks.count(1)), "_box").groupBy("_box").applyInArrow(alone, schema))
        return reduce(DataFrame.unionByName, parts)


class _Rounds:
    """A search in rounds: the home region of each query, then ever more regions, the most promising first.

    After each round the distance of a query's k-th best is its bound, and regions that cannot hold anything nearer
    are not visited any more.  A little work is done in one round.
    """

    def __init__(self, queries: DataFrame, key: Sequence[str], index: NeighbourIndex, keep: int, max_distance: float, report: dict[str, int] | None, region_col: str | None):
        self.queries, self.key, self.index, self.keep = queries, list(key), index, keep
        self.regions, self.most, self.report = index.fine or index.regions, float(max_distance), report if report is not None else {}
        top = top_of() if index.fine else F.col("_region")
        self.base = index.assigned.withColumn(region_col, top) if region_col else index.assigned
        self.base_cols = [*index.nb, *[f"aux_{c}" for c in index.aux], *([region_col] if region_col else [])]
        self.report.update(pairs=0, rounds=0)

    def visits(self, routed: DataFrame) -> Visits:
        return Visits.of(routed, self.regions, _wanted(routed))

    def search(self, routed: DataFrame, visits: Visits | None = None) -> DataFrame:
        visits = visits or self.visits(routed)
        self.report["pairs"] += visits.pairs
        return _search(routed, self.queries, self.base, self.regions, self.key, self.base_cols, self.keep, visits)

    def best(self, found: DataFrame) -> DataFrame:
        return stored(_best(found, self.key, self.index.nb, self.keep).drop("rank"))

    def run(self, tau: float | None) -> DataFrame:
        if not self.regions.several:
            return self.whole(self.queries)
        if tau is None:
            return self.all_nearest(self.queries)
        near = self.best(self.routed(tau))
        counts = near.groupBy(*self.key).agg(F.count("*").alias("_found"))
        enough = F.coalesce("_found", F.lit(0)) >= min(self.keep, self.index.rows)
        short = stored(self.queries.join(counts, self.key, "left").filter(~enough).drop("_found"))
        if short.isEmpty():
            return near
        return near.join(short.select(*self.key), self.key, "left_anti").unionByName(self.all_nearest(short))

    def all_nearest(self, queries: DataFrame) -> DataFrame:
        if self.index.rows > LARGE and self.excludes_little(queries, None):
            return self.whole(queries)
        return self.exact(queries)

    def routed(self, tau: float) -> DataFrame:
        """Candidates from the regions that ``tau`` visits; large ones are searched through the regions below them."""
        coarse = self.index.regions
        if self.index.fine and coarse.rows.all() and not (self.index.rows > LARGE and self.excludes_little(self.queries, tau)):
            return self.exact(self.queries, tau)
        visited = stored(route(self.queries, self.key, coarse, "tau", tau))
        visits = Visits.of(visited, coarse, _wanted(visited))
        self.report["pairs"] += visits.pairs
        base = self.base.withColumn("_region", top_of()) if self.index.fine else self.base
        return _search(visited, self.queries, base, coarse, self.key, self.base_cols, self.keep, visits)

    def whole(self, queries: DataFrame) -> DataFrame:
        """Every query against every base row, in cells as large as a task holds."""
        rows = int(self.index.regions.rows.sum())
        one = Regions(np.zeros((1, 1)), np.array([rows]), np.array([math.inf]))
        routed = queries.withColumn("_region", F.lit(0).cast("long"))
        cell = BASE_CELL
        if self.regions.several:  # as many cells on one side as on the other repeat the least
            size = self.queries.select(F.size("_v")).first()[0]
            cell = max(BASE_CELL, min(WIDE_CELL, WIDE_BYTES // (8 * size), math.ceil(rows / math.sqrt(_wanted(queries)))))
        visits = Visits.of(routed, one, _wanted(routed), cell)
        self.report["pairs"] += visits.pairs
        base = self.base.withColumn("_region", F.lit(0).cast("long")) if self.regions.several else self.base
        return _search(routed, self.queries, base, one, self.key, self.base_cols, self.keep, visits)

    def excludes_little(self, queries: DataFrame, tau: float | None) -> bool:
        """Whether a sample of the queries visits most of the pairs that a search without the regions would."""
        n = max(1, queries.count())
        few = stored(queries.filter(F.pmod(F.xxhash64(F.lit("few"), *self.key), F.lit(n)) < SAMPLE))
        home = stored(homes(few, self.key, self.regions))
        pending, _ = self.pending(home.drop("_reach"), self.distances(self.search(home.drop("_reach"))), tau)
        visited = self.visits(home).pairs + self.visits(pending).pairs
        if tau is None:
            every = few.count() * int(self.index.regions.rows.sum())
        else:
            every = Visits.of(route(few, self.key, self.index.regions, "tau", tau), self.index.regions, 1).pairs
        self.report["pairs"] = 0
        return visited > MOST_VISITED * every

    def pending(self, home: DataFrame, near: DataFrame, tau: float | None) -> tuple[DataFrame, DataFrame]:
        """(regions to visit after home, the bounds of the queries)."""
        asking = self.bounded(home.select(*self.key, "_v", F.col("_region").alias("_home")).join(near, self.key, "left")).drop("_near")
        if self.regions.below is None:
            asking = asking.drop("_home")
        slack = math.inf if tau is None else tau
        return stored(route(asking, self.key, self.regions, "within", slack, keep=self.keep)), asking.select(*self.key, "_bound")

    def exact(self, queries: DataFrame, tau: float | None = None) -> DataFrame:
        """The nearest of all rows, or of those whose top region ``tau`` visits."""
        home = stored(homes(queries, self.key, self.regions).drop("_reach"))
        parts = [stored(self.search(home))]
        # per query the sorted distances of its k best, a small array; the rows themselves are not rewritten
        near = stored(queries.select(*self.key).join(self.distances(parts[0]), self.key, "left"))
        pending, bounds = self.pending(home, near, tau)
        visits = self.visits(pending)
        if visits.pairs <= ROUND_WORK * max(1.0, visits.queries / _ROUND_QUERIES):
            self.report["rounds"] += 1
            return parts[0].unionByName(self.search(pending.join(bounds, self.key), visits))
        last, begin, step = pending.agg(F.max("_turn")).first()[0], 0, ROUND
        while begin <= last:
            due = pending.filter((F.col("_turn") >= begin) & (F.col("_turn") < begin + step))
            now = stored(due.join(self.bounded(near).drop("_near"), self.key).filter(F.col("_lower") <= _loose(F.col("_bound"))))
            visits = self.visits(now)
            if not visits.cells:  # the nearest regions left are too far for every query, so all others are
                break
            self.report["rounds"] += 1
            parts.append(stored(self.search(now, visits)))
            begin, step = begin + step, step * WIDER
            if begin <= last:
                active = now.select(*self.key).distinct()
                new = self.distances(parts[-1]).withColumnRenamed("_near", "_new")
                empty = F.array().cast("array<double>")
                merged = F.slice(F.array_sort(F.concat(F.coalesce("_near", empty), F.coalesce("_new", empty))), 1, self.keep)
                near = stored(near.join(active, self.key, "left_semi").join(new, self.key, "left").select(*self.key, merged.alias("_near")))
        return reduce(DataFrame.unionByName, parts)

    def distances(self, found: DataFrame) -> DataFrame:
        """(key, _near): the least distances found for each query, in order; a cell gives k at most."""
        return found.groupBy(*self.key).agg(F.slice(F.array_sort(F.collect_list("distance")), 1, self.keep).alias("_near"))

    def bounded(self, near: DataFrame) -> DataFrame:
        """With ``_bound``, the k-th distance, or the largest one allowed."""
        kth = F.coalesce(F.get("_near", F.lit(self.keep - 1)), F.lit(math.inf))
        return near.withColumn("_bound", F.least(kth, F.lit(self.most)))


def _loose(bound: Column) -> Column:
    """A bound that rounding cannot make too small; bounds are compared with bounds from other arithmetic."""
    return bound * (1 + 1e-9)


def knn_pairs(
    query: DataFrame,
    base: DataFrame,
    key: Sequence[str],
    features: Features,
    k: int = 5,
    base_key: Sequence[str] | None = None,
    aux_cols: Sequence[str] = (),
    max_distance: float = math.inf,
    exclude_self: bool = False,
    tau: float | None = None,
    pivots: int | None = None,
    seed: int = 0,
    recall: float | None = None,
    report: dict[str, int] | None = None,
) -> DataFrame:
    """Long form: (key…, nb_<base key>…, aux…, distance, rank), k nearest first.

    ``tau=None`` is exact.  A number routes approximately with that buffer; queries that it leaves short of k are
    answered exactly.  ``recall`` chooses the buffer that finds that share of the neighbours of a sample of the queries,
    or an exact search if the buffer visits over half of all pairs.  ``exclude_self`` drops the base row that has the
    query's own key.  ``pivots`` sets the number of regions.
    """
    base_key = list(base_key or key)
    approximate = tau is not None or recall is not None
    checked = base_key == list(key) and query.sameSemantics(base)
    counted = None
    if not approximate:
        rows, aux, vectors = _base_rows(base, base_key, features, aux_cols)
        nb = [f"nb_{c}" for c in base_key]
        counted = check_key(rows, nb, "base", "_v")
        kinds = [(query.schema[a].dataType, base.schema[b].dataType) for a, b in zip(key, base_key, strict=True)]
        plain = all(a == b and isinstance(a, _BOX_KEYS) for a, b in kinds)
        if plain and counted[0] > LARGE and counted[1] <= boxes.MOST_FEATURES and 0 < k <= boxes.MOST_NEAREST and max_distance > 0:
            if not checked:
                check_key(query, key, "query")
            asked = query.select(*key, as_array(query, features).alias("_v"))
            found = _Boxes(asked, rows, key, nb, k, max_distance, exclude_self, checked, report).run(*counted)
            if found is not None:
                return _named(found, key, aux, vectors)
    index = build_index(base, base_key, features, k + 1 if exclude_self else k, aux_cols, pivots, seed, approximate, counted)
    if tau is None and recall is not None:
        found = routing(query, index, key, features, k, exclude_self, seed, recall=recall)
        tau = found.tau if found.visited <= MOST_VISITED else None
    return search_index(query, index, key, features, k, max_distance, exclude_self, tau, checked, report)


@dataclass(frozen=True)
class Routing:
    """A buffer with what a sample says of it: the share of exact neighbours it finds, and of all pairs it visits."""

    tau: float
    recall: float
    visited: float
    queries: int
    pairs: int


def sampled_buffers(
    query: DataFrame, index: NeighbourIndex, key: Sequence[str], features: Features, k: int = 5, exclude_self: bool = False, seed: int = 0, sample: int = SAMPLE
) -> tuple[DataFrame, DataFrame]:
    """(queries, neighbours): about ``sample`` hash-drawn queries, and their exact neighbours (key…, nb…, distance, rank,
    buffer), ``buffer`` being the least with which routing visits the neighbour's region."""
    rows = max(1, query.count())
    drawn = checkpoint(query.filter(uniform(key, seed, "recall") < min(1.0, sample / rows)))
    exact = search_index(drawn, index, key, features, k, exclude_self=exclude_self, checked=True, region_col="_nb_region")
    asked = drawn.select(*key, as_array(drawn, features).alias("_v")).filter(_finite("_v"))
    if not index.regions.several:
        return drawn, checkpoint(exact.drop("_nb_region").withColumn("buffer", F.lit(0.0)))
    home = route(asked, list(key), index.regions, "home").select(*key, F.col("_lower").alias("_least"))
    places = pivot_table(index.assigned, index.regions).select(F.col("_region").alias("_nb_region"), "_pivot")
    there = exact.join(places, "_nb_region").join(asked, list(key)).join(home, list(key))
    extra = euclidean_distance(F.col("_v"), F.col("_pivot")) - F.col("_least")
    buffer = F.when(extra > 1e-9 * F.col("_least"), extra).otherwise(F.lit(0.0))
    return drawn, checkpoint(there.withColumn("buffer", buffer).drop("_nb_region", "_pivot", "_v", "_least"))


def routing(
    query: DataFrame, index: NeighbourIndex, key: Sequence[str], features: Features, k: int = 5, exclude_self: bool = False, seed: int = 0,
    tau: float | None = None, recall: float = 0.9, sample: int = SAMPLE,
) -> Routing:
    """What ``tau`` would find and visit, before the run; without it, the least buffer that finds ``recall``.

    A neighbour is found if its region is visited, so one exact search of a sample tells the recall of every buffer.
    """
    if not 0 < recall <= 1:
        raise ValueError("recall must be in (0, 1]")
    drawn, exact = sampled_buffers(query, index, key, features, k, exclude_self, seed, sample)
    pairs = exact.count()
    if tau is None:
        # the smallest buffer at or under which that share of the neighbours lies
        at = max(1, math.ceil(recall * pairs - 1e-9))
        row = exact.orderBy("buffer", *key, "rank").offset(at - 1).limit(1).first() if pairs else None
        tau = float(row["buffer"]) * (1 + 1e-9) if row else 0.0
    found = exact.filter(F.col("buffer") <= tau).count()
    asked = drawn.select(*key, as_array(drawn, features).alias("_v")).filter(_finite("_v"))
    queries, visited = asked.count(), 1.0
    if index.regions.several and queries:
        routed = route(asked, list(key), index.regions, "tau", tau).select("_region").join(pivot_table(index.assigned, index.regions), "_region")
        there = pivot_table(index.assigned, index.regions).agg(F.sum("_rows")).first()[0]
        visited = (routed.agg(F.sum("_rows")).first()[0] or 0) / (queries * max(1, there))
    return Routing(tau, found / pairs if pairs else 1.0, visited, queries, pairs)


def _same_key(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def nest_neighbours(
    query: DataFrame,
    pairs: DataFrame,
    key: Sequence[str],
    base_key: Sequence[str],
    aux_cols: Sequence[str],
    neighbors_col: str = "neighbors",
    distance_col: str | None = None,
) -> DataFrame:
    """Attach pairs to their query rows as arrays, nearest first; no hit leaves an empty array."""

    def source(c: str) -> Column:
        if c in base_key:
            return F.col(f"nb_{c}")
        return F.col(f"aux_{c}") if c in key else F.col(c)

    row = F.struct(*[source(c).alias(c) for c in aux_cols]).alias("row")
    hits = F.collect_list(F.struct("rank", row, "distance"))
    # compared by rank alone: neighbour rows may hold types without an order
    lists = pairs.groupBy(*key).agg(F.array_sort(hits, lambda a, b: a["rank"] - b["rank"]).alias("_hits"))
    out = query.join(lists, list(key), "left")
    hits = F.coalesce(F.col("_hits"), F.array().cast(lists.schema["_hits"].dataType))
    out = out.withColumn(neighbors_col, F.transform(hits, lambda h: h["row"]))
    if distance_col:
        out = out.withColumn(distance_col, F.transform(hits, lambda h: h["distance"]))
    return out.drop("_hits")


def knn_join(
    query: DataFrame,
    base: DataFrame,
    key: Sequence[str],
    features: Features,
    k: int = 5,
    base_key: Sequence[str] | None = None,
    aux_cols: Sequence[str] | None = None,
    max_distance: float = math.inf,
    neighbors_col: str = "neighbors",
    distance_col: str | None = None,
    **options: object,
) -> DataFrame:
    """Query rows with ``neighbors: array<struct<aux…>>``, nearest first; no hit leaves an empty array."""
    base_key = list(base_key or key)
    aux = list(aux_cols or base_key)
    pairs = knn_pairs(query, base, key, features, k, base_key, aux, max_distance, **options)
    return nest_neighbours(query, pairs, key, base_key, aux, neighbors_col, distance_col)


TAU_SAMPLES = tuple(range(100, 1001, 100))  # fixed values: sample sizes of the estimate


def tau_points(
    base: DataFrame, key: Sequence[str], features: Features, seed: int = 0, samples: Sequence[int] = TAU_SAMPLES, rows: int | None = None
) -> DataFrame:
    """(sample, n, mean nearest-neighbour distance among non-identical sampled points).

    Samples hold about ``samples[i]`` rows each, however large the table is.
    """
    n = rows or base.count()
    sized = F.array(
        *[F.struct(F.lit(i).alias("sample"), (uniform(key, seed, f"tau{i}") < min(1.0, s / n)).alias("drawn")) for i, s in enumerate(samples)]
    )
    drawn = base.select(as_array(base, features).alias("_v"), F.explode(F.filter(sized, lambda s: s["drawn"])).alias("s"))

    def run(table: pa.Table) -> pa.Table:
        v = matrix(table, "_v")
        nearest = []
        for rows in slabs(len(v), len(v)):
            square = np.zeros((len(v[rows]), len(v)))
            for j in range(v.shape[1]):
                gap = v[rows, j][:, None] - v[:, j]
                square += gap * gap
            square[square == 0] = np.inf
            nearest.append(square.min(1))
        nearest = np.concatenate(nearest)
        nearest = np.sqrt(nearest[np.isfinite(nearest)])
        mean = math.fsum(nearest) / len(nearest) if len(nearest) else None
        return pa.table(
            {
                "sample": pa.array([table.column("sample")[0].as_py()], pa.int32()),
                "n": pa.array([len(v)], pa.int64()),
                "mean_distance": pa.array([mean], pa.float64()),
            }
        )

    return (
        drawn.select("_v", F.col("s.sample").alias("sample"))
        .groupBy("sample")
        .applyInArrow(run, "sample int, n bigint, mean_distance double")
    )


def tau_fit(points: DataFrame, rows: int) -> DataFrame:
    """Extrapolate the sampled distances to the whole table: (slope, intercept, tau)."""
    x, y = F.log("n"), F.log("mean_distance")
    fit = (
        points.filter(F.col("mean_distance") > 0)
        .select("n", "mean_distance")
        .distinct()
        .agg(
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.max("mean_distance").alias("widest"),
        )
    )
    radius = F.exp(F.col("intercept") + F.col("slope") * F.lit(math.log(rows)))
    usable = F.col("slope") < 0
    return fit.select(
        "slope",
        "intercept",
        F.when(usable, radius / F.sqrt(F.lit(-1.0) / F.col("slope"))).otherwise(F.col("widest")).alias("tau"),
    )


def estimate_tau(
    base: DataFrame, key: Sequence[str], features: Features, seed: int = 0, samples: Sequence[int] = TAU_SAMPLES
) -> float:
    """A routing buffer from the data's density."""
    rows = base.count()
    tau = tau_fit(tau_points(base, key, features, seed, samples, rows), rows).first()["tau"]
    return float(tau or 0.0)
