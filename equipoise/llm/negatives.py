"""Hard negatives of anchors: rows of another label that score nearly as high as a row of the anchor's own label.

Scores are inner products of whole numbers, found by the method of the Four Russians. A candidate is kept as the bit
planes of its components, eight dimensions to a byte. For every eight dimensions of some anchors all 256 sums of subsets of
their components are tabled; a plane's byte picks one, and the planes are added from the highest to the lowest, doubling in
between. Every pair of an anchor and a row gets its full, exact score, in blocks: anchors are copied to the blocks of
candidates, and both are cut so that a task holds a bounded block of each. Only the best rows of a block leave it.

Positives come first, each label on its own; the window of a negative's score follows from its positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equipoise.llm.arrow import column, ragged
from equipoise.sources.session import checkpoint

SCALE = 256
#: Rows of a block at most, and bytes that they may take; groups of labels that positives are looked for in.
CANDIDATES, ANCHORS, BLOCK_BYTES = 262_144, 16_384, 32 << 20
LABELS = 1024
#: Least candidates of a block where all cores could have one; bytes of the tables, and candidates scored in one step.
SMALL, TABLE_BYTES, STEP = 2048, 8 << 20, 256
#: Scores, times a hundred, stay below this.
_LIMIT = 1 << 62
_NO_ID = (1 << 63) - 1


def narrowest(most: int) -> type:
    """The smallest signed type that holds -most … most."""
    return next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)


def bit_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """rows x planes x bytes: bit p of eight components in one byte, the highest plane with the sign first."""
    bits = [np.packbits((vectors >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes - 1, -1, -1)]
    return np.stack(bits, axis=1)


def subset_tables(anchors: np.ndarray, kind: type) -> np.ndarray:
    """groups x 256 x anchors: the sum of each subset of the eight components of a group."""
    groups = -(-anchors.shape[1] // 8)
    padded = np.zeros((len(anchors), 8 * groups), kind)
    padded[:, : anchors.shape[1]] = anchors
    tables = np.zeros((groups, 256, len(anchors)), kind)
    for j in range(8):
        tables[:, 1 << j : 2 << j] = tables[:, : 1 << j] + padded[:, j::8].T[:, None, :]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray, kind: type) -> np.ndarray:
    """candidates x anchors: inner products, from a subset sum per plane and group."""
    n, anchors = len(planes), tables.shape[2]
    total = np.zeros((n, anchors), kind)
    part, picked = np.empty((n, anchors), tables.dtype), np.empty((n, anchors), tables.dtype)
    for p in range(planes.shape[1]):
        part[:] = 0
        for g in range(len(tables)):
            np.take(tables[g], planes[:, p, g], axis=0, out=picked, mode="clip")
            part += picked
        if p == 0:
            total -= part  # the plane of the sign
        else:
            total += total
            total += part
    return total


def first_of_each(group: np.ndarray, order: Sequence[np.ndarray], most: int) -> np.ndarray:
    """Places of the first ``most`` members of each group by the keys of ``order`` (the most important first)."""
    at = np.lexsort((*reversed(order), group))
    g = group[at]
    return at[np.arange(len(g)) - np.searchsorted(g, g, side="left") < most]


def fixed_rows(table: pa.Table, name: str) -> np.ndarray:
    """The bytes of a binary column whose values are equally long: one row each."""
    values = column(table, name).cast(pa.large_binary())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(len(values), -1)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return column(table, name).to_numpy(zero_copy_only=False)


class Held:
    """The best candidates of each group so far, and the score that a further one needs."""

    def __init__(self, bars: np.ndarray, most: int):
        self.bars, self.most = bars, most
        self.group, self.candidate, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, candidate: np.ndarray, score: np.ndarray, ties: Sequence[np.ndarray]) -> None:
        """``ties`` order candidates of equal score. Nothing under a group's bar may be added."""
        group, candidate, score = (np.concatenate(x) for x in ((self.group, group), (self.candidate, candidate), (self.score, score)))
        at = first_of_each(group, (-score, *(t[candidate] for t in ties)), self.most)
        self.group, self.candidate, self.score = group[at], candidate[at], score[at]
        count = np.bincount(self.group, minlength=len(self.bars))
        full = count == self.most
        self.bars[full] = self.score[np.cumsum(count)[full] - 1]


class Blocks:
    """Scoring of one block of anchors against one of candidates."""

    def __init__(self, dims: int, planes: int, most: int):
        self.planes, self.groups = planes, max(1, -(-dims // 8))
        self.part = narrowest(8 * self.groups * most)  # of a plane's sum
        self.total = narrowest(8 * self.groups * most * most)
        self.number = narrowest(most)

    def anchors(self, table: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
        """(some anchors, their tables of subset sums)."""
        vectors = fixed_rows(table, "_v").view(self.number)
        width = max(1, TABLE_BYTES // (256 * self.groups * np.dtype(self.part).itemsize))
        for a in range(0, len(vectors), width):
            yield slice(a, min(a + width, len(vectors))), subset_tables(vectors[a : a + width], self.part)

    def scored(self, tables: np.ndarray, candidates: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
        """(some candidates, their scores with all anchors of the tables)."""
        packed = fixed_rows(candidates, "_planes").reshape(-1, self.planes, self.groups)
        for c in range(0, len(packed), STEP):
            yield slice(c, c + STEP), scores(tables, packed[c : c + STEP], self.total)


def best_positives(blocks: Blocks, anchors: pa.Table, candidates: pa.Table, most: int) -> pa.Table:
    """(_anchor, _other, _id, score): of each anchor the ``most`` best other rows of its label in this block."""
    row, label = numbers(anchors, "_row"), numbers(anchors, "_label")
    other, ids, kind = (numbers(candidates, c) for c in ("_row", "_id", "_label"))
    parts = [[np.zeros(0, np.int64)] * 4]
    for a, tables in blocks.anchors(anchors) if candidates.num_rows else ():
        held = Held(np.full(a.stop - a.start, np.iinfo(np.int64).min), most)
        for c, s in blocks.scored(tables, candidates):
            i, j = np.nonzero((s >= held.bars) & (kind[c, None] == label[None, a]) & (other[c, None] != row[None, a]))
            if len(i):
                held.add(j, c.start + i, s[i, j].astype(np.int64), (ids, other))
        parts.append([row[a][held.group], other[held.candidate], ids[held.candidate], held.score])
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["_anchor", "_other", "_id", "score"])


def best_negatives(blocks: Blocks, anchors: pa.Table, candidates: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """(_anchor, _place, _id, score): for each anchor and positive the ``most`` best rows of another label in its window."""
    row, label = numbers(anchors, "_row"), numbers(anchors, "_label")
    ids, kind = numbers(candidates, "_id"), numbers(candidates, "_label")
    lists = column(anchors, "_scores")
    positives, width = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    least, largest = -(-low * positives // 100), high * positives // 100  # the whole numbers at the ends of the windows
    begin = np.r_[0, np.cumsum(width)]
    parts = [[np.zeros(0, np.int64)] * 4]
    for a, tables in blocks.anchors(anchors) if candidates.num_rows else ():
        first, last = begin[a.start], begin[a.stop]
        held = Held(least[first:last].copy(), most)
        opens, wide = begin[a] - first, width[a]
        for c, s in blocks.scored(tables, candidates):
            floor = np.minimum.reduceat(held.bars, opens)  # every anchor here has a positive
            i, j = np.nonzero((s >= floor) & (kind[c, None] != label[None, a]))
            # such a pair may be in any window of its anchor
            k = np.repeat(np.arange(len(i)), wide[j])
            window = ragged(opens[j], wide[j])
            score = s[i, j].astype(np.int64)[k]
            inside = (score >= held.bars[window]) & (score <= largest[first:last][window])
            if inside.any():
                held.add(window[inside], c.start + i[k[inside]], score[inside], (ids,))
        owner = np.searchsorted(opens, held.group, side="right") - 1
        parts.append([row[a][owner], held.group - opens[owner], ids[held.candidate], held.score])
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["_anchor", "_place", "_id", "score"])


def _dealt(
    anchors: DataFrame, candidates: DataFrame, part: Column, parts: int, sizes: tuple[dict[int, int], dict[int, int]], rows: tuple[int, int]
) -> tuple[DataFrame, DataFrame, int]:
    """Both tables with (_part, _salt, _chunk), dealt so that no block of a part has more than ``rows`` on average; the cells."""
    per_anchor, per_candidate = sizes
    chunks = [math.ceil(per_anchor.get(i, 0) / rows[0]) if per_candidate.get(i) else 0 for i in range(parts)]
    salts = [math.ceil(per_candidate.get(i, 0) / rows[1]) if per_anchor.get(i) else 0 for i in range(parts)]
    of = lambda xs: F.get(F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>"), F.col("_part"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("_row"), n).cast("int")
    a = anchors.withColumn("_part", part).withColumn("_n", of(salts)).where("_n > 0").select("*", own(of(chunks)).alias("_chunk"), every(F.col("_n")).alias("_salt")).drop("_n")
    c = candidates.withColumn("_part", part).withColumn("_n", of(chunks)).where("_n > 0").select("*", own(of(salts)).alias("_salt"), every(F.col("_n")).alias("_chunk")).drop("_n")
    return a, c, sum(x * y for x, y in zip(chunks, salts, strict=True))


def hard_negatives(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores as long.

    A component x counts as floor(scale * x), a score is the inner product with the anchor; anchors are the rows whose
    whole-number key is divisible by ``every``. Rows are ordered by score, highest first, then by key (null last). An
    anchor's positives are its first ``positives`` other rows of the same label; the negatives of a positive are the first
    ``negatives`` rows of another label with low * p <= 100 * score <= high * p, ranked from 1.

    Rows with a null label, vector or component, or one that is not finite, take no part. A shorter vector counts as
    filled up with zeros. Rows that share a key are rows of their own: each such anchor has its results, each is a positive.
    An anchor without a positive, or a positive without a negative, gives no row, nor does an empty table. Labels are
    whole numbers. Other columns are not read. Vectors whose scores, times 100, could leave 62 bits are refused.
    """
    spark = df.sparkSession
    good = F.col(vector).isNotNull() & F.col(label).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == math.inf))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = df.where(good).select(F.col(key).cast("long").alias("_key"), F.col(label).cast("long").alias("_label"), whole.alias("_x"))
    limits = rows.agg(F.min(F.array_min("_x")).alias("least"), F.max(F.array_max("_x")).alias("most"), F.max(F.size("_x")).alias("dims"), F.count("*").alias("n")).first()
    n, dims = limits["n"], limits["dims"] or 0
    least, most = limits["least"] or 0, limits["most"] or 0
    planes = max(1, (most if most >= 0 else ~most).bit_length(), (least if least >= 0 else ~least).bit_length()) + 1
    size = 1 << (planes - 1)
    if 100 * (dims + 8) * size * size >= _LIMIT:
        raise ValueError(f"components of {least} to {most} in {dims} dimensions: scores would not fit a long")
    blocks = Blocks(dims, planes, size)
    width, groups = 8 * blocks.groups, blocks.groups

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "_x")
            count = lists.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((len(count), width), blocks.number)
            x[np.arange(width)[None, :] < count[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            anchor = column(batch, "_is").to_numpy(zero_copy_only=False)
            packed = bit_planes(x, planes)
            made = [pa.array([x[i].tobytes() if anchor[i] else None for i in range(len(x))], pa.binary()), pa.array([p.tobytes() for p in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), *made], [*names, "_v", "_planes"])

    names = ["_row", "_key", "_id", "_label"]
    is_anchor = F.coalesce(F.col("_key") % every == 0, F.lit(False))
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "_key", F.coalesce("_key", F.lit(_NO_ID)).alias("_id"), "_label", is_anchor.alias("_is"), "_x")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = checkpoint(rows.mapInArrow(pack, ", ".join(f"{c} {kinds[c]}" for c in names) + ", _v binary, _planes binary"))
    candidates = rows.select("_row", "_id", "_label", "_planes")
    anchors = rows.where("_v IS NOT NULL").select("_row", "_label", "_v")

    cores = 2 * spark.sparkContext.defaultParallelism
    per_anchor = max(1, min(ANCHORS, BLOCK_BYTES // max(1, width * np.dtype(blocks.number).itemsize)))
    per_candidate = max(1, min(CANDIDATES, BLOCK_BYTES // max(1, planes * groups), max(SMALL, math.ceil(n / cores))))
    part = F.pmod(F.xxhash64("_label"), F.lit(LABELS)).cast("int")

    def counted(table: DataFrame) -> dict[int, int]:
        return {r["p"]: r["count"] for r in table.groupBy(part.alias("p")).count().collect()}

    def search(a: DataFrame, c: DataFrame, cells: int, run, schema: str) -> DataFrame:  # noqa: ANN001
        # an explicit number: blocks are small in bytes but heavy to compute, so they must not be merged
        many = max(1, min(cells, max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        cell = ("_part", "_salt", "_chunk")
        return a.repartition(many, *cell).groupBy(*cell).cogroup(c.repartition(many, *cell).groupBy(*cell)).applyInArrow(run, schema)

    sizes = counted(anchors), counted(candidates)
    own = _dealt(anchors, candidates, part, LABELS, sizes, (per_anchor, per_candidate))
    near = search(*own, lambda a, c: best_positives(blocks, a, c, positives), "_anchor long, _other long, _id long, score long")
    order = Window.partitionBy("_anchor").orderBy(F.desc("score"), "_id", "_other")
    near = checkpoint(near.withColumn("_place", F.row_number().over(order) - 1).where(F.col("_place") < positives))

    # array_sort: by place, which is the order that the search of negatives counts windows in
    held = F.transform(F.array_sort(F.collect_list(F.struct("_place", "score"))), lambda x: x["score"])
    asking = anchors.join(near.groupBy(F.col("_anchor").alias("_row")).agg(held.alias("_scores")), "_row")
    whole_size = {0: sum(sizes[0].values())}, {0: n}
    asking = asking.select(*(F.col(c).alias(c) for c in asking.columns))  # both sides come from the same rows
    every_pair = _dealt(asking, candidates, F.lit(0), 1, whole_size, (per_anchor, per_candidate))
    far = search(*every_pair, lambda a, c: best_negatives(blocks, a, c, negatives, low, high), "_anchor long, _place long, _id long, score long")
    order = Window.partitionBy("_anchor", "_place").orderBy(F.desc("score"), "_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)

    real = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    pairs = near.select("_anchor", "_place", real("_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = rows.where("_v IS NOT NULL").select(F.col("_row").alias("_anchor"), F.col("_key").alias("anchor_id"))
    out = far.select("_anchor", "_place", "rank", real("_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["_anchor", "_place"]).join(ids, "_anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
