"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie.

Two fingerprints within d bits agree up to d // 2 bits in their first or in their last half. The trie is therefore
walked twice, once with each half on top: a pair of nodes is followed while its differing bits are at most d // 2 in the
upper half and d in all. The top of the walk is done by Spark: fingerprints go to cells (nodes of one depth), and a cell
meets only the cells whose paths are within the budget. Cells that hold many fingerprints are cut into chunks, so that no
task sees more than two chunks; the rest of the walk happens inside a task, on sorted arrays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.arrow import column, flat_words, ragged, text_slices, unused
from equipoise.llm.components import connected_components
from equipoise.llm.exact import one_of_each
from equipoise.sources.session import checkpoint

#: Fingerprints of a cell on average, of a chunk at most on average, and candidate pairs compared in one step.
CELL, CHUNK, STEP = 1024, 4096, 1 << 21
SALTS = 32
#: Bytes of a text whose shingles are counted at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(text: memoryview, words: int) -> Iterator[bytes]:
    """A long text in pieces of about ``PIECE`` bytes, cut between words, whose shingles together are those of the text."""
    start = 0
    while len(text) - start > PIECE:
        cut = start + PIECE
        while (found := _SPACE.search(text, cut)) and len(bytes(text[start : found.start()]).split(None, words)) < words:
            cut = start + 2 * (found.end() - start)
        if not found or found.end() == len(text):
            break
        piece = bytes(text[start : found.start()])
        yield piece
        # The next piece begins with the last words of this one, whose shingles it continues.
        start = start + len(piece.rsplit(None, words - 1)[0]) if words > 1 else found.end()
    if start == 0 or len(bytes(text[start:]).split(None, words)) >= words:
        yield bytes(text[start:])


def _bit_counts(texts: pa.Array, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many shingles set each bit: text x 64; shingles of each text)."""
    data, starts, ends, first = flat_words(texts)
    per = np.diff(first)
    shingles = np.where(per > 0, np.maximum(per - words + 1, 1), 0)
    sums = np.zeros((len(per), 64), np.int64)
    if not len(starts):
        return sums, shingles
    sizes = ends - starts
    joined = _LOWER[np.append(data, np.uint8(32))[ragged(starts, sizes + 1)]]
    stops = np.cumsum(sizes + 1) - 1
    joined[stops] = 32
    begins = stops - sizes
    a = ragged(first[:-1], shingles)
    b = np.minimum(a + words - 1, np.repeat(first[1:] - 1, shingles))
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(text[x:y], seed) for x, y in zip(begins[a].tolist(), stops[b].tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    rows = np.flatnonzero(shingles)
    sums[rows] = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[rows], axis=0, dtype=np.int32)
    return sums, shingles


def fingerprints_of(texts: pa.Array, words: int, seed: int) -> np.ndarray:
    """One unsigned 64-bit SimHash per text. No words: zero; fewer than ``words``: the whole sequence is one shingle.

    A text of over ``PIECE`` bytes is counted piece by piece, so that memory does not follow its length.
    """
    long = pc.fill_null(pc.greater(pc.binary_length(texts), PIECE), False)
    sums, shingles = _bit_counts(pc.if_else(long, "", texts) if long.true_count else texts, words, seed)
    for i in np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist():
        for piece in _pieces(memoryview(texts[i].as_buffer()), words):
            more, n = _bit_counts(pa.array([piece], pa.binary()), words, seed)
            sums[i] += more[0]
            shingles[i] += n[0]
    return np.packbits(2 * sums > shingles[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, seed: int = 42, out: str = "fingerprint") -> DataFrame:
    """``df`` without ``text``, with the SimHash of its ``words``-word shingles as a (signed) long.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, repeated shingles count as often as they occur. A shingle's
    hash is XXH64 of its words joined by a space; a bit is set if it is set in over half of the hashes. Nulls are empty.
    """
    rest = [f for f in df.schema if f.name not in (text, out)]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, 1 << 20):
            found = fingerprints_of(column(batch, text), words, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(found)], [*names, out])

    return df.select(*names, text).mapInArrow(run, T.StructType([*rest, T.StructField(out, T.LongType())]))


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest member of each set) after joining the sets of i and j."""
    while True:
        x, y = label[i], label[j]
        differ = x != y
        if not differ.any():
            return label
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def linked_sets(a: np.ndarray, b: np.ndarray | None, depth: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk the pairs of trie nodes below two nodes (b is None: one node with itself): (members, smallest linked one).

    ``a`` and ``b`` are sorted and distinct, each with one common path of ``depth`` bits. Only members with a link to
    another value are returned, under the order of the values.
    """
    same = b is None
    b = a if same else b
    place = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    label = place.copy()
    mask = np.uint64(0xFFFFFFFFFFFFFFFF)
    path = mask << np.uint64(64 - depth) if depth else np.uint64(0)
    error = int(np.bitwise_count((a[0] ^ b[0]) & path))
    pairs = tuple(np.array([x]) for x in (0, len(a), 0, len(b), error))
    while len(pairs[0]):
        al, ah, bl, bh, err = pairs
        size = (ah - al) * (bh - bl)
        small = (size <= 64) if depth < 64 else np.ones(len(size), bool)
        ends = np.cumsum(size[small])
        for part in np.split(np.flatnonzero(small), np.searchsorted(ends, np.arange(STEP, ends[-1], STEP)) if len(ends) else []):
            if len(part):
                k = ragged(np.zeros(len(part), np.int64), size[part])
                wide = np.repeat(bh[part] - bl[part], size[part])
                i, j = np.repeat(al[part], size[part]) + k // wide, np.repeat(bl[part], size[part]) + k % wide
                near = (np.bitwise_count(a[i] ^ b[j]) <= distance) & ((i < j) if same else True)
                label = _unite(label, i[near], j[near] + shift)
        if depth == 64 or small.all():
            break
        al, ah, bl, bh, err = (x[~small] for x in pairs)
        top = mask << np.uint64(64 - depth) if depth else np.uint64(0)
        bit = np.uint64(1) << np.uint64(63 - depth)
        am = np.clip(np.searchsorted(a, a[al] & top | bit), al, ah)
        bm = np.clip(np.searchsorted(b, b[bl] & top | bit), bl, bh)
        mirrored = same & (al == bl)
        budget = distance // 2 if depth < 32 else distance
        depth += 1
        found = []
        for x, y, more, ok in (((al, am), (bl, bm), 0, True), ((am, ah), (bm, bh), 0, True), ((al, am), (bm, bh), 1, True), ((am, ah), (bl, bm), 1, ~mirrored)):
            keep = (x[0] < x[1]) & (y[0] < y[1]) & (err + more <= budget) & ok
            found.append(np.stack([x[0], x[1], y[0], y[1], err + more])[:, keep])
        pairs = tuple(np.concatenate(found, axis=1))
    values = a if same else np.concatenate([a, b])
    linked = np.flatnonzero(label != place)
    return values[linked], values[label[linked]]


def links(values: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v): for distinct longs ``fingerprint``, links whose connected components are those of all pairs within ``distance`` bits.

    A task returns each member once with a member that it can reach, not all pairs of a group.
    """
    values = checkpoint(values.select("fingerprint"))
    depth = min(30, max(0, math.ceil(math.log2(max(1, values.count()) / CELL))))
    flips = [sum(1 << x for x in c) for n in range(distance // 2 + 1) for c in combinations(range(depth), n)]
    turned = F.expr("shiftleft(fingerprint, 32) | shiftrightunsigned(fingerprint, 32)")
    turns = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fingerprint").alias("key")), F.struct(F.lit(1).alias("turn"), turned.alias("key"))))
    cell = F.shiftrightunsigned("t.key", 64 - depth) if depth else F.lit(0).cast("long")
    keys = values.select(turns.alias("t")).select("t.turn", "t.key", cell.alias("cell"))
    cells = checkpoint(keys.groupBy("turn", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    near = cells.select("turn", F.col("cell").alias("home"), F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    near = near.select("turn", "home", F.col("home").bitwiseXOR(F.col("flip").cast("long")).alias("cell"))
    met = near.join(cells, ["turn", "cell"]).groupBy("turn", "home").agg(F.collect_list(F.struct("cell", "chunks")).alias("met"))
    homes = cells.select("turn", F.col("cell").alias("home"), F.col("chunks").alias("own")).join(met, ["turn", "home"])
    sent = keys.withColumnRenamed("cell", "home").join(homes, ["turn", "home"])
    chunk = F.pmod(F.xxhash64("key"), F.col("own")).cast("int")
    sent = sent.select("turn", "key", "home", chunk.alias("mine"), F.explode("met").alias("m"))
    sent = sent.select("turn", "key", "home", "mine", F.col("m.cell").alias("other"), F.explode(F.sequence(F.lit(0), F.col("m.chunks") - 1)).alias("theirs"))
    left = (F.col("home") < F.col("other")) | (F.col("home") == F.col("other")) & (F.col("mine") <= F.col("theirs"))
    ends = [F.when(left, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("c1", "home", "other"), ("k1", "mine", "theirs"), ("c2", "other", "home"), ("k2", "theirs", "mine"))]
    sent = sent.select("turn", *ends, (~left).alias("second"), "key")

    def walk(table: pa.Table) -> pa.Table:
        key = column(table, "key").to_numpy().view(np.uint64)
        second = column(table, "second").to_numpy(zero_copy_only=False)
        turn = table.column("turn")[0].as_py()
        one = (table.column("c1")[0], table.column("k1")[0]) == (table.column("c2")[0], table.column("k2")[0])
        a, b = np.sort(key[~second]), np.sort(key[second])
        found = linked_sets(a, None if one else b, depth, distance) if len(a) and (one or len(b)) else (key[:0], key[:0])
        back = [(x << np.uint64(32) | x >> np.uint64(32)) if turn else x for x in found]
        return pa.table({"u": back[0].view(np.int64), "v": back[1].view(np.int64)})

    return sent.groupBy("turn", "c1", "k1", "c2", "k2").applyInArrow(walk, "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``df``: (key, fingerprint as 16 hex digits, component_id).

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest key that can be reached, the
    row's own included (null keys count only where there is no other). Equal fingerprints meet salted; the links are
    sought between distinct ones. Other columns are not read.
    """
    docs = fingerprints(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", words, seed)
    docs = checkpoint(docs.withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")))
    salted = docs.groupBy("fingerprint", "salt").agg(F.min("_key").alias("least"))
    values = salted.groupBy("fingerprint").agg(F.min("least").alias("least"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    values = checkpoint(values)
    roots = connected_components(links(values, distance))
    held = values.join(roots, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint"))
    parts = held.groupBy("root").agg(F.min("least").alias("component_id"))
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.bit_get("salts", s) == 1)
    named = held.join(parts, "root").select("fingerprint", F.explode(salts).alias("salt"), "component_id")
    return docs.join(named, ["fingerprint", "salt"]).select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """``df`` with the row of the smallest key of each near-duplicate group; all columns stay.

    Rows that share a key stay or go together where their texts differ: they stay if the key is the smallest of any of
    their groups. Rows that repeat key and text leave one of them, whatever their other columns.
    """
    least, digest = unused(df, "_kept", "_digest")
    found = near_duplicates(df, key, text, **how).select(F.col(key).alias(least), F.col(key).eqNullSafe(F.col("component_id")).alias("stays"))
    kept = found.groupBy(least).agg(F.count("*").alias("count"), F.bool_or("stays").alias("stays")).where("stays")
    content = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    same = F.col(key).eqNullSafe(F.col(least))
    kept = checkpoint(kept)
    alone = df.join(kept.where("count = 1").select(least), same, "left_semi")
    shared = kept.where("count > 1").select(least)
    if shared.isEmpty():
        return alone
    rows = df.join(shared, same, "left_semi")
    texts = rows.groupBy(F.col(key).alias(least), content.alias(digest)).count()
    return alone.union(one_of_each(rows, texts, same & (content == F.col(digest)), [least, digest]))
