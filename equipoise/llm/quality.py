"""Quality classifier: random-indexing word vectors, pooled per document, and a small network with calibrated output.

Every hashed word has a sparse random index vector; its word vector is the sum of the index vectors of its neighbours all
over the corpus. The documents' pooled vectors are written once, and training and scoring both read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.arrow import column, flat_tokens, text_slices
from equipoise.llm.substrings import _word_hashes
from equipoise.sources.session import checkpoint

#: Hash buckets of the words, numbers of a vector, non-zero ones of an index vector, neighbours on each side.
BUCKETS, WIDTH, NONZERO, REACH = 1 << 14, 32, 2, 2
#: Rows of the vector table that travel as one message.
_ROWS, _STEP = 256, 1 << 20
#: Labelled rows that the network learns from, at most: those whose keys hash lowest.
MAX_TRAIN = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.01, 1e-4
SEED, THRESHOLD = 17, 0.3

#: Letters (and all other bytes of UTF-8 letters) make words, digits numbers, other signs runs of signs.
_KINDS = np.full(256, 3, np.int8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[48:58] = 2


def token_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every token, first token of rows + 1 entries). Case counts, digits are all alike; nulls are empty."""
    data, starts, ends, first = flat_tokens(texts, _KINDS)
    data = np.where(_KINDS[data] == 2, np.uint8(48), data)
    return (_word_hashes(data, starts, ends) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero numbers of every bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_vectors(df: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(vectors, counts) of all buckets over every text of ``df``.

    A task sums its texts into one table and sends it in pieces; a piece's sum is formed row by row as messages come in.
    What reaches the driver is the table itself, whose size is fixed.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        table, counts = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS)
        for batch in text_slices(batches, text, _STEP):
            bucket, first = token_buckets(column(batch, text))
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            counts += np.bincount(bucket, minlength=BUCKETS)
            for o in range(1, REACH + 1):
                near = np.flatnonzero(doc[:-o] == doc[o:]) if len(doc) > o else np.zeros(0, np.int64)
                for a, b in ((bucket[near], bucket[near + o]), (bucket[near + o], bucket[near])):
                    for k in range(NONZERO):
                        table += np.bincount(a * WIDTH + places[b, k], signs[b, k], BUCKETS * WIDTH)
        whole = np.hstack([table.reshape(BUCKETS, WIDTH), counts[:, None]]).astype(np.int64)
        if counts.any():
            pieces = [whole[i : i + _ROWS].tobytes() for i in range(0, BUCKETS, _ROWS)]
            yield pa.RecordBatch.from_pydict({"piece": list(range(len(pieces))), "data": pieces})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(column(batch, "piece").to_pylist(), column(batch, "data").to_pylist(), strict=True):
                one = np.frombuffer(data, np.int64)
                sums[piece] = sums[piece] + one if piece in sums else one.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"piece": list(sums), "data": [s.tobytes() for s in sums.values()]})

    kind = "piece long, data binary"
    sums = df.select(text).mapInArrow(gather, kind).repartition(min(16, BUCKETS // _ROWS), "piece").mapInArrow(add, kind)
    whole = np.zeros((BUCKETS, WIDTH + 1), np.int64)
    for r in sums.collect():
        whole[r["piece"] * _ROWS : (r["piece"] + 1) * _ROWS] = np.frombuffer(r["data"], np.int64).reshape(_ROWS, WIDTH + 1)
    return whole[:, :-1].astype(float), whole[:, -1].astype(float)


def weighted(vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a token adds to its document: the centred unit vector of its word, less for frequent words."""
    total = max(counts.sum(), 1.0)
    per = vectors / np.maximum(counts, 1)[:, None]
    per -= (per * counts[:, None]).sum(0) / total
    per /= np.maximum(np.linalg.norm(per, axis=1, keepdims=True), 1e-9)
    return (per * (1e-3 / (1e-3 + counts / total))[:, None]).astype(np.float32)


def pooled(df: DataFrame, table: np.ndarray, text: str = "text", out: str = "vector") -> DataFrame:
    """``df`` without ``text``, with the mean of its tokens' vectors, its norm, its length and its share of distinct words."""
    rest = [f for f in df.schema if f.name not in (text, out)]
    names = [f.name for f in rest]
    shared = df.sparkSession.sparkContext.broadcast(table)  # BUCKETS x WIDTH numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch in text_slices(batches, text, _STEP):
            bucket, first = token_buckets(column(batch, text))
            n = np.diff(first)
            found = np.zeros((batch.num_rows, WIDTH + 3), np.float32)
            rows = np.flatnonzero(n)
            if len(rows):
                found[rows, :WIDTH] = np.add.reduceat(vectors[bucket], first[rows], axis=0, dtype=np.float64) / n[rows, None]
                pairs = np.sort(np.repeat(np.arange(len(n)), n) * BUCKETS + bucket)
                distinct = np.bincount(pairs[np.r_[True, np.diff(pairs) > 0]] // BUCKETS, minlength=len(n))
                found[:, WIDTH] = np.linalg.norm(found[:, :WIDTH], axis=1) * np.sqrt(n)
                found[rows, WIDTH + 1] = np.log1p(n[rows])
                found[rows, WIDTH + 2] = distinct[rows] / n[rows] * np.sqrt(np.log1p(n[rows]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), lists], [*names, out])

    return df.select(*names, text).mapInArrow(run, T.StructType([*rest, T.StructField(out, T.ArrayType(T.FloatType()))]))


@dataclass
class Network:
    """Input scaling, two layers, and the temperature that its log odds are divided by."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit by Adam on four fifths of the rows, and the temperature on the rest. Without rows, every score is one half."""
    width = x.shape[1] if len(x) else WIDTH + 3
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    if not len(x):
        return Network(np.zeros(width), np.ones(width), [a * 0 for a in layers])
    apart = np.arange(len(x)) % 5 == 4
    fit, held = (x[~apart], y[~apart]), (x[apart], y[apart])
    net = Network(fit[0].mean(0), np.maximum(fit[0].std(0), 1e-6), layers)
    z = (fit[0] - net.mean) / net.scale
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in layers]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            i = order[at : at + BATCH]
            w1, b1, w2, b2 = layers
            h = np.tanh(z[i] @ w1 + b1)
            wrong = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -500, 500))) - fit[1][i]) / len(i)
            back = np.outer(wrong, w2) * (1 - h * h)
            slopes = [z[i].T @ back + DECAY * w1, back.sum(0), h.T @ wrong + DECAY * w2, np.array([wrong.sum()])]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for a, g, m in zip(layers, slopes, moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                a -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    if len(held[0]):
        odds = net.odds(held[0])
        tried = np.exp(np.linspace(-2, 3, 101))
        loss = [np.logaddexp(0, -np.where(held[1] > 0, 1, -1) * odds / t).mean() for t in tried]
        net.temperature = float(tried[int(np.argmin(loss))])
    return net


def sampled(known: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(_at, _key, _y, _n, vector): one row per label of ``known`` (_n: how often it is there) whose key has documents.

    The vector is the mean over the documents of that key, however many they are.
    """
    counted = known.groupBy("_at", "_key", "_y").agg(F.count("*").alias("_n"))
    mean = F.array(*(F.avg(F.get("vector", F.lit(i))) for i in range(WIDTH + 3)))
    return counted.join(vectors, F.col("_key") == F.col(key)).groupBy("_at", "_key", "_y", "_n").agg(mean.alias("vector"))


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs``: (key, held_out, score, predicted).

    Word vectors come from all texts. The network learns from at most ``max_train`` labelled rows (those whose keys hash
    lowest) of keys whose crc32 as text is not 0 modulo 5; a key that is null is neither held out nor labelled. ``score``
    is the calibrated probability of label 1, ``predicted`` is 1 from 0.3 on. Empty and null texts are scored too; a key
    labelled twice counts twice, and one on several documents is learned from their mean vector; without labels every score is 0.5. Other columns are not read.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(False))
    vectors = checkpoint(pooled(docs.select(key, text), weighted(*word_vectors(docs, text)), text))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"))
    known = known.withColumn("_at", F.xxhash64("_key")).orderBy("_at", "_key", "_y").limit(max_train)
    rows = sampled(known, vectors, key).toArrow().sort_by([("_at", "ascending"), ("_key", "ascending"), ("_y", "ascending")])
    times = rows.column("_n").to_numpy()
    x = np.array(rows.column("vector").combine_chunks().flatten(), float).reshape(len(rows), WIDTH + 3)
    net = train(np.repeat(x, times, axis=0), np.repeat(rows.column("_y").to_numpy(), times))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # two layers, a few kilobytes
    names = [key, "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = shared.value.score(np.array(column(batch, "vector").flatten(), float).reshape(batch.num_rows, -1))
                columns = [*(column(batch, c) for c in names), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    kinds = [vectors.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return vectors.select(key, held.alias("held_out"), "vector").mapInArrow(run, T.StructType(kinds))
