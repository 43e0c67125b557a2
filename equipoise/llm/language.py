"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.arrow import column, text_slices, unused
from equipoise.sources.session import checkpoint

#: Hash buckets of the n-grams, their lengths, and the additive smoothing.
BUCKETS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
#: The matrix that goes to every executor may not be larger than this.
MAX_MATRIX_BYTES = 256 << 20
UNKNOWN = "und"
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_STEP = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _hashed(codes: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Buckets of the ``n``-grams that begin at each code."""
    mixed = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for j in range(n):
        mixed += codes[j : len(mixed) + j] * _PRIMES[j]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _PRIMES[3] + np.uint64(2 * n)
    mixed >>= np.uint64(64 - (buckets - 1).bit_length())
    return mixed.astype(np.int64)


def gram_orders(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: (buckets of its n-grams, first n-gram of each text + 1 entries).

    Letters are lower-cased, all else is a space; runs of spaces count once, and a text begins and ends with one. A text
    with a letter has n-grams of every length, one without has none.
    """
    low = [f" {t.lower()} " if t else "" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    letter = _letters()[codes]
    has = np.bincount(row[letter], minlength=len(low)) > 0
    keep = (letter | np.append(True, letter[:-1]) | np.append(True, row[1:] != row[:-1]))[: len(codes)] & has[row]
    codes = np.where(letter, codes, 32).astype(np.uint64)[keep] + np.uint64(1)
    row = row[keep]
    for n in ORDERS:
        mixed = _hashed(codes, n, buckets)
        whole = row[: len(mixed)] == row[n - 1 :]
        yield mixed[whole], np.searchsorted(row[: len(mixed)][whole], np.arange(len(low) + 1))


def gram_pieces(text: str, buckets: int = BUCKETS, step: int = _STEP) -> Iterator[np.ndarray]:
    """The buckets that :func:`gram_orders` gives for one text, all lengths mixed, of about ``step`` characters at a time.

    A piece begins with the last codes of the piece before it, and its n-grams end in what is new.
    """
    low = f" {text.lower()} "
    tail, space, lettered = np.zeros(0, np.uint64), False, False
    lead = []  # the space before the first letter waits for one
    for at in range(0, len(low), step):
        codes = np.frombuffer(low[at : at + step].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        keep = letter | ~np.append(space, ~letter[:-1])
        space = not letter[-1]
        fresh = np.where(letter, codes, 32).astype(np.uint64)[keep] + np.uint64(1)
        lettered = lettered or bool(letter.any())
        if not lettered:
            lead.append(fresh)
            continue
        fresh = np.concatenate([*lead, fresh])
        lead = []
        known = np.concatenate([tail, fresh])
        for n in ORDERS:
            yield _hashed(known[max(0, len(tail) - n + 1) :], n, buckets)
        tail = known[len(known) - min(len(known), max(ORDERS) - 1) :]


def gram_buckets(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams of a text, one length after the other, text by text; first of each + 1 entries; whether it has a letter)."""
    orders = list(gram_orders(texts, buckets))
    found = np.concatenate([f for f, _ in orders])
    of = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(at)) for _, at in orders])
    order = np.argsort(of, kind="stable")
    offsets = np.searchsorted(of[order], np.arange(len(texts) + 1))
    return found[order], offsets, np.diff(offsets) > 0


def _grams(texts: list[str | None], buckets: int) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of the texts, a long text in pieces."""
    yield from (found for found, _ in gram_orders([t for t in texts if len(t or "") <= _STEP], buckets))
    for t in texts:
        if len(t or "") > _STEP:
            yield from gram_pieces(t, buckets)


@dataclass
class LanguageModel:
    """Languages in order, their log priors, and the log probability of each bucket (language x bucket)."""

    langs: list[str]
    prior: np.ndarray
    table: np.ndarray


def fit(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> LanguageModel:
    """Count the n-grams of every row with a text and a language, whatever their number.

    Each task adds up a count vector per language; sums by (language, bucket) reach the driver, ``buckets`` x languages
    numbers at most. A table without labelled rows gives a model that knows no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], ["lang", "bucket", "n"])
            sums.clear()

        for batch in text_slices(batches, text, _STEP):
            names = np.array(column(batch, lang).to_pylist(), object)
            texts = column(batch, text).to_pylist()
            for name in sorted(set(names)):
                mine = [texts[i] for i in np.flatnonzero(names == name)]
                n = sums.setdefault(name, np.zeros(buckets + 1, np.int64))
                for found in _grams(mine, buckets):
                    n[:buckets] += np.bincount(found, minlength=buckets)
                n[buckets] += len(mine)
            if len(sums) > 128:
                yield from flush()
        yield from flush()

    known = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    sums = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = checkpoint(sums)  # counted first, fetched then: the texts are read once
    sizes = sums.where(F.col("bucket") == buckets)
    langs = sizes.count()
    if langs * buckets * 8 > MAX_MATRIX_BYTES:
        raise ValueError(f"{langs} languages x {buckets} buckets are too large to send to every executor; use fewer buckets")
    found = sums.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    if not names:
        return LanguageModel([], np.zeros(0), np.zeros((0, buckets)))
    counts = np.zeros((len(names), buckets + 1))
    where = {name: i for i, name in enumerate(names)}
    counts[[where[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    docs, grams = counts[:, -1], counts[:, :-1]
    table = np.log(grams + SMOOTHING) - np.log(grams.sum(1, keepdims=True) + SMOOTHING * buckets)
    return LanguageModel(names, np.log(docs / docs.sum()), table)


def predict(
    df: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score", keep_text: bool = False
) -> DataFrame:
    """``df`` (without ``text`` unless ``keep_text``), with the likeliest language and its posterior probability.

    A text that is null or has no letter, and every text under a model without languages, gives ``und`` and 0. Ties go
    to the language that sorts first. Only ``text`` is looked at; other columns pass through.
    """
    rest = [f for f in df.schema if f.name not in (pred, score) and (keep_text or f.name != text)]
    names = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = np.array([*m.langs, UNKNOWN], object)
        for batch in text_slices(batches, text, _STEP):
            best, chance = np.full(batch.num_rows, len(m.langs)), np.zeros(batch.num_rows)
            texts, buckets = column(batch, text).to_pylist(), m.table.shape[1]
            long = [i for i, t in enumerate(texts) if len(t or "") > _STEP]
            sums, known = np.repeat(m.prior[:, None], len(texts), 1), np.zeros(len(texts), bool)
            for found, offsets in gram_orders([None if len(t or "") > _STEP else t for t in texts], buckets):
                rows = np.flatnonzero(np.diff(offsets))  # the texts with a letter, the same for every length
                known[rows] = True
                if len(rows) and m.langs:
                    sums[:, rows] += np.stack([np.add.reduceat(logs[found], offsets[rows]) for logs in m.table])
            for i in long:
                for found in gram_pieces(texts[i], buckets):
                    known[i] = True
                    sums[:, i] += m.table @ np.bincount(found, minlength=buckets)
            rows = np.flatnonzero(known)
            if len(rows) and m.langs:
                sums = sums[:, rows]
                top = sums.argmax(0)
                best[rows], chance[rows] = top, 1 / np.exp(sums - sums.max(0)).sum(0)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(langs[best], pa.string()), pa.array(chance)], [f.name for f in schema])

    return df.select(*names, *(() if keep_text else (text,))).mapInArrow(run, schema)


def identify(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from three quarters of the rows, predict all: (key, held_out, lang_pred, score).

    Rows whose crc32 of the key as text leaves 2 modulo 4 are held out (a null key never is).
    """
    held = held_out(key)
    model = fit(docs.where(~held), text, lang)
    return predict(docs.select(key, held.alias("held_out"), text), model, text)


def held_out(key: str) -> Column:
    """Rows whose crc32 of the key as text leaves 2 modulo 4; a null key never is."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def keep_identified(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.5) -> DataFrame:
    """``df`` without the rows whose language is ``und`` or less likely than ``min_score``; all columns stay.

    The model is learned from the rows of ``df`` that are not held out.
    """
    model = fit(df.where(~held_out(key)), text, lang)
    pred, score = unused(df, "_lang", "_score")
    found = predict(df, model, text, pred, score, keep_text=True)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).select(*df.columns)
