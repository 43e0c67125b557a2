"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, which are written with sentinels in another order.

Texts are bytes in UTF-8. Only characters of several bytes are remembered (``Exceptions``): where they begin and how many
bytes they have beyond one. A cut in code points becomes one in bytes, or the other way round, by a binary search among
them; everything between two of them is arithmetic, and a text in ASCII has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.arrow import column, text_bytes, text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
UNITS = ("line", "char")


class Exceptions:
    """Characters of several bytes in some UTF-8 bytes: their first byte, and the excess bytes of all before each."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.r_[0, np.cumsum(excess)]
        self.chars = self.bytes - self.before[:-1]

    def chars_of(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte that begins a character."""
        return at - self.before[np.searchsorted(self.bytes, at)]

    def bytes_of(self, at: np.ndarray) -> np.ndarray:
        """The byte where each code point begins."""
        return at + self.before[np.searchsorted(self.chars, at)]


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end bytes of all lines ``[^\\n]*\\n|[^\\n]+``, first line of rows + 1 entries): a row's end also ends a line."""
    ends = np.flatnonzero(data == 10) + 1
    filled = offsets[1:][offsets[1:] > offsets[:-1]]
    ends = np.union1d(ends, filled)
    return ends, np.searchsorted(ends, offsets, side="right")


def cut_texts(texts: pa.Array, draws: list[np.ndarray], unit: str, rate: int, spm: int) -> list[pa.Array]:
    """(n, form, prefix_chars, middle_chars, output) of texts, from the four draws of each."""
    data, offsets = text_bytes(texts)
    exceptions = Exceptions(data)
    begin, end = offsets[:-1], offsets[1:]
    zero = exceptions.chars_of(begin)
    if unit == "line":
        ends, first = line_ends(data, offsets)
        n = np.diff(first)
        # the line before a row's first one ends where the row begins, or earlier if rows without text lie between
        byte = lambda k: np.where(k > 0, ends[np.clip(first[:-1] + k - 1, 0, max(0, len(ends) - 1))] if len(ends) else 0, begin)
    else:
        n = exceptions.chars_of(end) - zero
        byte = lambda k: exceptions.bytes_of(zero + k)
    cuts = [h % (n + 1) for h in draws[:2]]
    a, b = byte(np.minimum(*cuts)), byte(np.maximum(*cuts))
    chars_a, chars_b = exceptions.chars_of(a), exceptions.chars_of(b)
    raw = memoryview(np.ascontiguousarray(data))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    taken = draws[2] % 100 < rate
    first_suffix = draws[3] % 100 < spm
    forms, out = [], []
    for i, (w, x, y, z) in enumerate(zip(begin.tolist(), a.tolist(), b.tolist(), end.tolist(), strict=True)):
        text = bytes(raw[w:z])
        if not text or not taken[i] or any(m in text for m in marks):
            forms.append("plain")
            out.append(text)
        elif first_suffix[i]:
            forms.append("spm")
            out.append(b"".join((marks[1], raw[y:z], marks[0], raw[w:x], marks[2], raw[x:y])))
        else:
            forms.append("psm")
            out.append(b"".join((marks[0], raw[w:x], marks[1], raw[y:z], marks[2], raw[x:y])))
    plain = np.array([f == "plain" for f in forms], bool)
    return [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(chars_a - zero, pa.int64(), mask=plain), pa.array(chars_b - chars_a, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED
) -> DataFrame:
    """One row per row of ``df``: (key, n, form, prefix_chars, middle_chars, output).

    A text has ``n`` units: lines with their line feed, or code points. With h1 to h4 the first four groups of eight hex
    digits of the sha256 of ``seed:key``, the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the
    middle after the larger. ``output`` is the text itself (form ``plain``) if the text is empty, contains a sentinel, or
    h3 % 100 >= ``rate``; else suffix, prefix, middle (``spm``) if h4 % 100 < ``spm``, else prefix, suffix, middle
    (``psm``), each after its sentinel. The two counts are code points, null where the form is plain. A null text is
    empty, a null key is written as nothing; equal rows give equal rows. Other columns are not read.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text"):
            h = [column(batch, f"_h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
            yield pa.RecordBatch.from_arrays([column(batch, "_key"), *cut_texts(column(batch, "_text"), h, unit, rate, spm)], schema.names)

    made = (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))
    schema = T.StructType([docs.schema["_key"], *(T.StructField(c, t) for c, t in made)])
    return docs.mapInArrow(run, schema).withColumnRenamed("_key", key)


def restored(output: str, form: str) -> Column:
    """The text again, from what :func:`fill_in_middle` wrote: no text with a sentinel of its own is ever cut."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")  # nothing, then the three parts in their order
    part = lambda i: F.get(parts, F.lit(i))
    back = F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1)))
    return back.otherwise(F.col(output))
