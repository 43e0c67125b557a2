"""Arrow batches inside tasks: bounded slices of texts, and words as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes that one step of a task works on; a longer text makes a step of its own.
STEP_BYTES = 4 << 20

#: The bytes that separate words: space and U+0009 to U+000D. All are ASCII, so UTF-8 can be cut at them.
_WORDS = np.ones(256, np.int8)
_WORDS[[0x20, *range(0x09, 0x0E)]] = 0


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """One column as a single array."""
    found = batch.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of ``df``'s columns, whatever their case."""
    known, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def text_slices(batches: Iterator[pa.RecordBatch], text: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``step`` text bytes, so that memory does not follow the batch size."""
    for batch in batches:
        if batch.num_rows:
            size = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size, dtype=np.int64) // step
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, offsets of rows + 1 entries); nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def flat_tokens(texts: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of one kind (0 separates): (bytes, first byte, end byte, first token of rows + 1 entries)."""
    data, offsets = text_bytes(texts)
    kind = kinds[data]
    starts, ends = kind != 0, kind != 0
    if len(data):
        change = kind[1:] != kind[:-1]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        change[edge - 1] = True  # tokens end with their row
        starts[1:] &= change
        ends[:-1] &= change
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def flat_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows: (bytes, first byte, end byte, first word of rows + 1 entries)."""
    return flat_tokens(texts, _WORDS)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, … of all runs, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
