"""Removal of word sequences that an earlier document already has.

A window of 13 words holds exactly one of the non-overlapping 7-word blocks of its document. The first word of each block
is an anchor: blocks are indexed by their hash, every rolling window of 7 words of every document probes the index, and
a block that is met anywhere else is alive; what collides by chance or design is only looked at in vain. Only the 13-word
windows around live blocks can repeat. Their words are compared by a cryptographic digest (BLAKE2b, 128 bits) of the words
themselves; digests meet, each with the smallest document that has it, and runs of repeated windows are the maximal
exact repeats.

Index and probes travel as sorted, packed sets, one per unit of documents and range of hashes: a passage in a third of
all documents is sent once per unit. A range answers with one bit per entry. Texts are shuffled once, by unit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.arrow import column, flat_words, ragged

#: Text bytes of a unit and of a step within it.
UNIT, STEP = 8 << 20, 1 << 20
_LAST = np.iinfo(np.int64).max
_MULTIPLIER = 0x9E3779B97F4A7C15
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_MESSAGE = "unit int, range int, kind int, n long, data binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(33)
    h = h * np.uint64(_MIX[0])
    h = h ^ h >> np.uint64(29)
    h = h * np.uint64(_MIX[1])
    return h ^ h >> np.uint64(32)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, for anchors: a polynomial of the bytes modulo 2**64 from prefix sums, then mixed."""
    base = _MULTIPLIER
    inverse = pow(base, -1, 1 << 64)
    powers = np.full(len(data) + 1, base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    powers = np.full(len(data) + 1, inverse, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return _mixed((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64) * np.uint64(_MIX[1]))


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; empty if there are fewer."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(_MULTIPLIER) + words[j : j + n]
    return _mixed(h)


def _pack(values: np.ndarray) -> bytes:
    """A sorted array of unsigned 64-bit numbers: differences, byte by byte."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data, max_output_size=8 * n + 64), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64)


def _plain(values: np.ndarray) -> bytes:
    kind = np.uint8(values.dtype.itemsize)
    return bytes([kind]) + zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, kind).T).tobytes(), 1)


def _unplain(data: bytes, n: int, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:], max_output_size=8 * n + 64), np.uint8).reshape(data[0], n)
    return np.ascontiguousarray(planes.T).view(dtype)[:, 0] if n else np.zeros(0, dtype)


def _messages(rows: list[tuple[int, int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["unit", "range", "kind", "n", "data"])


class _Unit:
    """Words of the documents of a unit, in the order of their keys (null last), so that every phase sees the same."""

    def __init__(self, table: pa.Table, key: str, text: str):
        keys = column(table, key).cast(pa.int64())
        texts = column(table, text)
        ids = keys.fill_null(_LAST).to_numpy(zero_copy_only=False)
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        order = np.lexsort((sizes, ids))
        self.keys, self.texts, self.ids = keys.take(pa.array(order)), texts.take(pa.array(order)), ids[order]
        ends = np.cumsum(sizes[order], dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // STEP)) + 1).tolist(), len(ids)]
        self.steps = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]

    def hashes(self) -> np.ndarray:
        """Hashes of all words; sets ``first``, the first word of each document."""
        parts, counts = [], []
        for a, b in self.steps:
            data, starts, ends, first = flat_words(self.texts.slice(a, b - a))
            parts.append(_word_hashes(data, starts, ends))
            counts.append(np.diff(first))
        self.first = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def digests(self, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the digest of the ``size`` words from each of the (sorted) windows on, joined by one space."""
        parts = [np.zeros((0, 2), np.uint64)]
        for a, b in self.steps:
            here = windows[np.searchsorted(windows, self.first[a]) : np.searchsorted(windows, self.first[b])] - self.first[a]
            if len(here):
                data, starts, ends, _ = flat_words(self.texts.slice(a, b - a))
                sizes = ends - starts
                text = np.append(data, np.uint8(32))[ragged(starts, sizes + 1)]
                stops = np.cumsum(sizes + 1) - 1
                text[stops] = 32
                text, begins = text.tobytes(), stops - sizes
                digest = hashlib.blake2b
                found = [digest(text[x:y], digest_size=16).digest() for x, y in zip(begins[here].tolist(), stops[here + size - 1].tolist(), strict=True)]
                parts.append(np.frombuffer(b"".join(found), "<u8").reshape(-1, 2))
        both = np.concatenate(parts)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def inside(self, size: int, window: int) -> np.ndarray:
        """Words from which ``size`` words of the same document go on, in documents that have a window."""
        n = max(0, len(self.doc) - size + 1)
        long_enough = (np.diff(self.first) >= window)[self.doc[:n]]
        return np.flatnonzero((self.doc[:n] == self.doc[size - 1 :]) & long_enough)


class _Search:
    """The phases, for windows of ``window`` words, ``ranges`` ranges and ``bits`` bits of an anchor's hash."""

    def __init__(self, window: int, ranges: int, bits: int, key: str, text: str):
        self.window, self.block, self.ranges, self.bits = window, (window + 1) // 2, ranges, bits
        self.key, self.text = key, text

    def edges(self, sorted_high: np.ndarray, bits: int) -> np.ndarray:
        """Where each range begins in sorted hashes of ``bits`` bits, and the end."""
        limits = [min((i << bits) // self.ranges, (1 << 64) - 1) for i in range(1, self.ranges)]
        return np.r_[0, np.searchsorted(sorted_high, np.array(limits, np.uint64)), len(sorted_high)]

    def anchors(self, unit: _Unit, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct probes with two low bits, places of own blocks, their hashes). Bits: 1 a block here, 2 met twice here."""
        rolled = _rolling(words, self.block) >> np.uint64(64 - self.bits)
        places = unit.inside(self.block, self.window)
        own = places[(places - unit.first[unit.doc[places]]) % self.block == 0]
        is_own = np.zeros(len(rolled), np.uint64)
        is_own[own] = 1
        probes = np.sort(rolled[places] << np.uint64(1) | is_own[places])
        new = np.r_[True, probes[1:] >> np.uint64(1) != probes[:-1] >> np.uint64(1)] if len(probes) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        count = np.diff(np.r_[at, len(probes)])
        last = probes[at + count - 1]  # the block bit of a hash sorts last
        distinct = last >> np.uint64(1) << np.uint64(2) | last & np.uint64(1) | (count > 1).astype(np.uint64) << np.uint64(1)
        return distinct, own, rolled[own]

    def ask_blocks(self, key: tuple, table: pa.Table) -> pa.Table:
        """Phase 1: index entries and probes of a unit, cut into ranges."""
        unit = _Unit(table, self.key, self.text)
        distinct, _, _ = self.anchors(unit, unit.hashes())
        edges = self.edges(distinct >> np.uint64(2), self.bits)
        cut = zip(range(self.ranges), edges[:-1], edges[1:], strict=True)
        return _messages([(key[0].as_py(), r, 0, int(b - a), _pack(distinct[a:b])) for r, a, b in cut if b > a])

    def answer_blocks(self, key: tuple, table: pa.Table) -> pa.Table:
        """A range: which entries of each unit are blocks somewhere and occur twice or more."""
        units, ns, data = (table.column(c).to_pylist() for c in ("unit", "n", "data"))
        every = np.concatenate([_unpack(d, n) for d, n in zip(data, ns, strict=True)])
        order = np.argsort(every >> np.uint64(2), kind="stable")
        entries = every[order]
        new = np.flatnonzero(np.r_[True, entries[1:] >> np.uint64(2) != entries[:-1] >> np.uint64(2)])
        count = np.diff(np.r_[new, len(entries)])
        flags = np.bitwise_or.reduceat(entries & np.uint64(3), new)
        alive = np.zeros(len(every), bool)
        alive[order] = np.repeat((flags & np.uint64(1) > 0) & ((count > 1) | (flags & np.uint64(2) > 0)), count)
        ends = np.cumsum(ns)
        return _messages([(u, key[0].as_py(), 0, n, np.packbits(alive[e - n : e]).tobytes()) for u, n, e in zip(units, ns, ends, strict=True)])

    @staticmethod
    def bits_of(answers: pa.Table, kind: int) -> np.ndarray:
        """One bit per entry that the unit sent, in the order of the ranges."""
        rows = [r for r in answers.to_pylist() if r["kind"] == kind]
        rows.sort(key=lambda r: r["range"])
        parts = [np.unpackbits(np.frombuffer(r["data"], np.uint8), count=r["n"]).astype(bool) for r in rows]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def candidates(self, unit: _Unit, words: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first words of windows around live blocks, digests, checks, order, begins of equal digests in that order)."""
        distinct, own, hashes = self.anchors(unit, words)
        known = (distinct >> np.uint64(2))[alive]
        live = own[np.isin(hashes, known)] if len(known) else own[:0]
        back = np.arange(self.block)
        near = np.zeros(len(words) + self.block, bool)
        for j in back:
            near[np.maximum(live - j, 0)] = True
        windows = unit.inside(self.window, self.window)
        windows = windows[near[windows]]
        digest, check = unit.digests(windows, self.window)
        order = np.lexsort((windows, check, digest))
        d, c = digest[order], check[order]
        begins = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])]) if len(d) else np.zeros(0, np.int64)
        return windows, digest, check, order, begins

    def ask_windows(self, key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Phase 2: digests of the candidate windows of a unit, each with its smallest document here."""
        unit, me = _Unit(table, self.key, self.text), key[0].as_py()
        alive = self.bits_of(answers, 0)
        windows, digest, check, order, begins = self.candidates(unit, unit.hashes(), alive)
        at = order[begins]  # of equal windows the first one is of the smallest document
        digest, check, least = digest[at], check[at], unit.ids[unit.doc[windows[at]]]
        edges = self.edges(digest, 64)
        cut = zip(range(self.ranges), edges[:-1], edges[1:], strict=True)
        rows = [(me, -1 - me % self.ranges, 0, len(alive), np.packbits(alive).tobytes())]  # a note to itself
        for r, a, b in cut:
            if b > a:
                parts = [_pack(digest[a:b]), _plain(check[a:b]), _plain(least[a:b])]
                rows.append((me, r, 1, int(b - a), b"".join(len(p).to_bytes(4, "little") + p for p in parts)))
        return _messages(rows)

    def answer_windows(self, key: tuple, table: pa.Table) -> pa.Table:
        """A range: which windows of each unit start in a smaller document of another unit. Notes go back as they are."""
        if key[0].as_py() < 0:
            return table.select(["unit", "range", "kind", "n", "data"])
        units, ns = table.column("unit").to_pylist(), table.column("n").to_pylist()
        parts: list[list[np.ndarray]] = [[], [], []]
        for data, n in zip(table.column("data").to_pylist(), ns, strict=True):
            at = 0
            for part, read in zip(parts, (_unpack, lambda d, n: _unplain(d, n, np.uint64), lambda d, n: _unplain(d, n, np.int64)), strict=True):
                size = int.from_bytes(data[at : at + 4], "little")
                part.append(read(data[at + 4 : at + 4 + size], n))
                at += 4 + size
        digest, check, least = map(np.concatenate, parts)
        order = np.lexsort((least, check, digest))
        d, c = digest[order], check[order]
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
        first = np.repeat(least[order[new]], np.diff(np.r_[new, len(d)]))
        earlier = np.zeros(len(d), bool)
        earlier[order] = first < least[order]
        ends = np.cumsum(ns)
        return _messages([(u, key[0].as_py(), 1, n, np.packbits(earlier[e - n : e]).tobytes()) for u, n, e in zip(units, ns, ends, strict=True)])

    def cut_out(self, key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Phase 3: the repeats of each document, and its other words."""
        unit = _Unit(table, self.key, self.text)
        words = unit.hashes()
        windows, _, _, order, begins = self.candidates(unit, words, self.bits_of(answers, 0))
        elsewhere = self.bits_of(answers, 1)
        ids = unit.ids[unit.doc[windows]] if len(windows) else np.zeros(0, np.int64)
        count = np.diff(np.r_[begins, len(order)])
        least = np.repeat(ids[order[begins]], count)
        gone = windows[order[np.repeat(elsewhere, count) | (ids[order] > least)]]
        change = np.zeros(len(unit.doc) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.subtract.at(change, gone + self.window, 1)
        removed = np.cumsum(change[:-1]) > 0
        before = np.r_[0, np.cumsum(removed)]
        n_words = np.diff(unit.first)
        n_removed = before[unit.first[1:]] - before[unit.first[:-1]]
        edge = np.r_[True, unit.doc[1:] != unit.doc[:-1]] if len(removed) else removed
        opens = np.flatnonzero(removed & (edge | ~np.r_[False, removed[:-1]])) if len(removed) else np.zeros(0, np.int64)
        closes = np.flatnonzero(removed & (np.r_[edge[1:], True] | ~np.r_[removed[1:], False])) + 1 if len(removed) else opens
        doc = unit.doc[opens]
        spans = pa.StructArray.from_arrays([pa.array(x - unit.first[doc], pa.int32()) for x in (opens, closes)], ["begin", "end"])
        offsets = pa.array(np.searchsorted(doc, np.arange(len(n_words) + 1)), pa.int32())
        kept = [self.joined(unit.texts.slice(a, b - a), ~removed[unit.first[a] : unit.first[b]]) for a, b in unit.steps]
        columns = [unit.keys, pa.array(n_words), pa.array(n_removed, pa.int64()), pa.ListArray.from_arrays(offsets, spans), pa.chunked_array(kept, pa.string())]
        return pa.table(columns, names=[self.key, "n_words", "n_removed", "spans", "kept"])

    @staticmethod
    def joined(texts: pa.Array, keep: np.ndarray) -> pa.Array:
        """The words to keep of each text, joined by one space."""
        data, starts, ends, first = flat_words(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))[keep]
        starts, sizes = starts[keep], ends[keep] - starts[keep]
        out = np.append(data, np.uint8(32))[ragged(starts, sizes + 1)]
        stops = np.cumsum(sizes + 1) - 1
        out[stops] = 32
        last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
        drop = np.zeros(len(out), bool)
        drop[stops[last]] = True
        per = np.bincount(doc, weights=sizes + 1 - last, minlength=len(texts)).astype(np.int64)
        offsets = np.r_[0, np.cumsum(per)].astype(np.int32)
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(out[~drop].tobytes()))


def unit_of(key: str, text: str, units: int) -> Column:
    """The unit of a row follows from its key and its text, so rows that share a key, or have none, are spread."""
    return F.pmod(F.xxhash64(key, text), F.lit(units)).cast("int")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """One row per row of ``df``: (key, n_words, n_removed, spans, kept).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. ``spans`` are the maximal runs (begin, end) of words covered by windows
    of ``window`` (odd) words whose sequence also starts in a document with a smaller integer key; ``kept`` are the other
    words joined by a space. Windows are judged on the input. A null text has no words; a null key counts as the
    largest; rows that share a key never cut each other. Other columns are not read.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd, and 3 at least")
    docs = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units, ranges = max(-(-size // UNIT), 2 * parts), max(-(-size // UNIT), parts)
    bits = min(61, max(16, size.bit_length()) + 16)  # one chance probe in 65,536 meets a block that is not its own
    search = _Search(window, ranges, bits, "_key", "_text")
    docs = docs.select(unit_of("_key", "_text", units).alias("unit"), "_key", "_text").repartition(parts, "unit")  # one exchange, which all three phases read

    asked = docs.groupBy("unit").applyInArrow(lambda k, t: search.ask_blocks(k, t), _MESSAGE)
    live = asked.groupBy("range").applyInArrow(lambda k, t: search.answer_blocks(k, t), _MESSAGE)
    asked = docs.groupBy("unit").cogroup(live.groupBy("unit")).applyInArrow(lambda k, a, b: search.ask_windows(k, a, b), _MESSAGE)
    found = asked.groupBy("range").applyInArrow(lambda k, t: search.answer_windows(k, t), _MESSAGE)
    result = "_key long, n_words long, n_removed long, spans array<struct<begin int, end int>>, kept string"
    out = docs.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(lambda k, a, b: search.cut_out(k, a, b), result)
    return out.withColumnRenamed("_key", key)
