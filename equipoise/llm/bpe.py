"""Byte-pair encoding and decoding with a public vocabulary file.

Encoding works on many words at once: the symbols of all new words of a batch lie in one flat array; a round looks the
neighbouring pairs up by binary search over the sorted pair keys, takes the lowest rank of each word, and merges all of
its occurrences. Words without a known pair leave the array; the rest goes on to the next round. Long words have an array
of their own, whose rounds touch the places of one rank and their neighbours only.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.arrow import column, ragged, text_slices

#: White_Space of Unicode, which the file's ``\s`` stands for (Python's own also has U+001C to U+001F).
SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces between white space that a worker remembers, and their characters and ids; beyond either, it starts afresh.
REMEMBERED, REMEMBERED_SIZE = 200_000, 4 << 20
#: Text bytes encoded at a time.
STEP = 1 << 20
#: Words of more bytes are merged rank by rank: rounds over whole words would cost their length times their ranks.
LONG = 4096
_NONE = np.int64(1) << 62
#: A symbol in no pair: the guard at the end of words, and merged places.
_GUARD = np.int64(1) << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Numbered(dict):
    """Numbers chunks in the order in which they are first asked for."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


class Bpe:
    """A vocabulary file of the kind: NFC, white space, lower case; split by a pattern; bytes; merges with word ends.

    Categories and case follow the tables of Python and ``regex``. Some code points that Unicode 15.1 leaves unassigned
    are cut or lower-cased otherwise by a library with other tables; all assigned ones agree (tests compare them).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, as_bytes = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or as_bytes["use_regex"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a word-level byte-pair vocabulary with white space dropped")
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.piece = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.space = regex.compile(f"[{SPACE}]+")
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.made = made
        # Merges whose product takes part in an earlier merge: only the leftmost occurrence may be merged in a round.
        first = np.full(max(vocab.values()) + 1, len(merges))
        for side in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(first, side, np.arange(len(merges)))
        self.single = first[made] < np.arange(len(merges))
        self.tokens = np.full(max([*vocab.values(), *added.values()]) + 1, "", object)
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        self.forget()

    def forget(self) -> None:
        self.known, self.size = _Numbered(), 0
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the word (ascending numbers) of each."""
        far = np.bincount(word)[word] > LONG
        if far.any():
            parts = self.merge_long(symbols[far], word[far]), self.merge(symbols[~far], word[~far])
            symbols, word = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(word, kind="stable")
            return symbols[order], word[order]
        done = []
        while len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.rank[at], _NONE)
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[begins, len(word)])
            rank = np.r_[rank, _NONE]
            lowest = np.minimum.reduceat(rank, begins)
            of = np.repeat(lowest, lengths)
            hit = (rank == of) & (of < _NONE)
            # Of overlapping occurrences (aaa) every other one counts, from the left.
            i = np.flatnonzero(hit)
            run = np.r_[True, np.diff(i) != 1] if len(i) else np.zeros(0, bool)
            place = np.arange(len(i)) - np.repeat(np.flatnonzero(run), np.diff(np.r_[np.flatnonzero(run), len(i)]))
            i = i[place % 2 == 0]
            if self.single.any() and len(i):
                leftmost = np.r_[True, word[i[1:]] != word[i[:-1]]]
                i = i[leftmost | ~self.single[rank[i]]]
            symbols = symbols.copy()
            symbols[i] = self.made[rank[i]]
            keep = np.ones(len(symbols), bool)
            keep[i + 1] = False
            over = np.repeat(lowest == _NONE, lengths)
            if over.any():
                done.append((symbols[over], word[over]))
                keep &= ~over
            symbols, word = symbols[keep], word[keep]
        done.append((symbols, word))
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def merge_long(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, a round for each rank in turn: the places of the lowest rank merge, and only their new pairs are looked up.

        Words do not touch each other, so all of them share the rounds.
        """
        n = len(symbols)
        symbols = np.append(symbols, _GUARD)
        after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
        edge = np.flatnonzero(word[1:] != word[:-1])
        after[edge], before[edge + 1], before[0] = n, n, n
        by_rank = self.keys[np.argsort(self.rank)]
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look_up(at: np.ndarray) -> None:
            pair = symbols[at] << 32 | symbols[after[at]]
            found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = self.keys[found] == pair
            at, rank = at[known], self.rank[found[known]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else (), np.split(at, cuts), strict=False):
                if r not in waiting:
                    heappush(ranks, r)
                    waiting[r] = []
                waiting[r].append(places)

        look_up(np.arange(n))
        while ranks:
            r = heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            at = places = places[symbols[places] << 32 | symbols[after[places]] == by_rank[r]]  # still there
            if not len(at):
                continue
            # Of overlapping occurrences (aaa) every other one counts, from the left.
            run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            if self.single[r]:
                at = at[:1]
            gone = after[at]
            symbols[at], symbols[gone] = self.made[r], _GUARD
            after[at] = after[gone]
            before[after[at]] = at
            look_up(np.r_[at, before[at], places if self.single[r] else at[:0]])
        keep = symbols[:n] != _GUARD
        return symbols[:n][keep], word[keep]

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks (without white space) and remember their ids."""
        pieces: dict[str, int] = {}
        of, per = [], np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            # Letters alone are one piece, whatever the alternatives before them.
            found = (chunk,) if chunk.isalpha() else self.piece.findall(chunk)
            per[k] = len(found)
            of += [pieces.setdefault(p, len(pieces)) for p in found]
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.final[data[ends]]
        symbols, word = self.merge(symbols, np.repeat(np.arange(len(raw)), size))
        count = np.bincount(word, minlength=len(raw))
        first = np.cumsum(count) - count
        of = np.array(of, np.int64)
        lengths = count[of]
        ids = symbols[ragged(first[of], lengths)].astype(np.int32)
        edges = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(per)]]
        self.size += sum(map(len, chunks)) + len(ids)
        base = len(self.ids)
        self.ids = np.r_[self.ids, ids]
        self.first = np.r_[self.first, base + edges[:-1]]
        self.count = np.r_[self.count, np.diff(edges)]

    def chunks(self, text: str) -> list[str]:
        """Normalised text cut at white space."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # Character by character: a final sigma stays a plain one.
        text = text.lower() if text.isascii() else text.replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.space.split(text) if c]
        return text.split()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of texts + 1 entries). A null is an empty text."""
        if len(self.known) > REMEMBERED or self.size > REMEMBERED_SIZE:
            self.forget()
        told, know, parts = len(self.first), self.known.__getitem__, []

        def add(k: int, text: str) -> None:
            chunks = self.chunks(text)
            parts.append((k, np.fromiter(map(know, chunks), np.int64, len(chunks))))

        for k, text in enumerate(texts):
            if text and self.special and self.special.search(text):
                at = 0
                for m in self.special.finditer(text):
                    add(k, text[at : m.start()])
                    parts.append((k, self.added[m[0]]))
                    at = m.end()
                text = text[at:]
            add(k, text or "")
        self.learn(list(islice(self.known, told, None)))
        out, sizes = [], np.zeros(len(texts), np.int64)
        for k, part in parts:
            ids = np.array([part], np.int32) if isinstance(part, int) else self.ids[ragged(self.first[part], self.count[part])]
            out.append(ids)
            sizes[k] += len(ids)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.r_[0, np.cumsum(sizes)]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, special ones included; ids outside the vocabulary are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        return " ".join(t for t in self.tokens[ids].tolist() if t)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The vocabulary, read once by each Python worker."""
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` (array of int) in ``out``, in place of ``text``.

    ``path`` is a vocabulary file that every executor has. Null and blank texts give an empty array. Other columns
    stay as they are; a column already called ``out`` is replaced. Whole texts are encoded, whatever their length.
    """
    rest = [f for f in df.schema if f.name not in (text, out)]
    schema = T.StructType([*rest, T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in text_slices(batches, text, STEP):
            ids, offsets = bpe.encode(column(batch, text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), lists], [*names, out])

    return df.select(*names, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids in ``out``; a null array gives an empty text. Other columns stay."""
    rest = [f for f in df.schema if f.name != out]
    schema = T.StructType([*rest, T.StructField(out, T.StringType())])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [bpe.decode(np.asarray(x.values, dtype=np.int64) if x.is_valid else np.zeros(0, np.int64)) for x in column(batch, ids)]
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(texts, pa.string())], [*names, out])

    return df.select(*names).mapInArrow(run, schema)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass of one worker: the ids, and the text that they stand for."""
    rest = [f for f in df.schema if f.name not in (text, ids, decoded)]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in text_slices(batches, text, STEP):
            found, offsets = bpe.encode(column(batch, text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))
            texts = pa.array([bpe.decode(found[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), lists, texts], [*names, ids, decoded])

    return df.select(*names, text).mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode ``text``: (key, n_tokens, ids_sha256, decoded_sha256)."""
    both = encode_decode(df.select(key, text), path, text)
    return both.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
