"""Encoding and decoding against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from equipoise.llm import bpe
from equipoise.llm.bpe import Bpe, decode, encode, round_trip_digests

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    parts = ["a", "b", "th", "in", " ", "\n", "'s", "'", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "é", "é", "9", "42", "$", "aaaa", "\x1c", "\x85", "　", "中文", "😀", "ß", "\x00"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    latin = [chr(c) for c in range(0x20, 0x530)]
    out += ["".join(latin[i : i + 40]) for i in range(0, len(latin), 40)] + ["x" + c + "y " + c for c in latin]
    return [*out, "a" * 5000, "ab" * 3000 + "c", "", None, "   ", "<|ENDOFTEXT|>", "word " * 20_000]


@pytest.mark.parametrize("long", [0, 7, bpe.LONG])
def test_ids_and_texts_are_those_of_the_library(library, monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG", long)
    own = Bpe(PATH)
    ids, offsets = own.encode(texts())
    for k, text in enumerate(texts()):
        want = library.encode(text or "", add_special_tokens=False).ids
        got = ids[offsets[k] : offsets[k + 1]]
        assert got.tolist() == want, repr(text)[:80]
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name,limit", [("REMEMBERED", 3), ("REMEMBERED_SIZE", 20)])
def test_forgetting_changes_nothing(library, monkeypatch, name, limit):
    monkeypatch.setattr(bpe, name, limit)
    own = Bpe(PATH)
    for text in ["one two three four five", "six seven one two", "one six nine"] * 2:
        assert len(own.known) < 12 and own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_take_time_in_proportion(library):
    rng = random.Random(5)
    word = "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", k=1_000_000))
    own, begin = Bpe(PATH), time.process_time()
    ids, _ = own.encode([word, word[:9_000] + " " + word[5:8_000], "aa" * 70_000 + "b"])
    assert time.process_time() - begin < 30
    want = [library.encode(t, add_special_tokens=False).ids for t in (word, word[:9_000] + " " + word[5:8_000], "aa" * 70_000 + "b")]
    assert ids.tolist() == sum(want, [])


@pytest.mark.parametrize("long", [0, bpe.LONG])
def test_merges_that_feed_earlier_ones_go_left_to_right(monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG", long)
    own = Bpe(PATH)
    a, b, c = (own.inner[ord(x)] for x in "abc")
    ab, bc = 1000, 1001
    own.keys = np.array(sorted([a << 32 | b, ab << 32 | c, b << 32 | c]))
    rank = {a << 32 | b: 1, ab << 32 | c: 0, b << 32 | c: 2}
    own.rank = np.array([rank[k] for k in own.keys])
    own.made, own.single = np.array([1002, ab, bc]), np.array([False, True, False])
    got, _ = own.merge(np.array([a, b, c, a, b]), np.zeros(5, np.int64))
    assert got.tolist() == [1002, ab]


def test_edge_cases_have_defined_results(spark, library):
    rows = [(1, "Hello WORLD"), (2, None), (3, ""), (4, " \n"), (None, "x"), (1, "Hello WORLD")]
    table = spark.createDataFrame([(k, t, "c", [7]) for k, t in rows], "doc_id long, text string, decoded string, ids array<int>")
    both = decode(encode(table, PATH), PATH)
    assert both.columns == ["doc_id", "ids", "decoded"] and both.count() == 6
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in round_trip_digests(table, PATH).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k or 0, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert round_trip_digests(table.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, library):
    from equipoise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, sf).collect():
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
