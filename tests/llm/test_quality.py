"""Quality classifier: held-out accuracy, word vectors against a plain version, and edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from equipoise.llm import quality
from equipoise.llm.quality import Network, assess, index_vectors, token_buckets, train, word_vectors

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in assess(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for k, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(q == r["predicted"] for q, r in held) >= 0.93 * len(held)
    assert np.mean([(r["score"] - q) ** 2 for q, r in held]) < 0.07


def test_tokens_and_vectors_against_plain_ones(spark):
    texts = ["It it, 42 99!! é-a", None, "", "b b b it", "x"]
    tokens = [re.findall(r"[^\W\d_]+|\d+|[^\w\s]+", t or "") for t in texts]
    bucket, first = token_buckets(pa.array(texts))
    assert np.diff(first).tolist() == [len(t) for t in tokens]
    named = dict(zip(["0" * len(w) if w.isdigit() else w for t in tokens for w in t], bucket.tolist(), strict=True))
    assert named["00"] == bucket[3] == bucket[4 - 0 - 1] and named["It"] != named["it"]
    places, signs = index_vectors()
    want, counts = np.zeros((quality.BUCKETS, quality.WIDTH)), Counter(bucket.tolist())
    for a, b in zip(first[:-1], first[1:], strict=True):
        for i in range(a, b):
            for j in range(max(a, i - 2), min(b, i + 3)):
                if i != j:
                    for k in range(quality.NONZERO):
                        want[bucket[i], places[bucket[j], k]] += signs[bucket[j], k]
    vectors, n = word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert (vectors == want).all() and {i: int(c) for i, c in enumerate(n) if c} == dict(counts)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-4 * x[:, 0] * x[:, 1]))).astype(float)
    net = train(x, y)
    score = net.score(x)
    assert np.mean((score > 0.5) == (y > 0.5)) > 0.75
    for low in (0.1, 0.3, 0.5, 0.7):
        some = (score >= low) & (score < low + 0.2)
        assert abs(score[some].mean() - y[some].mean()) < 0.08
    assert isinstance(net, Network) and train(x[:0], y[:0]).score(np.zeros((2, quality.WIDTH + 3))).tolist() == [0.5, 0.5]


def test_edge_cases_have_defined_results(spark):
    rows = [(1, "good text here"), (2, None), (3, ""), (None, "x y"), (1, "good text here"), (4, "w " * 60_000), (6, "$$ || ##")]
    docs = spark.createDataFrame([(k, t, 0.5, False) for k, t in rows], "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (4, None, 0), (None, 1, 0), (99, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = assess(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 7
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert {r["score"] for r in assess(docs, labels.limit(0)).collect()} == {0.5}
    assert assess(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("most", [40, 10_000])
def test_training_rows_are_bounded(spark, monkeypatch, most):
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append(len(x)) or train(x, y))
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assess(docs, labels, max_train=most).count()
    assert seen == [min(most, sum(zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 for r in labels.collect()))]


def test_fetched_rows_are_bounded_where_a_key_has_many_documents(spark, monkeypatch):
    fetched, trained, sampled = [], [], quality.sampled
    monkeypatch.setattr(quality, "sampled", lambda *a: fetched.append(sampled(*a)) or fetched[0])
    monkeypatch.setattr(quality, "train", lambda x, y: trained.append(len(x)) or train(x, y))
    docs = spark.createDataFrame([(1 if i < 400 else i, f"text number {i} of {i % 7}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), *((i, i % 2) for i in range(400, 430))], "doc_id long, quality int")
    kept = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 1, *range(400, 430)))
    assert assess(docs, labels).count() == 600
    assert fetched[0].count() == kept - 1 and trained == [kept]
