"""Language identification: held-out accuracy, the counts behind the model, and edge cases."""

import re
import tracemalloc
import zlib

import numpy as np
import pytest

from equipoise.llm import language
from equipoise.llm.language import fit, gram_buckets, gram_pieces, identify, keep_identified, predict

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = identify(spark, docs).collect()
    assert len(got) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.98 * len(held)


def plain_counts(text, buckets):
    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    found, _, _ = gram_buckets([letters.strip()], buckets)
    return np.bincount(found, minlength=buckets)


def test_model_against_plain_bayes(spark):
    rows = [(1, "Der Hund, die Katze!", "de"), (2, "the dog 42 and the cat", "en"), (3, "ein Haus", "de"), (4, None, "en"), (5, "xyz", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = fit(table, buckets=256)
    assert model.langs == ["de", "en"]
    de, en = plain_counts("Der Hund, die Katze!", 256) + plain_counts("ein Haus", 256), plain_counts("the dog 42 and the cat", 256)
    for row, n in zip(model.table, (de, en), strict=True):
        assert np.allclose(row, np.log((n + 0.5) / (n.sum() + 128)))
    assert np.allclose(np.exp(model.prior), [2 / 3, 1 / 3])
    got = predict(table.select("doc_id", "text"), model).where("doc_id = 2").first()
    own = plain_counts("the dog 42 and the cat", 256) @ model.table.T + model.prior
    assert got["lang_pred"] == "en" and abs(got["score"] - 1 / (1 + np.exp(own[0] - own[1]))) < 1e-9


def test_whole_texts_count():
    found, offsets, _ = gram_buckets(["a" * 300_000 + " zq", "", None, "9", "b"])
    assert np.diff(offsets).tolist()[0] > 900_000 and len(found) == offsets[-1]


@pytest.mark.parametrize("text", ["", "a", "9", " ab  9 cd. ", "..  ..", "Ende ΑΣ ΑΣΑ 中文 İx", "   \n 12 x", "x" * 50, "  7 " * 20 + "q"])
@pytest.mark.parametrize("step", [1, 2, 3, 5, 64])
def test_pieces_have_the_same_grams(text, step):
    whole, _, _ = gram_buckets([text], 256)
    pieces = np.concatenate([np.zeros(0, np.int64), *gram_pieces(text, 256, step)])
    assert np.array_equal(np.bincount(whole, minlength=256), np.bincount(pieces, minlength=256))


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    texts = [("der hund und die katze 42, " * 60, "de"), ("the dog and the cat; " * 60, "en"), ("9 " * 900, None), ("a" * 1500, None), ("der hund", None)]
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    whole_model = fit(table, buckets=256)
    whole = predict(table, whole_model).orderBy("doc_id").collect()
    monkeypatch.setattr(language, "_STEP", 1000)
    model = fit(table, buckets=256)
    assert np.array_equal(model.table, whole_model.table) and model.langs == whole_model.langs
    cut = predict(table, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in cut] == [r["lang_pred"] for r in whole] and cut[2]["lang_pred"] == "und"
    assert np.allclose([r["score"] for r in cut], [r["score"] for r in whole])


def test_memory_for_a_long_text_does_not_follow_its_grams():
    text = "the quick brown fox " * 1_000_000
    tracemalloc.start()
    n = sum(len(found) for found in gram_pieces(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3 * (len(text) + 1) - 3 and peak < 5 * len(text)


def test_edge_cases_have_defined_results(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 $$ \n", "en"), (4, "hello there", "en"), (None, "hello there", "en"), (4, "hello there", "en"), (5, "ß", None), (6, "hello " * 50_000, "en")]
    table = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = identify(spark, table).collect()
    assert len(got) == 8
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2, 3)} == dict.fromkeys((1, 2, 3), ("und", 0.0))
    assert {r["lang_pred"] for r in got if r["doc_id"] not in (1, 2, 3)} == {"en"}
    kept = keep_identified(table)
    assert kept.columns == table.columns and kept.count() == 5 and {r["lang_pred"] for r in kept.collect()} == {"c"}
    empty = identify(spark, table.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]
    unlabelled = identify(spark, table.withColumn("lang", table["lang"].substr(100, 1)).where("false").unionByName(table.selectExpr("doc_id", "text", "cast(null as string) lang", "lang_pred", "score")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_neighbours_in_a_batch_do_not_count(spark):
    """A text without letters leaves the scores of the texts around it as they are."""
    table = spark.createDataFrame([(1, "der hund", "de"), (2, "the dog", "en")], "doc_id long, text string, lang string")
    model = fit(table, buckets=256)
    texts = ["hund", "1 2 3", None, "...", "dog", "", "hund"]
    together = predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()
    alone = [predict(spark.createDataFrame([(i, t)], "doc_id long, text string"), model).first() for i, t in enumerate(texts)]
    assert together == alone
