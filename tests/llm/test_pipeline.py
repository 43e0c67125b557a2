"""The pipeline against a version in plain Python over the same stages."""

import re
from collections import Counter

import pytest
from test_simhash import plain_fingerprint, plain_roots

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_rows_are_those_of_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    last = {}
    for r in kept:
        last[lower(r["text"])] = max(r["doc_id"], last.get(lower(r["text"]), -1))
    kept = [r for r in kept if last[lower(r["text"])] == r["doc_id"]]
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in kept}
    root = plain_roots(sorted(set(prints.values())), 3)
    least = {}
    for k, p in prints.items():
        least[root[p]] = min(k, least.get(root[p], k))
    kept = [r for r in kept if least[root[prints[r["doc_id"]]]] == r["doc_id"]]

    from equipoise.llm.mixing import mix

    table = spark.createDataFrame([tuple(r) for r in kept], docs.schema)
    want = Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mix(table).collect() if r["size"]})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == +want and all(r["n_tokens"] > 0 for r in got)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == COLUMNS


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "some words here " * 5, "en", "a", 3), (2, "", "en", "a", 0), (3, "other words there " * 9, "en", None, 5), (3, "other words there " * 9, "en", None, 5), (4, "z" * 50_000, None, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert {r["doc_id"] for r in docs.collect()} <= {None, 3, 4}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=lambda f: f.__name__)
def test_columns_with_the_names_of_helpers_stay(spark, stage):
    """Every stage before the last keeps all columns and their values, whatever they are called."""
    names = "_key _text _digest _kept _copy _copies _COPY2 _mixed _lang _score __kept _salt kept rank size taken target fingerprint component_id".split()
    rows = [(i, f"{'some words here and there ' * 9} number {i}", "en", "a", 3, *(f"{n}{i}" for n in names)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    kept = got.collect()
    assert kept and {tuple(r) for r in kept} <= set(rows)
