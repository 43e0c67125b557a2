"""Exact duplicates: classes, salts and edge cases."""

import hashlib
import re

import pytest

from equipoise.llm.exact import drop_exact_duplicates, exact_duplicates


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("salts", [1, 5, 63])
def test_classes_do_not_depend_on_salts(spark, salts):
    rows = [(k, ["Same", "sAME", "x", None, "", "É", "é", "big " * 9000][k * k % 8]) for k in range(-40, 40)] + [(None, "same"), (None, "alone"), (3, "twice"), (3, "Twice")]
    table = spark.createDataFrame([(k, t, True, "z") for k, t in rows], "doc_id long, text string, kept boolean, text_sha256 string").repartition(7)
    got = exact_duplicates(table, salts=salts).collect()
    best, size = {}, {}
    for k, t in rows:
        t = lower(t)
        size[t] = size.get(t, 0) + 1
        best[t] = k if best.get(t) is None else best[t] if k is None else max(k, best[t])
    want = sorted(str((k, best[lower(t)], size[lower(t)], k == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest())) for k, t in rows)
    assert sorted(str(tuple(r)) for r in got) == want
    dropped = drop_exact_duplicates(table, salts=salts)
    assert dropped.columns == table.columns
    assert sorted(map(str, (r["doc_id"] for r in dropped.collect()))) == sorted(str(k) for k, _ in {(k, lower(t)) for k, t in rows if k == best[lower(t)]})


def test_empty_table_and_bad_salts(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(table).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(table, salts=64)


def test_copies_are_combined_before_the_shuffle(spark):
    plan = exact_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") >= 2 and "Python" not in plan


def test_rows_that_repeat_leave_one(spark):
    rows = [*[(7, "again and again", "x")] * 50, (6, "again and again", "x"), (7, "other", "y"), *[(None, "none", "z")] * 20, (None, None, "n"), (None, "", "n"), (8, "Tie", "first"), (8, "tie", "second")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(6)
    got = drop_exact_duplicates(table)
    assert got.columns == table.columns
    got = [tuple(r) for r in got.collect()]
    assert set(got) <= set(rows)
    assert sorted(((k, (t or "").lower()) for k, t, _ in got), key=str) == sorted([(7, "again and again"), (7, "other"), (None, "none"), (None, ""), (8, "tie")], key=str)
