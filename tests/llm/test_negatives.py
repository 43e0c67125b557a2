"""Hard negatives against all pairs in plain Python, and the scores against plain products."""

import math

import numpy as np
import pytest

from equipoise.llm import negatives
from equipoise.llm.negatives import bit_planes, hard_negatives, narrowest, scores, subset_tables

SCHEMA = "vec_id long, embedding array<float>, label int, _row int, score string, rank int"


def plain(rows, every=50, positives=5, most=3, low=50, high=95):
    """(anchor, positive, rank, negative, scores) of rows (id, vector, label), with every row on its own."""
    good = [(k, [math.floor(256 * float(np.float32(x))) for x in v], y) for k, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda k: (k is None, k or 0)
    out = []
    for i, (k, v, y) in enumerate(good):
        if k is None or k % every:
            continue
        found = [(-sum(a * b for a, b in zip(v, w)), last(j), n, z) for n, (j, w, z) in enumerate(good) if n != i]
        for s, p, _, _ in sorted(f for f in found if f[3] == y)[:positives]:
            inside = sorted(f for f in found if f[3] != y and low * -s <= 100 * -f[0] <= high * -s)
            out += [(k, None if p[0] else p[1], r, None if f[1][0] else f[1][1], -s, -f[0]) for r, f in enumerate(inside[:most], 1)]
    return sorted(map(str, out))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)


def drawn(n, dims, labels, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, spread, (labels, dims))
    y = rng.integers(0, labels, n)
    return [(i, [float(x) for x in np.float32(centre[y[i]] * 0.5 + rng.normal(0, spread, dims))], int(y[i])) for i in range(n)]


@pytest.mark.parametrize("dims,size", [(1, 2), (7, 5), (8, 128), (64, 256), (130, 1000), (64, 1 << 20)])
def test_scores_are_products(dims, size):
    rng = np.random.default_rng(dims)
    a, c = rng.integers(-size, size, (9, dims)), rng.integers(-size, size, (300, dims))
    a[0], c[0], c[1] = -size, -size, size - 1
    planes = (size - 1).bit_length() + 1
    wide = 8 * -(-dims // 8)
    padded = np.zeros((300, wide), np.int64)
    padded[:, :dims] = c
    got = scores(subset_tables(a, narrowest(wide * size)), bit_planes(padded, planes), narrowest(wide * size * size))
    assert (got == c @ a.T).all()


def test_all_pairs(spark):
    rows = drawn(700, 13, 4, 1)
    got = sorted(str(tuple(r)) for r in hard_negatives(table(spark, rows)).collect())
    assert got == plain(rows) and len(got) > 100


def test_blocks_do_not_change_the_answer(spark, monkeypatch):
    rows = drawn(600, 6, 3, 2) + [(1000 + i, [0.25] * 6, 0) for i in range(300)]  # a third are copies of one vector
    want = plain(rows, every=20)
    assert sorted(str(tuple(r)) for r in hard_negatives(table(spark, rows), every=20).collect()) == want
    for name, value in (("CANDIDATES", 90), ("ANCHORS", 7), ("TABLE_BYTES", 4096), ("STEP", 16), ("LABELS", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert sorted(str(tuple(r)) for r in hard_negatives(table(spark, rows), every=20).collect()) == want


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = drawn(150, 4, 2, 3) + [
        (50, [0.5, 0.5, 0.1, 0.0], 0), (50, [0.5, 0.5, 0.1, 0.0], 0), (50, [0.2, 0.1, 0.9, 0.0], 1),  # a key met again
        (200, None, 1), (200, [0.1, None, 0.0, 0.0], 1), (250, [nan, 0.0, 0.0, 0.0], 0), (300, [inf, 0.0, 0.0, 0.0], 0), (350, [0.1] * 4, None), (1, [-inf] * 4, 0),
        (None, [0.9] * 4, 0), (None, [0.8] * 4, 1), (400, [], 1), (450, [0.5, 0.4], 0), (500, [-0.5] * 4, 7), (-50, [0.4] * 4, 1), (550, [0.0] * 4, 0), (551, [0.0] * 4, 0),
    ]
    got = hard_negatives(table(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)


def test_windows_of_zero_and_under(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, -1.0], 2), (3, [-1.0, 0.0], 2), (4, [-0.5, 0.0], 1), (5, [0.5, 0.0], 2), (6, [0.75, 3.0], 1)]
    assert sorted(str(tuple(r)) for r in hard_negatives(table(spark, rows)).collect()) == plain(rows)


def test_empty_tables_and_refusals(spark):
    assert hard_negatives(table(spark, [])).count() == 0
    assert hard_negatives(table(spark, [(50, [0.1], 1)])).count() == 0
    assert hard_negatives(table(spark, [(51, [0.1], 1), (52, [0.1], 1), (53, [0.1], 2)])).count() == 0
    with pytest.raises(ValueError):
        hard_negatives(table(spark, [(50, [1e30], 1), (51, [1e30], 1)]))
