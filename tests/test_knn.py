import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equipoise.functions.vectors import as_vector
from equipoise.operators import boxes, knn, regions
from equipoise.operators.knn import estimate_tau, knn_join, knn_pairs, search_index
from equipoise.operators.stages import NearestNeighbors


def table(spark, vectors, start=0):
    rows = [(start + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, features array<double>").repartition(3)


def brute(q, b, k, exclude=False, limit=math.inf):
    out = {}
    for i, v in q:
        near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w, strict=True))), j) for j, w in b if not (exclude and i == j))
        out[i] = [(j, round(d, 9)) for d, j in near[:k] if d <= limit]
    return out


def found(pairs):
    out = {}
    for r in pairs.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["nb_id"], round(r["distance"], 9)))
    return out


def pull(df):
    return [(r["id"], r["features"]) for r in df.collect()]


@pytest.fixture
def tiny_cells(monkeypatch):
    """Cells of a few rows, so that every split and merge is exercised."""
    monkeypatch.setattr(knn, "BASE_CELL", 40)
    monkeypatch.setattr(knn, "MIN_QUERY_CELL", 16)
    monkeypatch.setattr(knn, "_REPEATED", 500)
    monkeypatch.setattr(regions, "_SLAB", 700)


@pytest.mark.parametrize("probe", [1, 16, 2048])
@pytest.mark.parametrize("shape", ["spread", "grid", "far"])
def test_cell_search_equals_brute_force(monkeypatch, probe, shape):
    monkeypatch.setattr(knn, "_PROBE", probe)
    monkeypatch.setattr(knn, "_CELL_SLAB", 900)
    rng = np.random.default_rng(7)
    base, query = rng.normal(0, 1, (300, 5)), rng.normal(0, 1, (80, 5))
    if shape == "grid":
        base, query = np.round(base), np.round(query)
    if shape == "far":
        base, query = base + 1e6, query + 1e6
    qi, bi, distance = knn.nearest_in_cell(query, base, 7)
    exact = np.sqrt(((query[:, None] - base[None]) ** 2).sum(2))
    want = np.lexsort((np.tile(np.arange(300), (80, 1)), np.round(exact, 9)))[:, :7]
    assert np.array_equal(qi, np.repeat(np.arange(80), 7))
    assert np.allclose(distance.reshape(80, 7), np.sort(exact, 1)[:, :7], atol=1e-9)
    if shape != "far":
        assert np.array_equal(bi.reshape(80, 7), want)


@pytest.mark.parametrize("pivots", [1, 12])
def test_exact_with_hot_copies_and_ties(spark, tiny_cells, pivots):
    """A third of the rows are one point and the rest lie on a grid full of equal distances."""
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 6, (200, 2)).astype(float)
    df = table(spark, np.vstack([np.tile([2.5, 2.5], (100, 1)), grid]))
    got = found(knn_pairs(df, df, ["id"], "features", 4, exclude_self=True, pivots=pivots, seed=3))
    assert got == brute(pull(df), pull(df), 4, exclude=True)


def test_exact_for_queries_far_from_a_sparse_region(spark, tiny_cells):
    rng = np.random.default_rng(2)
    base = table(spark, np.vstack([rng.normal(0, 1, (300, 3)), [[50, 50, 50], [51, 50, 50]]]))
    query = table(spark, np.vstack([rng.normal(50, 1, (40, 3)), rng.normal(0, 3, (60, 3))]), start=1000)
    got = found(knn_pairs(query, base, ["id"], "features", 5, pivots=15))
    assert got == brute(pull(query), pull(base), 5)


def test_radius_and_empty_arrays(spark, tiny_cells):
    rng = np.random.default_rng(3)
    base, query = table(spark, rng.normal(0, 1, (150, 2))), table(spark, rng.normal(0, 4, (50, 2)), 500)
    want = brute(pull(query), pull(base), 3, limit=0.4)
    for pivots in (1, 9):
        out = knn_join(query, base, ["id"], "features", 3, max_distance=0.4, pivots=pivots, distance_col="d")
        got = {r["id"]: [(n["id"], round(d, 9)) for n, d in zip(r["neighbors"], r["d"], strict=True)] for r in out.collect()}
        assert got == want and any(not v for v in got.values())


def test_base_smaller_than_k(spark):
    df = table(spark, [[0.0], [1.0], [3.0]])
    got = found(knn_pairs(df, df, ["id"], "features", 10, exclude_self=True))
    assert got == brute(pull(df), pull(df), 10, exclude=True)


def test_routing(spark, blobs):
    exact = found(knn_pairs(blobs, blobs, ["id"], "features", 5, pivots=20))
    wide = found(knn_pairs(blobs, blobs, ["id"], "features", 5, pivots=20, tau=math.inf))
    assert wide == exact
    tau = estimate_tau(blobs, ["id"], "features", 1)
    near = found(knn_pairs(blobs, blobs, ["id"], "features", 5, pivots=20, tau=tau))
    hits = sum(len(set(near[i]) & set(exact[i])) for i in exact)
    assert tau > 0 and hits / sum(map(len, exact.values())) >= 0.9


def test_tau_without_distinct_points(spark):
    assert estimate_tau(table(spark, [[1.0, 1.0]] * 20), ["id"], "features") == 0.0


def test_stage(spark, blobs):
    stage = NearestNeighbors(keyCols=["id"], featuresCol="features", k=2, distanceCol="d", auxCols=["label", "features"])
    out = stage.fit(blobs).transform(blobs.filter("id < 10"))
    rows = out.collect()
    assert len(rows) == 10 and all(r["d"][0] == 0.0 and len(r["neighbors"]) == 2 for r in rows)
    assert all(r["neighbors"][0]["features"] == r["features"] for r in rows)


@pytest.mark.parametrize("buffer", [-1.0, 0.3])
def test_stage_reuses_its_index(spark, blobs, buffer):
    model = NearestNeighbors(keyCols=["id"], featuresCol="features", k=3, pivots=10, bufferSize=buffer).fit(blobs)
    first, second = blobs.filter("id % 50 = 1"), blobs.filter("id % 50 = 2")
    for part in (first, second):
        rows = model.transform(part).collect()
        assert all(r["neighbors"][0]["id"] == r["id"] and len(r["neighbors"]) == 3 for r in rows)
    with pytest.raises(ValueError, match="copies per vector"):
        search_index(first, model.index, ["id"], "features", 9)


@pytest.mark.parametrize("pivots", [1, 10])
def test_plan_has_partial_limits_and_no_cross_join(spark, blobs, pivots):
    df = knn_pairs(blobs, blobs, ["id"], "features", 3, pivots=pivots)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert df.filter(F.col("rank") > 3).count() == 0


def test_vector_columns(spark, blobs):
    df = blobs.select("id", as_vector(blobs, "features").alias("features"))
    out = knn_join(df, df.filter("id < 50"), ["id"], "features", 2, aux_cols=["id", "features"])
    row = out.filter("id = 7").first()
    assert row["neighbors"][0]["features"] == row["features"] and row["neighbors"][0]["id"] == 7


@pytest.mark.parametrize("pivots", [1, 16])
@pytest.mark.parametrize("offset", [1e7, 1e8, 1.7e9])
def test_exact_far_from_the_origin(spark, tiny_cells, offset, pivots):
    rng = np.random.default_rng(4)
    df = table(spark, rng.normal(0, 1, (300, 2)) + offset)
    got = found(knn_pairs(df, df, ["id"], "features", 5, exclude_self=True, pivots=pivots))
    assert got == brute(pull(df), pull(df), 5, exclude=True)


def test_rows_with_unusable_features_have_no_neighbours(spark, tiny_cells):
    good = [[float(i), 1.0] for i in range(60)]
    rows = [*enumerate(good), (100, None), (101, [float("nan"), 1.0]), (102, [float("inf"), 1.0]), (103, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    for pivots in (1, 6):
        got = found(knn_pairs(df, df, ["id"], "features", 3, exclude_self=True, pivots=pivots))
        assert got == brute(list(enumerate(good)), list(enumerate(good)), 3, exclude=True)
    nested = {r["id"]: len(r["neighbors"]) for r in knn_join(df, df, ["id"], "features", 3).collect()}
    assert nested == {i: 3 if i < 60 else 0 for i, _ in rows}


def test_keys_must_be_unique_and_known(spark):
    twice = spark.createDataFrame([(i // 2, [float(i)]) for i in range(40)], "id long, features array<double>")
    lost = spark.createDataFrame([(None, [1.0]), (1, [2.0])], "id long, features array<double>")
    good = table(spark, [[1.0], [2.0]])
    for query, base, what in [(twice, good, "query.*unique"), (good, twice, "base.*unique"), (lost, good, "query.*null"), (good, lost, "base.*null")]:
        with pytest.raises(ValueError, match=what):
            knn_pairs(query, base, ["id"], "features", 1)


@pytest.mark.parametrize("k", [5, 90, 400])
def test_routed_queries_are_never_short(spark, tiny_cells, k):
    rng = np.random.default_rng(6)
    df = table(spark, rng.normal(0, 1, (200, 2)))
    got = found(knn_pairs(df, df, ["id"], "features", k, tau=0.0, pivots=20))
    assert {len(v) for v in got.values()} == {min(k, 200)}
    if k > 20:
        assert sum(got[i] == v for i, v in brute(pull(df), pull(df), k).items()) > 150


def test_regions_stay_one_size_at_any_number_of_rows():
    """A million to a hundred thousand million rows: neither a region nor a query's share of pivots follows the table."""
    for rows in (10**6, 10**7, 10**8, 10**9, 10**10, 10**11):
        wanted = regions.default_pivots(rows, 4 * knn.BASE_CELL)
        top, second = regions.levels(wanted, 8)
        below = math.ceil(wanted / top) if second else 1
        assert rows / (top * below) <= 1.05 * regions.REGION and regions.REGION <= knn.BASE_CELL
        assert top <= regions.most_pivots(8) and below <= 3 * regions.MAX_PIVOTS and top + below <= max(regions.MAX_PIVOTS, 3 * math.sqrt(wanted)) + 1
    assert regions.default_pivots(65_536, 65_536) == 1 and regions.default_pivots(65_537, 65_536) == 32
    assert [regions.default_pivots(n) for n in (100, 2048, 20_480)] == [1, 1, 10]  # routed: one rule at every size


@pytest.fixture
def two_levels(monkeypatch):
    """Few pivots to a level, so that a small table has two."""
    monkeypatch.setattr(regions, "MAX_PIVOTS", 16)
    monkeypatch.setattr(regions, "PLACED", 70)
    monkeypatch.setattr(regions, "_SLAB", 900)
    monkeypatch.setattr(knn, "BASE_CELL", 40)
    monkeypatch.setattr(knn, "MIN_QUERY_CELL", 64)


@pytest.mark.parametrize("rows", [400, 1200, 3600])
def test_two_levels_keep_regions_small(spark, two_levels, monkeypatch, rows):
    rng = np.random.default_rng(rows)
    points = rng.normal(0, 1, (rows, 3))
    points[: rows // 3] = rng.normal(4, 0.01, (rows // 3, 3))  # a third of the rows in one dense spot
    index = knn.build_index(table(spark, points), ["id"], "features", 4, pivots=rows // 20)
    sizes = [r["_rows"] for r in index.regions.below.collect()]
    assert sum(sizes) == rows and len(sizes) > 16
    assert np.median([n for n in sizes if n]) <= 40 and max(sizes) <= 200


@pytest.mark.parametrize("work", [0, 10**9])
@pytest.mark.parametrize("pivots", [12, 60])
def test_rounds_and_levels_give_the_exact_answer(spark, two_levels, monkeypatch, work, pivots):
    monkeypatch.setattr(knn, "ROUND_WORK", work)
    rng = np.random.default_rng(21)
    grid = rng.integers(0, 9, (400, 2)).astype(float)
    df = table(spark, np.vstack([np.tile([4.5, 4.5], (150, 1)), grid, rng.normal(60, 1, (20, 2))]))
    query = table(spark, np.vstack([grid[:60] + 0.25, rng.normal(60, 2, (30, 2)), [[-500.0, 900.0]]]), 5000)
    report = {}
    assert found(knn_pairs(df, df, ["id"], "features", 4, exclude_self=True, pivots=pivots, report=report)) == brute(pull(df), pull(df), 4, exclude=True)
    assert report["rounds"] == 1 if work else report["rounds"] > 1
    assert found(knn_pairs(query, df, ["id"], "features", 6, pivots=pivots)) == brute(pull(query), pull(df), 6)
    assert found(knn_pairs(query, df, ["id"], "features", 6, max_distance=0.6, pivots=pivots)) == {k: v for k, v in brute(pull(query), pull(df), 6, limit=0.6).items() if v}
    wide = found(knn_pairs(query, df, ["id"], "features", 6, tau=math.inf, pivots=pivots))
    assert wide == brute(pull(query), pull(df), 6)


@pytest.mark.parametrize("offset", [1e7, 1.7e9])
def test_two_levels_far_from_the_origin(spark, two_levels, monkeypatch, offset):
    monkeypatch.setattr(knn, "ROUND_WORK", 0)
    df = table(spark, np.random.default_rng(4).normal(0, 1, (300, 2)) + offset)
    got = found(knn_pairs(df, df, ["id"], "features", 5, exclude_self=True, pivots=40))
    assert got == brute(pull(df), pull(df), 5, exclude=True)


def test_rounds_visit_fewer_pairs(spark, monkeypatch):
    """On points in the plane with home regions smaller than k; in 64 dimensions no region can be excluded, and rounds
    visit no more."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    rng = np.random.default_rng(9)
    plane = table(spark, rng.normal(0, 1, (2500, 2)) * rng.exponential(1, (2500, 1)))
    for df, k, pivots, most in ((vectors, 5, 64, 1.0), (plane, 25, 120, 0.9)):
        pairs = {}
        for work in (10**12, 0):
            monkeypatch.setattr(knn, "ROUND_WORK", work)
            report = {}
            pairs[work] = (found(knn_pairs(df, df, ["id"], "features", k, pivots=pivots, report=report)), report["pairs"])
        assert pairs[0][0] == pairs[10**12][0]
        assert pairs[0][1] <= most * pairs[10**12][1]


@pytest.mark.parametrize("pivots", [20, 60])
def test_sampled_recall_is_that_of_the_run(spark, two_levels, blobs, pivots):
    """20 pivots are one level in production and two here; the sample is large enough to be the whole table."""
    index = knn.build_index(blobs, ["id"], "features", 6, pivots=pivots)
    plan = knn.routing(blobs, index, ["id"], "features", 5, True, recall=0.95, sample=3400)
    assert plan.queries == 3400 and plan.recall >= 0.95 and 0 < plan.visited < 1
    exact = found(search_index(blobs, index, ["id"], "features", 5, exclude_self=True))
    near = found(search_index(blobs, index, ["id"], "features", 5, exclude_self=True, tau=plan.tau))
    hits = sum(len(set(near[i]) & set(exact[i])) for i in exact)
    assert hits / 17_000 == pytest.approx(plan.recall, abs=0.01)
    part = knn.routing(blobs, index, ["id"], "features", 5, True, seed=3, recall=0.99, sample=300)
    assert 200 < part.queries < 400 and part.recall >= 0.99
    none = knn.routing(blobs, index, ["id"], "features", 5, True, seed=3, tau=0.0, sample=300)
    assert none.recall < part.recall and none.visited < part.visited


def test_search_to_a_given_recall(spark, blobs, monkeypatch):
    exact = found(knn_pairs(blobs, blobs, ["id"], "features", 5, pivots=40))
    near = found(knn_pairs(blobs, blobs, ["id"], "features", 5, pivots=40, recall=0.9))
    assert sum(len(set(near[i]) & set(exact[i])) for i in exact) / 17_000 >= 0.88
    monkeypatch.setattr(knn, "MOST_VISITED", 0.0)
    assert found(knn_pairs(blobs, blobs, ["id"], "features", 5, pivots=40, recall=0.9)) == exact
    assert found(knn_pairs(blobs, blobs, ["id"], "features", 5, recall=0.5)) == exact  # one region
    with pytest.raises(ValueError, match="recall"):
        knn_pairs(blobs, blobs, ["id"], "features", 5, recall=0.0)


def test_routes_carry_no_vectors(spark, blobs):
    index = knn.build_index(blobs, ["id"], "features", 5, pivots=20)
    routed = regions.route(blobs.select("id", F.col("features").alias("_v")), ["id"], index.regions, "tau", 0.1)
    assert routed.columns == ["id", "_region", "_lower", "_turn"]


def test_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(knn, "_SPARK_LIMITS", 10)
    df = table(spark, [[1.0, 1.0]] * 300 + [[float(i), 0.0] for i in range(50)])
    got = found(knn_pairs(df.filter("id < 3"), df, ["id"], "features", 40))
    assert got == brute([(i, [1.0, 1.0]) for i in range(3)], pull(df), 40)


def test_tau_does_not_depend_on_the_unit(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(0, 1, (400, 2))
    large, small = (estimate_tau(table(spark, points * s), ["id"], "features", samples=(50, 100, 200)) for s in (1.0, 1e-11))
    assert small == pytest.approx(large * 1e-11, rel=1e-6) and small > 0


def test_all_line_items_against_brute_force(spark):
    """The registered query on its whole smallest table."""
    from equipoise.functions.vectors import min_max_scale
    from equipoise.plans.catalog import QUERIES
    from equipoise.plans.fixtures import LINE, lineitem

    sf = "/root/testdata/sf0.001"
    rows = min_max_scale(lineitem(spark, sf).groupBy(*LINE).agg(F.min("features").alias("features")), "features").orderBy(*LINE).collect()
    keys, v = [tuple(r[c] for c in LINE) for r in rows], np.array([r["features"] for r in rows])
    got = {}
    for r in QUERIES["knn_lines"](spark, sf).collect():
        got[tuple(r)[:4], r["rank"]] = (tuple(r)[5:9], r["distance"])
    assert len(got) == 5 * len(rows)
    for i, key in enumerate(keys):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((np.arange(len(d)), np.round(d, 12)))[:5]  # keys are in order, and so are ties
        assert [got[key, n][1] for n in range(1, 6)] == pytest.approx(d[order].tolist(), abs=2e-9)
        assert {got[key, n][0] for n in range(1, 6) if got[key, n][1] < d[order[4]] - 2e-9} == {keys[j] for j in order if d[j] < d[order[4]] - 2e-9}


def test_large_regions_have_regions_below_them(spark, monkeypatch):
    """A given number of regions does not make them grow with the table; no answer depends on it, a routed one neither."""
    rng = np.random.default_rng(31)
    df = table(spark, np.vstack([rng.normal(0, 1, (900, 2)), np.round(rng.normal(0, 1, (200, 2))), np.tile([0.5, 0.5], (100, 1))]))
    routed = {tau: found(knn_pairs(df, df, ["id"], "features", 4, exclude_self=True, pivots=6, tau=tau)) for tau in (0.0, 0.3)}
    report = {}
    knn_pairs(df, df, ["id"], "features", 4, exclude_self=True, pivots=6, report=report)
    monkeypatch.setattr(knn, "REGION", 30)
    index = knn.build_index(df, ["id"], "features", 5, pivots=6)
    assert index.fine.below.count() > 20 and index.fine.below.agg(F.max("_rows")).first()[0] < 200
    fewer = {}
    assert found(knn_pairs(df, df, ["id"], "features", 4, exclude_self=True, pivots=6, report=fewer)) == brute(pull(df), pull(df), 4, exclude=True)
    assert fewer["pairs"] < 0.5 * report["pairs"]
    for tau, want in routed.items():
        assert found(knn_pairs(df, df, ["id"], "features", 4, exclude_self=True, pivots=6, tau=tau)) == want


@pytest.mark.parametrize("tau", [None, 0.2])
def test_regions_that_exclude_nothing_are_not_searched_one_by_one(spark, monkeypatch, tau):
    rng = np.random.default_rng(32)
    df = table(spark, rng.normal(0, 1, (500, 48)))
    want = found(knn_pairs(df, df, ["id"], "features", 3, pivots=10, tau=tau))
    monkeypatch.setattr(knn, "LARGE", 100)
    monkeypatch.setattr(knn, "REGION", 20)
    monkeypatch.setattr(knn, "BASE_CELL", 64)
    report = {}
    assert found(knn_pairs(df, df, ["id"], "features", 3, pivots=10, tau=tau, report=report)) == want
    assert report["rounds"] == 0 and (tau is not None or report["pairs"] == 250_000)


def test_blocks_of_a_base_give_the_same_nearest():
    rng = np.random.default_rng(33)
    base, query = np.round(8 * rng.normal(0, 1, (300, 3))) / 8, np.round(8 * rng.normal(0, 1, (40, 3))) / 8  # squares are exact
    one = knn.nearest_in_cell(query, base, 6)
    for block in (5, 64, 299, 300):
        assert all(np.array_equal(a, b) for a, b in zip(one, knn.nearest_in_blocks(query, base, 6, block), strict=True))


def test_search_to_a_recall_through_regions_below(spark, blobs, monkeypatch):
    """The buffer and its answer are those of the given regions."""
    few = blobs.filter("id < 1200")
    want = found(knn_pairs(few, few, ["id"], "features", 4, exclude_self=True, pivots=8, recall=0.7))
    monkeypatch.setattr(knn, "REGION", 40)
    report = {}
    assert found(knn_pairs(few, few, ["id"], "features", 4, exclude_self=True, pivots=8, recall=0.7, report=report)) == want
    assert 0 < report["pairs"] < 1200 * 1200 / 3 and report["rounds"] > 0


@pytest.fixture
def small_boxes(monkeypatch):
    """Boxes of a few rows, so that a small table has many, some cut into groups."""
    monkeypatch.setattr(knn, "LARGE", 100)
    monkeypatch.setattr(boxes, "LEAST_ROWS", 40)
    monkeypatch.setattr(boxes, "ROWS", 40)
    monkeypatch.setattr(knn, "BOX_QUERIES", 60)


def lines(rng, n):
    """A price and three features of few values, as line items have them."""
    return np.column_stack([np.round(rng.random(n), 4), rng.integers(0, 4, n) / 10, rng.integers(0, 3, n) / 8, rng.integers(0, 3, n) / 6])


@pytest.mark.parametrize("shape", ["lines", "spread", "grid", "far"])
def test_boxes_give_the_exact_answer(spark, small_boxes, shape):
    """With a hot vector, a far group and ties; all rows among all, and other rows among them."""
    rng = np.random.default_rng(41)
    points = {"lines": lines(rng, 400), "spread": rng.normal(0, 1, (400, 3)), "grid": rng.integers(0, 20, (400, 2)).astype(float), "far": rng.normal(0, 1, (400, 2)) + 1e8}[shape]
    points = np.vstack([points, np.tile(points[:1], (200, 1)), points[1:20] + 50])
    df, query = table(spark, points), table(spark, np.vstack([points[::15] + 0.01, points[:1] - 40, points[1:9]]), 5000)
    report = {}
    assert found(knn_pairs(df, df, ["id"], "features", 4, exclude_self=True, pivots=6, report=report)) == brute(pull(df), pull(df), 4, exclude=True)
    assert report["rounds"] == 1 and 0 < report["pairs"] < 0.6 * len(points) ** 2
    assert found(knn_pairs(query, df, ["id"], "features", 6)) == brute(pull(query), pull(df), 6)
    near = {k: v for k, v in brute(pull(query), pull(df), 6, limit=0.05).items() if v}
    assert found(knn_pairs(query, df, ["id"], "features", 6, max_distance=0.05)) == near


def test_boxes_with_odd_rows_columns_and_keys(spark, small_boxes):
    rng = np.random.default_rng(42)
    good = [(i, f"k{i:04}", i % 7, [float(x) for x in v]) for i, v in enumerate(lines(rng, 400))]
    odd = [(1000, "x", 1, None), (1001, "y", 1, [float("nan"), 0.0, 0.0, 0.0]), (1002, "z", 1, [None, 0.0, 0.0, 0.0]), (1003, "é", 1, [math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + odd, "id long, name string, part int, features array<double>").repartition(5)
    df = df.withColumn("kept", F.struct("part", F.col("name").alias("n")))
    rows = [(r["id"], r["features"]) for r in df.filter("id < 1000").collect()]
    out = knn_join(df, df, ["id", "name"], "features", 3, aux_cols=["id", "kept", "features"], exclude_self=True, distance_col="d").collect()
    want = brute(rows, rows, 3, exclude=True)
    assert {r["id"]: [(n["id"], round(d, 9)) for n, d in zip(r["neighbors"], r["d"], strict=True)] for r in out} == {**want, **{i: [] for i in range(1000, 1004)}}
    assert all(n["kept"]["n"] == f"k{n['id']:04}" and n["kept"]["part"] == n["id"] % 7 for r in out for n in r["neighbors"])
    vectors = df.filter("id < 1000").select("id", as_vector(df, "features").alias("features"))
    first = knn_join(vectors, vectors, ["id"], "features", 1, aux_cols=["id", "features"]).filter("id = 7").first()
    assert first["neighbors"][0]["features"] == first["features"]
    with pytest.raises(ValueError, match="query.*unique"):
        knn_pairs(df.select(F.lit(1).cast("long").alias("id"), "features"), df, ["id"], "features", 1)


def test_boxes_meet_few_rows_at_any_size(spark, small_boxes, monkeypatch):
    """Ten times as many line items: a query meets about as many rows, and nearly all are answered by one box."""
    monkeypatch.setattr(boxes, "ROWS", 400)
    monkeypatch.setattr(boxes, "LEAST_ROWS", 400)
    monkeypatch.setattr(knn, "BOX_QUERIES", 10_000)
    met = {}
    for n in (1500, 15_000):
        df, report = table(spark, lines(np.random.default_rng(43), n)), {}
        pairs = knn_pairs(df, df, ["id"], "features", 5, exclude_self=True, pivots=6, report=report)
        assert pairs.count() == 5 * n
        met[n] = report["pairs"] / n
    assert met[15_000] < 1.5 * met[1500] and met[15_000] < 500


def test_boxes_that_exclude_little_are_left(spark, small_boxes, monkeypatch):
    monkeypatch.setattr(knn, "MOST_MET", 10)
    monkeypatch.setattr(knn, "MOST_VISITED", 1.0)
    df, report = table(spark, lines(np.random.default_rng(44), 600)), {}
    assert found(knn_pairs(df, df, ["id"], "features", 4, exclude_self=True, pivots=6, report=report)) == brute(pull(df), pull(df), 4, exclude=True)


@pytest.mark.parametrize("keep", [1, 6, 40])
def test_points_in_small_boxes_equal_brute_force(monkeypatch, keep):
    monkeypatch.setattr(boxes, "ENDS", 8)
    monkeypatch.setattr(boxes, "_SLAB", 500)
    monkeypatch.setattr(boxes, "_PAIRS", 300)
    rng = np.random.default_rng(45)
    for base in (lines(rng, 500), rng.normal(0, 1, (500, 3)), rng.integers(0, 5, (500, 2)) * 1.0, np.zeros((3, 2)), rng.normal(0, 1, (1, 2)) + 1e9):
        first = boxes.few_copies(base, keep)
        v = np.vstack([base[::5], base[::7] + 0.3])
        bound = np.where(np.arange(len(v)) % 3 == 0, 0.2, math.inf)
        qi, bi, distance, met = boxes.Points(base[first], keep).nearest(v, keep, bound)
        got = [[(first[b], d) for b, d in zip(bi[qi == i], distance[qi == i], strict=True)] for i in range(len(v))]
        exact = [np.sqrt(sum((v[i, j] - base[:, j]) ** 2 for j in range(base.shape[1]))) for i in range(len(v))]
        assert got == [[(b, d[b]) for b in np.lexsort((np.arange(len(d)), d))[:keep] if d[b] <= bound[i]] for i, d in enumerate(exact)]
        assert (met > 0).all()
