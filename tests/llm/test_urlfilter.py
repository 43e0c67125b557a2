"""URL rules against plain Python, and cascades that are exact for every key of their universe."""

import random
import re

import pytest
from pyspark.sql import functions as F

from equipoise.llm import urlfilter
from equipoise.llm.queries import URL_RULES
from equipoise.llm.urlfilter import build_cascade, judge_urls, level_size, split_url


def plain(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, verdict in sorted(rules, key=lambda r: r[1] == "block"):  # of two verdicts for one rule, block comes last and wins
        h, slash, p = rule.partition("/")
        h, p = re.sub("[A-Z]", lambda c: c[0].lower(), h), slash + p
        if rule.strip() and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h + p), len(h)) >= best[0]):
            best = ((len(h + p), len(h)), h + p, verdict)
    return (host, path, best[1] if best else None, best[2] if best else default)


def urls():
    rng = random.Random(3)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.b.example.net", "net", "com", "notcom", "notexample.com", "x.org", "", ".com", "a..net", "é.com", "com.", "m.example.com:80", "u@example.com"]
    paths = ["", "/", "/en/", "/en/a/b", "/EN/", "/es/1", "/fr/", "/fr", "/é/en/", "//en/", "/en"]
    tails = ["", "?q=/en/", "#top", "?x#y", "?http://example.com/en/"]
    out = [rng.choice(["http://", "https://", "://", "x://y://", ""]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(600)]
    return out + [None, "", "://", "http:/example.com/en/", "http://a\nb.example.com/en/\nx", "http://" + "a." * 3000 + "example.com/en/" + "y" * 50_000, "no scheme"]


def pages(spark, values):
    return spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(values)], "page_id long, url string, host string, rule string, _keys int").repartition(4)


def judged(spark, values, rules, **how):
    table = spark.createDataFrame(rules, "rule string, verdict string")
    return {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages(spark, values), table, **how).collect()}


def test_rules_of_the_contract(spark):
    values = urls()
    got = judged(spark, values, URL_RULES)
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(values)}
    assert {v[3] for v in got.values()} == {"allow", "block"} and len({v[2] for v in got.values()}) == 6


def test_other_rules(spark):
    values = urls()
    rules = [("example.com", "block"), ("EXAMPLE.com/e", "allow"), ("net/", "allow"), ("net/", "block"), ("b.example.net", "allow"), ("/", "block"), ("", "block"), ("é.com/é", "block"), ("x.org/en", "block"), ("org//en/", "block")]
    assert judged(spark, values, rules, default="block") == {i: plain(u, rules, "block") for i, u in enumerate(values)}
    assert set(judged(spark, values, [("", "block")]).values()) == {(*plain(u, [])[:2], None, "allow") for u in values}


def test_many_rules_in_parts(spark):
    rng = random.Random(5)
    values = [f"http://{rng.choice('abc')}.h{rng.randrange(400)}.com/p{rng.randrange(9)}/x" for _ in range(1500)]
    rules = [(f"h{i}.com/p{i % 9}", rng.choice(["allow", "block"])) for i in range(0, 400, 2)] + [(f"a.h{i}.com/", "block") for i in range(1, 400, 3)]
    want = {i: plain(u, rules) for i, u in enumerate(values)}
    assert judged(spark, values, rules) == want
    assert judged(spark, values, rules, max_bytes=400) == want  # three parts or more


@pytest.mark.parametrize("listed,others", [(1, 5000), (300, 5000), (3000, 3000), (5000, 0)])
def test_cascade_is_exact_for_its_universe(spark, listed, others):
    keys = spark.range(listed).select(F.concat(F.lit("key/"), F.col("id").cast("string")).alias("key"))
    universe = spark.range(listed // 2, listed + others).select(F.concat(F.lit("key/"), F.col("id").cast("string")).alias("key"))
    universe = universe.unionByName(universe.limit(10))  # keys may repeat
    cascade = build_cascade(keys, universe, others=listed)  # a poor guess makes more false positives
    wrong = keys.unionByName(universe).where(cascade.lists(F.col("key")) != (F.regexp_extract("key", "[0-9]+", 0).cast("int") < listed))
    assert wrong.count() == 0
    if others > listed:
        assert len(cascade.levels) > 1


def test_slow_levels_are_exact_too(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "FAST_LEVELS", 1)
    keys, universe = (spark.range(a, b).select(F.col("id").cast("string").alias("key")) for a, b in ((0, 400), (0, 3000)))
    cascade = build_cascade(keys, universe, others=10)
    assert len(cascade.levels) > 2 and universe.where(cascade.lists(F.col("key")) != (F.col("key").cast("int") < 400)).count() == 0


def test_level_sizes():
    assert level_size(1, 0.5) == (64, 1)
    bits, hashes = level_size(1_000_000, 1 / 1024)
    assert hashes == 10 and 14.4e6 < bits < 14.5e6


def test_empty_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    assert judge_urls(pages(spark, []), rules).count() == 0
    none = spark.createDataFrame([], "rule string, verdict string")
    assert judge_urls(pages(spark, ["http://a.com/"]), none).first()["verdict"] == "allow"
    assert build_cascade(none.select(F.col("rule").alias("key")), none.select(F.col("rule").alias("key"))).levels == ()


def test_no_join_and_no_python(spark):
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    plan = judge_urls(pages(spark, urls()), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "").replace("Exchange SinglePartition", "") and "Python" not in plan and "Arrow" not in plan


def test_split(spark):
    values = urls()
    got = pages(spark, values).select("page_id", *(c.alias(n) for c, n in zip(split_url("url"), ("h", "p")))).collect()
    assert {r["page_id"]: (r["h"], r["p"]) for r in got} == {i: plain(u, [])[:2] for i, u in enumerate(values)}
