"""Filters on URLs: a list of rules as a cascade of Bloom filters, which tells listed keys from all others exactly.

The first level holds the listed keys. Which other keys of the corpus pass it is found in one reading, and the second
level holds those; the third holds the listed keys that pass the second, and so on, until nothing passes that should not.
A key of the corpus is listed if the first level that it fails is an even one. The levels are constants of the query:
no URL is joined with a rule. A rule is a host and a path, and the keys of a URL are the ends of its host with the
beginnings of its path, as far as any rule has their lengths.

Everything is a column expression or an aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.exact import LOWER, UPPER
from equipoise.llm.hostrules import with_value
from equipoise.sources.session import checkpoint

#: Bytes of all levels of a cascade that a query carries as constants; longer lists are cut and judged part by part.
MAX_BYTES = 16 << 20
#: Levels whose positions come from xxhash64; those after it, which only colliding keys reach, take SHA-256.
FAST_LEVELS = 24
#: Bits that ``bitmap_construct_agg`` puts in one row.
_ROW_BITS = 32_768


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits, how many of them count, and how many a key sets."""

    bitmap: bytes
    bits: int
    hashes: int
    number: int

    def positions(self, key: Column) -> Column:
        return _positions(key, self.bits, self.hashes, self.number)

    def holds(self, key: Column) -> Column:
        """Whether all bits of the key are set."""
        bitmap = F.lit(self.bitmap)

        def bit(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.bit_get(byte, (p % 8).cast("int")) == 1

        return F.forall(self.positions(key), bit)


def _positions(key: Column, bits: int, hashes: int, number: int) -> Column:
    """Bits of a key: two hashes, seeded by the level, make all of them."""
    if number < FAST_LEVELS:
        pair = [F.pmod(F.xxhash64(F.lit(2 * number + i), key), F.lit(bits)) for i in range(2)]
    else:
        digest = F.sha2(F.concat(F.lit(f"{number}:"), key), 256)
        pair = [F.pmod(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("long"), F.lit(bits)) for i in range(2)]
    made = F.struct(pair[0].alias("a"), pair[1].alias("b"))
    return with_value(made, lambda h: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (h["a"] + i * (h["b"] + 1)) % bits))


def level_size(keys: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a filter for so many keys that others pass with probability ``rate``."""
    rate = min(max(rate, 1e-12), 0.5)
    hashes = max(1, round(-math.log2(rate)))
    return max(64, 8 * math.ceil(hashes * max(1, keys) / math.log(2) / 8)), hashes


def build_level(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """The filter of the distinct ``key``s; a row of the aggregate holds 4 KB of it, and the driver all of it."""
    bits, hashes = level_size(count, rate)
    places = keys.select(F.explode(_positions(F.col("key"), bits, hashes, number)).alias("p")).select((F.col("p") + 1).alias("p"))  # both count from 1
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    bitmap = bytearray(-(-bits // _ROW_BITS) * _ROW_BITS // 8)
    for r in rows.collect():  # bounded by MAX_BYTES, see parts_of
        bitmap[(r["row"] - 1) * _ROW_BITS // 8 : r["row"] * _ROW_BITS // 8] = r["bitmap"]
    return Level(bytes(bitmap[: bits // 8 + 1]), bits, hashes, number)


@dataclass(frozen=True)
class Cascade:
    """Levels that hold listed keys and false positives in turn."""

    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed; a null key gives null."""
        verdict = F.lit(len(self.levels) % 2 == 1)  # passing all levels: the last one has the key's own kind
        for i, level in reversed(list(enumerate(self.levels))):
            verdict = F.when(level.holds(key), verdict).otherwise(F.lit(i % 2 == 1))
        return F.when(key.isNotNull(), verdict)


def build_cascade(listed: DataFrame, universe: DataFrame, others: int | None = None) -> Cascade:
    """A cascade that is exact for every ``key`` of ``universe`` and of ``listed``; both have a column ``key``.

    ``universe`` may repeat keys: it is read once, and only keys that pass the first level are grouped, each once per task
    and key. The first level lets about as many other keys pass as there are listed ones, or fewer; ``others`` is a
    guess of the number of other keys (by default they are counted approximately).
    """
    listed = checkpoint(listed.select("key").where("key IS NOT NULL").distinct())
    count = listed.count()
    if count == 0:
        return Cascade(())
    if others is None:
        others = universe.agg(F.approx_count_distinct("key")).first()[0]
    first = build_level(listed, count, math.sqrt(0.5) * count / max(1, others), 0)
    passing = universe.where(first.holds(F.col("key"))).select("key", F.lit(0).alias("own"))
    # No join: a key met in the list has its mark in the same group.
    false = passing.unionByName(listed.select("key", F.lit(1).alias("own"))).groupBy("key").agg(F.max("own").alias("own")).where("own = 0")
    levels, turn, other = [first], checkpoint(false.select("key")), listed
    while n := turn.count():
        level = build_level(turn, n, 0.5, len(levels))
        levels.append(level)
        turn, other = checkpoint(other.where(level.holds(F.col("key")))), turn
    return Cascade(tuple(levels))


def split_url(url: str) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; from there to ``?``, ``#``
    or the end. A null, or a text without ``://``, has neither."""
    known = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_keys(host: str, path: str, shapes: Sequence[tuple[int, int]]) -> Column:
    """Keys of a URL: ends of its host at a dot with beginnings of its path, of the lengths (host, path) that rules have."""
    h, p = F.col(host), F.col(path)
    size = F.array(*[F.struct(F.lit(a).alias("h"), F.lit(b).alias("p")) for a, b in shapes])

    def fits(s: Column) -> Column:
        dot = F.substring(h, F.length(h) - s["h"], F.lit(1)) == "."
        return (s["p"] <= F.length(p)) & ((s["h"] == F.length(h)) | (s["h"] < F.length(h)) & dot)

    return F.transform(F.filter(size, fits), lambda s: F.concat(F.right(h, s["h"]), F.left(p, s["p"])))


def parts_of(listed: DataFrame, others: int, most: int) -> int:
    """How many parts a list is cut into, so that the levels of each take ``most`` bytes at most.

    With r listed keys among s others the first level takes log2(s / r) + 0.5 bits over ln 2 per key, and the others
    together about 4 bits per key: half of that on the side of the false positives, which are 0.7 r.
    """
    count = listed.count()
    per_key = level_size(1_000_000, math.sqrt(0.5) * count / max(1, others))[0] / 1e6 + 8
    return max(1, math.ceil(count * per_key / 8 / most))


def judge_urls(
    df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """One row per row of ``df``: (key, host, path, rule, verdict).

    ``rules`` has (rule, verdict): a host with the beginning of a path, such as ``example.com/en/``, and ``allow`` or
    ``block``. A rule fits its host and all subdomains if the path begins with the rule's; of those that fit, the longest
    wins, and of equally long ones that with the longer host. Without one, ``rule`` is null and the verdict ``default``.
    Hosts of rules are lower-cased. A rule that is given twice with different verdicts blocks. A null or blank rule is
    none. Null URLs, or ones without ``://``, have an empty host and path, which no rule fits. Other columns are not read.

    Two cascades are built: one tells rules from all other keys of the corpus, one tells blocking rules from the others.
    Lists whose cascade would be larger than ``max_bytes`` are cut by hash and judged part after part.
    """
    cut = F.instr("rule", "/")
    rule_host = F.translate(F.when(cut > 0, F.substring(F.col("rule"), F.lit(1), cut - 1)).otherwise(F.col("rule")), UPPER, LOWER)
    listed = rules.where("trim(rule) <> ''").select(rule_host.alias("h"), F.when(cut > 0, F.substring(F.col("rule"), cut, F.length("rule"))).otherwise(F.lit("")).alias("p"), "verdict")
    listed = listed.select(F.concat("h", "p").alias("key"), F.length("h").alias("h"), F.length("p").alias("p"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"))
    listed = checkpoint(listed.groupBy("key", "h", "p").agg(F.max("blocks").alias("blocks")))
    shapes = sorted((r["h"], r["p"]) for r in listed.select("h", "p").distinct().collect())  # lengths, not rules
    host, path = split_url(url)
    pages = df.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    if not shapes:
        return pages.select(F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    pages = pages.withColumn("_keys", url_keys("host", "path", shapes))
    universe = pages.select(F.explode("_keys").alias("key"))
    others = universe.agg(F.approx_count_distinct("key")).first()[0]
    best = F.lit(None).cast("struct<size:int,host:int,rule:string,blocks:boolean>")
    parts = parts_of(listed, others, max_bytes)
    for part in range(parts):
        own = listed.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else listed
        rule = build_cascade(own, universe, others)
        if not rule.levels:
            continue
        block = build_cascade(own.where("blocks = 1"), own)

        def found(k: Column) -> Column:
            slash = F.instr(k, "/")
            length = F.when(slash > 0, slash - 1).otherwise(F.length(k))
            blocks = block.lists(k) if block.levels else F.lit(False)
            return F.struct(F.length(k).alias("size"), length.alias("host"), k.alias("rule"), blocks.alias("blocks"))

        hits = F.transform(F.filter("_keys", rule.lists), found)
        pages = pages.withColumn("_best", F.greatest(best, F.array_max(hits)))
        pages = checkpoint(pages) if part + 1 < parts else pages
        best = F.col("_best")
    verdict = F.when(best["blocks"], "block").when(best.isNotNull(), "allow").otherwise(default)
    return pages.select(F.col("_key").alias(key), "host", "path", best["rule"].alias("rule"), verdict.alias("verdict"))
