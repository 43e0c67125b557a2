"""Mixing sources to target weights: Sainte-Laguë quotas of equal blocks, and the words that they take from documents.

Blocks are never listed. A shard is its documents in seeded order, read as a ring of words; its quota of blocks is a run
of that ring from a seeded word on, so what a document gives follows from its place alone. Everything is a column
expression; per source or shard there is one row, and the driver sees sums only.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equipoise.llm.arrow import unused
from equipoise.llm.hostrules import split_words, with_value
from equipoise.sources.session import checkpoint

#: Words of a block; words of a shard; shards, or groups of them, whose quotas are found within one row.
BLOCK, SHARD_WORDS, FAN = 32, 100_000, 4096
#: Sources that one task ranks; quotients that are sorted at the end of the search; candidates tried in one pass.
RANKED, SORTED, TRIED = 100_000, 10_000, 31
SEED = 11


def _draw(*parts: Column) -> Column:
    """32 random bits that follow from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def _seats(votes: Column, most: Column, quotient: Column) -> Column:
    """How many of votes/1, votes/3, votes/5, … reach ``quotient``, ``most`` at most (a double without fraction)."""
    n = F.least(F.floor((votes / quotient + 1) / 2).cast("double"), most)
    n = F.when((n < most) & (votes / (2 * n + 1) >= quotient), n + 1).otherwise(n)
    return F.when((n > 0) & (votes / F.greatest(2 * n - 1, F.lit(1.0)) < quotient), n - 1).otherwise(n)


def _bits(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0]


def _double(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` (from 0) by code point of ``source``, null last, without one task for all of them."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = -(-max(1, sources.count()) // RANKED)
    cut = checkpoint(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before, start = 0, F.lit(0).cast("long")
    for r in cut.groupBy("part").count().orderBy("part").collect():  # one row per RANKED sources
        start, before = F.when(F.col("part") == r["part"], F.lit(before)).otherwise(start), before + r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return cut.select("*", (place + start).alias("rank")).drop("part")


def targets(sources: DataFrame, share: float, weights: Sequence[int], cap: int) -> DataFrame:
    """``sources`` (rank, source_size) with ``target`` words: ``share`` of all words by weight, ``cap`` times a source at most.

    What a source cannot take goes to the others by their weights, round by round; a round is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    most = F.col("source_size") * cap
    table = sources.withColumn("weight", weight)
    sums = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    words, taken, open_weight, full = share * (sums["size"] or 0), 0, sums["weight"] or 1, 0
    while True:
        level = (words - taken) / open_weight
        above = F.col("weight") * F.lit(level) > most
        now = table.agg(F.sum(F.when(above, most)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("full")).first()
        if now["full"] == full or not now["open"]:
            break
        taken, open_weight, full = now["taken"] or 0, now["open"], now["full"]
    target = F.when(above, most.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.withColumn("target", target).drop("weight")


def source_quotas(table: DataFrame, blocks: int) -> DataFrame:
    """(rank, quota): ``blocks`` seats by the highest quotients target/1, target/3, …, at most ``capacity`` per source.

    The lowest quotient that still gets a seat is searched for, ``TRIED`` candidates per pass; the few quotients left
    between the bounds are sorted. Ties go to the source that ranks first.
    """
    votes, most = F.col("target"), F.col("capacity").cast("double")
    top = table.agg(F.max("target")).first()[0] or 0.0
    low, high = _bits(1e-12), _bits(max(top, 1e-9)) + 1
    under, over = None, 0  # seats at the bounds
    while high - low > 1 and (under is None or under - over > SORTED):
        tried = sorted({low + (high - low) * (i + 1) // (TRIED + 1) for i in range(TRIED)} - {low})
        found = table.agg(*(F.sum(_seats(votes, most, F.lit(_double(b)))).alias(f"s{i}") for i, b in enumerate(tried))).first()
        for i, b in enumerate(tried):
            n = int(found[f"s{i}"] or 0)
            if n >= blocks:
                low, under = b, n
            else:
                high, over = b, n
                break
    sure = _seats(votes, most, F.lit(_double(high)))
    last = _seats(votes, most, F.lit(_double(low)))
    base = checkpoint(table.select("rank", sure.alias("sure"), last.alias("last"), "target"))
    rest = blocks - int(base.agg(F.sum("sure")).first()[0] or 0)
    close = base.where("last > sure").select("rank", "target", F.explode(F.sequence(F.col("sure").cast("long") + 1, F.col("last").cast("long"))).alias("k"))
    picked = close.orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), "rank").limit(max(0, rest)).groupBy("rank").agg(F.count("*").alias("more"))
    quota = F.col("sure").cast("long") + F.coalesce("more", F.lit(0))
    return base.join(picked, "rank", "left").select("rank", quota.alias("quota"))


def nested_quotas(shards: DataFrame, quotas: DataFrame, widest: int) -> DataFrame:
    """(rank, shard, shard_size, blocks): a source's quota over its shards, ``widest`` at most.

    More than ``FAN`` shards are dealt in levels: a source's quota goes to groups of shards, a group's to smaller ones,
    each level by the same rule, so that no row holds more than ``FAN`` parts at any number of shards.
    """
    spans = [1]
    while spans[-1] * FAN < widest:
        spans.append(spans[-1] * FAN)
    parents = [F.col("rank"), F.lit(0).cast("long").alias("above")]
    given = quotas.select(F.struct(*parents).alias("rank"), "quota")
    for span in reversed(spans):
        part = F.floor(F.col("shard") / span).cast("long")
        parts = shards.select("rank", part.alias("shard"), "shard_size", "room").groupBy("rank", "shard").agg(F.sum("shard_size").alias("shard_size"), F.sum("room").alias("room"))
        above = F.floor(F.col("shard") / FAN).cast("long").alias("above")
        given = shard_quotas(parts.withColumn("rank", F.struct("rank", above)), given)
        if span > 1:
            given = checkpoint(given.select(F.struct("rank.rank", F.col("shard").alias("above")).alias("rank"), F.col("blocks").alias("quota")))
    return given.withColumn("rank", F.col("rank.rank"))


def shard_quotas(shards: DataFrame, quotas: DataFrame) -> DataFrame:
    """(rank, shard, shard_size, blocks): the quota of a rank over its shards by the same rule, within one row per rank."""
    held = F.sort_array(F.collect_list(F.struct("shard", "shard_size", F.col("shard_size").cast("double").alias("v"), F.col("room").cast("double").alias("c"))))
    rows = shards.groupBy("rank").agg(held.alias("held")).join(quotas, "rank")

    def total(q: Column) -> Column:
        return F.aggregate("held", F.lit(0.0), lambda a, h: a + _seats(h["v"], h["c"], q))

    def halve(a: Column, _: Column) -> Column:
        middle = (a["low"] + a["high"]) / 2
        tried = F.struct(middle.alias("q"), (total(middle) >= F.col("quota")).alias("enough"))
        return with_value(tried, lambda t: F.struct(F.when(t["enough"], t["q"]).otherwise(a["low"]).alias("low"), F.when(t["enough"], a["high"]).otherwise(t["q"]).alias("high")))

    # The lowest quotient with a seat lies between 0 and the largest shard; 100 halvings leave neighbouring doubles.
    start = F.struct(F.lit(1e-9).alias("low"), (F.array_max(F.transform("held", lambda h: h["v"])) + 1).alias("high"))
    bound = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, halve)
    # The bound is found once per row, not once per shard: it is a value before the lambda that uses it.
    sure = with_value(bound, lambda b: F.transform("held", lambda h: F.struct(h["shard"].alias("shard"), h["shard_size"].alias("shard_size"), h["v"].alias("v"), _seats(h["v"], h["c"], b["high"]).alias("n"), h["c"].alias("c"))))
    rows = rows.select("rank", "quota", sure.alias("held"))
    open_ = F.filter("held", lambda h: h["n"] < h["c"])
    following = F.sort_array(F.transform(open_, lambda h: F.struct((-h["v"] / (2 * h["n"] + 1)).alias("q"), h["shard"].alias("shard"))))
    rest = F.col("quota") - F.aggregate("held", F.lit(0.0), lambda a, h: a + h["n"]).cast("long")
    extra = F.transform(F.slice(following, F.lit(1), F.greatest(rest, F.lit(0)).cast("int")), lambda x: x["shard"])
    rows = rows.select("rank", "held", extra.alias("extra")).select("rank", "extra", F.explode("held").alias("h"))
    blocks = F.col("h.n").cast("long") + F.array_contains("extra", F.col("h.shard")).cast("long")
    return rows.select("rank", F.col("h.shard").alias("shard"), F.col("h.shard_size").alias("shard_size"), blocks.alias("blocks"))


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5,
    weights: Sequence[int] = (3, 1, 2), cap: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``df``: (key, size, source_size, target, taken).

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: none). The mix has ``share`` times all
    words; sources, ordered by code point and a null source last, weigh ``weights`` in turn, and none is taken more than
    ``cap`` times. ``taken`` counts the words that the document gives, repeats included: ``cap`` x size at most. A source
    misses its target by a block, and where it is taken ``cap`` times by a block per shard; a shard of less than a block
    has one that ends with it. An empty table gives no rows, documents without words give none. The draw follows from
    ``seed``, keys and texts, so that rows that share a key or have none are spread; rows equal in both give in turn.
    """
    tag = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    sizes = df.select(F.col(key).alias("_key"), tag.alias("_tag"), F.col(source).alias("source"), F.size(split_words(text)).cast("long").alias("size"))
    sizes = checkpoint(sizes)  # the only reading of the texts
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = targets(checkpoint(ranked_sources(checkpoint(found))), share, weights, cap)
    cuts = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    table = checkpoint(table.withColumn("shards", cuts))
    docs = sizes.join(table.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).select(
        "_key", "_tag", "size", "source_size", "target", "rank", F.pmod(_draw(F.lit(f"shard {seed}"), F.col("_tag")), F.col("shards")).alias("shard")
    )
    shards = checkpoint(docs.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size")))
    some = (F.col("shard_size") * cap > 0).cast("long")
    shards = shards.withColumn("room", F.greatest(F.floor(F.col("shard_size") * cap / block), some))
    room = shards.groupBy("rank").agg(F.sum("room").alias("capacity"))
    table = checkpoint(table.join(room, "rank"))
    sums = table.agg(F.sum("source_size"), F.sum("capacity"), F.max("shards")).first()
    blocks = min(int(share * (sums[0] or 0) / block + 0.5), sums[1] or 0)
    quotas = nested_quotas(shards, source_quotas(table, blocks), sums[2] or 1)
    rows = docs.withColumnRenamed("size", "_size").join(quotas, ["rank", "shard"])
    order = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.col("_tag")))
    ring = Window.partitionBy("rank", "shard").orderBy(order, "_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.sum("_size").over(ring) - F.col("_size"))
    length = F.greatest("shard_size", F.lit(1))
    start = F.pmod(_draw(F.lit(f"start {seed}"), F.col("rank").cast("string"), F.col("shard").cast("string")), length)

    def before(x: Column) -> Column:
        """Words of the document among the first x words of the endless ring."""
        return F.floor(x / length) * F.col("_size") + F.least(F.greatest(F.pmod(x, length) - F.col("first"), F.lit(0)), F.col("_size"))

    run = F.least(F.col("blocks") * block, F.col("shard_size") * cap)
    taken = before(start + run) - before(start)
    return rows.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    """``df`` as mixed: each row as often as its words are taken, to the nearest whole number; all columns stay.

    Only the documents at the two ends of a shard's run are taken in part, so rounding moves two documents per shard.
    Rows that share a key are each repeated as often as the most taken of them. A null, empty or blank text has no words,
    and a key with no other text gives no rows.
    """
    mixed, times, copy = unused(df, "_mixed", "_copies", "_copy")
    copies = mix(df, key, text, **how).groupBy(F.col(key).alias(mixed)).agg(F.max(F.round(F.try_divide("taken", "size"))).cast("int").alias(times))
    copies = copies.where(F.col(times) > 0)
    joined = df.join(copies, F.col(key).eqNullSafe(F.col(mixed)))
    return joined.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)
