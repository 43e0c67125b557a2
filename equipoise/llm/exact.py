"""Exact duplicates, found without gathering the copies of a text anywhere.

The combining has three stages, each of which compares full contents because the text itself is a grouping key: a map
task first merges its own copies (Spark's partial aggregation), copies with the same digest and salt meet next, and the
winners of the salts are combined last. A text that makes up a third of all rows is therefore spread over ``salts``
groups, and each of those receives one row per map task at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.arrow import unused
from equipoise.sources.session import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str) -> Column:
    """A-Z in lower case, other characters as they are; a null is empty."""
    known = F.coalesce(F.col(text), F.lit(""))
    plain = F.octet_length(known) == F.length(known)  # for ASCII the built-in lower() is the same and far cheaper
    return F.when(plain, F.lower(known)).otherwise(F.translate(known, UPPER, LOWER))


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 32) -> DataFrame:
    """One row per row of ``df``: (key, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; a null counts as empty. Of equal texts the largest key stays
    (a null key stays only if all are null). Rows that repeat the staying key and text are all ``kept``.
    Other columns of ``df`` are not read. ``salts`` (at most 63) sets over how many groups the copies of one text go.
    """
    if not 1 <= salts <= 63:
        raise ValueError("salts must be 1 to 63")
    docs = df.select(F.col(key).alias("_key"), ascii_lower(text).alias("_text"))
    docs = docs.select("*", F.sha2("_text", 256).alias("_digest"), F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int").alias("_salt"))
    salted = docs.groupBy("_digest", "_salt", "_text").agg(F.max("_key").alias("_best"), F.count("*").alias("_n"))
    merged = salted.groupBy("_digest", "_text").agg(
        F.max("_best").alias("_keep"),
        F.sum("_n").alias("_size"),
        F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_salts"),
    )
    # The way back to the rows needs no text: digest, hash and length name a content.
    check = [F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_length")]
    held = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.bit_get("_salts", s) == 1)
    classes = merged.select("_digest", *check, "_keep", "_size", F.explode(held).alias("_salt"))
    rows = docs.select("_key", "_digest", *check, "_salt")
    return rows.join(classes, ["_digest", "_hash", "_length", "_salt"]).select(
        F.col("_key").alias(key),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_key").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 32) -> DataFrame:
    """``df`` without the rows that :func:`exact_duplicates` drops; all columns stay.

    Rows that repeat the staying key and text leave one of them, whatever their other columns.
    """
    best, digest = unused(df, "_kept", "_digest")
    kept = exact_duplicates(df, key, text, salts).where("kept").groupBy(F.col(key).alias(best), F.col("text_sha256").alias(digest)).count()
    same = F.col(key).eqNullSafe(F.col(best)) & (F.sha2(ascii_lower(text), 256) == F.col(digest))
    return one_of_each(df, kept, same, [best, digest])


def one_of_each(df: DataFrame, kept: DataFrame, same: Column, names: list[str]) -> DataFrame:
    """The rows of ``df`` that meet a row of ``kept`` (``names``, count), one for each row of ``kept``.

    Only rows that ``kept`` counts more than once are grouped, each task merging its own first.
    """
    kept = checkpoint(kept)
    alone = df.join(kept.where("count = 1").select(*names), same, "left_semi")
    repeated = kept.where("count > 1").select(*names)
    if repeated.isEmpty():
        return alone
    (row,) = unused(df, "_row")
    firsts = df.join(repeated, same).groupBy(*names).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(row))
    return alone.union(firsts.select(*(F.col(row).getField(c).alias(c) for c in df.columns)))
