"""Quality rules of hosts: rule failures by host, shrunk towards the corpus, and the verdicts joined back to documents.

Everything is a column expression; the host table and one row of corpus sums are all that is aggregated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.sources.session import checkpoint

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Limits of the rules: fewest words, percent of words in repeated windows, symbols per 100 words, percent of repeated lines.
MIN_WORDS, MAX_REPEATED, MAX_SYMBOLS, MAX_DUP_LINES = 10, 20, 10, 30
#: A host goes if its shrunk failure rate for a rule exceeds this.
MAX_HOST_RATE = 0.5
RULES = ("short", "repeated", "symbols", "dup_lines")


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def split_words(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; a null has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), "")


def repeated_words(words: str, n_words: str, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that the text holds twice or more, the first window included.

    Hashes of the windows tell texts without a repeat, which are the most; the others compare the windows themselves.
    """
    at = F.sequence(F.lit(1), F.col(n_words).cast("int") - (size - 1))
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, size)))
    windows = F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i, size), " ").alias("w"), i.alias("i")))

    def covered(found: Column) -> Column:
        same = lambda e, k: F.get(found, k)["w"].eqNullSafe(e["w"])
        again = F.filter(found, lambda e, k: (k > 0) & same(e, k - 1) | same(e, k + 1))
        places = F.sort_array(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    exact = with_value(F.sort_array(windows), covered)
    any_twice = with_value(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.col(n_words) < size, F.lit(0).cast("long")).when(any_twice, exact).otherwise(F.lit(0).cast("long"))


def document_stats(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines): counts over the whole text.

    ``n_lines`` are the lines with a word; ``n_dup_lines`` those equal to an earlier one.
    """
    known = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(known, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.when(known.rlike(f"[{SYMBOLS}]"), F.length(known) - F.length(F.translate(known, SYMBOLS, ""))).otherwise(0)
    # Words and lines are each used twice, so that Spark keeps them as columns of their own.
    cut = df.select(F.col(key).alias("_key"), F.col(host).alias("_host"), split_words(text).alias("_words"), lines.alias("_lines"), symbols.cast("long").alias("n_symbols"))
    sized = cut.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    return sized.select(
        "_key", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words("_words", "n_words").alias("n_repeat_words"), "n_lines"
    )


def failures() -> dict[str, Column]:
    """Which rule a document of :func:`document_stats` fails."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > MAX_REPEATED * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * n,
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
    }


def host_rates(stats: DataFrame) -> DataFrame:
    """(host, documents, <rule>_rate…): failure rates of every host, shrunk with a beta prior fitted to all hosts.

    The prior of a rule has the corpus rate m as its mean and the strength m (1 - m) / v - 1, v being the variance of the
    hosts' rates, each host weighted by its documents (one document at least, a million at most). A null host is a host.
    """
    fails = failures()
    hosts = stats.groupBy("_host").agg(F.count("*").alias("n"), *(F.sum(fails[r].cast("long")).alias(r) for r in RULES))
    hosts = checkpoint(hosts)  # read for the prior and again for the rates
    sums = hosts.agg(F.sum("n").alias("n"), *(F.sum(r).alias(r) for r in RULES), *(F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_2") for r in RULES)).first()
    total = sums["n"] or 1
    rates = []
    for r in RULES:
        mean = (sums[r] or 0) / total
        spread = (sums[f"{r}_2"] or 0.0) / total - mean * mean
        strength = mean * (1 - mean) / spread - 1 if spread > 1e-12 else 1e6
        strength = min(max(strength, 1.0), 1e6)
        rates.append(((F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))).alias(f"{r}_rate"))
    return hosts.select("_host", F.col("n").alias("documents"), *rates)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of ``df``: (key, the counts of :func:`document_stats`, base_failed, host_rejected, kept).

    base_failed: too short, or too many words in repeated windows. A host is rejected if its shrunk rate of any rule is
    above ``MAX_HOST_RATE``; a document is kept if it did not fail itself and its host stands. Nulls: a null text is
    empty (and so fails), a null host is one host, a null key is returned as it is. Other columns are not read.
    """
    stats = checkpoint(document_stats(df, key, text, host))
    rates = host_rates(stats)
    bad = F.greatest(*(F.col(f"{r}_rate") for r in RULES)) > MAX_HOST_RATE
    verdicts = rates.select(F.col("_host").alias("_judged"), bad.alias("host_rejected"))
    fails = failures()
    joined = stats.join(verdicts, F.col("_host").eqNullSafe(F.col("_judged"))).withColumn("base_failed", fails["short"] | fails["repeated"])
    return joined.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rejected",
    )
