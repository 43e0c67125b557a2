"""Secrets in texts: three fixed kinds by pattern, and strings that look drawn at random by character Markov models.

Everything on the way from text to spans is a column expression. Matches are placed by cutting the text at the pattern:
a match begins after all pieces and matches before it. Only texts that can hold a kind at all are cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.hostrules import with_value

#: Fixed by the contract: the pattern of each kind, the group whose length counts, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": (ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
NAMES = (*KINDS, "random")
#: Strings that the models judge: runs of these characters.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
#: Natural logarithm of the likelihood ratio per pair of characters above which a string is a secret; shorter strings need
#: the sum that one of so many characters needs.
MIN_RATIO, LONG = 0.9, 21
#: Documents (about so many, those whose keys hash lowest) that ordinary identifiers are made from; strings made of either
#: kind; pairs that the made ordinary ones, and those of the documents, count as.
SAMPLE, RANDOM, ORDINARY, WEIGHT = 2_000, 40_000, 20_000, 1_000_000
#: Characters that random strings are drawn from: base 64, letters and digits, letters, and so on, each as often.
DRAWN = (ALPHABET[:64], ALPHABET[:62], ALPHABET[:52], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:26], ALPHABET[26:52], ALPHABET[26:62])
#: Words that identifiers are often made of; with the words of the documents they stand for ordinary strings.
COMMON = """get set has add new old all any key val max min sum avg num str int map list array table index item value count size length
name type kind code data date time user account order customer product price total amount balance address number string object class method
function module package import export config setting option param argument result error warning message event handler listener request response
client server session token cookie header body content html http https json xml yaml csv sql api url uri path file folder directory
create read update delete insert remove find search filter sort group merge join split parse format encode decode compress build make
factory builder manager service controller provider adapter wrapper helper util test mock spec main init start stop open close
image video audio text line word page view model layout button window screen color style width height left right top bottom
north south east west john mary smith johnson williams thomas robert michael elizabeth alexander christopher anderson washington
january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday"""
_SPAN, _PART = "array<struct<start:int,kind:int,end:int>>", "array<struct<start:int,end:int>>"


def _matches(text: str, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans (start, kind, end) in code points of the leftmost matches that do not overlap and whose group is long enough."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    part = whole if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    before = F.transform(F.split(text, pattern, -1), F.length)
    # arrays_zip pads: there is one piece more than matches, without a length of its own.
    rows = F.arrays_zip(before.alias("before"), whole.alias("whole"), part.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(a: Column, r: Column) -> Column:
        begin = a["at"] + r["before"]
        end = begin + F.coalesce(r["whole"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(r["part"] >= least, F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

    return F.aggregate(rows, start, step, lambda a: a["found"])


def base_spans(text: str) -> Column:
    """All spans of the three kinds, by start and then kind. ``text`` has no nulls."""
    none, low = F.array().cast(_SPAN), F.lower(text)
    words = [F.contains(low, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    may = {"assign": words[0] | words[1] | words[2] | words[3] | words[4] | words[5], "access": F.contains(F.col(text), F.lit("AKIA")), "hex": F.col(text).rlike("[0-9a-f]{24}")}
    found = [F.when(may[k], _matches(text, *rule, i)).otherwise(none) for i, (k, rule) in enumerate(KINDS.items())]
    return F.sort_array(F.concat(*found))


def _place(char: Column) -> Column:
    return F.instr(F.lit(ALPHABET), char) - 1


def drawn_strings(spark: SparkSession, n: int = RANDOM) -> DataFrame:
    """(string): n strings of 20 to 43 characters, drawn from each of ``DRAWN`` as often."""
    alphabet = F.get(F.array(*map(F.lit, DRAWN)), (F.col("id") % len(DRAWN)).cast("int"))
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 512)
    rows = spark.range(n).select(digest.alias("h"), alphabet.alias("a"), (20 + F.floor(F.col("id") / len(DRAWN)) % 24).cast("int").alias("n"))
    byte = lambda i: F.conv(F.substring("h", 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("a", byte(i) % F.length("a") + 1, F.lit(1))), "").alias("string"))


def ordinary_values(spark: SparkSession, n: int = ORDINARY) -> DataFrame:
    """(string): dates and times in several forms, numbers of 1 to 18 digits, versions, telephone numbers and UUIDs."""
    digest = F.sha2(F.concat(F.lit("ordinary "), F.col("id").cast("string")), 256)
    rows = spark.range(n).select(digest.alias("h"), "id")
    part = lambda i, size: F.conv(F.substring("h", i, size), 16, 10).cast("long")
    at = F.timestamp_seconds(F.lit(631_152_000) + part(1, 8) % 1_500_000_000)
    dates = [F.date_format(at, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM-dd'T'HH-mm-ss", "yyyyMMdd'T'HHmmss'Z'", "dd-MMM-yyyy", "yyyy-MM-dd_HH-mm-ss")]
    number = F.substring(F.lpad(part(9, 15).cast("string"), 18, "7"), F.lit(1), (F.col("id") % 18 + 1).cast("int"))
    version = F.concat(F.lit("v"), (part(24, 2) % 20).cast("string"), F.lit("-"), (part(26, 2) % 100).cast("string"), F.lit("-"), (part(28, 2) % 100).cast("string"))
    phone = F.concat(F.lit("+"), (part(30, 2) % 99).cast("string"), F.lit("-"), (part(32, 4) % 1000).cast("string"), F.lit("-"), (part(36, 7) % 10_000_000).cast("string"))
    uuid = F.concat_ws("-", *(F.substring("h", a, b) for a, b in ((33, 8), (41, 4), (45, 4), (49, 4), (53, 12))))
    return rows.select(F.explode(F.array(*dates, number, version, phone, uuid)).alias("string"))


def common_triples(spark: SparkSession, n: int = ORDINARY) -> DataFrame:
    """(p): three words of ``COMMON`` each."""
    words = F.split(F.lit(" ".join(COMMON.split())), " ")
    pick = lambda i: F.get(words, F.pmod(F.xxhash64(F.lit(i), "id"), F.size(words)).cast("int"))
    return spark.range(n).select(F.array(pick(1), pick(2), pick(3)).alias("p"))


def labelled_strings(spark: SparkSession, docs: DataFrame, key: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """(string, random, made, times): labelled samples. Random ones are drawn from several alphabets, and what the base
    patterns find. Ordinary ones are identifiers of every three neighbouring words of sampled documents, in the pieces of
    :func:`ordinary_pieces`, and, ``made`` by rule, identifiers of common words, dates, numbers and the like.
    """
    n = max(1, docs.count())
    share = min(1.0, sample / n)
    picked = docs.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(F.coalesce(text, F.lit("")).alias("t"))
    picked = picked.withColumn("base", base_spans("t"))
    values = picked.select(F.explode("base").alias("s"), "t").where("s.kind < 2").select(F.regexp_extract(F.expr("substring(t, s.start + 1, s.end - s.start)"), "[A-Za-z0-9+/_=-]+$", 0).alias("string"))
    words = F.filter(F.split("t", "[^A-Za-z]+"), lambda w: F.length(w) >= 2)
    words = picked.where("size(base) = 0").select(words.alias("w")).where("size(w) >= 3")
    triples = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.slice("w", i, 3))).alias("p"))
    once = lambda df, random, made: df.select("string", F.lit(random).alias("random"), F.lit(made).alias("made"), F.lit(1).cast("long").alias("times"))
    pieces = lambda p, made: ordinary_pieces(p).select("string", "random", F.lit(made).alias("made"), "times")
    made = once(drawn_strings(spark).union(values), True, True).union(once(ordinary_values(spark), False, True))
    return made.union(pieces(common_triples(spark), True)).union(pieces(triples, False))


def ordinary_pieces(triples: DataFrame) -> DataFrame:
    """(string, random, times): pieces that hold every pair of characters of all eight forms of every triple ``p`` of words.

    The forms are joined by underscores, hyphens or strokes, in capitals, with a number, and in camel case with the first
    word also in small letters or in capitals. A piece is a word with what joins it to its neighbours, or the number of a
    triple. Equal pieces are counted before they are spelled out, so the work is one row per word of a triple and not one
    per character of a form.
    """
    initial = lambda w: F.upper(F.substring(w, 1, 1))
    number = F.expr("pmod(xxhash64(p), 1000)").cast("string")
    word = lambda i: F.struct(F.get("p", F.lit(i)).alias("word"), (initial(F.get("p", F.lit(i + 1))) if i < 2 else F.lit("")).alias("next"), F.lit(i).alias("at"))
    end = F.struct(F.lower(F.substring(F.get("p", F.lit(2)), -1, 1)).alias("word"), number.alias("next"), F.lit(3).alias("at"))
    counted = triples.select(F.explode(F.array(word(0), word(1), word(2), end)).alias("x")).groupBy("x.word", "x.next", "x.at").agg(F.count("*").alias("times"))
    lower = F.lower("word")

    def joined(w: Column, sign: str, last: str = "") -> Column:
        return F.concat(F.when(F.col("at") > 0, F.lit(sign)).otherwise(F.lit("")), w, F.when(F.col("at") < 2, F.lit(sign)).otherwise(F.lit(last)))

    def camel(first: Column) -> Column:
        return F.concat(F.when(F.col("at") == 0, first).otherwise(F.initcap("word")), "next")

    forms = F.array(
        joined(lower, "_"), joined(lower, "-"), camel(F.initcap("word")), joined(F.upper("word"), "_"), joined(lower, "_", "_"), joined(lower, "/"),
        camel(lower), camel(F.upper("word")),
    )
    numbers = F.array(F.concat(F.lit("_"), "next"), F.concat("word", "next"))
    pieces = F.when(F.col("at") < 3, forms).otherwise(numbers)
    return counted.select(F.explode(pieces).alias("string"), F.lit(False).alias("random"), "times")


def markov_ratios(strings: DataFrame) -> list[float]:
    """Log likelihood ratio, random over ordinary, of every pair of characters: one row of the alphabet after the other.

    Both models are smoothed by one of each pair. Ordinary pairs that are ``made`` and those of documents count alike, as
    ``WEIGHT`` each, however large the sample is. A character outside the alphabet ends a string. Texts also have rules and
    fillers of one repeated character, which no sampled identifier shows, so a pair of equal ones never speaks for random.
    """
    chars = strings.withColumn("c", F.split("string", "")).where("size(c) >= 2")
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(_place(F.get("c", i)).alias("a"), _place(F.get("c", i + 1)).alias("b")))
    counts = chars.select("random", "made", "times", F.explode(pairs).alias("p")).groupBy("random", "made", "p.a", "p.b").agg(F.sum("times").alias("count"))
    size = len(ALPHABET)
    table = {kind: [[1.0] * size for _ in range(size)] for kind in (True, False)}
    rows = counts.where("a >= 0 AND b >= 0").collect()  # a few tables of pairs of the alphabet at most
    total = {(False, made): sum(r["count"] for r in rows if not r["random"] and r["made"] == made) for made in (True, False)}
    for r in rows:
        table[r["random"]][r["a"]][r["b"]] += r["count"] if r["random"] else r["count"] * WEIGHT / total[False, r["made"]]
    ratios = [math.log(x / sum(xs)) - math.log(y / sum(ys)) for xs, ys in zip(table[True], table[False], strict=True) for x, y in zip(xs, ys, strict=True)]
    return [min(r, 0.0) if i % (size + 1) == 0 else r for i, r in enumerate(ratios)]


def _free(text: str, base: str) -> Column:
    """The parts (start, end) of a text that no base span covers."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_PART).alias("parts"))

    def step(a: Column, b: Column) -> Column:
        part = F.array(F.struct(a["at"].alias("start"), b["start"].alias("end")))
        return F.struct(F.greatest(a["at"], b["end"]).alias("at"), F.when(b["start"] > a["at"], F.concat(a["parts"], part)).otherwise(a["parts"]).alias("parts"))

    return F.aggregate(base, start, step, lambda a: F.concat(a["parts"], F.array(F.struct(a["at"].alias("start"), F.length(text).alias("end")))))


def random_spans(text: str, base: str, ratios: list[float]) -> Column:
    """Spans of runs, cut at the base spans, that the models call random.

    The sum of a run's ratios is over ``MIN_RATIO`` per pair, and over that of ``LONG`` characters where it is shorter.
    Runs too short for that sum, were all their pairs the likeliest one, are not looked at.
    """
    enough = MIN_RATIO * (LONG - 1)
    if max(ratios) <= 0:
        return F.array().cast(_SPAN)
    pattern = f"{RUN}{{{int(enough / max(ratios)) + 2},}}"
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def secret(run: Column) -> Column:
        places = F.transform(F.split(run, ""), _place)
        pairs = lambda p: F.sequence(F.lit(0), F.size(p) - 2)
        total = with_value(places, lambda p: F.aggregate(pairs(p), F.lit(0.0), lambda a, i: a + F.get(table, F.get(p, i) * len(ALPHABET) + F.get(p, i + 1))))
        # As a mean, the same number as before for a long run.
        return total / (F.length(run) - 1) > F.greatest(F.lit(MIN_RATIO), F.lit(enough) / (F.length(run) - 1))

    def runs(part: Column, offset: Column) -> Column:
        rows = F.arrays_zip(F.transform(F.split(part, pattern, -1), F.length).alias("before"), F.regexp_extract_all(part, F.lit(pattern), F.lit(0)).alias("run"))

        def step(a: Column, r: Column) -> Column:
            begin = a["at"] + r["before"]
            end = begin + F.coalesce(F.length(r["run"]), F.lit(0))
            span = F.struct(begin.alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(secret(r["run"]), F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

        return F.aggregate(rows, F.struct(offset.alias("at"), F.array().cast(_SPAN).alias("found")), step, lambda a: a["found"])

    return F.flatten(F.transform(_free(text, base), lambda f: runs(F.substring(F.col(text), f["start"] + 1, f["end"] - f["start"]), f["start"])))


def _of_kind(spans: str, kind: int) -> Column:
    """How many spans are of a kind; a second parameter of the lambda would be the span's place, given by Spark."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """One row per row of ``df``: (key, n_assign, n_access, n_hex, n_random, base_spans, random_spans, spans).

    The spans are arrays of (start, kind, end) in code points, kind counting ``NAMES``. ``random_spans`` are all parts of
    runs outside base spans that the models call random, and ``n_random`` is their number; ``spans`` has them and the base
    spans. ``ratios`` are those of :func:`markov_ratios`; without them the models are
    trained on samples from ``df``. A null text is empty. Other columns are not read.
    """
    docs = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if ratios is None:
        ratios = markov_ratios(labelled_strings(df.sparkSession, docs, key, "_text"))
    # The base spans are used more than once, so that Spark keeps them as a column.
    found = docs.withColumn("base_spans", base_spans("_text"))
    found = found.withColumn("random_spans", random_spans("_text", "base_spans", ratios))
    counts = [_of_kind("base_spans", i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = F.sort_array(F.concat("base_spans", "random_spans"))
    return found.select(key, *counts, F.size("random_spans").cast("long").alias("n_random"), "base_spans", "random_spans", spans.alias("spans"))


def secret_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, random_spans): the spans written as kind:start:end, joined by commas."""
    found = find_secrets(df, key, text)
    return found.select(key, "n_assign", "n_access", "n_hex", F.sha2(_written("base_spans"), 256).alias("base_sha256"), _written("spans").alias("spans"), _written("random_spans").alias("random_spans"))
