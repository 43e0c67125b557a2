"""Registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm import bpe, exact, hostrules, infill, language, mixing, negatives, quality, secrets, simhash, substrings, urlfilter, warc


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf, "documents"), window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(spark, _table(spark, sf, "documents"))


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_round_trip(spark, _table(spark, sf, "pages"), "page_id", "url", "html")


def op5_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    return hostrules.judge(_table(spark, sf, "documents"))


def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf, "documents"))


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.assess(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf, "documents"))


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"), words=3, distance=3)


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "embeddings")
    # by contract every seventh row has another label
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved))


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    cut = infill.fill_in_middle(_table(spark, sf, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: Fixed by the contract.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op13_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language": op3_language,
    "op4_warc": op4_warc,
    "op5_host_rules": op5_host_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_filters": op13_url_filters,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
           FROM documents),
p AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS g
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM p) WHERE owner < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM r),
w AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op5_host_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS g FROM (
        SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
twice AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM places) WHERE c > 1),
covered AS (SELECT doc_id, sum(least(5, coalesce(i - last, 5)))::BIGINT AS n FROM twice GROUP BY doc_id),
s AS (SELECT w.doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeated,
        100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM s),
h AS (SELECT source, rule, count(*) AS n, sum(fails::INT) AS x
      FROM (SELECT source, unnest(['short', 'repeated', 'symbols', 'dup_lines']) AS rule,
              unnest([short, repeated, symbols, dup_lines]) AS fails FROM f) GROUP BY ALL),
m AS (SELECT rule, sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2 AS spread FROM h GROUP BY rule),
k AS (SELECT rule, mean, CASE WHEN spread > 1e-12 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1e6) ELSE 1e6 END AS k FROM m),
v AS (SELECT source, bool_or((x + mean * k) / (n + k) > 0.5) AS host_rejected FROM h JOIN k USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed,
       NOT (short OR repeated) AND NOT host_rejected AS kept, host_rejected
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""",
    "op6_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, md5(doc_id || ':' || md5(coalesce(text, ''))) AS tag, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
           FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS weight, source_size * 2 AS most FROM s1),
s3 AS (SELECT *, sum(most) OVER w - most AS below, sum(weight) OVER () - sum(weight) OVER w + weight AS open,
         sum(source_size) OVER () AS total FROM s2 WINDOW w AS (ORDER BY most / weight, rank ROWS UNBOUNDED PRECEDING)),
level AS (SELECT (1.5::DOUBLE * total::DOUBLE - below::DOUBLE) / open::DOUBLE AS level FROM s3
          WHERE weight * ((1.5::DOUBLE * total::DOUBLE - below::DOUBLE) / open::DOUBLE) <= most ORDER BY most / weight, rank LIMIT 1),
t AS (SELECT s2.*, CASE WHEN weight * level > most THEN most::DOUBLE ELSE weight * level END AS target,
        greatest(ceil(source_size / 100000.0), 1)::BIGINT AS shards FROM s2, level),
p AS (SELECT doc_id, tag, size, source_size, target, rank, ('0x' || md5('shard 11:' || tag)[1:8])::BIGINT % shards AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT rank, shard, sum(size)::BIGINT AS shard_size, greatest(floor(sum(size) * 2 / 32), (sum(size) > 0)::INT)::BIGINT AS room FROM p GROUP BY ALL),
c AS (SELECT t.rank, target, sum(room)::BIGINT AS capacity, any_value(source_size) AS source_size FROM t JOIN h USING (rank) GROUP BY ALL),
n AS (SELECT least(floor(1.5 * sum(source_size) / 32 + 0.5), sum(capacity)) AS blocks FROM c),
a AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank) AS place
      FROM (SELECT rank, target, unnest(range(1, capacity + 1)) AS k FROM c)),
q AS (SELECT rank, count(*) AS quota FROM a, n WHERE place <= blocks GROUP BY rank),
b AS (SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * k - 1) DESC, shard) AS place
      FROM (SELECT rank, shard, shard_size, unnest(range(1, room + 1)) AS k FROM h)),
u AS (SELECT b.rank, shard, count(*) AS blocks FROM b JOIN q USING (rank) WHERE place <= quota GROUP BY ALL),
r AS (SELECT p.*, greatest(shard_size, 1) AS len, least(coalesce(blocks, 0) * 32, shard_size * 2) AS run,
        sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY md5('order 11:' || tag), doc_id ROWS UNBOUNDED PRECEDING) - size AS first,
        ('0x' || md5('start 11:' || p.rank || ':' || p.shard)[1:8])::BIGINT % greatest(shard_size, 1) AS start
      FROM p JOIN h USING (rank, shard) LEFT JOIN u ON u.rank = p.rank AND u.shard = p.shard)
SELECT doc_id, size, source_size, target,
       (((start + run) // len * size + least(greatest((start + run) % len - first, 0), size))
        - (start // len * size + least(greatest(start % len - first, 0), size)))::BIGINT AS taken
FROM r""",
    "op11_hard_negatives": """
WITH g AS (SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM g),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
l AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i : i + 7])::BIGINT) AS r,
        regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines FROM d),
c AS (SELECT *, len(lines)::BIGINT AS n, least(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS a,
        greatest(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS b FROM l),
p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1 : b], '') AS middle,
        array_to_string(lines[b + 1 :], '') AS suffix,
        CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""",
    "op13_url_filters": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rule, h, p, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
f AS (SELECT u.*, rule, verdict FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, length(host) DESC) = 1""",
}
