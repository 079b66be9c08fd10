"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_rules, line_dedup, neighbours, ngram_join, packing, secret_scan, suffix_dedup, tokens, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = line_dedup.apply_bitmaps(docs.select("doc_id", "text"), line_dedup.line_bitmaps(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.drop("host_rate")


QUERIES: dict[str, Query] = {"op5_line_dedup": op5_line_dedup, "op6_host_rules": op6_host_rules}

LINE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS lost FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES: dict[str, str] = {"op5_line_dedup": LINE_SQL}


def vocabulary() -> str:
    """The public vocabulary file; its place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


QUERIES |= {"op8_packing": op8_packing, "op9_bpe": op9_bpe}


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"),
    )


QUERIES |= {"op3_secret_scan": op3_secret_scan}


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES |= {"op7_warc": op7_warc}


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


QUERIES |= {"op2_nearest": op2_nearest}


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES |= {"op4_toxicity": op4_toxicity}


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES |= {"op1_ngram_join": op1_ngram_join}


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"), "n_passage_words")


QUERIES |= {"op10_suffix_dedup": op10_suffix_dedup}

HOST_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS f FROM documents),
x AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT r, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM x WINDOW p AS (PARTITION BY r ORDER BY i)),
z AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM y WHERE c IS NOT NULL),
v AS (SELECT DISTINCT r, i + k AS j FROM z CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) ks WHERE n > 1),
reps AS (SELECT r, count(*) AS n FROM v GROUP BY r),
m AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda q: length(q))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(f) - len(list_distinct(f)) AS BIGINT) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words
  FROM d LEFT JOIN reps ON reps.r = d.r),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words OR word_chars > 12 * n_words OR n_dup_lines >= 3 AS soft_failed FROM m),
hosts AS (SELECT host, count(*) AS n, count_if(base_failed OR soft_failed) AS k FROM j GROUP BY host),
prior AS (SELECT avg(k / n) AS mean, greatest(1.0, coalesce(avg(k / n) * (1 - avg(k / n)) / nullif(var_pop(k / n), 0), 1e6) - 1) AS strength FROM hosts),
bad AS (SELECT host, (k + mean * strength) / (n + strength) > 0.6 AS bad FROM hosts CROSS JOIN prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT (bad AND soft_failed) AS kept
FROM j JOIN bad ON bad.host IS NOT DISTINCT FROM j.host
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.sha, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON f.sha = p.sha
"""

ORACLES |= {"op6_host_rules": HOST_SQL, "op7_warc": WARC_SQL}

#: exact Jaccard of all pairs that share an n-gram; copies (equal word sequences) are one node
JOIN_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT w, row_number() OVER () AS node FROM (SELECT DISTINCT w FROM d)),
g AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM n WHERE len(w) > 0),
s AS (SELECT node, count(*) AS size FROM g GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node GROUP BY a.node, b.node),
l AS (SELECT a, b FROM p JOIN s x ON x.node = a JOIN s y ON y.node = b WHERE 5 * common >= 4 * (x.size + y.size - common)),
r AS (SELECT node, node AS reached FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
k AS (SELECT doc_id, node FROM d JOIN n ON n.w = d.w),
c AS (SELECT r.node, min(doc_id) AS class_id FROM r JOIN k ON k.node = r.reached GROUP BY r.node),
m AS (SELECT a AS node, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM k JOIN c ON c.node = k.node LEFT JOIN m ON m.node = k.node
"""

#: all windows of 400 bytes, as hexadecimal text, and all windows of 51 words
REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT r, unnest(range(0, length(h) // 2 - 399)) AS i FROM d),
y AS (SELECT x.r, i, md5_number(substring(h, CAST(2 * i + 1 AS INTEGER), 800)) AS k FROM x JOIN d ON d.r = x.r),
z AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM y) WHERE n > 1),
e AS (SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM (SELECT r, i, lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) AS before FROM z)),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM e GROUP BY r, span),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT d.r, coalesce(max(b), 0), any_value(length(h) // 2) FROM d LEFT JOIN spans s ON s.r = d.r GROUP BY d.r),
kept AS (SELECT g.r, string_agg(substring(h, CAST(2 * a + 1 AS INTEGER), CAST(2 * (b - a) AS INTEGER)), '' ORDER BY a) AS h FROM gaps g JOIN d ON d.r = g.r GROUP BY g.r),
t AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
u AS (SELECT r, doc_id, unnest(range(1, len(w) - 49)) AS i FROM d),
v AS (SELECT u.r, u.doc_id, i, md5_number(array_to_string(w[i:i + 50], ' ')) AS k FROM u JOIN d ON d.r = u.r),
q AS (SELECT r, i FROM (SELECT r, i, min(doc_id) OVER (PARTITION BY k) AS lo, max(doc_id) OVER (PARTITION BY k) AS hi FROM v) WHERE lo < hi),
words AS (SELECT r, CAST(sum(least(51, coalesce(nxt, i + 51) - i)) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM q) GROUP BY r)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256, coalesce(words.n, 0) AS n_passage_words
FROM d JOIN kept ON kept.r = d.r LEFT JOIN t ON t.r = d.r LEFT JOIN words ON words.r = d.r
"""

ORACLES |= {"op1_ngram_join": JOIN_SQL, "op10_suffix_dedup": REPEATS_SQL}
