"""The registered queries of the operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, mixing, multi_index, near_dup, sharding, substring_dedup, training_order, warc
from .base import scratch, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.ordered_round_trip(table(spark, sf_dir, "documents"))


def op3_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.digests(chat.prefix_examples(rows.unionByName(own)))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), scratch(spark, "slot-map"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op10_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_training_order, op3_chat_prefix, op4_multi_index, op5_decontaminate, op6_language_id, op7_virtual_slots,
        op8_mix_sources, op9_warc_index, op10_minhash_bayes,
    )
}

ORACLES = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lo FROM h) WHERE lo < doc_id),
g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM r) GROUP BY doc_id),
k AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY n) AS kept FROM (
    SELECT d.doc_id, unnest(d.w) AS t, unnest(range(1, len(d.w) + 1)) AS n FROM d) x
  LEFT JOIN (SELECT doc_id AS gd, unnest(gone) AS gn FROM g) y ON x.doc_id = y.gd AND x.n = y.gn WHERE y.gd IS NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256,
  CAST(coalesce(list_aggregate(list_transform(g.gone, lambda x: CASE WHEN list_contains(g.gone, x - 1) THEN 0 ELSE 1 END), 'sum'), 0) AS INTEGER) AS n_spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op9_warc_index": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100""",
    "op10_minhash_bayes": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') || ' ' || len(w) ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
c AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.lo AS component_id, m.lo = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS lo FROM c GROUP BY x) m ON m.x = d.doc_id""",
    "op3_chat_prefix": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + 2
    + length(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t')) + 8 AS n FROM c),
p AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id""",
    "op5_decontaminate": r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark WHERE item_id IS NOT NULL),
s AS (
  SELECT DISTINCT kind, id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') || ' ' || len(w) ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS item_shingles, count(*) AS shared, CAST(count(*) AS DOUBLE) / n.n AS containment
FROM s b JOIN s d ON d.s = b.s AND d.kind = 0 AND b.kind = 1 JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n HAVING 5 * count(*) >= 4 * n.n""",
    "op8_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('8:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CAST((r - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * n AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos FROM w),
l AS (
  SELECT *, (CAST(sum(n) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT pos, level FROM l WHERE weight * level < cap ORDER BY pos LIMIT 1),
t AS (SELECT source, r, n, CASE WHEN coalesce(pos < (SELECT pos FROM f), true) THEN cap ELSE weight * (SELECT level FROM f) END AS target FROM l),
g AS (SELECT *, target - whole * n AS gap FROM (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t)),
x AS (SELECT d.*, g.r, row_number() OVER (PARTITION BY g.r ORDER BY h) AS pos FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (
  SELECT 0 AS round, r, CAST(0 AS BIGINT) AS start, CAST('inf' AS DOUBLE) AS most, CAST(gap AS DOUBLE) AS rest FROM g
  UNION ALL
  SELECT round + 1, r, stop, least(left_, most / 2), left_ FROM (
    SELECT round, r, most, min(pos) FILTER (sum > rest) AS stop, rest - coalesce(max(sum) FILTER (sum <= rest), 0) AS left_ FROM (
      SELECT c.*, x.pos, CAST(sum(x.size) OVER (PARTITION BY c.r ORDER BY x.pos) AS BIGINT) AS sum
      FROM c JOIN x ON x.r = c.r AND x.pos > c.start AND x.size <= c.most) GROUP BY round, r, most, rest)
  WHERE stop IS NOT NULL AND least(left_, most / 2) >= 1),
k AS (
  SELECT c.r, c.round, c.rest, x.pos, x.size, CAST(sum(x.size) OVER (PARTITION BY c.r, c.round ORDER BY x.pos) AS BIGINT) AS sum
  FROM c JOIN x ON x.r = c.r AND x.pos > c.start AND x.size <= c.most),
taken AS (SELECT DISTINCT r, pos FROM k WHERE sum <= rest),
e AS (
  SELECT r, min(left_) AS rest FROM (
    SELECT c.r, c.round, c.rest - coalesce(max(k.sum) FILTER (k.sum <= c.rest), 0) AS left_ FROM c LEFT JOIN k ON k.r = c.r AND k.round = c.round GROUP BY c.r, c.round, c.rest)
  GROUP BY r),
p AS (
  SELECT x.r, arg_min(x.pos, (abs(x.size - e.rest), x.h, x.pos)) AS pos FROM x JOIN e ON e.r = x.r
  WHERE x.size > 0 AND abs(x.size - e.rest) < e.rest AND NOT EXISTS (SELECT 1 FROM taken WHERE taken.r = x.r AND taken.pos = x.pos) GROUP BY x.r),
m AS (SELECT r, pos FROM taken UNION SELECT r, pos FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target, CAST(size * copies AS BIGINT) AS taken, source, copies FROM (
  SELECT x.*, g.n, g.target, CAST(g.whole AS BIGINT) + CASE WHEN size > 0 AND m.pos IS NOT NULL THEN 1 ELSE 0 END AS copies
  FROM x JOIN g ON g.r = x.r LEFT JOIN m ON m.r = x.r AND m.pos = x.pos)""",
}
