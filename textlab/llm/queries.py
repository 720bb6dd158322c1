"""Registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op2_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@register
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan
    return license_scan(table(spark, sf_dir, "documents"))


@register
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, pii_spans
    found = pii_spans(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))


@register
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@register
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_verdicts
    return url_verdicts(table(spark, sf_dir, "pages"))


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_verdicts
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix
    return Mix(table(spark, sf_dir, "documents")).per_document().select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "block")


@register
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup
    return line_dedup(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), F.col("new_text").alias("text"), "removed_lines", "removed_words")


@register
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import audits, damage, repair, turns
    said = turns(table(spark, sf_dir, "conversations"))
    return audits(said, repair(damage(said)))


@register
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS id, b.r, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT ar, anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST, r) AS k
  FROM s WHERE same),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.id NULLS LAST, s.r) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND p.k <= 5
   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@register
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE["op11_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) > 0 THEN list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))
                 ELSE [] END AS s FROM w),
n AS (SELECT doc_id, coalesce(len(s), 0) AS n_shingles FROM s),
e AS (SELECT doc_id, hash(unnest(s)) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b USING (x) GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * shared >= 85 * (na.n_shingles + nb.n_shingles - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM n JOIN r ON r.a = doc_id GROUP BY doc_id, n_shingles
"""
