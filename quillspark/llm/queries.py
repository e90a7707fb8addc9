"""The registered opN_ queries: production parameters, whole tables, the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, edits, language, lm, quality, templates, toxicity, warc
from .neardup import Forest, near_duplicates
from .shared import crc_bucket, table

NEAR_COPIES = Forest(words=3, numerator=85, denominator=100)


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, NEAR_COPIES).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
label AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN label l USING (doc_id)
"""

def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    back = warc.round_trip(pages)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.page_id < o.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < o.last THEN o.last END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND p.n = o.n
"""


def op6_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    found = ann.search(rows, rows.where("id % 20 = 0"), 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; every executor has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edits.edit_aware_counts(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_log_frequency_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_bucket("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return lm.train_and_score(docs.withColumn("learn", F.coalesce(crc_bucket("doc_id", 5) != 1, F.lit(False)))).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_segmentation_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    model = language.train(docs.where(crc_bucket("doc_id", 4) != 2), tokenizer("piece_bpe_32k.model"))
    return language.identify(docs, model).select("doc_id", held, "lang_pred", "score")


def op7_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 5) != 0)
    scored = quality.score_quality(docs, quality.train(docs, labels))
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, tokenizer("word_bpe_49k.json")))


def op9_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 3) != 1)
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    held = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.contaminated(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op6_balanced_postings": op6_balanced_postings,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_edit_aware_counts": op3_edit_aware_counts,
    "op4_log_frequency_bloom_lm": op4_log_frequency_bloom_lm,
    "op5_segmentation_language_id": op5_segmentation_language_id,
    "op7_attention_mil_quality": op7_attention_mil_quality,
    "op8_rank_array_bpe": op8_rank_array_bpe,
    "op9_bigru_toxicity": op9_bigru_toxicity,
    "op10_template_decontamination": op10_template_decontamination,
}
ORACLES = {"op1_warc_revisits": OP1_SQL, "op2_minhash_forest": OP2_SQL}
