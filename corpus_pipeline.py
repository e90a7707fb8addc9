"""The corpus pipeline: quality, language, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  The first four return the columns of ``documents``; the last returns the
token counts and digests of what is left.

Only documents that a stage is sure about go: quality drops those it scores below
0.3, language drops those it calls ``und``.  Rows with a null id are kept by every
filter, as no decision can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, language, neardup, quality, templates
from quillspark.llm.queries import tokenizer
from quillspark.llm.shared import crc_bucket, keep, prepare, table, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 5) != 0)
    scored = quality.score_quality(docs, quality.train(docs, labels))
    return without(docs, scored.where("score < 0.3").select("doc_id"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language."""
    model = language.train(docs.where(crc_bucket("doc_id", 4) != 2), tokenizer("piece_bpe_32k.model"))
    return without(docs, language.identify(docs, model).where("lang_pred = 'und'").select("doc_id"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, 0.8)."""
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return without(docs, templates.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document left."""
    return bpe.digests(bpe.encode_decode(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]
#: The learned stages and the tokenizer have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
