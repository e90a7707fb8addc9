"""Domain tables over the test tables: units, observations, pages and boxes.

Times are whole or dyadic numbers, so Spark and the checking SQL compute the very
same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import shared
from .registry import sql_local, sql_words


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a video, a turn a unit of 10 s steps; the role says the source."""
    c = read(spark, sf_dir, "conversations")
    start, n = F.col("turn") * 10.0, F.size(F.split("text", " "))
    source = F.when(F.col("role") == "user", "asr").when(F.col("role") == "assistant", "ocr-temporal").otherwise("subtitle")
    return c.select(F.col("conv_id").alias("video"), F.col("turn").alias("unit_seq"), F.format_string("u-%04d", "turn").alias("unit_id"), "text", X.local_clean(F.col("text")).alias("normalized"), start.alias("start"), (start + F.least(n, F.lit(24)) * 0.25).alias("end"), source.alias("source"))


UNITS = f"""SELECT conv_id AS video, turn AS unit_seq, printf('u-%04d', turn) AS unit_id, text, {sql_local('text')} AS normalized,
  turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + least(len(string_split(text, ' ')), 24) * 0.25::DOUBLE AS "end",
  CASE role WHEN 'user' THEN 'asr' WHEN 'assistant' THEN 'ocr-temporal' ELSE 'subtitle' END AS source FROM conversations"""


def stories(units_: DataFrame) -> DataFrame:
    return units_.groupBy("video").agg(F.lit(0.0).alias("story_start"), (F.max("end") + 8.0).alias("story_end"))


STORIES = 'SELECT video, 0.0::DOUBLE AS story_start, max("end") + 8.0 AS story_end FROM u GROUP BY video'


def _hours(ts):
    """Sixteenths of an hour since the epoch of the tables: dyadic, so sums are exact."""
    return F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), ts) / 225) / 16.0


HOURS = "(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 225.0) / 16.0)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, normalized and tokens (hashes of the distinct words) of whole texts, each made once per document."""
    # dealt by the key of the join that follows, so few large files are cleaned by all cores and nothing is dealt twice
    raw = read(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    d = raw.withColumn("normalized", X.local_clean(F.col("text")))
    return d.withColumn("tokens", F.transform(X.token_set(F.col("normalized")), lambda t: F.xxhash64(t)))


def coded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, word_count and the coded word set of each whole text; written once."""
    return shared.coded(read(spark, sf_dir, "documents").select("doc_id", "text"))


def observations(spark: SparkSession, sf_dir: str, sets: DataFrame | None = None) -> DataFrame:
    """An event is an observation of its user's video, in hours; the text is a whole document.

    With ``sets`` (coded_documents) rows carry doc_id and n, the number of its words, instead of texts and word sets.
    """
    e, total = read(spark, sf_dir, "events"), read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("total"))
    rows = e.crossJoin(F.broadcast(total)).select("event_id", F.col("user_id").alias("video"), _hours(F.col("ts")).alias("ts"), F.pmod("event_id", "total").alias("doc_id"))
    d = sets.select("doc_id", "n", "word_count") if sets is not None else documents(spark, sf_dir).withColumn("word_count", X.word_count(F.col("normalized")))
    joined = rows.join(d, "doc_id")
    conf = F.pmod(F.col("event_id") * 37, F.lit(128)) / 128.0
    ink = F.pmod(F.col("event_id") * 53, F.lit(128)) / 128.0
    page = F.when(F.pmod("event_id", F.lit(5)) == 0, "").otherwise(F.concat(F.lit("p"), F.floor(F.col("ts") / 48).cast("long")))
    shown = ["doc_id", "n"] if sets is not None else ["text", "normalized", "tokens"]
    return joined.select("video", F.col("event_id").alias("obs_seq"), "ts", *shown, conf.alias("conf"), ink.alias("ink"), "word_count", page.alias("page_id"))


#: Words of whole documents: dn has the number of words and of distinct ones, ov how many distinct words two documents share.
WORDS = f"""d0 AS MATERIALIZED (SELECT doc_id, {sql_words(sql_local('text'))} AS ws FROM documents),
 tk AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(ws)) AS w FROM d0), dn AS MATERIALIZED (SELECT doc_id, len(list_distinct(ws)) AS nk, len(ws) AS word_count FROM d0)"""
SHARED = "ov AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM tk a JOIN tk b USING (w) GROUP BY a.doc_id, b.doc_id)"


def _observed(docs: str, columns: str) -> str:
    return f"""SELECT e.user_id AS video, e.event_id AS obs_seq, {HOURS} AS ts, {columns}
  ((e.event_id * 37) % 128) / 128.0::DOUBLE AS conf, ((e.event_id * 53) % 128) / 128.0::DOUBLE AS ink,
  CASE WHEN e.event_id % 5 = 0 THEN '' ELSE 'p' || CAST(floor({HOURS} / 48) AS BIGINT) END AS page_id
  FROM events e JOIN {docs} d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)"""


OBSERVATIONS, OBSERVED_WORDS = _observed("documents", ""), _observed("dn", "d.doc_id, d.nk, d.word_count,")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups cut a user's time into scenes."""
    cuts = read(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("video"), _hours(F.col("ts")).alias("start"), "event_id")
    w = Window.partitionBy("video").orderBy("start", "event_id")
    rows = cuts.select("video", F.row_number().over(w).alias("page_seq"), "start", F.lead("start").over(w).alias("end")).where('"end" is not null'.replace('"', "`"))
    return rows.select("video", "page_seq", F.format_string("page-%04d", "page_seq").alias("page_id"), "start", "end", F.lit("scene").alias("source"))


PAGES = f"""SELECT video, page_seq, printf('page-%04d', page_seq) AS page_id, start, "end", 'scene' AS source FROM (
  SELECT user_id AS video, row_number() OVER w AS page_seq, {HOURS} AS start, lead({HOURS}) OVER w AS "end"
  FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY {HOURS}, event_id)) WHERE "end" IS NOT NULL"""


def page_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.min(_hours(F.col("ts"))).alias("story_start"), F.max(_hours(F.col("ts"))).alias("story_end"))


PAGE_STORIES = f"SELECT user_id AS video, min({HOURS}) AS story_start, max({HOURS}) AS story_end FROM events GROUP BY user_id"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a box on its order's frame; its part's name is the text, now and then with a brand or a reject phrase."""
    item, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    every = [c for c in item.columns]
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*every))
    rows = item.withColumn("box_seq", seq).join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    k = F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(7))
    text = F.when(k == 0, F.concat(F.lit("VOOKS "), "p_name")).when(k == 1, F.lit("Subscribe")).when(k == 2, F.substring("p_name", 1, 2)).when(k == 3, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    return rows.select(
        F.col("l_orderkey").alias("frame"), "box_seq", text.alias("text"),
        (F.pmod(F.col("l_linenumber") * 17 + F.col("l_suppkey"), F.lit(64)) / 64.0).alias("confidence"),
        F.pmod(F.col("l_partkey") * 37, F.lit(1200)).cast("double").alias("x"), F.pmod(F.col("l_suppkey") * 53, F.lit(700)).cast("double").alias("y"),
        (F.pmod(F.col("l_partkey") * 11, F.lit(240)) + 16).cast("double").alias("width"), (F.pmod(F.col("l_suppkey") * 7, F.lit(120)) + 8).cast("double").alias("height"),
        F.lit(1280.0).alias("page_width"), F.lit(720.0).alias("page_height"), (F.pmod(F.col("l_partkey"), F.lit(32)) / 32.0).alias("ink_score"),
    )


BOXES = """SELECT l_orderkey AS frame, box_seq,
  CASE (l_partkey + l_suppkey) % 7 WHEN 0 THEN 'VOOKS ' || p_name WHEN 1 THEN 'Subscribe' WHEN 2 THEN substr(p_name, 1, 2) WHEN 3 THEN string_split(p_name, ' ')[1] ELSE p_name END AS text,
  ((l_linenumber * 17 + l_suppkey) % 64) / 64.0::DOUBLE AS confidence, ((l_partkey * 37) % 1200)::DOUBLE AS x, ((l_suppkey * 53) % 700)::DOUBLE AS y,
  ((l_partkey * 11) % 240 + 16)::DOUBLE AS width, ((l_suppkey * 7) % 120 + 8)::DOUBLE AS height, 1280.0::DOUBLE AS page_width, 720.0::DOUBLE AS page_height, (l_partkey % 32) / 32.0::DOUBLE AS ink_score
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS box_seq FROM lineitem) JOIN part ON p_partkey = l_partkey"""
