"""A table of results by key and version, so dear work is done once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 2


def lookup(keys: DataFrame, cache: DataFrame, on: list[str], version: int = VERSION) -> DataFrame:
    """``keys`` with hit and payload: a row of the version is a hit even if its payload is null; of repeated rows the last written (``written``, if the cache has it)."""
    newest = F.col("written") if "written" in cache.columns else F.lit(0)
    good = cache.where(F.col("version") == version).groupBy(*on).agg(F.max_by(F.struct("payload"), newest)["payload"].alias("payload")).withColumn("hit", F.lit(True))
    return keys.join(good, on, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(keys: DataFrame, cache: DataFrame, on: list[str], version: int = VERSION) -> DataFrame:
    """Keys that have no row of the version, each once."""
    return keys.distinct().join(cache.where(F.col("version") == version).select(*on), on, "left_anti")


def append(rows: DataFrame, path: str, by: list[str], version: int = VERSION) -> None:
    rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy(*by).parquet(path)


_BOX = "struct<text:string,confidence:double,x:double,y:double,width:double,height:double,page_width:double,page_height:double,ink_score:double>"
OBSERVATION = f"struct<timestamp:double,text:string,normalized_text:string,boxes:array<{_BOX}>,avg_confidence:double,avg_ink_score:double,word_count:int,visual_hash:string,page_id:string,ad_boxes:array<{_BOX}>>"


def decode(json: Column, frame_path: Column) -> Column:
    """A cached observation from its JSON, bound to the frame it is for; fields that aren't there get their defaults, a null stays null."""
    o = F.from_json(json, OBSERVATION)
    boxes = lambda c: F.transform(F.coalesce(c, F.array().cast(f"array<{_BOX}>")), lambda b: b.withField("ink_score", F.coalesce(b["ink_score"], F.lit(0.0))))
    filled = F.struct(
        frame_path.alias("frame_path"), o["timestamp"].alias("timestamp"), o["text"].alias("text"), o["normalized_text"].alias("normalized_text"),
        boxes(o["boxes"]).alias("boxes"), *(F.coalesce(o[c], F.lit(0.0)).alias(c) for c in ("avg_confidence", "avg_ink_score")), F.coalesce(o["word_count"], F.lit(0)).alias("word_count"),
        *(F.coalesce(o[c], F.lit("")).alias(c) for c in ("visual_hash", "page_id")), boxes(o["ad_boxes"]).alias("ad_boxes"),
    )
    return F.when(json.isNotNull() & (json != "null"), filled)


def encode(observation: Column) -> Column:
    """JSON of an observation, without the frame it was read from."""
    return F.to_json(observation.dropFields("frame_path"))
