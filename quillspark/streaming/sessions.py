"""Observations as a stream of files: late rows, gap sessions, and an append-only cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "video string, at timestamp, text string, word_count int"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def gap_sessions(stream: DataFrame, gap: str = "3 seconds", lateness: str = "30 seconds") -> DataFrame:
    """Sessions by gap alone: rows at most ``gap`` apart, closed once the watermark has passed; state is bounded by it."""
    held = stream.withWatermark("at", lateness).groupBy("video", F.session_window("at", gap).alias("w"))
    best = held.agg(F.max_by("text", "word_count").alias("text"), F.count(F.lit(1)).alias("n"), F.max("at").alias("end"))
    return best.select("video", F.col("w.start").alias("start"), "end", "n", "text")


def start(sessions: DataFrame, out: str, checkpoint: str):
    """Append closed sessions as Parquet; exactly once, by the sink's log and the checkpoint."""
    return sessions.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
