"""WebVTT subtitles: whole files to cues and transcript units."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import words as W
from ..operators.intervals import dedupe_equal_units

_TIMING = r"^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})\s+-->\s+((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})"


def read(spark: SparkSession, path: str) -> DataFrame:
    """video (the path) and value (the whole file)."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("video"), "value")


def seconds(c: Column) -> Column:
    """[h:]mm:ss with '.' or ',' before the fraction, as seconds."""
    parts = F.reverse(F.split(F.translate(c, ",", "."), ":"))
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)).cast("double"), F.lit(0.0))
    return at(2) * 3600.0 + at(1) * 60.0 + at(0)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x else x)


def cue_text(c: Column, every_entity: bool = False) -> Column:
    """Text of a cue without voice, tags and bracketed notes; the common entities by built-ins, all of them by a UDF if asked for."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)^<v\s+[^>]+>", ""), "<[^>]+>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\{[^}]+\}", " "), r"\[[^\]]+\]", " ")
    if every_entity:
        c = _unescape(c)
    else:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(X.straight_quotes(c), r"\s+", " "))


def parse(files: DataFrame) -> DataFrame:
    """video, cue (from 1), start, end, text: a timing line opens a cue, a blank line or the next timing ends it; empty and backward cues go.

    Lines are rows; the cue of a line is the running count of timing lines, so a
    file is cut by one window over its lines.
    """
    lines = files.select("video", F.posexplode(F.split(F.replace("value", F.lit("﻿"), F.lit("")), r"\r\n|\n|\r")).alias("n", "line"))
    w = Window.partitionBy("video").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    timed = F.col("line").rlike(_TIMING)
    rows = lines.withColumn("block", F.sum(timed.cast("int")).over(w)).where("block > 0")
    inside = Window.partitionBy("video", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("blank", F.sum((F.trim("line") == "").cast("int")).over(inside)).where("blank = 0")
    body = F.array_sort(F.collect_list(F.when(~timed, F.struct("n", "line"))))
    head = F.max(F.when(timed, F.col("line")))
    cues = rows.groupBy("video", "block").agg(head.alias("head"), F.array_join(F.transform(body, lambda x: x["line"]), " ").alias("raw"))
    cues = cues.select("video", "block", seconds(F.regexp_extract("head", _TIMING, 1)).alias("start"), seconds(F.regexp_extract("head", _TIMING, 2)).alias("end"), cue_text(F.col("raw")).alias("text"))
    kept = cues.where("`end` > start and text <> ''")
    return kept.select("video", F.row_number().over(Window.partitionBy("video").orderBy("block")).alias("cue"), "start", "end", "text")


def units(cues: DataFrame, stories: DataFrame) -> DataFrame:
    """Cues within the story as units: two words or more, no labels or reject phrases, clamped; numbers are those of the cues."""
    rows = cues.join(stories, "video").where((F.col("end") >= F.col("story_start")) & (F.col("start") <= F.col("story_end"))).withColumn("normalized", X.local_clean(F.col("text")))
    rows = rows.where((X.word_count(F.col("normalized")) >= 2) & ~F.col("normalized").isin(W.NON_STORY_LABELS) & ~X.local_reject(F.col("normalized")))
    named = rows.select("video", F.col("cue").alias("unit_seq"), F.format_string("subtitle-%04d", "cue").alias("unit_id"), "text", "normalized", F.greatest("story_start", "start").alias("start"), F.least("story_end", "end").alias("end"), F.lit("subtitle").alias("source"))
    return dedupe_equal_units(named)
