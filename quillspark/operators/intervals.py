"""Windows over time: merging, gap filling, sessions and range joins, all keyed by video.

Rows of one video are ordered by explicit columns, never by arrival.  Merging is
gaps-and-islands: the running maximum of ends says where an island begins, so it
is one window pass.  Range joins take the video as key, and for long videos a
time bucket too, so no join is a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running(df: DataFrame, end: str, *order: str):
    before = Window.partitionBy("video").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.max(end).over(before)


def merge(windows: DataFrame, gap: float) -> DataFrame:
    """video, start, end: overlapping windows, or ones at most ``gap`` apart, become one."""
    ordered = Window.partitionBy("video").orderBy("start", "end")
    marked = windows.withColumn("reach", _running(windows, "end", "start", "end"))
    marked = marked.withColumn("fresh", (F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap)).cast("int"))
    islands = marked.withColumn("island", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("video", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def make_windows(units: DataFrame, stories: DataFrame, padding: float) -> DataFrame:
    """Units padded, clamped to the story (video, story_start, story_end) and merged; a story without units is one window."""
    held = stories.join(units.select("video", "start", "end"), "video", "left")
    start = F.coalesce(F.greatest("story_start", F.col("start") - padding), "story_start")
    end = F.coalesce(F.least("story_end", F.col("end") + padding), "story_end")
    return merge(held.select("video", start.alias("start"), end.alias("end")), 0.25)


def merge_windows(windows: DataFrame) -> DataFrame:
    return merge(windows.where(F.col("end") > F.col("start")), 0.05)


def fill_page_gaps(pages: DataFrame, stories: DataFrame) -> DataFrame:
    """Pages and, where a story is uncovered by more than 0.05 s, gap rows numbered in order.

    ``pages`` has video, page_seq, page_id, start, end, source; stories without pages become one gap.
    """
    w = Window.partitionBy("video").orderBy("start", "page_seq")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    with_story = pages.join(stories, "video").withColumn("cursor", F.greatest("story_start", F.coalesce(reach, "story_start")))
    before = with_story.where(F.col("start") > F.col("cursor") + 0.05).select("video", F.col("cursor").alias("start"), F.col("start").alias("end"))
    last = stories.join(pages.groupBy("video").agg(F.max("end").alias("last")), "video", "left")
    cursor = F.greatest("story_start", F.coalesce("last", "story_start"))
    after = last.where(cursor < F.col("story_end") - 0.05).select("video", cursor.alias("start"), F.col("story_end").alias("end"))
    gaps = before.unionByName(after)
    number = F.row_number().over(Window.partitionBy("video").orderBy("start"))
    named = gaps.select("video", F.format_string("page-gap-%04d", number).alias("page_id"), "start", "end", F.lit("gap").alias("source"))
    return pages.select("video", "page_id", "start", "end", "source").unionByName(named)


def pages_from_cuts(cuts: DataFrame, stories: DataFrame) -> DataFrame:
    """Scenes between successive cuts (video, ts), clamped to the story; empty ones go, their numbers stay used."""
    w = Window.partitionBy("video").orderBy("ts")
    scenes = cuts.select("video", "ts", F.lead("ts").over(w).alias("next"), F.row_number().over(w).alias("page_seq")).where("next is not null")
    held = scenes.join(stories, "video").select("video", "page_seq", F.greatest("story_start", "ts").alias("start"), F.least("story_end", "next").alias("end"))
    return held.where(F.col("end") > F.col("start")).select("video", "page_seq", F.format_string("page-%04d", "page_seq").alias("page_id"), "start", "end", F.lit("scene").alias("source"))


def _bucketed(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    low, high = F.floor(start / width).cast("long"), F.floor(end / width).cast("long")
    return df.withColumn("bucket", F.explode(F.sequence(low, F.greatest(low, high))))


def overlapping(left: DataFrame, right: DataFrame, bucket: float) -> DataFrame:
    """Inner join of intervals of one video that overlap by more than 0; columns of the right get the suffix _r."""
    named = right.select("video", *[F.col(c).alias(f"{c}_r") for c in right.columns if c != "video"])
    a = _bucketed(left, F.col("start"), F.col("end"), bucket)
    b = _bucketed(named, F.col("start_r"), F.col("end_r"), bucket)
    met = a.join(b, ["video", "bucket"]).where((F.least("end", "end_r") - F.greatest("start", "start_r")) > 0)
    first = F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("start_r") / bucket))
    return met.where(F.col("bucket") == first).drop("bucket")


def expand_windows_to_pages(windows: DataFrame, pages: DataFrame, stories: DataFrame, mode: str, bucket: float = 600.0) -> DataFrame:
    """'unit': windows merged; 'all-pages': pages merged; 'unit-pages': the pages that windows overlap, or the window where there is none."""
    if mode == "all-pages":
        without = windows.join(pages.select("video").distinct(), "video", "left_anti")
        return merge_windows(pages.select("video", "start", "end").unionByName(without.select("video", "start", "end")))
    if mode == "unit":
        return merge_windows(windows)
    met = overlapping(windows, pages.select("video", "start", "end"), bucket)
    grown = met.join(stories, "video").select("video", F.greatest("story_start", "start_r").alias("start"), F.least("story_end", "end_r").alias("end"))
    alone = windows.join(met.select("video", "start", "end").distinct(), ["video", "start", "end"], "left_anti")
    return merge_windows(grown.unionByName(alone.select("video", "start", "end")))


def timestamps(start: Column, end: Column, fps: Column) -> Column:
    """Sample times of a window, rounded to milliseconds; none if it is empty."""
    n = F.greatest(F.lit(1), F.ceil((end - start) * fps)).cast("int")
    times = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(start + i / fps, 3))
    return F.when(end <= start, F.array().cast("array<double>")).otherwise(times)


def distinct_samples(windows: DataFrame, fps: float) -> DataFrame:
    """video, ms: each sampled millisecond once, however many windows hold it."""
    ts = F.explode(timestamps(F.col("start"), F.col("end"), F.lit(fps)))
    return windows.select("video", ts.alias("t")).select("video", F.bround(F.col("t") * 1000, 0).cast("long").alias("ms")).distinct()


def assign_pages(observations: DataFrame, pages: DataFrame, bucket: float) -> DataFrame:
    """``page_id`` of each observation (video, obs_seq, ts): the earliest listed page that holds it, both ends included; '' if none.

    Interval sides are bucketed, so a video's observations meet only nearby pages.
    """
    named = pages.select("video", F.col("page_id").alias("p"), F.col("start").alias("ps"), F.col("end").alias("pe"), "page_seq")
    spans = _bucketed(named, F.col("ps"), F.col("pe"), bucket)
    keyed = observations.select("video", "obs_seq", "ts").withColumn("bucket", F.floor(F.col("ts") / bucket).cast("long"))
    met = keyed.join(spans, ["video", "bucket"]).where("ts between ps and pe")
    first = met.groupBy("video", "obs_seq").agg(F.min_by("p", "page_seq").alias("page_id"))
    return observations.drop("page_id").join(first, ["video", "obs_seq"], "left").withColumn("page_id", F.coalesce("page_id", F.lit("")))


def islands(rows: DataFrame, joined: Column, order: list[str], name: str = "island") -> DataFrame:
    """Number runs of rows: a row goes on with the run before it where ``joined`` holds (null: it doesn't)."""
    w = Window.partitionBy("video").orderBy(*order)
    return rows.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def dedupe_equal_units(units: DataFrame, gap: float = 0.25) -> DataFrame:
    """Successive units (video, unit_seq, normalized, start, end) of one text that touch become one: the first row's fields, the latest end.

    The end that counts is the latest of the run so far, so the run is found among
    rows of one text that follow one another.
    """
    order = ["start", "end", "unit_seq"]
    w = Window.partitionBy("video").orderBy(*order)
    runs = islands(units, F.lag("normalized").over(w) == F.col("normalized"), order, "_run")
    within = Window.partitionBy("video", "_run").orderBy(*order)
    reach = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    split = runs.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    split = split.withColumn("_part", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct(*[F.col(c) for c in order])
    fields = [F.min_by(c, first).alias(c) for c in units.columns if c not in ("video", "end")]
    return split.groupBy("video", "_run", "_part").agg(*fields, F.max("end").alias("end")).drop("_run", "_part").select(units.columns)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def unique_names(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """``name``: the slug, then slug-2, slug-3, ... in order."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return rows.withColumn("name", F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n)))
