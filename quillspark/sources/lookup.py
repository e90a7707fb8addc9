"""Finding files for sources in listings (folder, name, size, modified): downloaded videos, their captions, and the videos of folders.

A file meets what it may belong to by equality on keys cut from its own name, so a
listing is never compared with every id.  Empty files are no files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import caption_rank, is_url, is_video


def _stems(name: Column) -> Column:
    """What stands before each dot of a name."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def _after_dashes(text: Column) -> Column:
    """What stands after each dash."""
    parts = F.split(text, "-")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "-"))


def _prefixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda k: F.left(text, k))


def cached_videos(ids: DataFrame, files: DataFrame) -> DataFrame:
    """``ids`` (video_id) with folder and name of the newest finished video called '<id>.*' or '*-<id>.*'; nulls where there is none."""
    good = files.where(is_video(F.col("name")) & (F.col("size") > 0) & F.col("name").contains("."))
    stems = _stems(F.col("name"))
    keys = F.array_distinct(F.concat(stems, F.flatten(F.transform(stems, _after_dashes))))
    keyed = good.select(F.explode(keys).alias("video_id"), "folder", "name", "modified").where("video_id <> ''")
    newest = keyed.groupBy("video_id").agg(F.max_by(F.struct("folder", "name"), F.struct("modified", "name")).alias("f"))
    return ids.join(newest, "video_id", "left").select(*ids.columns, "f.folder", "f.name")


def _captions(files: DataFrame) -> DataFrame:
    return files.where(F.col("name").endswith(".vtt") & (F.col("size") > 0)).withColumn("body", F.expr("left(name, length(name) - 4)"))


def _best(by: list[str], keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(*by).agg(F.max_by("name", F.struct(caption_rank(F.col("name")), "modified", "name")).alias("caption"))


def cached_captions(ids: DataFrame, files: DataFrame) -> DataFrame:
    """``ids`` (video_id) with the best caption called '*-<id>*.vtt': English first, originals last, then the newest."""
    keys = F.array_distinct(F.flatten(F.transform(_after_dashes(F.col("body")), _prefixes)))
    keyed = _captions(files).select(F.explode(keys).alias("video_id"), "name", "modified")
    return ids.join(_best(["video_id"], keyed), "video_id", "left")


def captions_beside(videos: DataFrame, files: DataFrame) -> DataFrame:
    """``videos`` (folder, name) with the best caption of the same folder whose name begins with the video's stem."""
    keyed = _captions(files).select("folder", F.explode(_prefixes(F.col("body"))).alias("stem"), "name", "modified")
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    named = videos.withColumn("stem", stem)
    return named.join(_best(["folder", "stem"], keyed), ["folder", "stem"], "left").select(*videos.columns, "caption")


def expand_sources(sources: DataFrame, files: DataFrame, recursive: bool = False) -> DataFrame:
    """source, kind, folder, name: one row per video of each source (source string).

    A URL is one row of kind 'url' without a file; a file of the listing is itself; a
    folder is the videos in it (with ``recursive`` also those below it); any other
    source is one row of kind 'unsupported'.
    """
    bare = F.regexp_replace("source", "(?<=[^/])/+$", "")
    plain = sources.select(F.when(is_url(F.col("source")), F.col("source")).otherwise(bare).alias("source")).distinct()
    urls = plain.where(is_url(F.col("source"))).select("source", F.lit("url").alias("kind"), F.lit(None).cast("string").alias("folder"), F.lit(None).cast("string").alias("name"))
    local = plain.where(~is_url(F.col("source")))
    videos = files.where(is_video(F.col("name"))).select("folder", "name")
    alone = videos.withColumn("source", F.concat_ws("/", "folder", "name"))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    inside = videos.withColumn("source", F.explode(above) if recursive else F.col("folder"))
    found = local.join(alone, "source").withColumn("kind", F.lit("file")).unionByName(local.join(inside, "source").withColumn("kind", F.lit("folder")))
    found = found.select("source", "kind", "folder", "name")
    rest = local.join(found.select("source").distinct(), "source", "left_anti").select("source", F.lit("unsupported").alias("kind"), F.lit(None).cast("string").alias("folder"), F.lit(None).cast("string").alias("name"))
    return urls.unionByName(found).unionByName(rest)
