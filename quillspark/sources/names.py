"""Source names: URLs, video files, captions and fingerprints, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted video file endings, and unfinished downloads.
VIDEO_EXTENSIONS = [".avi", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".webm"]
UNFINISHED = [".description", ".info.json", ".json", ".part", ".temp", ".tmp", ".webp", ".ytdl"]


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike("^(?i:https?)://[^/?#]+"), F.lit(False))


def youtube_id(c: Column) -> Column:
    """Video id of a short link, a watch link or an embed, live or shorts path; null for others."""
    host = F.regexp_replace(F.lower(F.regexp_extract(c, "^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(c, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    asked = F.regexp_extract(c, "[?&]v=([^&#]+)", 1)
    piece = F.regexp_extract(path, "^/+(?:embed|live|shorts)/+([^/]+)", 1)
    short = F.regexp_extract(path, "^/*([^/]+)", 1)
    return F.nullif(F.when(host == "youtu.be", short).when(host.endswith("youtube.com"), F.coalesce(F.nullif(asked, F.lit("")), piece)).otherwise(F.lit("")), F.lit(""))


def is_video(path: Column) -> Column:
    low = F.lower(path)
    ends = lambda all_: F.exists(F.array(*map(F.lit, all_)), lambda e: low.endswith(e))
    return ends(VIDEO_EXTENSIONS) & ~ends(UNFINISHED)


def caption_rank(path: Column) -> Column:
    """English names are worth 2, originals cost 1."""
    low = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    return F.when(low.contains(".en"), 2).otherwise(0) - F.when(low.contains(".orig."), 1).otherwise(0)


def fingerprint(path: Column, size: Column, modified: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", path, size, modified).cast("binary")), 1, 20)
