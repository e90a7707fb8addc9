"""Queries over text boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as X
from ..functions import words as W
from ..operators import folds
from . import views
from .registry import listed, query, sql_any, sql_legacy, sql_local, sql_words

#: Boxes with cleaned text, word counts and the frame's median height.  Names repeat, so each is cleaned once.
_B = f"""(SELECT b.*, c.c, len({sql_words('c.c')}) AS n, x + width AS rt, y + height AS bt, median(height) OVER (PARTITION BY frame) AS ref
 FROM ({views.BOXES}) b JOIN (SELECT text, {sql_local('text')} AS c FROM (SELECT DISTINCT text FROM ({views.BOXES}))) c USING (text))"""
_SOCIAL = f"(c <> '' AND {sql_any(chr(39) + ' ' + chr(39) + ' || c || ' + chr(39) + ' ' + chr(39), W.LOCAL_REJECT_PHRASES)} AND x > page_width * 0.52::DOUBLE AND y > page_height * 0.50::DOUBLE)"
_MARK = f"({sql_any('regexp_replace(lower(text), ' + chr(39) + '[^a-z0-9]+' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')', W.WATERMARK_MARKERS)} AND x < page_width * 0.30::DOUBLE AND y > page_height * 0.62::DOUBLE)"
_EDGE = "(n BETWEEN 1 AND 2 AND width <= page_width * 0.12::DOUBLE AND (x <= 2 OR rt >= page_width - 2 OR y <= 2 OR bt >= page_height - 2))"
_CORNER = "(n = 1 AND (x < page_width * 0.18::DOUBLE OR x > page_width * 0.82::DOUBLE) AND y > page_height * 0.82::DOUBLE AND width < page_width * 0.10::DOUBLE AND height < page_height * 0.06::DOUBLE AND confidence < 0.90)"
_LOW = "(n BETWEEN 1 AND 2 AND confidence < 0.72)"
_TALL = "(n BETWEEN 1 AND 2 AND ref > 0 AND height > greatest(ref * 2.4::DOUBLE, 90.0) AND confidence < 0.90)"
_NOISE = f"(c = '' OR {_MARK} OR {_EDGE} OR {_CORNER} OR {_LOW} OR {_TALL})"


def _cleaned(spark, sf_dir):
    """Boxes with clean text; the few distinct texts are cleaned once and joined back."""
    b = views.boxes(spark, sf_dir)
    names = b.select("text").distinct().withColumn("c", X.local_clean(F.col("text"))).withColumn("g", X.legacy_clean(F.col("text")))
    return b.join(names, "text").withColumn("ref", F.median("height").over(Window.partitionBy("frame")))


def _box():
    return B.Box(clean=F.col("c"))


def _count_by(flag: str, sql: str):
    """Frames and how many of their boxes a predicate takes."""
    return f"SELECT frame, count(*) FILTER (WHERE {sql}) AS {flag} FROM {_B} GROUP BY frame"


def _counted(rows, cond, flag):
    return rows.groupBy("frame").agg(F.count_if(cond).alias(flag))


def _register(name: str, sql: str, cond):
    @query(name, _count_by("boxes", sql))
    def run(spark, sf_dir):
        return _counted(_cleaned(spark, sf_dir), cond(_box()), "boxes")


_register("box_social_overlay", _SOCIAL, B.social_overlay)
_register("box_watermark", _MARK, B.watermark_contaminated)
_register("box_edge_crop", _EDGE, B.edge_crop_fragment)
_register("box_corner_artifact", _CORNER, B.corner_short_artifact)
_register("box_low_confidence", _LOW, B.low_confidence_short)
_register("box_tall_artifact", _TALL, lambda b: B.tall_short_artifact(b, F.col("ref")))
_register("box_meaningful", f"c <> '' AND confidence >= 0.35 AND NOT {_NOISE}", lambda b: B.meaningful(b, F.col("ref")))
_register("box_occluded_suffix", f"n BETWEEN 1 AND 2 AND x < page_width * 0.32::DOUBLE AND y > page_height * 0.82::DOUBLE AND width < page_width * 0.18::DOUBLE AND height < page_height * 0.16::DOUBLE AND len(list_filter({sql_words('c')}, lambda w: len(w) <= 5)) > 0", B.occluded_suffix)
_register("box_occluded_text", "x < page_width * 0.30::DOUBLE AND y > page_height * 0.70::DOUBLE", B.occluded_text)
_register("box_bottom_overlay", "y > page_height * 0.74::DOUBLE OR x > page_width * 0.72::DOUBLE", B.bottom_overlay)


@query("box_legacy_watermark", f"""SELECT frame, count(*) FILTER (WHERE g = '' OR (len(list_filter({sql_words('g')}, lambda w: regexp_matches(w, '^(vook|vo0k|wook)'))) > 0 AND x < page_width * 0.22::DOUBLE AND y > page_height * 0.72::DOUBLE)) AS marks,
 count(*) FILTER (WHERE g = '' OR len(list_intersect({sql_words('g')}, [{listed(W.AD_ITEM_WORDS)[1:-1]}])) > 0) AS ads
 FROM ({views.BOXES}) b JOIN (SELECT text, {sql_legacy('text')} AS g FROM (SELECT DISTINCT text FROM ({views.BOXES}))) c USING (text) GROUP BY frame""")
def box_legacy_watermark(spark, sf_dir):
    return _cleaned(spark, sf_dir).groupBy("frame").agg(F.count_if(B.lower_left_watermark(_box(), F.col("g"))).alias("marks"), F.count_if(B.ad_item(F.col("g"))).alias("ads"))


@query("box_routes", f"SELECT frame, count(*) FILTER (WHERE r = 'ad') AS ads, count(*) FILTER (WHERE r = 'noise') AS noise, count(*) FILTER (WHERE r = 'story') AS story FROM (SELECT frame, CASE WHEN {_SOCIAL} THEN 'ad' WHEN {_NOISE} THEN 'noise' ELSE 'story' END AS r FROM {_B}) GROUP BY frame")
def box_routes(spark, sf_dir):
    rows = _cleaned(spark, sf_dir).withColumn("r", B.route(_box(), F.col("ref")))
    return rows.groupBy("frame").agg(*[F.count_if(F.col("r") == k).alias(n) for k, n in (("ad", "ads"), ("noise", "noise"), ("story", "story"))])


@query("observation_boxes", f"""SELECT frame, round(avg(confidence), 6) AS conf, round(avg(ink_score), 6) AS ink, sum(n)::BIGINT AS words FROM (SELECT *, CASE WHEN {_SOCIAL} THEN 'ad' WHEN {_NOISE} THEN 'noise' ELSE 'story' END AS r FROM {_B}) WHERE r = 'story' GROUP BY frame
 HAVING sum(n) >= 2 AND count(*) FILTER (WHERE {sql_any(chr(39) + ' ' + chr(39) + ' || c || ' + chr(39) + ' ' + chr(39), W.LOCAL_REJECT_PHRASES)}) = 0""")
def observation_boxes(spark, sf_dir):
    """A frame's story boxes as one observation: two words at least, no reject phrase."""
    story = _cleaned(spark, sf_dir).where(B.route(_box(), F.col("ref")) == "story")
    rows = story.groupBy("frame").agg(F.round(F.avg("confidence"), 6).alias("conf"), F.round(F.avg("ink_score"), 6).alias("ink"), F.sum(X.word_count(F.col("c"))).alias("words"), F.count_if(X.local_reject(F.col("c"))).alias("bad"))
    return rows.where("words >= 2 and bad = 0").drop("bad")


@query("union_bbox", f'SELECT frame, min(x) AS "left", min(y) AS top, max(x + width) AS "right", max(y + height) AS bottom, greatest(0, floor(min(x) - 10)) AS padded FROM ({views.BOXES}) GROUP BY frame')
def union_bbox(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    return b.groupBy("frame").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.greatest(F.lit(0), F.floor(F.min("x") - 10)).alias("padded"))


@query("edge_crop_scores", f"""SELECT frame, round(least(1.0, CASE WHEN min(x) <= 1280.0::DOUBLE * 0.018::DOUBLE THEN 0.55 ELSE 0 END + CASE WHEN max(x + width) >= 1280.0::DOUBLE - 1280.0::DOUBLE * 0.018::DOUBLE THEN 0.55 ELSE 0 END
 + CASE WHEN min(y) <= 720.0::DOUBLE * 0.014::DOUBLE THEN 0.2 ELSE 0 END + CASE WHEN max(y + height) >= 720.0::DOUBLE - 720.0::DOUBLE * 0.014::DOUBLE THEN 0.2 ELSE 0 END
 + least(0.35, count(*) FILTER (WHERE x <= 1280.0::DOUBLE * 0.018::DOUBLE OR x + width >= 1280.0::DOUBLE - 1280.0::DOUBLE * 0.018::DOUBLE) / count(*)::DOUBLE * 0.35)), 6)::DOUBLE AS score FROM ({views.BOXES}) GROUP BY frame""")
def edge_crop_scores(spark, sf_dir):
    b = views.boxes(spark, sf_dir).groupBy("frame").agg(F.collect_list(F.struct("x", "y", "width", "height", "page_width", "page_height")).alias("boxes"))
    return b.select("frame", F.round(B.edge_crop_score(F.col("boxes")), 6).alias("score"))


@query("box_overlaps", f"""SELECT a.frame, count(*) AS pairs, round(max(greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) / greatest(1.0, least(a.width * a.height, b.width * b.height))), 6) AS most
 FROM ({views.BOXES}) a JOIN ({views.BOXES}) b ON a.frame = b.frame AND a.box_seq < b.box_seq GROUP BY a.frame""")
def box_overlaps(spark, sf_dir):
    """Pairs of boxes of one frame: a frame has few."""
    b = views.boxes(spark, sf_dir).select("frame", "box_seq", F.struct("x", "y", "width", "height").alias("a"))
    pairs = b.join(b.select("frame", F.col("box_seq").alias("other"), F.col("a").alias("b")), "frame").where("box_seq < other")
    return pairs.groupBy("frame").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max(B.overlap_ratio(F.col("a"), F.col("b"))), 6).alias("most"))


@query("upper_medians", f"SELECT frame, list_sort(list(height))[len(list(height)) // 2 + 1] AS upper, median(height) AS middle FROM ({views.BOXES}) GROUP BY frame")
def upper_medians(spark, sf_dir):
    b = views.boxes(spark, sf_dir).groupBy("frame").agg(F.collect_list("height").alias("h"), F.median("height").alias("middle"))
    return b.select("frame", B.upper_median(F.col("h")).alias("upper"), "middle")


@query("ink_scores", "SELECT vec_id, round(greatest((255.0 - s[greatest(0, floor(len(s) * 0.10)::INT - 1) + 1]) / 255.0, greatest(0.0, (s[least(len(s) - 1, floor(len(s) * 0.90)::INT) + 1] - s[greatest(0, floor(len(s) * 0.10)::INT - 1) + 1]) / 255.0)), 6) AS ink FROM (SELECT vec_id, list_sort(list_transform(embedding, lambda v: floor(v::DOUBLE * 127 + 128))) AS s FROM embeddings)")
def ink_scores(spark, sf_dir):
    pixels = F.transform("embedding", lambda v: F.floor(v.cast("double") * 127 + 128).cast("double"))
    return views.read(spark, sf_dir, "embeddings").select("vec_id", F.round(B.ink_score(pixels), 6).alias("ink"))


@query("visual_distances", """SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / (64 * 255.0), 8) AS distance
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def visual_distances(spark, sf_dir):
    e = views.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("vec_id", F.round(B.visual_distance(F.col("a"), F.col("b")), 8).alias("distance"))


@query("line_groups")
def line_groups(spark, sf_dir):
    rows = folds.line_groups(views.boxes(spark, sf_dir).select("frame", "box_seq", "x", "y", "height"))
    return rows.groupBy("frame").agg((F.max("line") + 1).alias("lines"), F.count(F.lit(1)).alias("boxes"))


@query("merged_boxes")
def merged_boxes(spark, sf_dir):
    b = views.boxes(spark, sf_dir).select("frame", "box_seq", "x", "y", "width", "height", "text", (F.col("box_seq") % 2 == 0).alias("fallback"))
    return folds.merge_fallback(b).select("frame", F.size("boxes").alias("boxes"))
