"""The legacy engine's set operators: representatives, transition pruning, edges, refinement, polish.

A candidate row has video, cand_seq, ts, text, normalized, word_count, conf,
contrast, ad_overlay, edge_crop, group_index, group_start, group_end,
group_frames, stable_neighbors, score, output_source and thumbnail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import fuzzy
from ..functions import text as X
from .options import LegacyOptions
from .select import Measure


def cropped(edge_crop: Column) -> Column:
    return edge_crop >= 0.55


def strong_visual(contrast: Column, edge_crop: Column, frames: Column, neighbors: Column) -> Column:
    return (contrast >= 0.82) & ~cropped(edge_crop) & ((frames >= 8) | (neighbors >= 2))


def fade_like(contrast: Column, edge_crop: Column, frames: Column, neighbors: Column) -> Column:
    return (contrast < 0.50) | (cropped(edge_crop) & (neighbors <= 1)) | ((frames <= 2) & (neighbors <= 1) & (contrast < 0.70))


def stable_neighbors(rows: DataFrame, measure: Measure, o: LegacyOptions) -> DataFrame:
    """Adds stable_neighbors: rows of the group near in time, complete enough, and alike."""
    window = max(0.75, 2.0 / o.fps)
    most = F.max("word_count").over(Window.partitionBy("video", "group_index"))
    own = rows.withColumn("_most", most).select("video", "group_index", "cand_seq", "ts", "normalized", "word_count", "_most")
    right = own.select("video", "group_index", *[F.col(c).alias(f"{c}_r") for c in ("cand_seq", "ts", "normalized", "word_count")])
    bucket = lambda c: F.floor(c / window).cast("long")
    left = own.withColumn("_b", F.explode(F.array(bucket(F.col("ts")) - 1, bucket(F.col("ts")), bucket(F.col("ts")) + 1)))
    met = left.join(right.withColumn("_b", bucket(F.col("ts_r"))), ["video", "group_index", "_b"])
    near = met.where((F.col("cand_seq") != F.col("cand_seq_r")) & (F.abs(F.col("ts") - F.col("ts_r")) <= window) & (F.col("word_count_r") >= F.greatest(F.lit(1), F.ceil(F.col("_most") * o.complete_share))))
    alike = near.withColumn("_m", measure(F.col("normalized"), F.col("normalized_r"))).where(F.col("_m") >= o.group_overlap)
    counts = alike.groupBy("video", "cand_seq").agg(F.count(F.lit(1)).cast("int").alias("stable_neighbors"))
    return rows.drop("stable_neighbors").join(counts, ["video", "cand_seq"], "left").withColumn("stable_neighbors", F.coalesce("stable_neighbors", F.lit(0)))


def representatives(rows: DataFrame, o: LegacyOptions) -> DataFrame:
    """The best row of each group, with its score; a group of several rows without enough contrast has none."""
    g = Window.partitionBy("video", "group_index")
    start, end, most, n = F.min("ts").over(g), F.max("ts").over(g), F.max("word_count").over(g), F.count(F.lit(1)).over(g)
    top = F.max("contrast").over(g)
    rows = rows.withColumn("_s", start).withColumn("_e", end).withColumn("_most", most).withColumn("_n", n).withColumn("_top", top)
    least = F.when(F.col("_most") <= 3, F.greatest(F.lit(o.least_words), F.col("_most") - 1)).otherwise(F.greatest(F.lit(o.least_words), F.ceil(F.col("_most") * o.complete_share)))
    rows = rows.withColumn("_ok", F.col("word_count") >= least)
    rows = rows.withColumn("_ok", F.col("_ok") | ~F.max("_ok").over(g))
    bright = F.col("_ok") & (F.col("contrast") >= F.col("_top") * o.contrast_share)
    rows = rows.withColumn("_bright", bright).withColumn("_any", F.max("_bright").over(g))
    rows = rows.where((F.col("_top") <= 0) & F.col("_ok") | (F.col("_top") > 0) & (F.col("_bright") | (~F.col("_any") & (F.col("_n") == 1) & F.col("_ok"))))
    trim = o.trim_seconds
    inner = F.col("ts").between(F.col("_s") + trim, F.col("_e") - trim)
    wide = F.col("_e") - F.col("_s") > trim * 2.2
    rows = rows.withColumn("_in", inner & wide).withColumn("_anyin", F.max("_in").over(g)).where(~F.col("_anyin") | F.col("_in"))
    edge = F.least(F.col("ts") - F.col("_s"), F.col("_e") - F.col("ts"))
    total = (
        F.col("conf") * 42.0
        + F.col("contrast") * 28.0
        + F.col("contrast") / F.greatest(F.col("_top"), F.lit(0.001)) * 12.0
        + F.col("word_count") / F.greatest(F.lit(1), F.col("_most")) * 10.0
        + F.col("stable_neighbors") * 4.0
        + F.least(F.col("word_count"), F.lit(18)) * 0.8
        - F.greatest(F.lit(0.0), F.lit(trim) - edge) * 14.0
        - F.col("edge_crop") * 36.0
        - F.col("ad_overlay") * 24.0
    )
    best = Window.partitionBy("video", "group_index").orderBy(F.desc("score"), "cand_seq")
    ranked = rows.withColumn("score", total).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return ranked.drop("_s", "_e", "_most", "_n", "_top", "_ok", "_bright", "_any", "_in", "_anyin", "_r")


class _Side:
    """Columns of one row of a pair, under a prefix."""

    def __init__(self, prefix: str):
        c = lambda n: F.col(prefix + n)
        self.ts, self.words, self.conf, self.contrast = c("ts"), c("word_count"), c("conf"), c("contrast")
        self.crop, self.frames, self.neighbors, self.score = c("edge_crop"), c("group_frames"), c("stable_neighbors"), c("score")
        self.normalized, self.source = c("normalized"), c("output_source")
        self.tokens = X.token_set(self.normalized)
        self.cropped = cropped(self.crop)
        self.noisy = X.noisy_ocr(X.tokens(self.normalized), self.conf)
        self.strong = strong_visual(self.contrast, self.crop, self.frames, self.neighbors)
        self.fade = fade_like(self.contrast, self.crop, self.frames, self.neighbors)


def preferred(a: _Side, b: _Side) -> Column:
    """Whether ``a`` is the better of two equals: score beyond a dead band, then frames, neighbours, and the earlier."""
    return (
        F.when(a.score > b.score + 0.35, True)
        .when(b.score > a.score + 0.35, False)
        .when(a.frames != b.frames, a.frames > b.frames)
        .when(a.neighbors != b.neighbors, a.neighbors > b.neighbors)
        .when(F.abs(a.ts - b.ts) > 0.001, a.ts < b.ts)
        .otherwise(False)
    )


def prune_verdict(c: _Side, x: _Side, related: Column, near: Column, visual: Column, o: LegacyOptions) -> Column:
    """Whether ``c`` goes because of ``x``: the first rule that applies decides."""
    gap, held = F.abs(c.ts - x.ts), X.containment(c.tokens, x.tokens)
    inside = F.size(F.array_except(c.tokens, x.tokens)) == 0
    outside = F.size(F.array_except(x.tokens, c.tokens)) == 0
    later = x.ts > c.ts
    both_strong = c.strong & x.strong
    cleaner = (gap <= o.superset_window) & (x.words >= c.words + 2) & (held >= F.when(c.words <= 3, 0.55).otherwise(0.75)) & ~x.cropped & ~x.noisy
    broken = X.trailing_fragment(X.tokens(c.normalized)) | (X.noise_ratio(X.tokens(c.normalized)) > 0) | (c.source == "reconstructed")
    short = gap <= o.short_window
    shorter_alike = inside | ((related >= o.group_overlap) & (c.words < x.words))
    evolves = later & (near >= o.evolution)
    rules = [
        (cleaner & broken & (c.words <= 18), True),
        (cleaner & (c.words <= 3) & ((c.frames <= 3) | (c.neighbors <= 1)), True),
        (cleaner & (c.words <= 6) & ((c.frames <= 6) | (c.neighbors <= 1) | c.fade), True),
        (c.cropped & (c.frames <= 2) & (c.words <= 16) & ((c.crop >= 0.65) | c.noisy), True),
        (inside & short & (c.words >= 5) & (x.words > c.words) & (x.score >= c.score - 24), True),
        (outside & short & (c.conf + 0.04 < x.conf) & (x.score >= c.score - 16), True),
        (c.cropped & (held >= 0.55) & (((x.words > c.words) & (x.score >= c.score - 24)) | ((x.words >= c.words) & ~x.cropped)), True),
        ((c.normalized == x.normalized) & (visual > 0.08) & both_strong, False),
        ((c.normalized == x.normalized) & c.fade & ~x.fade, True),
        (c.normalized == x.normalized, preferred(x, c)),
        (shorter_alike & both_strong & (visual > o.visual_split), False),
        (shorter_alike & (visual <= o.visual_split * 1.25) & (x.words >= c.words) & ((x.score >= c.score) | (x.words > c.words)), True),
        (shorter_alike & c.fade & (x.words >= c.words), True),
        (outside & c.fade & (related >= o.group_overlap), True),
        (short & (visual <= o.noisy_visual) & c.noisy & x.noisy & (x.score >= c.score), True),
        (short & c.cropped & (c.words <= 4) & (x.words >= c.words + 2) & (held >= 0.40), True),
        (evolves & (visual > 0.08) & both_strong, False),
        (evolves & (x.words >= c.words) & (x.score >= c.score - 8), True),
        (evolves & (x.words > c.words) & (x.conf >= c.conf - 0.02), True),
        (evolves & c.fade & (x.score >= c.score - 12), True),
        (later & short & (c.words <= 2) & (x.words >= c.words + 2) & (F.size(F.array_intersect(c.tokens, x.tokens)) > 0) & (x.conf >= c.conf), True),
    ]
    verdict = None
    for test, result in rules:
        value = result if isinstance(result, Column) else F.lit(result)
        verdict = F.when(test, value) if verdict is None else verdict.when(test, value)
    return verdict.otherwise(False)


def prune_transitions(rows: DataFrame, o: LegacyOptions, related: Measure = fuzzy.legacy_similarity_col, near: Measure = fuzzy.near_similarity_col) -> DataFrame:
    """Without rows that any other row of the original list prunes; two may prune each other."""
    reach = max(o.subset_window, o.superset_window)
    kept = ["cand_seq", "ts", "normalized", "word_count", "conf", "contrast", "edge_crop", "group_frames", "stable_neighbors", "score", "output_source", "thumbnail"]
    left = rows.select("video", *[F.col(c).alias(f"c_{c}") for c in kept])
    right = rows.select("video", *[F.col(c).alias(f"x_{c}") for c in kept])
    bucket = lambda c: F.floor(c / reach).cast("long")
    left = left.withColumn("_b", F.explode(F.array(bucket(F.col("c_ts")) - 1, bucket(F.col("c_ts")), bucket(F.col("c_ts")) + 1)))
    pairs = left.join(right.withColumn("_b", bucket(F.col("x_ts"))), ["video", "_b"]).where((F.col("c_cand_seq") != F.col("x_cand_seq")) & (F.abs(F.col("c_ts") - F.col("x_ts")) <= reach))
    pairs = pairs.withColumn("_rel", related(F.col("c_normalized"), F.col("x_normalized"))).withColumn("_near", near(F.col("c_normalized"), F.col("x_normalized")))
    pairs = pairs.withColumn("_vis", B.visual_distance(F.col("c_thumbnail"), F.col("x_thumbnail")))
    pruned = pairs.where(prune_verdict(_Side("c_"), _Side("x_"), F.col("_rel"), F.col("_near"), F.col("_vis"), o))
    return rows.join(pruned.select("video", F.col("c_cand_seq").alias("cand_seq")).distinct(), ["video", "cand_seq"], "left_anti")


def low_quality(normalized: Column, words: Column, conf: Column) -> Column:
    return ((words <= 3) & (conf < 0.90)) | ((words <= 2) & X.noisy_ocr(X.tokens(normalized), conf))


def trim_edges(rows: DataFrame, titles: DataFrame, o: LegacyOptions) -> DataFrame:
    """From the first story anchor (or the first row) to before the first late title, without rejected and partial rows.

    ``titles`` has video and ``title`` (array of title words).
    """
    duration = max(1.0, o.story_end - o.story_start)
    held = rows.join(titles, "video", "left").withColumn("title", F.coalesce("title", F.array().cast("array<string>")))
    norm, words, conf = F.col("normalized"), F.col("word_count"), F.col("conf")
    rejected = X.legacy_reject(X.legacy_clean(F.col("text")), norm)
    late = (F.col("ts") >= o.story_start + duration * 0.78) & (words <= F.greatest(F.lit(10), F.size("title") + 4)) & (X.title_overlap(norm, F.col("title")) >= 0.60)
    partial = low_quality(norm, words, conf)
    clean = ~rejected & ~late & ~partial & ~(cropped(F.col("edge_crop")) & (words <= 4)) & ~X.noisy_ocr(X.tokens(norm), conf)
    anchor = clean & (((words >= 4) & (conf >= 0.84)) | ((words >= 2) & (conf >= 0.93)))
    v = Window.partitionBy("video")
    seq = F.row_number().over(v.orderBy("ts", "cand_seq"))
    held = held.withColumn("_i", seq).withColumn("_late", late).withColumn("_drop", rejected | partial).withColumn("_first", F.min(F.when(anchor, F.col("_i"))).over(v))
    held = held.withColumn("_first", F.coalesce("_first", F.lit(1)))
    held = held.withColumn("_stop", F.min(F.when(F.col("_late") & (F.col("_i") >= F.col("_first")), F.col("_i"))).over(v))
    kept = held.where((F.col("_i") >= F.col("_first")) & (F.col("_stop").isNull() | (F.col("_i") < F.col("_stop"))) & ~F.col("_drop"))
    return kept.select(rows.columns)


def refinement_bounds(ts: Column, start: Column, end: Column, o: LegacyOptions) -> tuple[Column, Column]:
    intro = F.lit(o.include_title_intro) & (ts >= o.title_start) & (ts < o.title_end)
    low, high = F.when(intro, o.title_start).otherwise(o.story_start), F.when(intro, o.title_end).otherwise(o.story_end)
    return F.greatest(start - o.refine_extra, low), F.least(end + o.refine_extra, high)


def refinement_score(orig: _Side, cand: _Side, ad_overlay: Column, warned: Column) -> Column:
    return cand.conf * 32.0 + cand.contrast * 36.0 + cand.words * 6.0 + F.greatest(F.lit(0), cand.words - orig.words) * 14.0 - F.abs(cand.ts - orig.ts) * 2.0 - F.when(warned, 120.0).otherwise(0.0) - cand.crop * 32.0 - ad_overlay * 18.0


def refinement_probes(rows: DataFrame, o: LegacyOptions) -> DataFrame:
    """video, cand_seq, probe (order), probe_ms: the distinct times to look at around each row, within its bounds."""
    offsets = [0.0, *o.refine_offsets] if 0.0 not in o.refine_offsets else list(o.refine_offsets)
    low, high = refinement_bounds(F.col("ts"), F.col("group_start"), F.col("group_end"), o)
    times = rows.withColumn("_lo", low).withColumn("_hi", high).select("video", "cand_seq", "ts", "_lo", "_hi", F.posexplode(F.array(*map(F.lit, map(float, offsets)))).alias("probe", "offset"))
    t = F.bround(F.col("ts") + F.col("offset"), 3)
    near = times.withColumn("t", t).where((F.col("t") >= F.col("_lo")) & (F.col("t") <= F.col("_hi")))
    return near.groupBy("video", "cand_seq", F.bround(F.col("t") * 1000, 0).cast("long").alias("probe_ms")).agg(F.min("probe").alias("probe"))


def refine(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Fold each row's accepted probes in order: one replaces the choice if its score is more than 2 above the choice's, it has more words, or the row was warned.

    ``probes`` has video, cand_seq, probe, words, score and payload, only accepted and unwarned ones; ``rows`` has base_score, word_count and warned.
    """
    ordered = probes.groupBy("video", "cand_seq").agg(F.array_sort(F.collect_list(F.struct("probe", "words", "score", "payload"))).alias("_p"))
    met = rows.join(ordered, ["video", "cand_seq"], "left")
    start = F.struct(F.col("base_score").alias("score"), F.lit(None).cast(dict(probes.dtypes)["payload"]).alias("payload"))
    step = lambda s, p: F.when((p["score"] > s["score"] + 2.0) | (p["words"] > F.col("word_count")) | F.col("warned"), F.struct(p["score"].alias("score"), p["payload"].alias("payload"))).otherwise(s)
    return met.withColumn("refined", F.aggregate(F.coalesce("_p", F.array().cast(ordered.schema["_p"].dataType)), start, step)).drop("_p")


def polish(rows: DataFrame) -> DataFrame:
    """``transcript``: the polished reading where it is accepted.  Wants text and polished."""
    ok = fuzzy.accepts_polish_col(X.legacy_clean(F.col("text")), X.legacy_clean(F.col("polished")))
    return rows.withColumn("_ok", ok).withColumn("transcript", F.when(F.col("_ok"), F.col("polished")).otherwise(F.col("text"))).drop("_ok")
