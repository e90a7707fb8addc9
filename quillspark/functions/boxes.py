"""Geometry and filters of text boxes, as column expressions over one box per row.

A box has text, confidence, x, y, width, height, page_width, page_height and
ink_score; ``clean`` is its cleaned text.  Predicates take the box as a struct or
any object whose items are columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from . import words as W

BOX = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("confidence", "x", "y", "width", "height", "page_width", "page_height", "ink_score"))])


class Box:
    """Columns of a box; ``Box()`` takes them from the row, ``Box(struct)`` from a struct column."""

    def __init__(self, of: Column | None = None, clean: Column | None = None):
        get = (lambda n: F.col(n)) if of is None else (lambda n: of[n])
        self.text, self.confidence, self.x, self.y = get("text"), get("confidence"), get("x"), get("y")
        self.width, self.height, self.page_width, self.page_height = get("width"), get("height"), get("page_width"), get("page_height")
        self.right, self.bottom = self.x + self.width, self.y + self.height
        self.clean = X.local_clean_inline(self.text) if clean is None else clean
        self.n = X.word_count(self.clean)


def watermark_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "").rlike("|".join(W.WATERMARK_MARKERS))


def social_overlay(b: Box) -> Column:
    return (b.clean != "") & X.local_reject(b.clean) & (b.x > b.page_width * 0.52) & (b.y > b.page_height * 0.50)


def watermark_contaminated(b: Box) -> Column:
    return watermark_text(b.text) & (b.x < b.page_width * 0.30) & (b.y > b.page_height * 0.62)


def edge_crop_fragment(b: Box) -> Column:
    touches = (b.x <= 2) | (b.right >= b.page_width - 2) | (b.y <= 2) | (b.bottom >= b.page_height - 2)
    return b.n.between(1, 2) & (b.width <= b.page_width * 0.12) & touches


def corner_short_artifact(b: Box) -> Column:
    corner = ((b.x < b.page_width * 0.18) | (b.x > b.page_width * 0.82)) & (b.y > b.page_height * 0.82)
    return (b.n == 1) & corner & (b.width < b.page_width * 0.10) & (b.height < b.page_height * 0.06) & (b.confidence < 0.90)


def low_confidence_short(b: Box) -> Column:
    return b.n.between(1, 2) & (b.confidence < 0.72)


def tall_short_artifact(b: Box, reference: Column) -> Column:
    return b.n.between(1, 2) & (reference > 0) & (b.height > F.greatest(reference * 2.4, F.lit(90.0))) & (b.confidence < 0.90)


def noise(b: Box, reference: Column) -> Column:
    """Any of the six rules that drop a box."""
    return (b.clean == "") | watermark_contaminated(b) | edge_crop_fragment(b) | corner_short_artifact(b) | low_confidence_short(b) | tall_short_artifact(b, reference)


def route(b: Box, reference: Column) -> Column:
    """'ad', 'noise' or 'story'; overlays are ads even where they look like noise."""
    return F.when(social_overlay(b), "ad").when(noise(b, reference), "noise").otherwise("story")


def meaningful(b: Box, reference: Column) -> Column:
    return (b.clean != "") & (b.confidence >= 0.35) & ~noise(b, reference)


def occluded_suffix(b: Box) -> Column:
    """A short compact box in the lower-left logo zone."""
    short = F.exists(X.tokens(b.clean), lambda t: F.length(t) <= 5)
    zone = (b.x < b.page_width * 0.32) & (b.y > b.page_height * 0.82)
    return b.n.between(1, 2) & zone & (b.width < b.page_width * 0.18) & (b.height < b.page_height * 0.16) & short


def occluded_text(b: Box) -> Column:
    return (b.x < b.page_width * 0.30) & (b.y > b.page_height * 0.70)


def lower_left_watermark(b: Box, legacy: Column) -> Column:
    """True wherever no legacy word is left; else brand-like words in the lower left."""
    brand = F.exists(X.tokens(legacy), lambda t: t.rlike("^(vook|vo0k|wook)"))
    return (legacy == "") | (brand & (b.x < b.page_width * 0.22) & (b.y > b.page_height * 0.72))


def bottom_overlay(b: Box) -> Column:
    return (b.y > b.page_height * 0.74) | (b.x > b.page_width * 0.72)


def ad_item(legacy: Column) -> Column:
    return (legacy == "") | F.arrays_overlap(X.tokens(legacy), F.array(*map(F.lit, W.AD_ITEM_WORDS)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area of two box structs."""
    wide = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    small = F.least(a["width"] * a["height"], b["width"] * b["height"])
    return F.when(wide * high <= 0, F.lit(0.0)).otherwise(wide * high / F.greatest(F.lit(1.0), small))


def edge_crop_score(boxes: Column) -> Column:
    """Additive score of touching page edges, over an array of boxes of one page; at most 1."""
    first = F.get(boxes, F.lit(0))
    pw, ph = F.greatest(first["page_width"], F.lit(1.0)), F.greatest(first["page_height"], F.lit(1.0))
    mx, my = pw * 0.018, ph * 0.014
    low = lambda f: F.array_min(F.transform(boxes, f))
    high = lambda f: F.array_max(F.transform(boxes, f))
    add = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    edge = F.size(F.filter(boxes, lambda b: (b["x"] <= mx) | (b["x"] + b["width"] >= pw - mx)))
    score = (
        add(low(lambda b: b["x"]) <= mx, 0.55)
        + add(high(lambda b: b["x"] + b["width"]) >= pw - mx, 0.55)
        + add(low(lambda b: b["y"]) <= my, 0.20)
        + add(high(lambda b: b["y"] + b["height"]) >= ph - my, 0.20)
        + F.least(F.lit(0.35), edge / F.greatest(F.size(boxes), F.lit(1)) * 0.35)
    )
    return F.when(F.size(boxes) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted array; 0 if empty."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))


def ink_score(pixels: Column) -> Column:
    """Darkness or spread from the nearest-index 10th and 90th percentiles of grey values 0 to 255."""
    ordered, n = F.array_sort(pixels), F.size(pixels)
    p10 = F.get(ordered, F.greatest(F.lit(0), F.floor(n * 0.10).cast("int") - 1))
    p90 = F.get(ordered, F.least(n - 1, F.floor(n * 0.90).cast("int")))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest((F.lit(255.0) - p10) / 255.0, F.greatest(F.lit(0.0), (p90 - p10) / 255.0)))


def visual_distance(a: Column, b: Column, span: float = 255.0) -> Column:
    """Mean absolute difference of two thumbnails over ``span``; 1 where their sizes differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(1.0)).otherwise(total / (F.greatest(F.size(a), F.lit(1)) * span))
