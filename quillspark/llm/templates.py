"""Benchmark decontamination by template canonicalisation.

Texts become templates: words are lower-cased (A-Z and Latin-1 letters), ASCII punctuation inside and
around them is removed, and numbers, names and units become typed placeholders.
Every window of ``WINDOW`` template words is hashed; windows that occur in a
benchmark item are joined to that item's windows by hash.  A document is
contaminated by an item when the windows it shares cover enough of the item and
the slots agree: within one item, equal slot values must meet equal values in the
document, so a question whose numbers and names were changed throughout is
caught, while a chance meeting of templates is not.

The item windows are tested on the executors as a hash table when there are at
most ``BROADCAST_WINDOWS`` of them; beyond that every document window goes
through the join, which is the same join in both cases.

Placeholders: a word with a digit, or a number word, is NUM; a title-case word
that doesn't begin a sentence is NAME; a known unit is UNIT.  A window with fewer
than ``LEAST_PLAIN`` words beside its placeholders says too little as a template,
so its hash takes the values of the slots too and it matches verbatim only.  Where
most of the windows that meet are placeholders to more than half and slots were
changed, ``DENSE_COVERAGE`` of the item is asked for.

Defined results: null and empty texts, and texts or items shorter than a window,
have no windows and match nothing, but an item shorter than ``WINDOW`` words is
one window of its own length and is looked for at that length; repeated rows of a
document give one result per id; null ids match nothing; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _BYTE_VALUE, _SPACE, _STEP, _powers, chunks, mix64, text_buffers, window_hashes, word_hashes
from .shared import keep, prepare

WINDOW = 8
LEAST_PLAIN = 2
#: Share of an item's windows that a document must hold, and the least number of them; the share where slots say most.
COVERAGE, LEAST_WINDOWS, DENSE_COVERAGE = 0.3, 3, 0.8
BROADCAST_WINDOWS = 4_000_000

# Unit and number words.
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees mph kmh".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:")] = True
_DIGIT, _UPPER, _SMALL = (np.zeros(256, dtype=bool) for _ in range(3))
_DIGIT[48:58], _UPPER[65:91], _SMALL[97:123], _SMALL[128:] = True, True, True, True
_VALUE = np.where(_PUNCT, np.uint64(0), _BYTE_VALUE)
_TYPED = mix64(np.arange(1, 4, dtype=np.uint64))
NUM, NAME, UNIT = 1, 2, 3


def template(offsets: np.ndarray, raw: np.ndarray):
    """Per word: template hash, slot type (0: none), slot value; and the word offsets of each text."""
    n = len(raw)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8), np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    if n == 0:
        return none
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none
    first, lengths = int(starts[0]), np.diff(np.append(starts, n))
    body = raw[first:]
    # Latin-1 capitals are two bytes, of which the second differs from the small letter's by 32
    accented = np.zeros(len(body), dtype=bool)
    accented[1:] = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
    small = body + accented * np.uint8(32)
    kept = inside[first:] & ~_PUNCT[body]
    at = starts - first
    rank = np.cumsum(kept, dtype=np.int32)
    before = rank[at] - kept[at]
    size = np.add.reduceat(kept, at, dtype=np.int32)
    place = np.maximum(rank - 1 - np.repeat(before, lengths), 0)
    value = mix64(np.add.reduceat(_VALUE[small] * _powers(int(lengths.max()))[place], at) + _STEP)
    digits = np.logical_or.reduceat(_DIGIT[body], at)
    lead = np.minimum(at + (body[at] < 128) * _PUNCT[body[at]], len(body) - 1)
    second = np.minimum(lead + 1, len(body) - 1)
    title = _UPPER[body[lead]] & _SMALL[body[second]] & (size > 1)
    last = np.zeros(len(starts), dtype=bool)
    last[1:] = np.logical_or.reduceat(_STOP[body], at)[:-1]
    rows = np.searchsorted(starts, offsets)
    last[rows[:-1][rows[:-1] < len(starts)]] = True
    kind = np.zeros(len(starts), dtype=np.int8)
    kind[title & ~last] = NAME
    kind[np.isin(value, _UNIT_VALUES)] = UNIT
    kind[digits | np.isin(value, _NUMBER_VALUES)] = NUM
    shown = np.where(kind > 0, _TYPED[np.maximum(kind, 1) - 1], value)
    full = size > 0
    counts = np.concatenate(([0], np.cumsum(full)))
    return shown[full], kind[full], value[full], counts[rows]


def _values(words: list[str]) -> np.ndarray:
    offsets, raw = text_buffers(pa.array(words))
    return np.sort(word_hashes(offsets, raw)[0])


_UNIT_VALUES, _NUMBER_VALUES = _values(UNITS), _values(NUMBERS)


class WindowTable:
    """Membership of 64-bit window hashes: a bit table first, then a sorted array."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = np.uint64((1 << 20) - 1)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.sorted & self.mask).astype(np.intp)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(h & self.mask).astype(np.intp)])
        if not len(maybe) or not len(self.sorted):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == h[maybe]]


def _windows(shown: np.ndarray, value: np.ndarray, sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of template words, of values where a window has too few plain words; and which those are."""
    h = window_hashes(shown, size)
    bare = size - (sums[size:] - sums[:-size]) < min(LEAST_PLAIN, size) if len(h) else np.zeros(0, dtype=bool)
    return np.where(bare, ~window_hashes(value, size), h), bare


_WINDOWS = "id long, window long, place int, n_windows int, size int, slots array<long>"


def template_windows(rows: DataFrame, id_column: str, sizes: list[int], wanted: dict[int, WindowTable] | None = None, items: bool = False) -> DataFrame:
    """Windows of each text: id, hash, place, how many the text has, words, slot values in order.

    With ``wanted``, only windows in its tables.  With ``items``, a text shorter than
    the window gives one window of its own length.
    """
    prepare(rows.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offsets, raw = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets):
                shown, kind, value, begin = template(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])
                sums = np.concatenate(([0], np.cumsum(kind > 0)))
                parts: list[list] = [[], [], [], [], [], []]
                for size in sizes:
                    lengths = {*np.minimum(np.diff(begin), size).tolist()} - {0} if items else [size]
                    hashes = {z: _windows(shown, value, sums, z) for z in lengths}
                    for z, (h, bare) in hashes.items():
                        if wanted is not None:
                            found = wanted[z].find(h)
                        else:
                            found = np.arange(len(h))
                        own = np.searchsorted(begin, found, side="right") - 1
                        fits = found + z <= begin[own + 1]
                        if items:
                            fits &= np.minimum(np.diff(begin), size)[own] == z
                        for f, o in zip(found[fits].tolist(), own[fits].tolist()):
                            k = (kind[f : f + z] > 0) & ~bare[f]  # the values of a bare window are equal
                            for part, x in zip(parts, (ids[lo + o], h[f], f - begin[o], begin[o + 1] - begin[o] - z + 1, z, value[f : f + z][k].astype(np.int64).tolist())):
                                part.append(x)
                if parts[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(np.array(parts[1], dtype=np.uint64).astype(np.int64)), pa.array(parts[2], pa.int32()), pa.array(parts[3], pa.int32()), pa.array(parts[4], pa.int32()), pa.array(parts[5], pa.list_(pa.int64()))], names=["id", "window", "place", "n_windows", "size", "slots"])

    chosen = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, _WINDOWS)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, matched and item_windows, coverage, and match: 'verbatim' or 'template'.

    One row for each contaminated document and each item it holds.
    """
    items = keep(template_windows(benchmark, "item_id", [window], items=True).dropDuplicates(["id", "window", "place"]), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` numbers
    if not sizes:
        sizes = [window]
    wanted = None
    if items.count() <= BROADCAST_WINDOWS:
        hashes = items.select("window", "size").distinct().toArrow()
        own, size = hashes.column("window").to_numpy().astype(np.uint64), hashes.column("size").to_numpy()
        wanted = {z: WindowTable(own[size == z]) for z in sizes}
    found = template_windows(docs, "doc_id", sizes, wanted)
    right = items.select("window", "size", F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("n_windows").alias("item_windows"), F.col("slots").alias("item_slots"))
    met = keep(found.select(F.col("id").alias("doc_id"), "window", "size", "place", "slots").join(right, ["window", "size"]), "met-windows")
    # One occurrence of an item keeps the distance between its places and the document's, but for words put in or left
    # out.  Slots are compared at one distance; like passages within an item meet at another, and may agree there or not.
    key = ["doc_id", "item_id", "shift"]
    met = met.withColumn("shift", F.col("place") - F.col("item_place"))
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    slots = met.select(*key, F.explode(pairs).alias("s")).select(*key, "s.i", "s.d")
    values = slots.groupBy(*key, "i").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    same = (F.col("lo") == F.col("i")) & (F.col("hi") == F.col("i"))
    agreed = values.groupBy(*key).agg(F.sum((F.col("lo") != F.col("hi")).cast("int")).alias("clash"), F.sum((~same).cast("int")).alias("changed"), F.count(F.lit(1)).alias("n_slots"))
    dense = F.sum((F.size("item_slots") * 2 > F.col("size")).cast("int"))
    aligned = met.groupBy(*key).agg(F.collect_set("item_place").alias("places"), F.max("item_windows").alias("item_windows"), (dense * 2 > F.count(F.lit(1))).alias("dense")).join(agreed, key, "left")
    aligned = aligned.where(F.coalesce("clash", F.lit(0)) * 4 <= F.coalesce("n_slots", F.lit(0)))
    # distances that are near one another belong to one occurrence; a block and its neighbour overlap by half
    block = F.floor(F.col("shift") / F.lit(16))
    near = aligned.withColumn("block", F.explode(F.array(block, block + 1))).groupBy("doc_id", "item_id", "block")
    best = F.struct(F.size("places"), -F.abs(F.col("shift")))
    covered = near.agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("matched"), F.max("item_windows").alias("item_windows"), F.max_by(F.coalesce("changed", F.lit(0)), best).alias("changed"), F.max_by("dense", best).alias("dense"))
    share = F.when(F.col("dense") & (F.col("changed") > 0), F.lit(DENSE_COVERAGE)).otherwise(F.lit(coverage))
    need = F.least(F.col("item_windows"), F.greatest(F.lit(LEAST_WINDOWS), F.ceil(F.col("item_windows") * share)))
    return covered.where(F.col("matched") >= need).groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"),
        F.max("item_windows").alias("item_windows"),
        F.round(F.max(F.col("matched") / F.col("item_windows")), 6).alias("coverage"),
        F.when(F.min_by("changed", -F.col("matched")) == 0, "verbatim").otherwise("template").alias("match"),
    )
