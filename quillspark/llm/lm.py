"""Language-model scoring from a log-frequency Bloom filter.

Counting: every executor sorts the n-grams (n up to ``ORDER``) of some million
tokens at a time, and sends each hash range as one block of distinct hashes with
counts.  The number of ranges follows the size of the texts, so a range stays
small; it is merged by one task, where a frequent n-gram is one entry of each
block, not many rows.  The task also builds its own segment of the filter: an
n-gram whose count is at the q-th quantised number has (n-gram, level) inserted
for each level up to q.  All bits of one (n-gram, level) are in one block of 64
bytes, so a probe costs one memory access.

The filter is broadcast.  A count is read back by probing levels upwards until one
is absent, four at a stride beyond the first few; only n-grams still present are
probed on, and each n-gram of a chunk once.  The probability of a token is
interpolated: p_n = (1 - w) p_(n-1) + w c(context, token) / c(context), where w is
by the size of c(context) and p_1 is add-half over unigrams.  An unseen context has
weight 0.  With exact counts the probabilities of all words and one unknown word
add up to 1.

The levels of a text's n-grams are read once and kept, a byte each.  A probability
is a function of a token's few levels, so the weights are chosen on every token of
every training text, each with its own occurrence left out: what is gathered is how
often each combination of levels occurs, and the scores come from the same bytes.

What is broadcast is measured first.  If the filter or the vocabulary is larger
than its bound, texts are packed some megabytes together; the sorted distinct
n-grams of a pack go to the filter's segments, one block for each hash range.  A
range reads the blocks of many packs in one go, each n-gram once, and the levels
come back to each pack in the order asked.  Weights and results are the same.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, each text
has one end token more, so a null or empty text is scored as its end; rows with a
null id are scored, and learned from if they are among those trained on; with no
training rows every probability is that of add-half over nothing (base 0);
repeated rows get equal results; texts are never cut; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _STEP, chunks, mix64, text_buffers, word_hashes
from .shared import keep, prepare

ORDER = 2
BASE = 1.25
PROBES, BITS_PER_ENTRY = 6, 9
FLUSH_TOKENS = 1_500_000
#: Bytes of text for each hash range, and so many ranges at least.  A text's n-grams go to every range, so blocks number packs times ranges.
RANGE_BYTES, LEAST_RANGES = 16 << 20, 16
#: Bytes of text packed together for a filter that isn't broadcast; about an Arrow batch, which is one pack up to twice as many.
PACK_BYTES = 4 << 20
PACKS_PER_FILE = 4
#: Larger filters are read in their hash ranges: on check_l that takes as long as sending 92 MB to every worker, with more disk.
FILTER_BYTES = 16 << 20
VOCABULARY = 12_000_000
CHUNK = 1 << 20
_BINS = 32
_GRID = np.array([0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
END = mix64(np.array([77], dtype=np.uint64))[0]
#: What stands for the context of a first word at each order; the one before a first word is an end.
STARTS = np.concatenate(([END], mix64(np.arange(78, 76 + ORDER, dtype=np.uint64))))

#: The least count of each level: whole numbers about ``BASE`` apart, none twice.
_LEAST = [1]
while _LEAST[-1] < 2**62:
    _LEAST.append(max(_LEAST[-1] + 1, int(_LEAST[-1] * BASE)))
#: The number that each level stands for: the geometric middle of its counts; 0 for level 0.
_VALUES = np.array([0.0] + [(a * (b - 1)) ** 0.5 for a, b in zip(_LEAST, _LEAST[1:])])
_LEAST = np.array(_LEAST[:-1], dtype=np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 0 for 0, else the number of levels whose least count is reached."""
    return np.searchsorted(_LEAST, counts, side="right")


def tokens(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and token offsets (n + 1)."""
    words, rows = word_hashes(offsets, raw)
    n = len(rows) - 1
    begin = rows + np.arange(n + 1)
    out = np.full(int(begin[-1]), END, dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[begin[1:] - 1] = False
    out[inner] = words
    return out, begin


def pack_tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of an Arrow column, hashed about ``CHUNK`` bytes at a time: that takes some dozens of bytes for each one of the text."""
    offsets, raw = text_buffers(texts)
    own, sizes = [], [np.zeros(1, dtype=np.int64)]
    for lo, hi in chunks(offsets, CHUNK):
        hashes, begin = tokens(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])
        own.append(hashes)
        sizes.append(np.diff(begin))
    return np.concatenate(own), np.cumsum(np.concatenate(sizes))


def contexts(grams: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """The n-gram before each token; a text's first token has the start of that order."""
    before = np.concatenate((STARTS[n - 1 : n], grams[:-1]))
    before[begin[:-1]] = STARTS[n - 1]
    return before


def ngrams(own: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, for n from 1 to ``ORDER``."""
    out = [own]
    for n in range(1, ORDER):
        out.append(mix64(contexts(out[-1], begin, n) * np.uint64(0x9E3779B97F4A7C15) + _STEP) ^ mix64(own + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)))
    return out


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each n-gram; ``parts`` is a power of two."""
    return (hashes >> np.uint64(65 - parts.bit_length())).astype(np.int64) if parts > 1 else np.zeros(len(hashes), dtype=np.int64)


def _planes(hashes: np.ndarray) -> bytes:
    """Sorted hashes byte by byte: first bytes are much alike, so a shuffle's compression shortens them."""
    return hashes.view(np.uint8).reshape(-1, 8).T.tobytes()


def _hashes(planes: list[bytes]) -> np.ndarray:
    """The hashes of several blocks, one block after another."""
    out = [np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T for x in planes]
    return np.ascontiguousarray(np.concatenate(out)).view(np.uint64).ravel() if out else np.zeros(0, dtype=np.uint64)


def _kept(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """``keep``, with shuffle files deleted when they have been read, not when the driver happens to collect its garbage; ``rows``: of a file at most."""
    conf = df.sparkSession.conf
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.files.maxRecordsPerFile": str(rows)} if rows else {})
    before = {key: conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            conf.set(key, value)
        return keep(df, name)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


@dataclass
class Filter:
    """Segments by hash range: first blocks, numbers of blocks, and all bits, 64 bytes a block."""

    starts: np.ndarray
    blocks: np.ndarray
    bits: np.ndarray

    @staticmethod
    def segment(hashes: np.ndarray, q: np.ndarray) -> bytes:
        blocks = max(1, -(-int(q.sum() * BITS_PER_ENTRY) // 512))
        on = np.zeros(blocks * 512, dtype=bool)
        level = 1
        while len(hashes):
            block, places = Filter.places(hashes, level, np.uint64(blocks))
            for i in range(PROBES):
                on[((block << np.uint64(9)) + ((places >> np.uint64(9 * i)) & np.uint64(511))).astype(np.intp)] = True
            level += 1
            more = q >= level
            hashes, q = hashes[more], q[more]
        return np.packbits(on, bitorder="little").tobytes()

    @staticmethod
    def places(hashes: np.ndarray, level: int, blocks) -> tuple[np.ndarray, np.ndarray]:
        """The block of each (n-gram, level) and, nine bits each, its places there."""
        g = mix64(hashes + np.uint64(level * 0xD1342543DE82EF95 % 2**64))
        return ((g >> np.uint64(32)) * blocks) >> np.uint64(32), mix64(g + _STEP)

    def holds(self, hashes: np.ndarray, level: int, start: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        block, places = Filter.places(hashes, level, blocks)
        first = ((block + start) << np.uint64(6)).astype(np.intp)
        at = np.arange(len(hashes))
        for i in range(PROBES):
            place = (places[at] >> np.uint64(9 * i)) & np.uint64(511)
            on = (self.bits[first[at] + (place >> np.uint64(3)).astype(np.intp)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            at = at[on.view(bool)]
        found = np.zeros(len(hashes), dtype=bool)
        found[at] = True
        return found

    def read(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram; 0 if it isn't there."""
        found = np.zeros(len(hashes), dtype=np.int64)
        part = _ranges(hashes, len(self.starts))
        start, blocks = self.starts[part], self.blocks[part]

        def climb(live, level):
            """Those of ``live`` that hold ``level``."""
            on = live[self.holds(hashes[live], level, start[live], blocks[live])]
            found[on] = level
            return on

        live, top = np.arange(len(hashes)), 0
        while len(live):
            top += 1 if top < 4 else 4
            live = climb(live, top)
        # between the last level of the stride that was there and the next one
        for k in (1, 2, 3):
            more = np.flatnonzero((found >= 4) & (found % 4 == k - 1))
            for base in np.unique(found[more]).tolist():
                climb(more[found[more] == base], base + 1)
        return found


@dataclass
class Model:
    total: int
    distinct: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros((ORDER + 1, _BINS)))
    words: np.ndarray | None = None
    counts: np.ndarray | None = None
    filters: list[Filter] | None = None
    shared: object = None
    parts: int = 1

    @property
    def mass(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Exact training counts of sorted hashes."""
        if not len(self.words):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], 0)

    def read(self, own: np.ndarray, begin: np.ndarray):
        """Levels of the n-gram that ends at each token, by order; those of the starts; and the distinct tokens with their places."""
        held, first, words = [], [], None
        for n, grams in enumerate(ngrams(own, begin)):
            distinct, back = np.unique(grams, return_inverse=True)
            words = words or (distinct, back)
            held.append(self.filters[n].read(distinct)[back])
            if n + 1 < ORDER:
                first.append(self.filters[n].read(STARTS[n : n + 1])[0])
        return held, first, *words

    def probability(self, held, before, upto: int, less: float = 0.0):
        """p of each token by the first ``upto`` orders; ``held`` and ``before`` are levels by order; ``less``: occurrences left out."""
        p = (np.maximum(_VALUES[held[0]] - less, 0) + 0.5) / self.mass
        for n in range(2, upto + 1):
            w = self.weights[n][np.minimum(before[n - 2], _BINS - 1)]
            p = (1 - w) * p + w * share(held[n - 1], before[n - 2], less)
        return p


def share(held: np.ndarray, before: np.ndarray, less: float = 0.0) -> np.ndarray:
    """c(context, token) / c(context) from levels."""
    return np.clip(np.maximum(_VALUES[held] - less, 0) / np.maximum(_VALUES[before] - less, 1), 0, 1)


def _count_blocks(texts: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        held: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
        size = 0

        def out():
            rows: list[tuple] = []
            for kind, grams in enumerate(held, 1):
                h, n = np.unique(np.concatenate(grams), return_counts=True)
                part = _ranges(h, parts)
                cuts = np.flatnonzero(np.diff(part)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)]):
                    rows.append((kind, int(part[a]), _planes(h[a:b]), n[a:b].astype(np.uint32).tobytes()))
                grams.clear()
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kind", "part", "grams", "counts"])

        for batch in batches:
            offsets, raw = text_buffers(batch.column(0))
            for lo, hi in chunks(offsets):
                own, begin = tokens(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])
                for n, grams in enumerate(ngrams(own, begin)):
                    held[n].append(grams)
                    if 0 < n < ORDER - 1:
                        held[n].append(np.full(hi - lo, STARTS[n]))
                size += len(own)
                if size >= FLUSH_TOKENS:
                    yield out()
                    size = 0
        if size:
            yield out()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "kind int, part long, grams binary, counts binary")


def _merged(blocks: DataFrame) -> DataFrame:
    """One row for each order and hash range: its tokens and n-grams, the filter segment, and of words the hashes and exact counts."""

    def run(t: pa.Table) -> pa.Table:
        kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
        grams = _hashes(t.column("grams").to_pylist())
        counts = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in t.column("counts")])
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        grams, counts = grams[starts], np.add.reduceat(counts, starts)
        bits = Filter.segment(grams, levels(counts))
        exact = [grams.tobytes() if kind == 1 else None], [counts.tobytes() if kind == 1 else None]
        return pa.table({"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int64()), "total": [int(counts.sum())], "distinct": [len(grams)], "size": [len(bits)], "bits": pa.array([bits], pa.binary()), "grams": pa.array(exact[0], pa.binary()), "counts": pa.array(exact[1], pa.binary())})

    return blocks.groupBy("kind", "part").applyInArrow(run, "kind int, part long, total long, distinct long, size long, bits binary, grams binary, counts binary")


def _gather(merged: DataFrame, model: Model) -> None:
    """Bring vocabulary and filters into ``model``, one block at a time into arrays of their final size."""
    sizes, kept = np.full((ORDER + 1, model.parts), 64, dtype=np.int64), np.zeros(model.parts, dtype=np.int64)
    for r in merged.select("kind", "part", "size", "distinct").toLocalIterator():
        sizes[r["kind"], r["part"]] = r["size"]
        if r["kind"] == 1:
            kept[r["part"]] = r["distinct"]
    blocks = (sizes // 64).astype(np.uint64)
    model.filters = [Filter(np.cumsum(b) - b, b, np.zeros(int(b.sum()) * 64, dtype=np.uint8)) for b in blocks[1:]]
    at = np.concatenate(([0], np.cumsum(kept)))
    model.words, model.counts = np.zeros(at[-1], dtype=np.uint64), np.zeros(at[-1], dtype=np.int32 if model.total < 2**31 else np.int64)
    for r in merged.select("kind", "part", "bits", "grams", "counts").toLocalIterator():
        f, k = model.filters[r["kind"] - 1], r["part"]
        lo = int(f.starts[k]) * 64
        f.bits[lo : lo + len(r["bits"])] = np.frombuffer(r["bits"], dtype=np.uint8)
        if r["kind"] == 1:
            model.words[at[k] : at[k + 1]] = np.frombuffer(r["grams"], dtype=np.uint64)
            model.counts[at[k] : at[k + 1]] = np.frombuffer(r["counts"], dtype=np.int64)


_ROWS = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: held1, held2, ...: a byte for the level of the n-gram that ends at each token; of orders below the last, a byte before for that of the start.
_READ = "doc_id long, learn boolean, n_known long, base_score double, " + ", ".join(f"held{n} binary" for n in range(1, ORDER + 1))


def _read_rows(model: Model, ids, learn, begin: np.ndarray, held, first, exact: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_READ`` from levels by order, those of the starts, exact counts of distinct words and the words' places."""
    add = lambda x: pa.array(np.add.reduceat(x, begin[:-1]))
    columns = [ids, learn, add((exact > 0).astype(np.int64)[words]), add(np.log10((exact + 0.5) / model.mass)[words])]
    for n, q in enumerate(held):
        ends, flat = begin, q.astype(np.uint8)
        if n + 1 < ORDER:
            ends, flat = begin + np.arange(len(begin)), np.insert(flat, begin[:-1], first[n])
        columns.append(pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)]))
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _READ.split(", ")])


def _tokens_read(batch: pa.RecordBatch):
    """Levels of n-grams and of their contexts by order, and token offsets, of some texts at a time; and the range of their rows."""
    columns = [text_buffers(batch.column(f"held{n}")) for n in range(1, ORDER + 1)]
    for lo, hi in chunks(columns[-1][0], CHUNK // 4):
        begin = columns[-1][0][lo : hi + 1] - columns[-1][0][lo]
        held, before = [], []
        for n, (offsets, raw) in enumerate(columns):
            flat = raw[offsets[lo] : offsets[hi]]
            if n + 1 < ORDER:
                ends = offsets[lo : hi + 1] - offsets[lo]
                before.append(np.delete(flat, ends[1:] - 1))
                flat = np.delete(flat, ends[:-1])
            held.append(flat)
        yield held, before, begin, lo, hi


def _asked(grams: np.ndarray, n: int) -> np.ndarray:
    """What is read of the filter of order n + 1: the n-grams, and the start that is the context of first words."""
    return np.append(grams, STARTS[n]) if n + 1 < ORDER else grams


def _packed(rows: DataFrame) -> DataFrame:
    """pack, ids, learn, texts: some megabytes of the texts (doc_id, learn, text) in each row; a longer text stands alone, whole."""

    def run(batches):
        for batch in batches:
            offsets, _ = text_buffers(batch.column(2))
            cuts = [*chunks(offsets, 2 * PACK_BYTES)]
            ends = pa.array([0, *(hi for _, hi in cuts)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in batch.columns], names=["ids", "learn", "texts"])

    return rows.mapInArrow(run, "ids array<long>, learn array<boolean>, texts array<string>").withColumn("pack", F.monotonically_increasing_id())


def _levels(packs: DataFrame, model: Model, merged: DataFrame) -> DataFrame:
    """pack, kind, part: the levels (and of words the exact counts) of a pack's sorted distinct n-grams in one hash range."""
    parts = model.parts

    def ask(batches):
        for batch in batches:
            for pack, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own, begin = pack_tokens(texts.values)
                for n, grams in enumerate(ngrams(own, begin)):
                    h = np.unique(_asked(grams, n))
                    part = _ranges(h, parts)
                    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(h)).tolist()
                    size = len(cuts) - 1
                    flat = pa.array([_planes(h[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, pack)), pa.array(np.full(size, n + 1, np.int32)), pa.array(part[cuts[:-1]]), flat], names=["pack", "kind", "part", "grams"])

    def probe(asked: pa.Table, stored: pa.Table) -> pa.Table:
        words = asked.num_rows and asked.column("kind")[0].as_py() == 1
        own = counts = None
        if stored.num_rows:
            bits = np.frombuffer(stored.column("bits")[0].as_py(), dtype=np.uint8)
            own = Filter(np.zeros(1, dtype=np.uint64), np.array([len(bits) // 64], dtype=np.uint64), bits)
            if words:
                counts = replace(model, shared=None, words=np.frombuffer(stored.column("grams")[0].as_py(), dtype=np.uint64), counts=np.frombuffer(stored.column("counts")[0].as_py(), dtype=np.int64))
        grams = asked.column("grams")
        ends = np.cumsum([0, *pc.binary_length(grams).to_pylist()])
        read, exact = [], []
        # blocks are many and short, so a million n-grams are read in one go, each once
        for lo, hi in chunks(ends, 2 * PACK_BYTES):
            distinct, back = np.unique(_hashes(grams.slice(lo, hi - lo).to_pylist()), return_inverse=True)
            cuts = ((ends[lo : hi + 1] - ends[lo]) // 8).tolist()
            split = lambda x: [x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]  # noqa: B023, E731
            read += split((own.read(distinct) if own else np.zeros(len(distinct))).astype(np.uint8)[back])
            exact += split((counts.count(distinct) if counts else np.zeros(len(distinct))).astype(np.int64)[back]) if words else [None] * (hi - lo)
        return pa.table({"pack": asked.column("pack"), "kind": asked.column("kind"), "part": asked.column("part"), "levels": pa.array(read, pa.binary()), "counts": pa.array(exact, pa.binary())})

    asked = packs.select("pack", "texts").mapInArrow(ask, "pack long, kind int, part long, grams binary")
    read = asked.groupBy("kind", "part").cogroup(merged.select("kind", "part", "bits", "grams", "counts").groupBy("kind", "part"))
    return _kept(read.applyInArrow(probe, "pack long, kind int, part long, levels binary, counts binary"), "lm-levels")


def _read(docs: DataFrame, model: Model, merged: DataFrame) -> DataFrame:
    """The table ``_READ`` of the texts (doc_id, text, learn)."""
    rows, shared, plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "learn", F.col("text").cast("string")), model.shared, replace(model, shared=None)
    if shared is not None:

        def run(batches):
            for batch in batches:
                offsets, raw = text_buffers(batch.column(2))
                for lo, hi in chunks(offsets, CHUNK):
                    own, begin = tokens(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])
                    held, first, distinct, back = shared.value.read(own, begin)
                    yield _read_rows(plain, *(c[lo:hi] for c in batch.columns[:2]), begin, held, first, shared.value.count(distinct), back)

        return _kept(rows.mapInArrow(run, _READ), "lm-read")
    # Spark's reader takes up to 4096 rows at once, which of packs is all that a file holds
    packs = _kept(_packed(rows), "lm-packs", PACKS_PER_FILE)
    levels_ = _levels(packs, model, merged)

    def put(pack: pa.Table, read: pa.Table) -> pa.Table:
        ids, learn, texts = (pack.column(c).combine_chunks().flatten() for c in ("ids", "learn", "texts"))
        own, begin = pack_tokens(texts)
        read = read.sort_by([("kind", "ascending"), ("part", "ascending")])
        flat = np.frombuffer(b"".join(read.column("levels").to_pylist()), dtype=np.uint8)
        exact = np.frombuffer(b"".join(x for x in read.column("counts").to_pylist() if x is not None), dtype=np.int64)
        held, first, words, at = [], [], None, 0
        for n, grams in enumerate(ngrams(own, begin)):
            distinct, back = np.unique(_asked(grams, n), return_inverse=True)
            q = flat[at : at + len(distinct)][back]
            at += len(distinct)
            held.append(q[: len(own)])
            words = back[: len(own)] if words is None else words
            if n + 1 < ORDER:
                first.append(q[-1])
        return pa.Table.from_batches([_read_rows(plain, ids, learn, begin, held, first, exact, words)])

    return _kept(packs.groupBy("pack").cogroup(levels_.groupBy("pack")).applyInArrow(put, _READ), "lm-read")


def _tally(read: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The combinations of levels (of n-grams by order, then of contexts) that the tokens of ``_READ`` have, and how many tokens have each."""

    def run(batches):
        codes, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for held, before, *_ in _tokens_read(batch):
                code = np.zeros(len(held[0]), dtype=np.int64)
                for q in [*held, *before]:
                    code = (code << 8) | q
                found, n = np.unique(code, return_counts=True)
                codes, back = np.unique(np.concatenate((codes, found)), return_inverse=True)
                sums = np.bincount(back, np.concatenate((sums, n))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["code", "n"])

    held = [f"held{n}" for n in range(1, ORDER + 1)]
    rows = read.select(held).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    codes = np.array(sorted((r["code"], r["n"]) for r in rows), dtype=np.int64).reshape(-1, 2)
    return [(codes[:, 0] >> (8 * k)) & 255 for k in range(2 * ORDER - 2, -1, -1)], codes[:, 1]


def _weights(read: DataFrame, model: Model) -> None:
    """The best weight of each level of context counts, order after order, over all tokens of ``read`` with own occurrences left out."""
    found, times = _tally(read)
    held, before = found[:ORDER], found[ORDER:]
    for n in range(2, ORDER + 1):
        ratio, single = share(held[n - 1], before[n - 2], 1.0), model.probability(held, before, n - 1, 1.0)
        logs = np.log(_GRID * ratio[:, None] + (1 - _GRID) * single[:, None]) * times[:, None]
        total = np.zeros((_BINS, len(_GRID)))
        np.add.at(total, np.minimum(before[n - 2], _BINS - 1), logs)
        model.weights[n] = _GRID[total.argmax(axis=1)]
        model.weights[n, 0] = 0


def _parts(texts: DataFrame) -> int:
    """A number of hash ranges, a power of two, that follows the size of the texts."""
    size = texts.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return 1 << max(LEAST_RANGES.bit_length() - 1, (int(size) // RANGE_BYTES).bit_length())


def _counted(docs: DataFrame, filter_bytes: int, vocabulary: int) -> tuple[Model, DataFrame]:
    """The model of ``docs`` without weights, and the table of its counts.  Filters and words are in the model if within their bounds."""
    prepare(docs.sparkSession)
    parts = _parts(docs)
    merged = _kept(_merged(_count_blocks(docs, parts)), "lm-counts")
    sums = {r["kind"]: r for r in merged.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"), F.sum("size").alias("size")).collect()}
    one = sums.get(1)
    model = Model(one["total"] if one else 0, one["distinct"] if one else 0, parts=parts)
    if sum(r["size"] for r in sums.values()) <= filter_bytes and model.distinct <= vocabulary:
        _gather(merged, model)
        # what the executors get once; the driver needs the arrays no longer
        model.shared = docs.sparkSession.sparkContext.broadcast(replace(model))
        model.words = model.counts = model.filters = None
    return model, merged


def train(docs: DataFrame, filter_bytes: int = FILTER_BYTES, vocabulary: int = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model of ``docs`` (doc_id, text), and the table of its counts; all of them give counts and weights."""
    model, merged = _counted(docs, filter_bytes, vocabulary)
    _weights(_read(docs.withColumn("learn", F.lit(True)), model, merged), model)
    return model, merged


def score(docs: DataFrame, model: Model, merged: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    prepare(docs.sparkSession)
    return _scored(_read(docs.withColumn("learn", F.lit(False)), model, merged), model)


def train_and_score(docs: DataFrame, filter_bytes: int = FILTER_BYTES, vocabulary: int = VOCABULARY) -> DataFrame:
    """``score`` of all ``docs`` (doc_id, text, learn) by the model that ``train`` makes of those with ``learn``; each text is read once."""
    model, merged = _counted(docs.where("learn"), filter_bytes, vocabulary)
    read = _read(docs, model, merged)
    _weights(read.where("learn"), model)
    return _scored(read, model)


def _scored(read: DataFrame, model: Model) -> DataFrame:
    plain = replace(model, shared=None)

    def run(batches):
        for batch in batches:
            for held, before, begin, lo, hi in _tokens_read(batch):
                mixed = np.log10(np.maximum(plain.probability(held, before, ORDER), 1e-300))
                ids, known, base = (batch.column(c)[lo:hi] for c in ("doc_id", "n_known", "base_score"))
                columns = [ids, pa.array(np.diff(begin)), known, pa.array(np.full(hi - lo, plain.total, np.int64)), base, pa.array(np.add.reduceat(mixed, begin[:-1]))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROWS.split(", ")])

    return read.drop("learn").mapInArrow(run, _ROWS)
