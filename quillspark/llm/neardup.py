"""Near-duplicate groups by an LSH forest over MinHash signatures.

Each text's distinct word shingles give one signature.  The forest is several
sorted orders of the signatures: in each order the slots are permuted and the
rows are range-partitioned and sorted, so texts with a long common prefix stand
together.  Regions are the runs that share ``min_depth`` slots; where a run is
longer than ``region`` rows its depth grows until it is not, so crowded parts of
the forest are compared at a deeper prefix than sparse ones.  Runs of wholly
equal signatures are walked in overlapping windows.

Inside a region, texts whose signatures agree enough are candidates.  Not all
pairs are needed for groups: each text first offers its best few candidates, and
those are confirmed on full shingle sets.  Regions in which more was to be offered
and which still hold several groups are then taken whole: every pair of texts of
different groups there is compared on full sets (bounded by ``region`` rows), and
one link is kept of a text to each other group.  Last, offers beyond a text's best
few over all orders are confirmed wherever the two are still in different groups.
So no candidate is dropped, and a large group of copies gives a few pairs per
text, not all pairs.

Defined results: null and empty texts have an empty set and are linked with
nothing; texts with fewer words than a shingle have one shingle, the whole
sequence; equal sets are one class and cost no pairs; rows with a null id are
returned with a null component and are never dropped; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import chunks, mix64, shingle_set, text_buffers, word_hashes
from .shared import keep, partitions_for, prepare, small, without

#: Candidates that each text offers first.
OFFER = 2
#: Sets of more shingles don't travel with their regions; their pairs are confirmed on texts.
LARGE_SET = 20_000


@dataclass(frozen=True)
class Forest:
    """Parameters.  With 32 orders of depth 5, a pair at similarity 0.8 is missed with probability 3e-6, at 0.85 with 7e-9."""

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    slots: int = 64
    orders: int = 32
    min_depth: int = 5
    region: int = 384
    detail: int = 512
    seed: int = 11

    @property
    def least_equal(self) -> int:
        """Equal slots from which a pair is a candidate: 4.5 standard errors below the threshold."""
        t = self.numerator / self.denominator
        return max(1, int(self.slots * (t - 4.5 * (t * (1 - t) / self.slots) ** 0.5)))

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        g = np.random.Generator(np.random.PCG64(self.seed))
        return g.integers(0, 2**32, self.slots, dtype=np.uint32) | np.uint32(1), g.integers(0, 2**32, self.slots, dtype=np.uint32)

    def permutations(self) -> np.ndarray:
        g = np.random.Generator(np.random.PCG64(self.seed + 1))
        return np.stack([g.permutation(self.slots) for _ in range(self.orders)])


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Low bytes of the minima of ``len(mult)`` hashes; long sets are taken in blocks."""
    low = shingles.astype(np.uint32)
    best = np.full(len(mult), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(best, (low[at : at + 2048, None] * mult + add).min(axis=0), out=best)
    return ((best >> np.uint32(3)) & np.uint32(255)).astype(np.uint8)


def sketch(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set; null if empty), sig."""

    def run(batches):
        mult, add = forest.multipliers()
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            n = len(offsets) - 1
            counts, keys, sigs = np.zeros(n, dtype=np.int64), [None] * n, [None] * n
            for lo, hi in chunks(offsets):
                words, rows = word_hashes(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])
                for i in range(hi - lo):
                    s = shingle_set(words[rows[i] : rows[i + 1]], forest.words)
                    counts[lo + i] = len(s)
                    if len(s):
                        m = mix64(s)
                        keys[lo + i] = np.array([m.sum(), mix64(m).sum()], dtype=np.uint64).tobytes()
                        sigs[lo + i] = signature(s, mult, add).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _orders(classes: DataFrame, forest: Forest) -> DataFrame:
    def run(batches):
        perms = forest.permutations()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, forest.slots)
            ids = batch.column(0)
            for t, perm in enumerate(perms):
                flat = np.ascontiguousarray(sig[:, perm])
                key = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * forest.slots, forest.slots, dtype=np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, dtype=np.int32)), key, ids], names=["tree", "key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "tree int, key binary, id long")


def _regions(shared: np.ndarray, forest: Forest):
    """Row ranges [lo, hi) of regions; ``shared[i]`` is the common prefix of rows i - 1 and i."""
    n = len(shared)
    cuts = np.append(np.flatnonzero(shared < forest.min_depth), n)
    todo = [(int(a), int(b), forest.min_depth) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= forest.region:
            yield lo, hi
        elif depth >= forest.slots:
            step = forest.region // 2
            for at in range(lo, hi - step, step):
                yield at, min(at + forest.region, hi)
        else:
            inner = np.concatenate(([lo], lo + 1 + np.flatnonzero(shared[lo + 1 : hi] <= depth), [hi]))
            todo += [(int(a), int(b), depth + 1) for a, b in zip(inner[:-1], inner[1:]) if b - a > 1]


def _partners(sig: np.ndarray, ids: np.ndarray, least: int, limit: int):
    """Directed candidates of one region: (from, to, equal slots), the best ``limit`` for each row; and whether any were left over."""
    equal = (sig[:, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.int32)
    ok = (equal >= least) & (ids[:, None] != ids[None, :])
    a, b = np.nonzero(ok)
    order = np.lexsort((ids[b], -equal[a, b], a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep_ = rank < limit
    return ids[a[keep_]], ids[b[keep_]], equal[a, b][keep_], not keep_.all()


_OFFERS = "kind int, a long, b long, equal int"


def _walk(orders: DataFrame, forest: Forest) -> DataFrame:
    """First offers (kind 0), and the rows of regions that have more to offer (kind 1: a is the id, b the region)."""

    def run(batches):
        trees, keys, ids = [], [], []
        for batch in batches:
            if batch.num_rows:
                trees.append(batch.column(0).to_numpy(zero_copy_only=False))
                keys.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, forest.slots))
                ids.append(batch.column(2).to_numpy(zero_copy_only=False))
        if not ids:
            return
        tree, sig, node = np.concatenate(trees), np.concatenate(keys), np.concatenate(ids)
        differ = sig[1:] != sig[:-1]
        prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), forest.slots)
        prefix[tree[1:] != tree[:-1]] = -1
        shared = np.concatenate(([-1], prefix))
        out: list[list] = [[], [], [], []]
        held = 0

        def flush():
            nonlocal out, held
            kinds, a, b, e = out
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds), pa.int32()), pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(e), pa.int32())], names=["kind", "a", "b", "equal"])
            out, held = [[], [], [], []], 0
            return batch

        for lo, hi in _regions(shared, forest):
            a, b, e, more = _partners(sig[lo:hi], node[lo:hi], forest.least_equal, OFFER)
            for k, x in enumerate((np.zeros(len(a), np.int32), a, b, e)):
                out[k].append(x)
            held += len(a)
            if more:
                n = hi - lo
                name = int(mix64(np.frombuffer(sig[lo].tobytes()[:8], dtype=np.uint64) + np.uint64(tree[lo] * 1_000_003 + n) + node[lo : lo + 1].astype(np.uint64))[0].astype(np.int64))
                for k, x in enumerate((np.ones(n, np.int32), node[lo:hi], np.full(n, name, np.int64), np.zeros(n, np.int32))):
                    out[k].append(x)
                held += n
            if held > 50_000:
                yield flush()
        if held:
            yield flush()

    return orders.mapInArrow(run, _OFFERS)


def _detail(docs: DataFrame, ids: DataFrame, forest: Forest) -> DataFrame:
    """Of the texts in crowded regions: a, longer signature, and the full set unless it is very large."""

    def run(batches):
        mult, add = forest.multipliers()
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets):
                words, rows = word_hashes(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])
                sets = [shingle_set(words[rows[i] : rows[i + 1]], forest.words) for i in range(hi - lo)]
                ok = np.array([len(x) > 0 for x in sets])
                sets = [x for x in sets if len(x)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].filter(pa.array(ok)), pa.array([signature(x, mult, add).tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() if len(x) <= LARGE_SET else None for x in sets], pa.binary())], names=["a", "sig", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(small(ids.distinct()), "doc_id", "left_semi")
    return texts.mapInArrow(run, "a long, sig binary, shingles binary").dropDuplicates(["a"])


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: shingles of at least two sets, some thousands at a time, as one matrix product each."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.concatenate(([0], np.cumsum(flat[1:] != flat[:-1])))
    often = np.bincount(number)[number] > 1
    owner, number = owner[often], np.unique(number[often], return_inverse=True)[1]
    out, block = np.zeros((n, n), dtype=np.float32), 8192
    cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + 1 + block, block))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        held = np.zeros((n, block), dtype=np.float32)
        held[owner[lo:hi], number[lo:hi] - k * block] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _offers(crowded: DataFrame, detail: DataFrame, groups: DataFrame, forest: Forest) -> DataFrame:
    """Links between groups in the regions that hold more than one, confirmed on full sets (sure); pairs with a very large set are offers by signature.

    Of the links of one text to one other group, one is kept: they mean the same.
    """

    def run(t: pa.Table) -> pa.Table:
        ids, group = t.column("a").to_numpy(), t.column("component").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, forest.slots)
        sets = [np.frombuffer(x or b"", dtype=np.uint64) for x in t.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        apart = (group[:, None] != group[None, :]) & (ids[:, None] < ids[None, :])
        both = (size[:, None] > 0) & (size[None, :] > 0)
        common = common_shingles(sets) if (apart & both).any() else np.zeros((len(ids), len(ids)), dtype=np.int64)
        linked = apart & both & (forest.denominator * common >= forest.numerator * (size[:, None] + size[None, :] - common))
        a, b = np.nonzero(linked)
        _, first = np.unique(np.stack([a, group[b]]), axis=1, return_index=True)
        a, b = a[first], b[first]
        c, d = np.nonzero(apart & ~both)
        near = np.array([int((sig[i] == sig[j]).sum()) >= forest.least_equal for i, j in zip(c, d)], dtype=bool)
        c, d = c[near], d[near]
        return pa.table({"a": pa.array(ids[np.concatenate((a, c))], pa.int64()), "b": pa.array(ids[np.concatenate((b, d))], pa.int64()), "sure": pa.array(np.arange(len(a) + len(c)) < len(a))})

    named = small(groups.select(F.col("node").alias("a"), "component"))
    labelled = crowded.join(named, "a", "left").withColumn("component", F.coalesce("component", "a"))
    region = Window.partitionBy("b")
    mixed = labelled.withColumn("lo", F.min("component").over(region)).withColumn("hi", F.max("component").over(region)).where("lo < hi")
    return mixed.select("a", "b", "component").join(detail, "a").groupBy("b").applyInArrow(run, "a long, b long, sure boolean")


def _confirm(docs: DataFrame, pairs: DataFrame, forest: Forest) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, checked on whole texts.

    Each text is sent once for each of its pairs, and the two texts of a pair meet
    under the pair as key, so no key is frequent.
    """
    sides = small(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id")), 2)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(sides, "id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = texts.select("a", "b", "id", "text").repartition(n, "a", "b").sortWithinPartitions("a", "b", "id")

    def run(batches):
        pair, sets = None, {}

        def similar() -> bool:
            """Whether any set of the one id meets any of the other; an id has one, but for repeated ids."""
            for s in sets.get(0, ()):
                for t in sets.get(1, ()):
                    merged = np.sort(np.concatenate((s, t)))
                    common = int((merged[1:] == merged[:-1]).sum())
                    if forest.denominator * common >= forest.numerator * (len(s) + len(t) - common):
                        return True
            return False

        for batch in batches:
            good = []
            a, b, ids = (batch.column(k).to_pylist() for k in range(3))
            offsets, raw = text_buffers(batch.column(3))
            for lo, hi in chunks(offsets):
                words, rows = word_hashes(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])
                for i in range(lo, hi):
                    if pair != (a[i], b[i]):
                        if pair and similar():
                            good.append(pair)
                        pair, sets = (a[i], b[i]), {}
                    s = shingle_set(words[rows[i - lo] : rows[i - lo + 1]], forest.words)
                    if len(s):
                        sets.setdefault(int(ids[i] != a[i]), []).append(s)
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], names=["a", "b"])
        if pair and similar():
            yield pa.RecordBatch.from_arrays([pa.array([pair[0]], pa.int64()), pa.array([pair[1]], pa.int64())], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """``docs`` with one document of each group: the smallest id; repeated rows of an id become one row.

    Rows with a null id stay.  Columns, whatever their names, pass through.
    """
    found = keep(near_duplicates(docs, forest), "near-duplicates")
    rest = without(docs, found.where("not kept").select("doc_id"))
    again = keep(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return rest
    return without(rest, again).unionByName(rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id of its group), kept."""
    spark = prepare(docs.sparkSession)
    sketches = keep(sketch(docs, forest), "sketches")
    filled = sketches.where("set_key is not null and doc_id is not null")
    classes = keep(filled.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
    orders = _orders(classes, forest)
    n = partitions_for(spark, classes.count() * forest.orders * (forest.slots + 16))
    # by the prefix that every region shares, so no region is cut
    walked = keep(_walk(orders.repartition(n, "tree", F.substring("key", 1, forest.min_depth)).sortWithinPartitions("tree", "key", "id"), forest), "offers")
    offers, crowded = walked.where("kind = 0").select("a", "b", "equal"), keep(walked.where("kind = 1").select("a", "b"), "crowded")
    best = Window.partitionBy("a").orderBy(F.desc("equal"), "b")
    ranked = keep(offers.withColumn("rank", F.dense_rank().over(best)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rank").groupBy("a", "b").agg(F.min("rank").alias("rank")), "pairs")
    pairs, later = ranked.where(F.col("rank") <= OFFER).select("a", "b"), ranked.where(F.col("rank") > OFFER).select("a", "b")
    links = pairs if pairs.isEmpty() else keep(_confirm(docs, pairs, forest), "links")
    groups = keep(components(links), "groups")
    if not crowded.isEmpty():
        finer = replace(forest, slots=forest.detail)
        more = keep(_offers(crowded, _detail(docs, crowded.select(F.col("a").alias("doc_id")), finer), groups, finer), "more-links")
        sure, rest = more.where("sure").select("a", "b"), keep(more.where("not sure").select("a", "b").distinct(), "large-pairs")
        links = links.unionByName(sure if rest.isEmpty() else sure.unionByName(_confirm(docs, rest, forest)))
        links = keep(links.distinct(), "links")
        groups = keep(components(links), "groups")
    apart = keep(_apart(later, groups), "later-pairs")
    if not apart.isEmpty():
        links = links.unionByName(_confirm(docs, apart, forest))
        groups = keep(components(links.distinct()), "groups")
    return _labelled(sketches, classes, groups)


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are in different groups."""
    named = small(groups)
    for side in ("a", "b"):
        pairs = pairs.join(named.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _labelled(sketches: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    groups = small(groups)
    named = classes.join(groups, classes["id"] == groups["node"], "left").select("set_key", F.coalesce("component", "id").alias("component"))
    plain = sketches.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = sketches.where("set_key is not null and doc_id is not null").join(named, "set_key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return rest.unionByName(plain).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
