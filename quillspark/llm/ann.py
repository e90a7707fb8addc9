"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner products become angles by one more coordinate, sqrt(M^2 - |x|^2), where M is
the largest norm: every vector then lies on one sphere, a query (0 there, scaled
to M) too, and a larger inner product is a smaller distance.

Centroids are directions on that sphere, about sqrt(n) of them, from a two-level
k-means on a bounded sample: coarse clusters first, each then split in proportion
to its share.  Every centroid has a price that rises while its list is too full,
so lists are balanced.  A vector is posted to its nearest list and to those next
to it whose distance is within ``CLOSURE`` of the nearest one's, if they lie in
other directions (nearer to the vector than to any list taken before).

A query walks a neighbour graph of the centroids, nearest first, and takes the
lists whose distance is within a ratio of the nearest one's.  The ratio is
measured on vectors of the sample that no centroid was fitted on.  Lists are taken
beyond the ratio only while those taken can't hold enough vectors.

Lists are cut into blocks and meet the queries' probes by (list, block), so a
large list is many tasks.  Equal vectors are indexed by their smallest ids only,
as many as a result can hold, which loses no result; equal queries are searched
once.  The sample's vectors in a query's own lists bound its results from below,
so blocks send few candidates.  Scores are inner products of the original vectors
in double precision.

Defined results: vectors that are null, zero, hold nulls or non-finite numbers,
or have not the most frequent length (of ``vectors``, the longer on a tie) take
no part, nor do null ids, among vectors and queries alike; ties go to the smaller
id; with fewer candidates than wanted, all are returned; an empty table gives no
rows; repeated rows of an id are one vector each, and the own id is never
returned.  Columns other than id and x are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, partitions_for, prepare

#: Bounds of the sample that centroids and the ratio are fitted on: vectors a list, and bytes in all.
SAMPLE_A_LIST, SAMPLE_BYTES = 40, 128 << 20
MOST_LISTS = 16_384
REPLICAS, CLOSURE = 4, 1.1
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000
#: Share of the true neighbours, among vectors not fitted on, that the ratio has to find.
COVER = 0.965
_DEGREE, _ENTRIES, _FLOOR, _TRIALS = 16, 4, 8_000, 400


def usable(vectors: DataFrame, length: int | None = None) -> tuple[DataFrame, int | None]:
    """id and x (array of double) of the vectors that take part, and their length; ``length``: the one wanted."""
    x = F.col("x")
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).where("id is not null and x is not null and size(x) > 0")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = rows.where(~odd & F.exists(x, lambda v: v != 0)).withColumn("x", F.transform(x, lambda v: v + F.lit(0.0)))
    if length is None:
        first = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
        length = first[0]["n"] if first else None
    return (rows.where(F.size("x") == length) if length else rows), length


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _gap(cosine: np.ndarray) -> np.ndarray:
    """Distance on the unit sphere."""
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


@dataclass
class PostingIndex:
    """Centroids with prices, their neighbour graph, the pruning ratio, and sample vectors with the lists they are in."""

    largest: float
    centroids: np.ndarray
    prices: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    ratio: float = np.inf
    sample: np.ndarray | None = None
    posted: np.ndarray | None = None
    sizes: np.ndarray | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors as points of the unit sphere."""
        return (np.hstack([x, np.sqrt(np.maximum(0, self.largest - (x * x).sum(axis=1)))[:, None]]) / np.sqrt(self.largest)).astype(np.float32)

    @staticmethod
    def aim(q: np.ndarray) -> np.ndarray:
        """Queries as points of the unit sphere."""
        return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))]).astype(np.float32)

    def post(self, x: np.ndarray) -> np.ndarray:
        """Lists of each vector (n, REPLICAS), the nearest first; -1 where there are fewer."""
        k = len(self.centroids)
        out = np.full((len(x), REPLICAS), -1, dtype=np.int64)
        for lo in range(0, len(x), 2048):
            cosine = self.lift(x[lo : lo + 2048]) @ self.centroids.T
            worth = cosine - self.prices
            wide = min(k, 2 * REPLICAS)
            near = np.argpartition(-worth, wide - 1, axis=1)[:, :wide]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(worth, near, 1), axis=1, kind="stable"), 1)
            d = _gap(np.take_along_axis(cosine, near, 1))
            apart = _gap(np.einsum("nid,njd->nij", self.centroids[near], self.centroids[near]))
            taken = d <= CLOSURE * d[:, :1]
            taken[:, 0] = True
            for j in range(1, wide):
                taken[:, j] &= taken[:, :j].sum(axis=1) < REPLICAS
                taken[:, j] &= (~taken[:, :j] | (apart[:, j, :j] > d[:, j, None])).all(axis=1)
            row, col = np.nonzero(taken)
            out[lo + row, (np.cumsum(taken, axis=1) - 1)[row, col]] = near[row, col]
        return out

    def probe(self, aimed: np.ndarray, rows: int) -> np.ndarray:
        """Lists of one query: the graph is walked nearest first, and ends beyond the ratio once the lists hold ``rows``."""
        seen = np.zeros(len(self.centroids), dtype=bool)
        seen[self.entries] = True
        heap = list(zip(_gap(self.centroids[self.entries] @ aimed).tolist(), self.entries.tolist()))
        heapq.heapify(heap)
        best, at, far, held, spare = np.inf, [], [], 0, 0
        while heap:
            d, i = heapq.heappop(heap)
            best = min(best, d)
            if d > self.ratio * best and held >= rows:
                spare += 1
                if spare > _DEGREE:
                    break
            at.append(i)
            far.append(d)
            held += self.sizes[i]
            new = np.unique(self.graph[i][~seen[self.graph[i]]])
            seen[new] = True
            for e, j in zip(_gap(self.centroids[new] @ aimed).tolist(), new.tolist()):
                heapq.heappush(heap, (e, j))
        order = np.argsort(far, kind="stable")
        at, far = np.array(at)[order], np.array(far)[order]
        if held < rows:
            rest = np.setdiff1d(np.arange(len(self.centroids)), at)
            at, far = np.concatenate((at, rest[np.argsort(-(self.centroids[rest] @ aimed), kind="stable")])), np.append(far, np.full(len(rest), np.inf))
        before = np.concatenate(([0], np.cumsum(self.sizes[at])[:-1]))
        return at[(far <= self.ratio * best) | (before < rows)]

    def floor(self, q: np.ndarray, lists: list[np.ndarray], wanted: int) -> np.ndarray:
        """A lower bound of each query's ``wanted``-th best score, from the sample's vectors in the query's own lists."""
        out = np.full(len(q), -np.inf)
        if len(self.sample) < wanted:
            return out
        for lo in range(0, len(q), 128):
            mine = np.zeros((len(q[lo : lo + 128]), len(self.centroids) + 1), dtype=bool)
            for i, own in enumerate(lists[lo : lo + 128]):
                mine[i, own] = True
            held = np.zeros((len(mine), len(self.sample)), dtype=bool)
            for column in self.posted.T:
                held |= mine[:, column]
            s = np.where(held, q[lo : lo + 128] @ self.sample.T, -np.inf)
            s = np.partition(s, len(self.sample) - wanted, axis=1)[:, len(self.sample) - wanted]
            out[lo : lo + 128] = np.where(np.isfinite(s), s - 1e-9 * (1 + np.abs(s)), -np.inf)
        return out


def _spherical(points: np.ndarray, k: int, g: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """``k`` directions; an empty one starts again at a point of the fullest."""
    c = points[g.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        owner = np.concatenate([(points[lo : lo + 65_536] @ c.T).argmax(axis=1) for lo in range(0, len(points), 65_536)])
        fill = np.bincount(owner, minlength=k)
        order = np.argsort(owner, kind="stable")
        live = np.flatnonzero(fill)
        c[live] = np.add.reduceat(points[order], (np.cumsum(fill) - fill)[live], axis=0)
        for dead in np.flatnonzero(fill == 0):
            c[dead] = points[g.choice(np.flatnonzero(owner == fill.argmax()))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _centroids(points: np.ndarray, k: int, g: np.random.Generator) -> np.ndarray:
    """Two levels: about sqrt(k) coarse clusters, each split by its share of the points."""
    coarse = _spherical(points, max(1, round(k**0.5)), g)
    owner = np.concatenate([(points[lo : lo + 65_536] @ coarse.T).argmax(axis=1) for lo in range(0, len(points), 65_536)])
    fill = np.bincount(owner, minlength=len(coarse))
    share = np.maximum(1, np.round(k * fill / len(points)).astype(int)) * (fill > 0)
    return np.concatenate([_spherical(points[owner == i], min(n, fill[i]), g) for i, n in enumerate(share) if n])


def _prices(points: np.ndarray, c: np.ndarray, rounds: int = 40) -> np.ndarray:
    """What has to be taken off each centroid's cosine so that lists are about equally full."""
    points = points[: max(len(points) // 8, min(len(points), (1 << 28) // max(1, 4 * len(c))))]
    prices, step = np.zeros(len(c), dtype=np.float32), 0.04
    for _ in range(rounds if len(c) > 1 else 0):
        fill = np.zeros(len(c))
        for lo in range(0, len(points), 8192):
            fill += np.bincount((points[lo : lo + 8192] @ c.T - prices).argmax(axis=1), minlength=len(c))
        prices += (step * np.clip(fill / fill.mean() - 1, -1, 1)).astype(np.float32)
        prices -= prices.mean()
        step *= 0.93
    return prices


def fit(sample: np.ndarray, n: int, largest: float, wanted: int, lists: int, seed: int = 3) -> PostingIndex:
    """An index of about ``lists`` lists for ``n`` vectors; three quarters of the sample make centroids, the rest the ratio."""
    g = np.random.default_rng(seed)
    sample = sample[g.permutation(len(sample))]
    index = PostingIndex(largest, np.zeros((1, sample.shape[1] + 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 0), np.int64), np.zeros(1, np.int64))
    fitted, apart = np.split(sample, [max(1, 3 * len(sample) // 4)])
    points = index.lift(fitted)
    index.centroids = c = _centroids(points, max(1, min(lists, len(points) // 4)), g).astype(np.float32)
    k = len(c)
    index.prices = _prices(points, c)
    near = np.concatenate([np.argsort(-(c[lo : lo + 512] @ c.T), axis=1)[:, 1 : _DEGREE + 1] for lo in range(0, k, 512)])
    index.graph = np.hstack([near, g.integers(0, k, (k, 4))]) if k > 1 else near
    index.entries = np.unique(g.permutation(k)[:_ENTRIES])
    index.sample = sample[:_FLOOR]
    index.posted = index.post(index.sample)
    if len(apart) < 2:
        return index
    # a query's own nearest list is nearer if it was fitted on, so as many of the trials were as of all vectors; neighbours
    # are those of a rank that a sample of this rate would hold of the ones wanted
    seen = min(_TRIALS, len(fitted), round(_TRIALS * len(fitted) / n))
    queries = np.concatenate((apart[: max(1, _TRIALS - seen)], fitted[:seen]))
    first, rank = min(len(apart), max(1, _TRIALS - seen)), min(len(apart) - 1, max(1, round(wanted * len(apart) / n)))
    posted = index.post(apart)
    far = np.hstack([_gap(index.aim(queries) @ c.T), np.full((len(queries), 1), np.inf)])
    far /= far.min(axis=1, keepdims=True)
    scores = queries @ apart.T
    scores[np.arange(first), np.arange(first)] = -np.inf
    true = np.argpartition(-scores, rank - 1, axis=1)[:, :rank]
    index.ratio = float(np.quantile(far[np.arange(len(queries))[:, None, None], posted[true]].min(axis=2), COVER)) + 1e-6
    return index


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), id, score: the ``k`` best found of ``vectors`` (id, x) for each of ``queries`` (id, x), never its own id."""
    spark = prepare(vectors.sparkSession)
    rows, length = usable(vectors)
    own = Window.partitionBy("x").orderBy("id")
    base = keep(rows.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1).drop("r"), "vectors")
    asked = keep(usable(queries, length)[0], "queries") if length else None
    total, largest = base.agg(F.count(F.lit(1)), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    lists = max(1, min(MOST_LISTS, round(total**0.5)))
    size = min(SAMPLE_A_LIST * lists, SAMPLE_BYTES // (8 * length))
    rate = int(1e6 * min(1, size / total)) + 1
    chosen = base.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < rate).select("id", "x").orderBy("id").toArrow()
    if not chosen.num_rows:
        chosen = base.orderBy("id").limit(1).select("id", "x").toArrow()
    index = fit(_matrix(chosen.column("x")), total, largest, k, lists)
    enough = REPLICAS * (k + 1)

    def post(batches):
        for batch in batches:
            lists = index.post(_matrix(batch.column(1)))
            row, col = np.nonzero(lists >= 0)
            part = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(lists[row, col]), batch.column(0).take(part), batch.column(1).take(part)], names=["list", "id", "x"])

    postings = keep(base.mapInArrow(post, "list long, id long, x array<double>"), "postings")
    counted = postings.groupBy("list").count().collect()  # a row for each list, at most MOST_LISTS
    index.sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for r in counted:
        index.sizes[r["list"]] = r["count"]

    def probe(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            aimed = index.aim(x)
            lists = [index.probe(q, enough) for q in aimed]
            floors = index.floor(x, lists, k + 1)
            part = pa.array(np.repeat(np.arange(len(lists)), [len(p) for p in lists]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64), pa.int64()), batch.column(0).take(part), batch.column(1).take(part), pa.array(floors).take(part)], names=["list", "id", "x", "floor"])

    distinct = keep(asked.groupBy("x").agg(F.min("id").alias("id")), "distinct-queries")
    spread = distinct.repartition(partitions_for(spark, 8 * length * distinct.count(), 1 << 20), "id")
    probes = keep(spread.select("id", "x").mapInArrow(probe, "list long, id long, x array<double>, floor double"), "probes")
    sizes = postings.groupBy("list").agg(F.ceil(F.count("id") / BLOCK_ROWS).alias("blocks"))
    dealt = F.broadcast(sizes.join(probes.groupBy("list").agg(F.ceil(F.count("id") / BLOCK_QUERIES).alias("askers")), "list"))
    left = postings.join(dealt, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1)).alias("asker"), "id", "x")
    right = probes.join(dealt, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("askers")).alias("asker"), "id", "x", "floor")

    def meet(rows: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and asking.num_rows:
            x, ids = _matrix(rows.column("x")), rows.column("id").to_numpy()
            q, own_ids, floors = _matrix(asking.column("x")), asking.column("id").to_numpy(), asking.column("floor").to_numpy()
            for lo in range(0, len(q), 128):
                s, least = q[lo : lo + 128] @ x.T, floors[lo : lo + 128]
                if len(x) > k + 1:
                    top = np.partition(s, len(x) - k - 1, axis=1)[:, len(x) - k - 1]
                    least = np.maximum(least, top - 1e-9 * (1 + np.abs(top)))
                a, b = np.nonzero(s >= least[:, None])
                for column, value in zip(found, (own_ids[lo + a], ids[b], (q[lo + a] * x[b]).sum(axis=1))):
                    column.append(value)
        q_, i_, s_ = (np.concatenate(c) if c else np.zeros(0) for c in found)
        return pa.table({"query": pa.array(q_.astype(np.int64)), "id": pa.array(i_.astype(np.int64)), "score": pa.array(s_.astype(np.float64))})

    met = left.groupBy("list", "block", "asker").cogroup(right.groupBy("list", "block", "asker")).applyInArrow(meet, "query long, id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = met.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    names = asked.select(F.col("id").alias("query_id"), "x").distinct().join(distinct.select(F.col("id").alias("query"), "x"), "x").select("query_id", "query")
    mine = top.join(names, "query").where("id <> query_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return mine.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")
