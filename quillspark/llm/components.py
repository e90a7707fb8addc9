"""Connected components of a link table.

Up to ``ONE_TASK_LINKS`` links, counted first, go through a union-find in one
executor task; beyond that, alternating large and small stars over DataFrames.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep


#: 16 bytes each, some 150 MB as a dict of parents at most.
ONE_TASK_LINKS = 1_000_000


def _union_find(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(links: DataFrame, one_task: int | None = None) -> DataFrame:
    """``links`` has long columns ``a`` and ``b``; returns ``node``, ``component`` for every node with a link.

    ``component`` is the smallest node reachable.  Nodes and links never reach the
    driver; each round is written to the shared folder.  A very frequent node
    is a skewed join key only, which adaptive execution splits, since its row on
    the other side is one minimum.  Null ends and self links are ignored; an empty
    table gives an empty one.
    """
    if one_task is None:
        one_task = ONE_TASK_LINKS
    links = links.where("a <> b")
    if links.count() <= one_task:
        return links.select("a", "b").coalesce(1).mapInArrow(_union_find, "node long, component long")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = keep(edges, "edges")
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = keep(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _digest(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
