"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X


#: Edges for which there is one task.
TASK_EDGES = 100_000


def _star(edges: DataFrame, small: bool, tasks: int) -> DataFrame:
    """Joins neighbours of each node to its least neighbour: the greater ones (large star) or the lesser ones (small star)."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    own = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) if small else edges.unionByName(turned)
    least = own.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    met = own.join(least, own.a == least.node).coalesce(tasks)
    if small:
        out = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    else:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct().coalesce(tasks)


def _contract(batches):
    """A task's edges as stars: each node of it joined to the least that it reaches over them."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in up if (r := root(x)) != x]
    for i in range(0, len(pairs), 1 << 16):
        part = pairs[i : i + (1 << 16)]
        yield pa.record_batch({"a": pa.array([a for a, _ in part], pa.int64()), "b": pa.array([b for _, b in part], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """For undirected edges (a, b), rows (node, component): the least node that each can reach. Nodes without edges are absent.

    Each task first makes stars of its own edges, at most some TASK_EDGES: where one task holds all, that is the result.
    Otherwise star steps join the tasks' stars, until nothing changes. Every round is written to the shared folder, so
    lineage stays short; nodes with many edges meet only in joins that adaptive execution can split and in aggregates that
    combine before the shuffle.
    """
    now, mark = edges.select("a", "b").where("a <> b"), None
    n = now.count()
    while n:
        tasks = -(-n // TASK_EDGES)
        now = X.cut(now.coalesce(tasks).mapInArrow(_contract, "a long, b long"))
        if tasks == 1:
            break
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if seen == mark:
            break
        mark, n = seen, seen[0]
        now = X.cut(_star(_star(now, False, tasks), True, tasks))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
