"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.storage import small_enough


#: Edges up to which one task joins them; beyond, the distributed algorithm does, with the same result.
ONE_TASK = 200_000


def _united(batches):
    """(node, component) of all edges of one task, by union-find."""
    import pyarrow as pa

    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a != b:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([root(x) for x in parent], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], rounds: int = 200, one_task: int | None = None) -> DataFrame:
    """(node, component) for edges (a, b): component is the least node that links reach; isolated nodes do not appear.

    Few edges are joined in one task. Otherwise alternates large-star and small-star steps, which need a number of rounds that grows with the logarithm of the
    graph (not settled after so many, it raises); minima are taken partially before each shuffle, so a node with very many links is no bottleneck.
    cut materialises an intermediate table (a checkpoint, or a table in shared storage).
    """
    if small_enough(edges, ONE_TASK if one_task is None else one_task):
        kind = dict(edges.dtypes)["a"]
        return cut(edges.select("a", "b").repartition(1).mapInArrow(_united, f"node {kind}, component {kind}"))
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
