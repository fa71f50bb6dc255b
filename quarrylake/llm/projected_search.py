"""Approximate nearest neighbours by 2-stable projections in a kd-tree.

Vectors are projected onto a few Gaussian directions. For a vector at distance d from
the query, the squared projected distance is d^2 times a chi-square variable, so a
neighbour within d is projected within d * sqrt(quantile) with the quantile's
probability. The search takes projected neighbours in growing distance from a kd-tree,
verifies them by their own vectors, and stops where the next projected distance exceeds
the quantile times the k-th distance found so far.

The upper levels of the tree are cells, fitted to a bounded sample and applied to every
row; a cell of more than CAPACITY rows is searched in shards. Points and queries of a
shard meet in one sorted stream: the points, CAPACITY or so, are held as a tree, and the
queries pass by. A query first visits its own cell, whose k-th distance then bounds what
it asks of all other shards; cells whose box lies beyond the test are not visited.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part. A shorter vector counts as continued by zeros. Equal vectors
are one point with the k + 1 smallest ids, which is exact: no query can return more of
them. Repeated rows count once; different vectors under one id are each other's own rows
and answer as one query each, told apart by nothing but their scores. Rows without an id
take no part. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.llm.common import stored

#: Directions; even, so that the chi-square distribution has a closed form.
DIRECTIONS = 12
#: Probability that a neighbour passes the stopping test.
PROBABILITY = 0.99
#: Rows that the cells are fitted to at most, and of these at least so many to a cell.
SAMPLE, TO_A_CELL = 16_384, 16
#: Points of a shard on average; it bounds a task's memory.
CAPACITY = 4_096
#: Points of a leaf of a shard's tree.
BUCKET = 128


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution with an even number m of degrees."""
    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(size: int, m: int, seed: int) -> np.ndarray:
    """A Gaussian direction a column; longer vectors have more rows, the first ones stay the same."""
    return np.random.default_rng(seed).standard_normal((size, m))


def matrix(column: pa.Array) -> np.ndarray:
    """A row for each list; shorter ones are continued by zeros."""
    offs = np.asarray(column.offsets)
    flat, n = np.asarray(column.flatten(), np.float64), np.diff(offs)
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), n[0])
    out = np.zeros((len(n), n.max(initial=0)))
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def widened(x: np.ndarray, size: int) -> np.ndarray:
    return x if x.shape[1] == size else np.pad(x, ((0, 0), (0, size - x.shape[1])))


def splits(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """(axis, limit) of each inner node of a balanced kd-tree in heap order, with `cells` leaves, a power of two."""
    out, parts = [], [sample]
    while len(parts) < cells:
        below = []
        for x in parts:
            axis = int(np.argmax(x.max(0) - x.min(0))) if len(x) else 0
            limit = float(np.median(x[:, axis])) if len(x) else 0.0
            out.append((axis, limit))
            left = x[:, axis] <= limit
            below += [x[left], x[~left]]
        parts = below
    return out


def cell_of(proj: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(proj), np.int64)
    axis, limit = np.array([t[0] for t in tree], np.int64), np.array([t[1] for t in tree])
    while tree and node[0] < len(tree):
        node = 2 * node + 1 + (proj[np.arange(len(proj)), axis[node]] > limit[node])
    return node - len(tree)


class Tree:
    """A kd-tree over the projections of a shard's points."""

    def __init__(self, vectors: np.ndarray, proj: np.ndarray, ids: list[np.ndarray]):
        self.vectors, self.ids, self.inner, self.leaf, self.lo, self.hi = vectors, ids, {}, {}, [], []
        self.counts = np.array([len(x) for x in ids])
        open_ = [np.arange(len(proj))]
        while open_:
            below = []
            for rows in open_:  # level by level; a node's number is its place in lo
                x, node = proj[rows], len(self.lo)
                lo, hi = x.min(0), x.max(0)
                self.lo.append(lo)
                self.hi.append(hi)
                axis = int(np.argmax(hi - lo))
                if len(rows) <= BUCKET or hi[axis] == lo[axis]:
                    self.leaf[node] = rows
                    continue
                half = len(rows) // 2
                order = np.argpartition(x[:, axis], half)
                self.inner[node] = len(below)
                below += [rows[order[:half]], rows[order[half:]]]
            start = len(self.lo)
            for node in [n for n in self.inner if n >= start - len(open_)]:
                self.inner[node] += start
            open_ = below
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def distance(self, node: slice, at: np.ndarray) -> np.ndarray:
        """Squared, from the boxes of the nodes."""
        gap = np.maximum(np.maximum(self.lo[node] - at, at - self.hi[node]), 0)
        return (gap * gap).sum(-1)

    def nearest(self, vector: np.ndarray, at: np.ndarray, own: int, k: int, quantile: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest found, of none beyond bound."""
        far, near_d, near_i = bound, np.empty(0), np.empty(0, np.int64)
        heap = [(float(self.distance(slice(0, 1), at)[0]), 0)]
        while heap:
            low, node = heapq.heappop(heap)
            if low > quantile * far * far:  # also true for every box that is left
                break
            if node in self.inner:
                first = self.inner[node]
                for child, d in enumerate(self.distance(slice(first, first + 2), at).tolist(), first):
                    heapq.heappush(heap, (d, child))
                continue
            rows = self.leaf[node]
            diff = self.vectors[rows] - vector
            d = np.sqrt((diff * diff).sum(1))
            close = d <= far
            if not close.any():
                continue
            rows, d = rows[close], d[close]
            ids = np.concatenate([self.ids[r] for r in rows])
            d = np.repeat(d, self.counts[rows])
            other = ids != own
            near_d, near_i = np.concatenate((near_d, d[other])), np.concatenate((near_i, ids[other]))
            best = np.lexsort((near_i, near_d))[:k]
            near_d, near_i = near_d[best], near_i[best]
            if len(near_d) == k:
                far = min(far, float(near_d[-1]))
        return near_d, near_i


def _projected(rows: DataFrame, m: int, seed: int) -> DataFrame:
    def project(batches):
        base = np.empty((0, m))
        for b in batches:
            x = matrix(b.column("v"))
            if x.shape[1] > len(base):
                base = directions(x.shape[1], m, seed)
            p = x @ base[:x.shape[1]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), m).cast(pa.list_(pa.float64()))], [*b.schema.names, "p"])

    return rows.mapInArrow(project, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, p array<double>")


def _in_cells(rows: DataFrame, tree: list[tuple[int, float]]) -> DataFrame:
    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(matrix(b.column("p")), tree))], [*b.schema.names, "cell"])

    return rows.mapInArrow(place, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, cell long")


def _visits(queries: DataFrame, boxes: list[tuple], quantile: float, home: bool) -> DataFrame:
    """(query_id, v, p, bound, cell, shard): the shards that a query visits; home: the first one, else all others within its bound."""
    cells = np.array([b[0] for b in boxes])
    shards = np.array([b[1] for b in boxes])
    lo, hi = np.array([b[2] for b in boxes]), np.array([b[3] for b in boxes])

    def route(batches):
        for b in batches:
            p, far = matrix(b.column("p")), np.asarray(b.column("bound"), np.float64)
            for at in range(0, len(p), 1024):
                x = p[at:at + 1024, None]
                gap = np.maximum(np.maximum(lo - x, x - hi), 0)
                d = (gap * gap).sum(-1)
                first = d.argmin(1)
                if home:
                    q, c, s = np.arange(len(x)), first, np.zeros(len(x), np.int64)
                else:
                    q, c = np.nonzero(d <= quantile * far[at:at + 1024, None] ** 2)
                    n = shards[c]
                    s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    q, c = np.repeat(q, n), np.repeat(c, n)
                    other = (c != first[q]) | (s > 0)
                    q, c, s = q[other], c[other], s[other]
                taken = b.take(pa.array(q + at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells[c]), pa.array(s)], [*b.schema.names, "cell", "shard"])

    return queries.mapInArrow(route, "query_id long, h long, v array<double>, p array<double>, bound double, cell long, shard long")


def _searched(points: DataFrame, visits: DataFrame, k: int, quantile: float) -> DataFrame:
    """(query_id, h, vec_id, score): what each visit finds. A shard's points come first in its stream, its queries follow."""
    a = points.select("cell", "shard", F.lit(None).cast("long").alias("query_id"), "h", "v", "p", "ids", F.lit(None).cast("double").alias("bound"))
    b = visits.select("cell", "shard", "query_id", "h", "v", "p", F.lit(None).cast("array<long>").alias("ids"), "bound")
    met = a.union(b).repartition("cell", "shard").sortWithinPartitions("cell", "shard", F.col("query_id").asc_nulls_first())

    def search(batches):
        held, parts, tree = None, [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column("cell")), np.asarray(b.column("shard"))], 1)
            point = np.asarray(b.column("query_id").is_null())
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1) | (np.diff(point.astype(np.int8)) != 0)) + 1
            found = [[], [], [], []]
            for s, e in zip([0, *edges], [*edges, b.num_rows]):
                part, key = b.slice(s, e - s), tuple(keys[s])
                if key != held:
                    held, parts, tree = key, [], None
                if point[s]:
                    parts.append((matrix(part.column("v")), matrix(part.column("p")), np.split(np.asarray(part.column("ids").flatten()), np.cumsum(np.diff(np.asarray(part.column("ids").offsets)))[:-1])))
                    continue
                v, p = matrix(part.column("v")), matrix(part.column("p"))
                if tree is None and parts:
                    size = max(x[0].shape[1] for x in parts)
                    tree = Tree(np.concatenate([widened(x[0], size) for x in parts]), np.concatenate([x[1] for x in parts]), [i for x in parts for i in x[2]])
                    parts = []
                if tree is None:
                    continue
                size = max(v.shape[1], tree.vectors.shape[1])
                tree.vectors, v = widened(tree.vectors, size), widened(v, size)
                for x, at, own, h, far in zip(v, p, part.column("query_id").to_pylist(), part.column("h").to_pylist(), part.column("bound").to_pylist()):
                    d, i = tree.nearest(x, at, own, k, quantile, far)
                    for out, y in zip(found, (np.full(len(d), own), np.full(len(d), h), i, d)):
                        out.append(y)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["query_id", "h", "vec_id", "score"])

    return met.mapInArrow(search, "query_id long, h long, vec_id long, score double")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, h, v): each different row that takes part; v: array<double>, h: its hash."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("h", F.xxhash64("v")).groupBy("vec_id", "h", "v").agg(F.lit(1).alias("one")).drop("one")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, m: int = DIRECTIONS, probability: float = PROBABILITY, seed: int = 11, capacity: int = CAPACITY) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found. vectors and queries: (vec_id, embedding); a query's own id is no candidate."""
    quantile = chi_square_quantile(probability, m)
    first = F.row_number().over(W.partitionBy("h", "v").orderBy("vec_id"))
    points = usable(vectors).withColumn("_n", first).where(F.col("_n") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stored(_projected(points, m, seed))
    asked = stored(_projected(usable(queries), m, seed).select(F.col("vec_id").alias("query_id"), "h", "v", "p"))
    n = points.count()
    sample = np.array([r.p for r in points.select("h", "p").orderBy("h", "p").limit(SAMPLE).collect()]).reshape(-1, m)
    cells = 1
    while cells * capacity < n and 2 * cells * TO_A_CELL <= len(sample):
        cells *= 2
    placed = _in_cells(points, splits(sample, cells))
    # a row a cell, of which there are SAMPLE / TO_A_CELL at most
    edge = [f(F.col("p")[i]) for f in (F.min, F.max) for i in range(m)]
    boxes = [(r[0], -(-r[1] // capacity), r[2:2 + m], r[2 + m:]) for r in _in_cells(points.select("p"), splits(sample, cells)).groupBy("cell").agg(F.count("*"), *edge).collect()]
    if not boxes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.broadcast(vectors.sparkSession.createDataFrame([b[:2] for b in boxes], "cell long, shards long"))
    placed = stored(placed.join(shards, "cell").withColumn("shard", F.pmod(F.xxhash64("h"), "shards")).drop("shards"))
    near = stored(_searched(placed, _visits(asked.withColumn("bound", F.lit(float("inf"))), boxes, quantile, True), k, quantile))
    far = near.groupBy("query_id", "h").agg(F.when(F.count("*") >= k, F.max("score")).alias("bound"))
    rest = asked.join(far, ["query_id", "h"], "left").select("query_id", "h", "v", "p", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = near.union(_searched(placed, _visits(rest, boxes, quantile, False), k, quantile))
    rank = F.row_number().over(W.partitionBy("query_id", "h").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
