"""Epoch sampling, sharding and other ordered operators."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.functions.text import hash_offset
from quarrylake.operators.ordering import ordered_index, running_max
from quarrylake.operators.storage import cut


def epoch_sample(records: DataFrame, epoch: int, cap: int = 3, near_cap: int | None = None) -> DataFrame:
    """The records of one epoch: of each duplicate_group at most near_cap, from a start that moves on with the epoch,
    of each template_group in it at most cap; records: (case_id, duplicate_group, template_group, ...)."""
    near_cap = cap if near_cap is None else near_cap
    group = W.partitionBy("duplicate_group")
    r = records.withColumns({"_i": F.row_number().over(group.orderBy("case_id")) - 1, "_n": F.count("*").over(group)})
    limit = F.least("_n", F.lit(near_cap))
    r = r.withColumn("_at", F.pmod(F.col("_i") - F.lit(epoch) * limit, F.col("_n")))
    r = r.withColumn("_t", F.row_number().over(W.partitionBy("duplicate_group", "template_group").orderBy("_at"))).where(F.col("_t") <= cap)
    r = r.withColumn("_k", F.row_number().over(group.orderBy("_at")))
    # a group gives one record even at a cap of 0
    return r.where(F.col("_k") <= F.greatest(limit, F.lit(1))).drop("_i", "_n", "_at", "_t", "_k")


def annotation_index(case_id: Column, count: Column, seed: int, epoch: int) -> Column:
    return F.pmod(hash_offset(case_id) + seed + epoch, count)


def shard(rows: DataFrame, order: list, rank: int, world: int, drop_last: bool = False) -> DataFrame:
    """Every world-th row in order, from rank on; drop_last leaves out what does not fill all shards."""
    if not 0 <= rank < world:
        raise ValueError(f"shard {rank} of {world}")
    r = ordered_index(rows, order, "_i")
    if drop_last:
        n = r.count()
        r = r.where(F.col("_i") < n - n % world)
    return r.where(F.col("_i") % world == rank).drop("_i")


def permutation(n: int, seed: int) -> list[int]:
    """The seeded order of n places that the standard generator gives."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def permuted(index: Column, n: int, seed: int, rounds: int = 6) -> Column:
    """The place of index (0 to n - 1) in a seeded order of n, computed by itself: a keyed permutation.

    A Feistel network over a grid of a x b places, the least that holds n: each round moves one coordinate by a hash of the
    other. Places beyond n, fewer than a, are passed through it again until they fall below n.
    """
    a = max(1, math.isqrt(max(n, 1) - 1) + 1) if n > 1 else 1
    b = -(-max(n, 1) // a)

    def once(x: Column) -> Column:
        p, q = F.floor(x / b), x % b
        for k in range(rounds):
            if k % 2 == 0:
                p = F.pmod(p + hash_offset(F.concat(F.lit(f"{seed}:{k}:"), q.cast("string"))), F.lit(a))
            else:
                q = F.pmod(q + hash_offset(F.concat(F.lit(f"{seed}:{k}:"), p.cast("string"))), F.lit(b))
        return (p * b + q).cast("long")

    # a walk ends after a * b - n steps outside at most, and one of 40 among a > 40 has a chance below 40 ** -40
    steps = min(a * b - n, 40)
    at = once(index.cast("long"))
    if steps > 0:
        at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), at, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(at < n, at).otherwise(F.raise_error(F.lit("a walk of the permutation did not end")).cast("long"))


def shuffled(rows: DataFrame, order: list, seed: int, name: str = "place") -> DataFrame:
    """rows with name: their places (from 0) in a seeded order; order: columns that order the rows fully. Nothing passes through the driver."""
    indexed = ordered_index(rows, order, "_i")
    return indexed.withColumn(name, permuted(F.col("_i"), indexed.count(), seed)).drop("_i")


def derangement(records: DataFrame, order: str) -> DataFrame:
    """records with source: the case that follows in the cycle by the order column, never the case itself if there are two."""
    r = ordered_index(records, [order], "_i")
    n = max(r.count(), 1)
    before = r.select(F.pmod(F.col("_i") - 1, F.lit(n)).alias("_i"), F.col("case_id").alias("source"))
    return r.join(before, "_i").drop("_i")


def roll(rows: DataFrame, batch: str, order: str, value: str) -> DataFrame:
    """rows with rolled: the value of the row before in its batch, of the last row for the first."""
    w = W.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn("rolled", F.coalesce(F.lag(value).over(w), F.last(value).over(whole)))


def top_regions(regions: DataFrame, limit: int = 48, first: int = 11) -> DataFrame:
    """Of each case's regions the first limit: labels from first on by number, then the others."""
    return regions.withColumn("_k", F.row_number().over(W.partitionBy("case_id").orderBy(F.col("label") < first, "label"))).where(F.col("_k") <= limit).drop("_k")


def aligned_starts(size: Column, patch: Column, step: Column) -> Column:
    """Starts of windows of a patch's size in steps that cover size; the last may reach beyond it."""
    n = F.when(size <= patch, 1).otherwise(F.ceil((size - patch) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: (k * step).cast("int"))


def spread_count(size: Column, patch: Column, share: float) -> Column:
    return F.when(size <= patch, 1).otherwise(F.ceil((size - patch) / (patch * share)).cast("int") + 1)


def spread_start(k: Column, n: Column, last: Column) -> Column:
    """The k-th of n starts from 0 to last."""
    return F.when(n > 1, F.bround(last / (n - 1) * k)).otherwise(0).cast("int")


def spread_starts(size: Column, patch: Column, share: float) -> Column:
    """Starts of windows spread evenly from 0 to size - patch, no further apart than share of a patch."""
    n, last = spread_count(size, patch, share), F.greatest(size - patch, F.lit(0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: spread_start(k, n, last))


def moving_average(series: DataFrame, key: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """series with ema: keep * previous + (1 - keep) * value in order, the first value itself.

    Each series is cut into chunks. Within one the fold is a sum of values weighted by powers of keep, which a window
    adds up; a chunk passes on keep**n * (what it was given) + its own sum, folded over the chunks of a series.
    """
    chunk = max(1, int(200 / -math.log10(keep)))  # powers down to 1e-200
    r = ordered_index(series.select(key, order, F.col(value).cast("double").alias(value)), [key, order], "_i").withColumn("_c", F.floor(F.col("_i") / chunk))
    w = W.partitionBy(key, "_c").orderBy("_i")
    r = r.withColumn("_n", F.row_number().over(w))
    r = r.withColumn("_s", F.sum((1 - keep) * F.col(value) * F.pow(F.lit(keep), -F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = r.groupBy(key, "_c").agg(F.max("_n").alias("_k"), F.max_by("_s", "_n").alias("_t"), F.min_by(value, "_n").alias("_v"))

    def passed_on(chunks):
        chunks, at = chunks.sort_values("_c"), None
        given = []
        for k, t, v in zip(chunks["_k"], chunks["_t"], chunks["_v"]):
            # what the first chunk is given is the first value: keep * v + (1 - keep) * v is v
            at = v if at is None else at
            given.append(at)
            at = keep**k * (at + t)
        return chunks[[key, "_c"]].assign(_g=given)

    # a row a chunk; only a series that crosses the end of a chunk has several, so there are no more of these than chunks
    last = cut(last.withColumn("_many", F.count("*").over(W.partitionBy(key))))
    several = last.where("_many > 1").drop("_many").repartition(series.sparkSession.sparkContext.defaultParallelism, key)
    given = several.groupBy(key).applyInPandas(passed_on, f"{key} {r.schema[key].dataType.simpleString()}, _c long, _g double")
    given = given.unionByName(last.where("_many = 1").select(key, "_c", F.col("_v").alias("_g")))
    return r.join(given, [key, "_c"]).select(key, order, value, (F.pow(F.lit(keep), F.col("_n")) * (F.col("_g") + F.col("_s"))).alias("ema"))


def best_so_far(epochs: DataFrame, order: str, value: str, eligible: str) -> DataFrame:
    """epochs with saved: eligible rows that beat every eligible row before."""
    r = running_max(epochs, [order], F.when(F.col(eligible), F.col(value)), "_best")
    return r.withColumn("saved", F.coalesce(F.col(eligible) & (F.col("_best").isNull() | (F.col(value) > F.col("_best"))), F.lit(False))).drop("_best")


def forced_foreground(index: Column, batch: int, share: float) -> Column:
    """Whether the index-th sample of a batch must show foreground: the last share of it."""
    return index >= F.bround(F.lit(batch) * (1.0 - F.lit(share))).cast("int")


def warmup_cosine(step: Column, base: float, warmup: int, total: int, least: float = 0.0) -> Column:
    progress = F.least((step - warmup) / max(total - warmup, 1), F.lit(1.0))
    return F.when(step < warmup, F.lit(base) * step / max(warmup, 1)).otherwise(least + (base - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def polynomial_rate(step: Column, base: float, total: int, exponent: float = 0.9) -> Column:
    return F.lit(base) * F.pow(1 - step / total, F.lit(exponent))


def warmup_steps(total: int, steps: int | None = None, ratio: float | None = None, percent: float | None = None) -> int:
    """Warm-up steps given as a number, a share or a percentage of all; the first that is given counts."""
    found = steps if steps is not None else ratio * total if ratio is not None else percent / 100 * total if percent is not None else 0
    if not 0 <= found <= total:
        raise ValueError(f"{found} warm-up steps of {total}")
    return int(found)


def schedule(name: str, step: Column, base: float, total: int, **options) -> Column:
    """The learning rate at a step by a schedule's name: cosine (warm-up and cosine), poly, or constant."""
    if name == "cosine":
        return warmup_cosine(step, base, warmup_steps(total, **options), total)
    if name == "poly":
        return polynomial_rate(step, base, total, **options)
    if name == "constant":
        return F.lit(base) + 0 * step
    raise ValueError(f"unknown schedule {name}")
