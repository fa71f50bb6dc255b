"""How volumes are laid out for a network: axis order, normalisation, patches and their boxes, input channels."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators.storage import broadcast_if_small, cut

#: Channel names and the normalisation they stand for; all others mean z-score.
SCHEMES = {"ct": "ct", "nonorm": "none", "zscore": "zscore", "rescale_to_0_1": "rescale", "rgb_to_0_1": "rgb"}
#: Schemes that can be limited to the non-zero part.
MASKED = ("zscore", "none")


def axis_order(spacing: DataFrame, *by: str) -> DataFrame:
    """(by..., axis, forward, backward) of spacings (by..., axis, spacing): the coarsest axis first, the others in order; backward undoes it."""
    first = F.max_by("axis", F.struct("spacing", -F.col("axis"))).over(W.partitionBy(*by))
    s = spacing.withColumn("_first", first)
    forward = F.when(F.col("axis") == F.col("_first"), 0).when(F.col("axis") < F.col("_first"), F.col("axis") + 1).otherwise(F.col("axis"))
    order = s.select(*by, "axis", forward.cast("int").alias("forward"), "_first")
    # the axis at a place of the new order
    back = F.when(F.col("axis") == 0, F.col("_first")).when(F.col("axis") <= F.col("_first"), F.col("axis") - 1).otherwise(F.col("axis"))
    return order.select(*by, "axis", "forward", back.cast("int").alias("backward"))


def transpose(voxels: DataFrame, order: list[int]) -> DataFrame:
    """voxels (..., z, y, x) with their axes in another order: the k-th new axis is the order[k]-th."""
    names = ("z", "y", "x")
    return voxels.withColumns({n: F.col(names[k]) for n, k in zip(names, order)})


def normalization(channels: DataFrame, share: Column, least: float = 0.75) -> DataFrame:
    """channels (channel, ...) with scheme and use_mask: only where cropping leaves less than least of the median volume."""
    name = F.lower("channel")
    scheme = F.coalesce(*(F.when(name == k, v) for k, v in SCHEMES.items()), F.lit("zscore"))
    return channels.withColumn("scheme", scheme).withColumn("use_mask", F.col("scheme").isin(*MASKED) & (share < least))


def patch_size(requested: str | None, trained: list[int], strides: list[int]) -> list[int]:
    """The patch asked for ("AxBxC" or with commas), no larger than the trained one; it must fit the network's strides."""
    if not requested:
        return list(trained)
    parts = re.split("[x,]", requested)
    if len(parts) != len(trained) or not all(p.strip().isdigit() and int(p) > 0 for p in parts):
        raise ValueError(f"a patch takes {len(trained)} positive integers, not {requested}")
    patch = [min(int(p), t) for p, t in zip(parts, trained)]
    if any(p % s for p, s in zip(patch, strides)):
        raise ValueError(f"patch {patch} does not fit strides {strides}")
    return patch


def patch_bounds(size: Column, patch: Column, padding: Column) -> Column:
    """(low, high): the first and last start of a patch on an axis that is padded on both sides, enough for one patch."""
    pad = F.greatest(padding, patch - size)
    return F.struct((-F.ceil(pad / 2)).cast("int").alias("low"), (size + F.ceil(pad / 2) - patch).cast("int").alias("high"))


def patch_start(bounds: Column, patch: Column, centre: Column, draw: Column) -> Column:
    """The start of a patch: around a foreground voxel where there is one, else drawn from the bounds; draw: a non-negative long."""
    drawn = bounds["low"] + F.pmod(draw, (bounds["high"] - bounds["low"] + 1).cast("long"))
    return F.when(centre.isNotNull(), F.greatest(bounds["low"], centre - F.floor(patch / 2))).otherwise(drawn).cast("int")


def pick_location(locations: DataFrame, seed: int) -> DataFrame:
    """(case_id, label, z, y, x): of each case one location of one of its labels, both drawn by a seeded hash."""
    label = locations.select("case_id", "label").distinct().groupBy("case_id").agg(F.min_by("label", F.struct(F.xxhash64("case_id", "label", F.lit(seed)), F.col("label"))).alias("label"))
    return locations.join(label, ["case_id", "label"]).groupBy("case_id", "label").agg(
        F.min(F.struct(F.xxhash64("z", "y", "x", F.lit(seed)).alias("h"), "z", "y", "x")).alias("m")).select("case_id", "label", "m.z", "m.y", "m.x")


def input_channels(modalities: Column, labels: Column, cascaded: Column) -> Column:
    """Modalities, and for the second stage of a cascade a channel for each foreground label or region."""
    return modalities + F.when(cascaded, labels).otherwise(0)


def mirrored_mean(predictions: DataFrame, sizes: dict[str, int], axes: list[str]) -> DataFrame:
    """(case_id, c, z, y, x, v): the mean over predictions of an image and of all its mirror images.

    predictions: (case_id, flip, c, z, y, x, v), flip names the mirrored axes joined by commas ("" for none), places as predicted.
    A place with an infinite or undefined value raises. Predictions that are dealt out by case_id and an axis that is not
    mirrored (or several) are not shuffled again.
    """
    wanted = [",".join(c) for k in range(len(axes) + 1) for c in combinations(axes, k)]
    back = {a: F.when(F.array_contains(F.split("flip", ","), a), F.lit(sizes[a] - 1) - F.col(a)).otherwise(F.col(a)) for a in axes}
    p = predictions.where(F.col("flip").isin(*wanted)).withColumns(back).groupBy("case_id", "c", "z", "y", "x").agg(F.avg("v").alias("v"))
    odd = F.isnan("v") | (F.abs("v") == float("inf"))
    return p.withColumn("v", F.when(odd, F.raise_error(F.lit("a prediction is not finite"))).otherwise(F.col("v")))


def topology(patch: Column, spacing: Column, least: int = 4, most: int = 999999, uneven: float = 2.0, stages: int = 40) -> Column:
    """(pools, strides, kernels, patch, divisors) of a network for a patch and its spacings, both arrays along the axes.

    A stage halves each axis that keeps least places afterwards, has a spacing under uneven times the finest of such axes and
    was halved fewer than most times. Stages end where no axis is left, or a single one of fewer than 3 * least places. An axis
    gets kernels of 3 from the stage on in which its spacing is under uneven times the finest of all, the bottleneck on all
    axes. The patch is padded to what the strides divide.
    """
    axes = F.sequence(F.lit(0), F.size(patch) - 1)
    ones = F.transform(axes, lambda a: F.lit(1))
    begin = F.struct(F.transform(patch, lambda n: n.cast("long")).alias("size"), F.transform(spacing, lambda s: s.cast("double")).alias("space"), F.transform(ones, lambda o: o * 0).alias("pools"), ones.alias("kernel"),
                     F.array(ones).alias("strides"), F.array().cast("array<array<int>>").alias("kernels"), F.lit(True).alias("open"))

    def stage(s, _):
        wide = lambda a: F.get(s["size"], a) >= 2 * least
        fine = F.array_min(F.transform(F.filter(axes, wide), lambda a: F.get(s["space"], a)))
        chosen = F.transform(axes, lambda a: F.coalesce(wide(a) & (F.get(s["space"], a) / fine < uneven) & (F.get(s["pools"], a) < most), F.lit(False)))
        mine = F.filter(axes, lambda a: F.get(chosen, a))
        on = s["open"] & ((F.size(mine) > 1) | ((F.size(mine) == 1) & (F.get(s["size"], F.get(mine, F.lit(0))) >= 3 * least)))
        kernel = F.transform(axes, lambda a: F.when(F.get(s["space"], a) / F.array_min(s["space"]) < uneven, 3).otherwise(F.get(s["kernel"], a)))
        halve = lambda a, yes, no: F.when(F.get(chosen, a), yes).otherwise(no)
        after = F.struct(
            F.transform(axes, lambda a: halve(a, F.ceil(F.get(s["size"], a) / 2), F.get(s["size"], a))).alias("size"), F.transform(axes, lambda a: halve(a, F.get(s["space"], a) * 2, F.get(s["space"], a))).alias("space"),
            F.transform(axes, lambda a: halve(a, F.get(s["pools"], a) + 1, F.get(s["pools"], a))).alias("pools"), kernel.alias("kernel"),
            F.concat(s["strides"], F.array(F.transform(axes, lambda a: halve(a, F.lit(2), F.lit(1))))).alias("strides"), F.concat(s["kernels"], F.array(kernel)).alias("kernels"), F.lit(True).alias("open"))
        stop = F.struct(*(s[k].alias(k) for k in ("size", "space", "pools", "kernel", "strides", "kernels")), F.lit(False).alias("open"))
        return F.when(on, after).otherwise(stop)

    def finish(s):
        divisors = F.transform(s["pools"], lambda p: F.pow(F.lit(2), p).cast("int"))
        return F.struct(s["pools"].alias("pools"), s["strides"].alias("strides"), F.concat(s["kernels"], F.array(F.transform(axes, lambda a: F.lit(3)))).alias("kernels"),
                        F.zip_with(patch, divisors, lambda n, d: (F.ceil(n / d) * d).cast("int")).alias("patch"), divisors.alias("divisors"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(stages)), begin, stage, finish)


def topologies(rows: DataFrame, least: int = 4, most: int = 999999, uneven: float = 2.0, stages: int = 40) -> DataFrame:
    """rows (patch, spacing, ...) with t, their topology, found once for each different patch and spacing."""
    different = rows.select("patch", "spacing").distinct().repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "patch", "spacing")
    found = cut(different.withColumn("t", topology(F.col("patch"), F.col("spacing"), least, most, uneven, stages)))
    return rows.join(broadcast_if_small(found, 10_000), ["patch", "spacing"], "left")


def pooling(patch: list[int], spacing: list[float], least: int = 4, most: int = 999999, uneven: float = 2.0) -> tuple[list[list[int]], list[list[int]]]:
    """(strides, kernels) of a network for one patch, by the rule of topology."""
    size, space, pools = list(patch), list(spacing), [0] * len(patch)
    strides, kernels, near = [[1] * len(patch)], [], [1] * len(patch)
    while wide := [a for a, n in enumerate(size) if n >= 2 * least]:
        fine = min(space[a] for a in wide)
        chosen = [a for a in wide if space[a] / fine < uneven and pools[a] < most]
        if not chosen or len(chosen) == 1 and size[chosen[0]] < 3 * least:
            break
        near = [3 if s / min(space) < uneven else k for k, s in zip(near, space)]
        for a in chosen:
            size[a], space[a], pools[a] = -(-size[a] // 2), 2 * space[a], pools[a] + 1
        strides.append([2 if a in chosen else 1 for a in range(len(size))])
        kernels.append(near)
    return strides, [*kernels, [3] * len(patch)]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
