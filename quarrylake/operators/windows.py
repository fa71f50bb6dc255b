"""Sliding windows from end to end: cut, mirror, predict, undo, weigh and add up, as one plan.

Which windows a voxel lies in follows from the starts along each axis, so voxels meet windows
without a search. A window's weighted predictions and those of its mirror images are summed
in one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.sampling import spread_count, spread_start, spread_starts
from quarrylake.operators.storage import broadcast_if_small
from quarrylake.operators.voxels import AXES, gaussian_weight


def starts(sizes: DataFrame, patch: dict[str, int], share: float = 0.5) -> DataFrame:
    """(case_id, pad_z.., start_z..): of each case (case_id, z, y, x sizes) how far it is padded in front, to a patch at least, and where windows start along each axis of the padded volume."""
    room = {a: F.greatest(F.col(a), F.lit(patch[a])) for a in AXES}
    return sizes.select("case_id", *(F.floor((room[a] - F.col(a)) / 2).cast("int").alias(f"pad_{a}") for a in AXES), *(spread_starts(room[a], F.lit(patch[a]), share).alias(f"start_{a}") for a in AXES))


def cut_windows(volume: DataFrame, sizes: DataFrame, patch: dict[str, int], share: float = 0.5, mirrored: tuple[str, ...] = ()) -> DataFrame:
    """(case_id, z0, y0, x0, flip, c, z, y, x, v): each voxel in each window it lies in, at its place in the window, and in all mirror images.

    z0, y0, x0: the window's start in the unpadded volume; flip: the mirrored axes, joined by commas. Places beyond the volume give no rows.
    """
    flips = [",".join(s) for k in range(len(mirrored) + 1) for s in combinations(mirrored, k)]
    room = {a: F.greatest(F.col(a), F.lit(patch[a])) for a in AXES}
    bounds = sizes.select("case_id", *(room[a].alias(f"room_{a}") for a in AXES), *(F.floor((room[a] - F.col(a)) / 2).cast("int").alias(f"pad_{a}") for a in AXES))
    j = volume.join(broadcast_if_small(bounds), "case_id")
    # found before a row becomes several
    j = j.withColumns({f"_{a}0": F.transform(windows_of(F.col(a) + F.col(f"pad_{a}"), F.col(f"room_{a}"), patch[a], share), lambda s: s - F.col(f"pad_{a}")) for a in AXES})
    for a in AXES:
        j = j.withColumn(f"{a}0", F.explode(f"_{a}0"))
    j = j.withColumn("flip", F.explode(F.array(*map(F.lit, flips))))
    return j.select("case_id", "z0", "y0", "x0", "flip", "c", *(_mirror(F.col(a) - F.col(f"{a}0"), a, patch[a]).cast("int").alias(a) for a in AXES), "v")


def windows_of(at: Column, size: Column, patch: int, share: float) -> Column:
    """Those of spread_starts whose windows hold a place: only the few around it are looked at, however long the axis."""
    n, last = spread_count(size, F.lit(patch), share), F.greatest(size - patch, F.lit(0))
    # starts are rounded, so half a place more on both sides
    lo = F.when(n > 1, F.least(F.greatest(F.floor((at - patch - 0.5) * (n - 1) / last), F.lit(0)), n - 1)).otherwise(0).cast("int")
    hi = F.when(n > 1, F.least(F.greatest(F.floor((at + 0.5) * (n - 1) / last) + 1, lo), n - 1)).otherwise(0).cast("int")
    return F.filter(F.transform(F.sequence(lo, hi), lambda k: spread_start(k, n, last)), lambda s: (s <= at) & (at < s + patch))


def _mirror(offset: Column, axis: str, size: int) -> Column:
    # axes are single letters
    return F.when(F.contains("flip", F.lit(axis)), F.lit(size - 1) - offset).otherwise(offset)


def added_up(predictions: DataFrame, sizes: DataFrame, patch: dict[str, int], gaussian: bool = True) -> DataFrame:
    """(case_id, c, z, y, x, v): the mean of all windows and mirror images at each place of the volume, weighted by the middle of windows.

    predictions: as cut_windows gives them, of any channels. What lies in the padding goes; a value that is not finite raises.
    """
    p = predictions.select("case_id", "c", "v", *((F.col(f"{a}0") + _mirror(F.col(a), a, patch[a])).cast("int").alias(f"_{a}") for a in AXES), *(_mirror(F.col(a), a, patch[a]).alias(f"_o{a}") for a in AXES))
    g = F.lit(1.0)
    if gaussian:
        for a in AXES:
            g = g * F.get(F.array(*(gaussian_weight(F.lit(k), patch[a]) for k in range(patch[a]))), F.col(f"_o{a}"))
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(f"_{a}") >= 0) & (F.col(f"_{a}") < F.col(f"_size_{a}"))
    bounds = sizes.select("case_id", *(F.col(a).alias(f"_size_{a}") for a in AXES))
    p = p.withColumn("_g", g).join(broadcast_if_small(bounds), "case_id").where(inside)
    total = p.groupBy("case_id", "c", *(F.col(f"_{a}").alias(a) for a in AXES)).agg((F.sum(F.col("v") * F.col("_g")) / F.sum("_g")).alias("v"))
    odd = F.isnan("v") | (F.abs("v") == float("inf"))
    return total.withColumn("v", F.when(odd, F.raise_error(F.lit("a prediction is not finite"))).otherwise(F.col("v")))


def sliding_prediction(volume: DataFrame, sizes: DataFrame, patch: dict[str, int], models: list[Callable[[DataFrame], DataFrame]], share: float = 0.5, mirrored: tuple[str, ...] = (), gaussian: bool = True) -> DataFrame:
    """(case_id, c, z, y, x, v): the mean of the models' predictions for volume (case_id, c, z, y, x, v), by windows and mirror images.

    A model maps what cut_windows gives to predictions of the same form. All models' windows meet in one aggregate, as each weighs the same at a place.
    """
    windows = cut_windows(volume, sizes, patch, share, mirrored)
    predicted = None
    for model in models:
        own = model(windows).select("case_id", "z0", "y0", "x0", "flip", "c", *AXES, "v")
        predicted = own if predicted is None else predicted.unionByName(own)
    return added_up(predicted, sizes, patch, gaussian)
