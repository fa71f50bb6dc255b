"""Resampling of volumes of any size to any other, each case on its own grid, by nearest places, lines or cubic B-splines.

A volume is cut into tiles of CHUNK places along each axis, which are dealt out with HALO
neighbours on all sides, so that no task holds a whole volume or line and each row is
shuffled once: the spline's coefficients come from a recurrence up and down the line, whose
memory fades by 0.268 a place, far below a double's precision over HALO. Along each axis
tiles of equal places share one matrix, made by running the recurrences over the unit
vectors, so a tile is three products.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.planning import transpose
from quarrylake.operators.storage import broadcast_if_small, cut
from quarrylake.operators.voxels import AXES, crop, crop_to_nonzero, nonzero_box, resampled_size, separate_axis, z_score

CHUNK, HALO = 96, 32
#: Pole of the cubic B-spline's recurrence.
POLE = 3**0.5 - 2
#: Edge values that a line is continued by, so that all neighbours of a target exist.
EDGE = 4


def spline_coefficients(s: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along axis 0 of s, which goes on with its first and last values for ever."""
    out, z = s.astype(float), POLE
    out[0] = s[0] / (1 - z)
    for k in range(1, len(s)):
        out[k] += z * out[k - 1]
    rest = s[-1] / (1 - z)
    out[-1] = -z * rest / (1 - z) - z / (1 - z * z) * (out[-1] - rest)
    for k in range(len(s) - 2, -1, -1):
        out[k] = z * (out[k + 1] - out[k])
    return 6 * out


def cubic(t: np.ndarray) -> np.ndarray:
    """The cubic B-spline at distance t."""
    t = np.abs(t)
    return np.where(t < 1, 2 / 3 - t * t * (2 - t) / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


@lru_cache(64)
def chunk_matrix(n: int, m: int, order: int, chunk: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(first source place, targets, weights): the targets of a chunk of a line of n places that becomes m, from the chunk's places and halo."""
    lo, hi = max(0, chunk * CHUNK - HALO), min(n, (chunk + 1) * CHUNK + HALO)
    # a little more than the targets whose nearest place is in the chunk
    i = np.arange(max(0, chunk * CHUNK * m // n - 2), min(m, (chunk + 1) * CHUNK * m // n + 3))
    nearest = np.minimum(((2 * i + 1) * n) // (2 * m), n - 1)
    i, nearest = i[nearest // CHUNK == chunk], nearest[nearest // CHUNK == chunk]
    if order == 0 or n == m:
        return lo, i, (nearest[:, None] == np.arange(lo, hi)).astype(float)
    at = (i + 0.5) * n / m - 0.5
    unit = np.pad(np.eye(hi - lo), ((EDGE, EDGE), (0, 0)), mode="edge")
    places = np.arange(lo - EDGE, hi + EDGE)
    if order == 1:
        return lo, i, np.maximum(1 - np.abs(at[:, None] - places), 0) @ unit
    if order == 3:
        return lo, i, cubic(at[:, None] - places) @ spline_coefficients(unit)
    raise ValueError(f"order {order} is none of 0, 1, 3")


def _tiled(cells: DataFrame, rest: list[str], resample, out: str) -> DataFrame:
    """resample of each tile's table of cells (rest..., _separate, _n0.., _m0.., _o0.., _a0.., ...), _t0.. being the tile's number along each axis."""
    for k in range(3):
        at, n, order = F.col(f"_a{k}"), F.col(f"_n{k}"), F.col(f"_o{k}")
        # how far a target's sources lie from its nearest place
        halo = F.when((order == 0) | (n == F.col(f"_m{k}")), 0).when(order == 1, 2).otherwise(HALO)
        near = F.sequence(F.greatest(F.floor((at - halo) / CHUNK), F.lit(0)), F.least(F.floor((at + halo) / CHUNK), F.floor((n - 1) / CHUNK)))
        cells = cells.withColumn(f"_t{k}", F.explode(near.cast("array<int>")))
    return cells.groupBy("_t2", "_t1", "_t0", *rest).applyInArrow(lambda table: resample(table), out)


def _matrices(table: pa.Table) -> tuple[int, list, list[np.ndarray]]:
    """(separate axis, the chunk's matrices along _a0.._a2, places of the cells from the tile's first) of a tile."""
    one = {c: table.column(c)[0].as_py() for c in table.column_names if c[:2] in ("_n", "_m", "_o", "_t", "_s")}
    matrices = [chunk_matrix(*(one[f"_{x}{k}"] for x in "nmot")) for k in range(3)]
    return one["_separate"], matrices, [table.column(f"_a{k}").to_numpy().astype(np.int64) - matrices[k][0] for k in range(3)]


def _by(weights: np.ndarray, dense: np.ndarray, axis: int) -> np.ndarray:
    return np.moveaxis(np.tensordot(weights, dense, (1, axis)), 0, axis)


def _rows(table: pa.Table, rest: list[str], separate: int, matrices: list, values: np.ndarray, names: list[str], zeros: bool) -> pa.Table:
    """(rest..., z, y, x, value) of a tile's dense values at the targets along _a0.._a2."""
    places = np.indices(values.shape).reshape(3, -1) if zeros else np.array(np.nonzero(values))
    at = [pa.array(targets[p].astype(np.int32)) for (_, targets, _), p in zip(matrices, places)]
    if separate >= 0:
        at.insert(separate, at.pop())
    flat = values.ravel() if zeros else values[tuple(places)]
    same = [pa.repeat(table.column(c)[0], len(flat)) for c in rest]
    return pa.Table.from_arrays([*same, *at, pa.array(flat)], names=names)


def _cells(places: DataFrame, grids: DataFrame, order: int, order_z: int) -> DataFrame:
    """places (case_id, ..., z, y, x, ...) with _separate, and along the axes as they are resampled their place, sizes and order (_a0.., _n0.., _m0.., _o0..)."""
    g = grids.select("case_id", "n", "m", F.coalesce("separate", F.lit(-1)).alias("_separate")).where(F.forall("m", lambda k: k > 0))
    alone = F.col("_separate")
    sizes = [c.cast("int").alias(f"_{x}{k}") for x in "nm" for k, c in enumerate(_turned([F.get(x, F.lit(k)) for k in range(3)], alone))]
    orders = [F.lit(order).alias("_o0"), F.lit(order).alias("_o1"), F.when(alone >= 0, order_z).otherwise(order).alias("_o2")]
    g = g.select("case_id", "_separate", *sizes, *orders)
    v = places.join(broadcast_if_small(g), "case_id")
    return v.withColumns({f"_a{k}": c.cast("int") for k, c in enumerate(_turned([F.col(a) for a in AXES], alone))}).drop(*AXES)


def resampling_grid(sizes: DataFrame, target: list[float], threshold: float = 3.0) -> DataFrame:
    """(case_id, n, m, separate): each case's places before and behind along z, y, x, and the axis that is resampled by itself, or NULL.

    sizes: (case_id, size, spacing), two arrays along z, y, x. A target of two spacings keeps the first axis as it is. The
    separate axis is the only coarsest one of the case's spacing, or else of the target's, where it exceeds threshold times the finest.
    """
    first = 3 - len(target)
    new = F.array(*(F.get("spacing", F.lit(a)) if a < first else F.lit(float(target[a - first])) for a in range(3)))
    uneven = lambda s: F.array_max(s) / F.array_min(s) > threshold
    m = F.array(*(resampled_size(F.get("size", F.lit(a)), F.get("spacing", F.lit(a)), F.get(new, F.lit(a))) for a in range(3)))
    separate = F.when(uneven(F.col("spacing")), separate_axis(F.col("spacing"), threshold)).when(uneven(new), separate_axis(new, threshold))
    return sizes.select("case_id", F.col("size").cast("array<int>").alias("n"), m.alias("m"), separate.alias("separate"))


def _turned(values: list[Column], separate: Column) -> list[Column]:
    """z, y, x with the separate axis moved to the end."""
    a, b, c = values
    return [F.when(separate == 0, b).otherwise(a), F.when(separate.isin(0, 1), c).otherwise(b), F.when(separate == 0, a).when(separate == 1, b).otherwise(c)]


def resampled_cases(volume: DataFrame, grids: DataFrame, order: int = 3, order_z: int = 0, clip: bool = True, zeros: bool = True) -> DataFrame:
    """(case_id, ..., z, y, x, v) at each case's own grid (of resampling_grid), of volume (case_id, ..., z, y, x, v).

    order: 0 the nearest place, 1 lines, 3 cubic splines; order_z for the separate axis, slice by slice. Lines go on with
    their edge values. clip keeps values within those that the volume, or the slice, had before. Absent places and NULL
    values count 0, places given several times count by their sum; cases without a grid, or of which nothing is left, give no rows.
    Tiles of which nothing is given have no rows; without zeros no place has one whose value is exactly 0.
    """
    rest = [c for c in volume.columns if c not in (*AXES, "v")]
    v = volume.withColumn("v", F.coalesce(F.col("v").cast("double"), F.lit(0.0)))
    if clip:  # by the sums
        v = v.groupBy(*rest, *AXES).agg(F.sum("v").alias("v"))
    v = _cells(v, grids, order, order_z)
    if clip:
        # of a slice where an axis is separate, else of the volume; what is absent counts
        alone = F.col("_separate")
        part = F.when(alone >= 0, F.col("_a2")).otherwise(F.lit(-1))
        places = F.col("_n0").cast("long") * F.col("_n1") * F.when(alone >= 0, 1).otherwise(F.col("_n2"))
        edges = v.withColumns({"_part": part, "_places": places}).groupBy(*rest, "_part", "_places").agg(F.count("*").alias("_k"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        gap = F.col("_k") < F.col("_places")
        edges = edges.select(*rest, "_part", F.when(gap, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo")).alias("_lo"), F.when(gap, F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi")).alias("_hi"))
        v = v.withColumn("_part", part).join(broadcast_if_small(edges), [*rest, "_part"]).drop("_part")
    kinds = {f.name: f.dataType.simpleString() for f in volume.schema}
    names = [*rest, *AXES, "v"]

    def resample(table):
        separate, matrices, at = _matrices(table)
        shape = [w.shape[1] for _, _, w in matrices]
        dense = np.bincount(np.ravel_multi_index(at, shape), table.column("v").to_numpy(), np.prod(shape)).reshape(shape)
        for k, (_, _, weights) in enumerate(matrices):
            if clip and k == 2 and separate >= 0:
                # slices without a cell here are 0, which is inside their bounds
                lo, hi = np.zeros(shape[2]), np.zeros(shape[2])
                lo[at[2]], hi[at[2]] = table.column("_lo").to_numpy(), table.column("_hi").to_numpy()
                dense = np.clip(dense, lo, hi)
            dense = _by(weights, dense, k)
        if clip and separate < 0:
            dense = np.clip(dense, table.column("_lo")[0].as_py(), table.column("_hi")[0].as_py())
        return _rows(table, rest, separate, matrices, dense, names, zeros)

    return _tiled(v, rest, resample, ", ".join(f"{k} {kinds[k]}" for k in rest) + ", z int, y int, x int, v double")


def resampled_labels(labels: DataFrame, grids: DataFrame, order: int = 1, zeros: bool = True) -> DataFrame:
    """(case_id, z, y, x, label) at each case's own grid: the largest label whose share of a place is a half at least, 0 where none is.

    Without zeros places whose label is 0 have no row.
    """
    cells = _cells(labels.where("label IS NOT NULL").select("case_id", F.col("label").cast("int").alias("label"), *AXES), grids, order, 0)

    def resample(table):
        separate, matrices, at = _matrices(table)
        shape, own = [w.shape[1] for _, _, w in matrices], table.column("label").to_numpy()
        out = np.zeros([len(targets) for _, targets, _ in matrices], np.int32)
        for label in np.unique(own):
            share = np.zeros(shape)
            share[tuple(a[own == label] for a in at)] = 1
            for k, (_, _, weights) in enumerate(matrices):
                share = _by(weights, share, k)
            out[share >= 0.5 - 1e-9] = label  # a half that was summed up of parts
        return _rows(table, ["case_id"], separate, matrices, out, ["case_id", *AXES, "label"], zeros)

    return _tiled(cells, ["case_id"], resample, f"case_id {labels.schema['case_id'].dataType.simpleString()}, z int, y int, x int, label int")


def _to_crop(volume: DataFrame, spacings: DataFrame, order: list[int], target: list[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(volume, boxes, grids): the volume transposed, the boxes of what is not zero, and the grids of the crops."""
    v = transpose(volume, order)
    boxes = cut(nonzero_box(v))  # a row a case, read several times
    size = F.array(*(F.col(f"{a}1") - F.col(f"{a}0") for a in AXES))
    turned = spacings.select("case_id", F.array(*(F.get("spacing", F.lit(k)) for k in order)).alias("spacing"))
    return v, boxes, cut(resampling_grid(boxes.join(turned, "case_id").select("case_id", size.alias("size"), "spacing"), target))


def preprocessed_volumes(volume: DataFrame, spacings: DataFrame, order: list[int], target: list[float], normalise=z_score, zeros: bool = True) -> DataFrame:
    """The volume of preprocessed_cases, without the labels' work."""
    v, boxes, grids = _to_crop(volume, spacings, order, target)
    # read for the means, the bounds and the values
    return resampled_cases(normalise(cut(crop(v, broadcast_if_small(boxes)))), grids, zeros=zeros)


def preprocessed_cases(volume: DataFrame, labels: DataFrame, spacings: DataFrame, order: list[int], target: list[float], normalise=z_score) -> tuple[DataFrame, DataFrame]:
    """(volume, labels) of cases of any size: transposed, cropped to what is not zero, normalised and brought to the target spacing.

    volume: (case_id, c, z, y, x, v), labels: (case_id, z, y, x, label), spacings: (case_id, spacing), an array along the axes
    as they come. Each case is resampled from the size of its own crop. A case that is zero everywhere gives no rows.
    """
    v, _, grids = _to_crop(volume, spacings, order, target)
    v, s = crop_to_nonzero(v, transpose(labels, order))
    return resampled_cases(normalise(v), grids), resampled_labels(s, grids)
