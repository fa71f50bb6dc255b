"""Morphology with balls, by distances: what a ball reaches is what lies no farther than its radius.

Squared distances come axis by axis: the least of (distance along the axis)^2 + what the axes
before have found. Places are dealt out in tiles with a halo on all sides, of the radius for
each step of an operator, so that no task holds a whole volume or line, each place is shuffled
once and all steps of an operator are taken in the tile. Only tiles with places of the mask
in reach are looked at, as no operator adds anything elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.augmentation import PLACE, components
from quarrylake.operators.storage import broadcast_if_small, cut

#: Places of a tile along an axis, besides the halo.
TILE = 64
_FAR = 1 << 29
_BOX = [f"{a}{k}" for a in "zyx" for k in (0, 1)]


def _squares(seed: np.ndarray, radius: int) -> np.ndarray:
    """Of each place the squared distance to the seed, if it lies within radius along every axis."""
    out = np.where(seed, 0, _FAR).astype(np.int32)
    for axis in range(3):
        before, out = out, out.copy()
        for k in range(1, min(radius, out.shape[axis] - 1) + 1):
            up, down = ([slice(None)] * axis + [s] for s in (slice(k, None), slice(None, -k)))
            for to, of in ((tuple(up), tuple(down)), (tuple(down), tuple(up))):
                np.minimum(out[to], before[of] + k * k, out=out[to])
    return out


def _grown(mask: np.ndarray, inside: np.ndarray, radius: float) -> np.ndarray:
    return (_squares(mask & inside, int(radius)) <= radius * radius) & inside


def _shrunk(mask: np.ndarray, inside: np.ndarray, radius: float) -> np.ndarray:
    return mask & ~_grown(inside & ~mask, inside, radius)


def _tiled(mask: DataFrame, within: DataFrame, steps: list[Callable], radius: float, distances: bool = False) -> DataFrame:
    """(case_id, z, y, x) that the steps, one after the other, make of the mask; distances: with d2, the squared distance to the mask, instead of a step.

    within: the volume's places, or boxes (case_id, z0, z1, ...) without the ends, a row a case.
    """
    reach = int(np.floor(radius))
    halo = reach * max(1, len(steps))
    boxes = "x" not in within.columns
    lowest = lambda a: F.col(f"{a}0") if boxes else F.lit(-(1 << 31))
    highest = lambda a: F.col(f"{a}1") - 1 if boxes else F.lit((1 << 31) - 1)

    def dealt(places):
        for a in "zyx":
            tiles = F.sequence(F.floor(F.greatest(F.col(a) - halo, lowest(a)) / TILE), F.floor(F.least(F.col(a) + halo, highest(a)) / TILE))
            places = places.withColumn(f"_{a}", F.explode(tiles))
        return places

    if boxes:
        cells = mask.select(*PLACE, F.lit(True).alias("_in")).join(broadcast_if_small(within.select("case_id", *_BOX)), "case_id")
        cells = cells.where(" AND ".join(f"{a} >= {a}0 AND {a} < {a}1" for a in "zyx"))
    else:
        cells = mask.select(*PLACE, F.lit(True).alias("_in")).unionByName(within.select(*PLACE, F.lit(False).alias("_in")))
    kind = mask.schema["case_id"].dataType.simpleString()
    names = [*PLACE, "d2"] if distances else PLACE

    def run(table):
        first = [table.column(f"_{a}")[0].as_py() * TILE for a in "zyx"]
        at = np.stack([table.column(a).to_numpy().astype(np.int64) for a in "zyx"])
        own = table.column("_in").to_numpy(zero_copy_only=False).astype(bool)
        edges = [(table.column(f"{a}0")[0].as_py(), table.column(f"{a}1")[0].as_py()) for a in "zyx"] if boxes else [(p.min(), p.max() + 1) for p in at]
        lo = [max(f - halo, e[0]) for f, e in zip(first, edges)]
        hi = [min(f + TILE + halo, e[1]) for f, e in zip(first, edges)]
        at -= np.array(lo)[:, None]
        seed = np.zeros([b - a for a, b in zip(lo, hi)] if own.any() else (0, 0, 0), bool)
        inside = np.full(seed.shape, boxes)
        if own.any():
            seed[tuple(at[:, own])] = True
            if not boxes:
                inside[tuple(at[:, ~own])] = True
        out = seed
        for step in steps:
            out = step(out, inside, radius)
        if distances:
            squares = _squares(seed & inside, reach)
            out = (squares <= radius * radius) & inside
        # the tile without its halo
        middle = tuple(slice(max(f - a, 0), f + TILE - a) for f, a in zip(first, lo))
        found = np.nonzero(out[middle])
        columns = [pa.repeat(table.column("case_id")[0], len(found[0]))]
        columns += [pa.array((f + m.start + a).astype(np.int32)) for f, m, a in zip(found, middle, lo)]
        if distances:
            columns.append(pa.array(squares[middle][found].astype(np.int64)))
        return pa.Table.from_arrays(columns, names=list(names))

    return dealt(cells).groupBy("_x", "_y", "_z", "case_id").applyInArrow(lambda table: run(table), f"case_id {kind}, z int, y int, x int" + (", d2 long" if distances else ""))


def squared_distance(mask: DataFrame, within: DataFrame, radius: float) -> DataFrame:
    """(case_id, z, y, x, d2): of the places within no farther than radius from the mask their squared distance to it.

    within, here and below: a volume's places (case_id, z, y, x), repeated rows count once, or a box a case
    (case_id, z0, z1, y0, y1, x0, x1; the ends not included), which needs no rows of places. A task holds a tile
    and twice as many radii around it at most.
    """
    return _tiled(mask, within, [], radius, True)


def ball_dilated(mask: DataFrame, within: DataFrame, radius: float) -> DataFrame:
    """The places (case_id, z, y, x) within that a ball around a place of the mask reaches."""
    return _tiled(mask, within, [_grown], radius)


def ball_eroded(mask: DataFrame, within: DataFrame, radius: float) -> DataFrame:
    """The places of the mask whose ball lies in it; beyond the volume counts as mask."""
    return _tiled(mask, within, [_shrunk], radius)


def ball_opened(mask: DataFrame, within: DataFrame, radius: float) -> DataFrame:
    return _tiled(mask, within, [_shrunk, _grown], radius)


def ball_closed(mask: DataFrame, within: DataFrame, radius: float) -> DataFrame:
    return _tiled(mask, within, [_grown, _shrunk], radius)


OPERATORS: dict[str, Callable] = {"dilation": ball_dilated, "erosion": ball_eroded, "closing": ball_closed, "opening": ball_opened}


def draw(seed: int, *of: str | Column) -> Column:
    """A seeded number of 0 to 1 for each different key."""
    return F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def operated(cells: DataFrame, within: DataFrame, channel: int, seed: int, share: float = 0.3, radii: tuple[int, int] = (1, 10), label_share: float = 1.0) -> DataFrame:
    """cells (case_id, c, z, y, x), the set places of one-hot channels, after a random operator on one channel of a share of the cases.

    Which case, operator and radius (whole, from radii[0] up to below radii[1]) follow from a seeded hash of the case. What the
    operator adds leaves all other channels; what it removes becomes background. Cases are taken together by operator and radius.
    """
    cases = within.select("case_id").distinct()
    names = F.array(*map(F.lit, OPERATORS))
    pick = lambda n, k: F.floor(draw(seed + k, "case_id", F.lit(channel)) * n).cast("int")
    chosen = cases.where((draw(seed, "case_id") < share) & (draw(seed + 1, "case_id", F.lit(channel)) < label_share))
    chosen = cut(chosen.select("case_id", F.get(names, pick(len(OPERATORS), 2)).alias("op"), (radii[0] + pick(radii[1] - radii[0], 3)).alias("radius")))
    own = cells.where(F.col("c") == channel)
    parts = []
    # an operator and a radius at a time: a bounded number, whatever the cases
    for r in sorted(chosen.select("op", "radius").distinct().collect()):
        mine = chosen.where((F.col("op") == r.op) & (F.col("radius") == r.radius)).select("case_id")
        volume = within.join(broadcast_if_small(mine), "case_id", "left_semi")
        parts.append(OPERATORS[r.op](own.join(broadcast_if_small(mine), "case_id", "left_semi").select(*PLACE), volume, float(r.radius)))
    if not parts:
        return cells.select("case_id", "c", "z", "y", "x")
    new = cut(reduce(DataFrame.unionByName, parts))
    kept = own.join(broadcast_if_small(chosen.select("case_id")), "case_id", "left_anti").select("case_id", "c", "z", "y", "x")
    added = new.join(own.select(*PLACE), PLACE, "left_anti")
    others = cells.where(F.col("c") != channel).join(added, PLACE, "left_anti").select("case_id", "c", "z", "y", "x")
    return others.unionByName(kept).unionByName(new.select("case_id", F.lit(channel).cast(cells.schema["c"].dataType).alias("c"), "z", "y", "x"))


def without_random_component(cells: DataFrame, sizes: DataFrame, channels: list[int], seed: int, share: float = 0.2, other_share: float = 0.25, most: float = 0.25, label_share: float = 1.0) -> DataFrame:
    """cells (case_id, c, z, y, x), the set places of one-hot channels, less one component in each chosen channel of a share of the cases.

    A component (places that touch by face, edge or corner) is a candidate if it has less than most of the case's places; sizes:
    (case_id, places). With other_share it moves to another of the channels instead. All draws are seeded hashes.
    """
    case_draw = (draw(seed, "case_id") < share) & (draw(seed + 1, "case_id", "c") < label_share)
    at_work = cells.where(F.col("c").isin(*channels) & case_draw)
    named = at_work.select(F.to_json(F.struct("case_id", "c")).alias("case_id"), "z", "y", "x")
    found = components(named, full=True)
    back = F.from_json("case_id", f"case_id {cells.schema['case_id'].dataType.simpleString()}, c {cells.schema['c'].dataType.simpleString()}")
    found = cut(found.withColumn("k", back).select("k.case_id", "k.c", "z", "y", "x", "component", "size"))
    candidate = found.join(broadcast_if_small(sizes), "case_id").where(F.col("size") < F.col("places") * most)
    picked = candidate.groupBy("case_id", "c").agg(F.min_by("component", F.struct(F.xxhash64("component", F.lit(seed + 2)), "component")).alias("component"))
    gone = found.join(broadcast_if_small(picked), ["case_id", "c", "component"]).select("case_id", "c", "z", "y", "x")
    left = cells.join(gone, ["case_id", "c", "z", "y", "x"], "left_anti").select("case_id", "c", "z", "y", "x")
    if len(channels) < 2:
        return left
    other = F.filter(F.array(*map(F.lit, channels)), lambda k: k != F.col("c"))
    moved = gone.where(draw(seed + 3, "case_id", "c") < other_share)
    to = F.get(other, F.floor(draw(seed + 4, "case_id", "c") * (len(channels) - 1)).cast("int")).cast(cells.schema["c"].dataType)
    return left.unionByName(moved.select("case_id", to.alias("c"), "z", "y", "x")).distinct()
