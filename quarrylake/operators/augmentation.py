"""Changes to label maps in long form: regions, masks, components, morphology and sparse annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.components import connected_components
from quarrylake.operators.storage import broadcast_if_small, cut

PLACE = ["case_id", "z", "y", "x"]
_STEPS = ((1, 0, 0), (0, 1, 0), (0, 0, 1))


def to_regions(voxels: DataFrame, regions: list[list[int]]) -> DataFrame:
    """voxels with region_0, region_1, ...: whether the label is in each region."""
    return voxels.select("*", *(F.col("label").isin(*r).cast("int").alias(f"region_{k}") for k, r in enumerate(regions)))


def masked(volume: DataFrame, mask: Column, outside: float = 0.0) -> DataFrame:
    """volume with v set to outside where mask does not hold."""
    return volume.withColumn("v", F.when(mask, F.col("v")).otherwise(F.lit(outside)))


def labels_as_channels(voxels: DataFrame, labels: list[int], first: int) -> DataFrame:
    """(case_id, c, z, y, x, v): a previous stage's label map as one 0/1 channel a label, numbered from first on."""
    channels = F.array(*(F.struct(F.lit(first + k).alias("c"), (F.col("label") == x).cast("double").alias("v")) for k, x in enumerate(labels)))
    return voxels.select(*PLACE, F.explode(channels).alias("e")).select("case_id", "e.c", "z", "y", "x", "e.v")


def neighbours(voxels: DataFrame) -> DataFrame:
    """The places next to voxels by a face, and their own."""
    steps = F.array(*(F.struct(*(F.lit(s * d).alias(a) for a, d in zip(("dz", "dy", "dx"), step))) for step in [*_STEPS, (0, 0, 0)] for s in (1, -1)))
    e = voxels.select(*PLACE, F.explode(steps).alias("s"))
    return e.select("case_id", *((F.col(a) + F.col(f"s.d{a}")).alias(a) for a in "zyx")).distinct()


def dilated(mask: DataFrame, within: DataFrame) -> DataFrame:
    """A mask (case_id, z, y, x) and its face neighbours, inside the volume."""
    return neighbours(mask).join(within.select(*PLACE), PLACE, "left_semi")


def eroded(mask: DataFrame, within: DataFrame) -> DataFrame:
    """The places of a mask whose face neighbours inside the volume are all in it."""
    outside = within.select(*PLACE).join(mask, PLACE, "left_anti")
    return mask.select(*PLACE).join(dilated(outside, within), PLACE, "left_anti")


def opened(mask: DataFrame, within: DataFrame) -> DataFrame:
    return dilated(eroded(mask, within), within)


def closed(mask: DataFrame, within: DataFrame) -> DataFrame:
    return eroded(dilated(mask, within), within)


#: Half of the 26 places that touch one by face, edge or corner.
_TOUCHING = tuple(s for s in ((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)) if s > (0, 0, 0))


def components(voxels: DataFrame, full: bool = False) -> DataFrame:
    """(case_id, z, y, x, component, size): the face-connected components of foreground places; full: connected by edges and corners, too."""
    key = F.concat_ws(":", "case_id", *(F.lpad(F.col(a).cast("string"), 9, "0") for a in "zyx"))
    v = cut(voxels.select(*PLACE).distinct().withColumn("node", key))
    steps = F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip(("dz", "dy", "dx"), step))) for step in (_TOUCHING if full else _STEPS)))
    to = v.select("case_id", F.col("node").alias("a"), F.explode(steps).alias("s"), "z", "y", "x")
    to = to.select("case_id", "a", *((F.col(x) + F.col(f"s.d{x}")).alias(x) for x in "zyx"))
    edges = to.join(v, PLACE).select("a", F.col("node").alias("b"))
    c = v.join(connected_components(edges, cut), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return c.join(c.groupBy("component").agg(F.count("*").alias("size")), "component").select(*PLACE, "component", "size")


def without_large_components(labels: DataFrame, mask: DataFrame, more_than: int = 50, value: int = 0) -> DataFrame:
    """labels (case_id, z, y, x, label) with value where a component of mask has more than so many places."""
    large = components(mask).where(F.col("size") > more_than).select(*PLACE, F.lit(True).alias("_in"))
    return labels.join(large, PLACE, "left").withColumn("label", F.when(F.col("_in"), F.lit(value)).otherwise(F.col("label"))).drop("_in")


def filled(mask: DataFrame, within: DataFrame) -> DataFrame:
    """A mask and its holes: components of the rest of the volume (case_id, z, y, x) that touch no side on which the volume extends."""
    rest = components(within.select(*PLACE).join(mask, PLACE, "left_anti"))
    ends = within.groupBy("case_id").agg(*(f(a).alias(f"{n}_{a}") for a in "zyx" for n, f in (("lo", F.min), ("hi", F.max))))
    side = F.lit(False)
    for a in "zyx":
        side = side | ((F.col(f"lo_{a}") < F.col(f"hi_{a}")) & ((F.col(a) == F.col(f"lo_{a}")) | (F.col(a) == F.col(f"hi_{a}"))))
    open_ = rest.join(broadcast_if_small(ends), "case_id").where(side).select("component").distinct()
    return mask.select(*PLACE).unionByName(rest.join(open_, "component", "left_anti").select(*PLACE))


def downsampled(voxels: DataFrame, factor: dict[str, int]) -> DataFrame:
    """Label maps at every factor-th place of each axis."""
    keep = F.lit(True)
    for a, k in factor.items():
        keep = keep & (F.col(a) % k == 0)
    return voxels.where(keep).withColumns({a: F.floor(F.col(a) / k).cast("int") for a, k in factor.items()})


def slices_as_channels(volume: DataFrame, depth: int) -> DataFrame:
    """volume (case_id, c, z, y, x, v) of depth slices with the slices as channels c * depth + z."""
    return volume.select("case_id", (F.col("c") * depth + F.col("z")).alias("c"), "y", "x", "v")


def channels_as_slices(volume: DataFrame, depth: int) -> DataFrame:
    return volume.select("case_id", F.floor(F.col("c") / depth).cast("int").alias("c"), (F.col("c") % depth).alias("z"), "y", "x", "v")


def sparsified(voxels: DataFrame, share: float, ignore: int, seed: int) -> DataFrame:
    """voxels whose label stays in max(1, round(n * share)) of an axis's n slices, picked by a seeded hash on each axis; elsewhere it is ignore."""
    kept = F.lit(False)
    out = voxels
    for a in "zyx":
        places = voxels.select("case_id", a).distinct()
        n = places.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(a), a, F.lit(seed)).alias("h"), F.col(a).alias("k")))).alias("all"))
        chosen = n.select("case_id", F.explode(F.slice("all", 1, F.greatest(F.lit(1), F.bround(F.size("all") * F.lit(share)).cast("int")))).alias("s")).select("case_id", F.col("s.k").alias(a), F.lit(True).alias(f"_{a}"))
        out = out.join(broadcast_if_small(chosen), ["case_id", a], "left")
        kept = kept | F.coalesce(f"_{a}", F.lit(False))
    return out.withColumn("label", F.when(kept, F.col("label")).otherwise(F.lit(ignore))).select(voxels.columns)
