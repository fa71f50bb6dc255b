"""Pooling, geometry, windows and intensities of volumes in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators.storage import BROADCAST_ROWS, broadcast_if_small

AXES = ("z", "y", "x")


def global_pool(features: DataFrame) -> DataFrame:
    """(case_id, c, mean, max) of features (case_id, c, z, y, x, v)."""
    return features.groupBy("case_id", "c").agg(F.avg("v").alias("mean"), F.max("v").alias("max"))


def region_pool(features: DataFrame, labels: DataFrame, regions: DataFrame) -> DataFrame:
    """(case_id, label, c, mean, max) of each region (label) asked for; zeros where a case lacks it."""
    j = features.join(labels, ["case_id", *AXES]).groupBy("case_id", "label", "c").agg(F.avg("v").alias("mean"), F.max("v").alias("max"))
    grid = features.select("case_id", "c").distinct().crossJoin(broadcast_if_small(regions))
    return grid.join(j, ["case_id", "label", "c"], "left").fillna(0.0, ["mean", "max"]).select("case_id", "label", "c", "mean", "max")


def present_regions(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(case_id, label, name) of non-zero labels; label_<n> without a name."""
    found = labels.where("label <> 0").select("case_id", "label").distinct().join(broadcast_if_small(names), "label", "left")
    return found.select("case_id", "label", F.coalesce("name", F.concat(F.lit("label_"), F.col("label").cast("string"))).alias("name"))


def region_geometry(labels: DataFrame, affine: list[list[float]] | None = None) -> DataFrame:
    """(case_id, label, voxel_count, centroid, bbox): the affine of the mean voxel (x, y, z), and the half-open box."""
    a = labels.where("label <> 0").groupBy("case_id", "label").agg(
        F.count("*").alias("voxel_count"), *(F.avg(k).alias(f"m{k}") for k in "xyz"), *(F.min(k).alias(f"lo{k}") for k in "xyz"), *((F.max(k) + 1).alias(f"hi{k}") for k in "xyz"))
    m = affine or [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    centroid = F.array(*(sum((F.lit(float(r[k])) * F.col(f"m{x}") for k, x in enumerate("xyz")), F.lit(float(r[3]))) for r in m[:3]))
    return a.select("case_id", "label", "voxel_count", centroid.alias("centroid"), F.array(*(f"lo{k}" for k in "xyz"), *(f"hi{k}" for k in "xyz")).alias("bbox"))


def region_metadata(regions: DataFrame) -> DataFrame:
    """regions (case_id, label, cx, cy, cz, x0, y0, z0, x1, y1, z1, voxels) scaled within each case: centroids to -1..1, boxes to 0..1, log volumes to the largest."""
    w = W.partitionBy("case_id")
    out = [F.col("case_id"), F.col("label")]
    for k in "xyz":
        lo, extent = F.min(f"c{k}").over(w), F.greatest(F.max(f"c{k}").over(w) - F.min(f"c{k}").over(w), F.lit(1.0))
        out.append((2.0 * (F.col(f"c{k}") - lo) / extent - 1.0).alias(f"c{k}"))
    for end in "01":
        for k in "xyz":
            lo, extent = F.min(f"{k}0").over(w), F.greatest(F.max(f"{k}1").over(w) - F.min(f"{k}0").over(w), F.lit(1.0))
            out.append(((F.col(f"{k}{end}") - lo) / extent).alias(f"{k}{end}"))
    out.append((F.log1p("voxels") / F.greatest(F.log1p(F.max("voxels").over(w)), F.lit(1.0))).alias("volume"))
    return regions.select(*out)


def adaptive_pool(features: DataFrame, shape: dict[str, int], grid: int) -> DataFrame:
    """(case_id, token, c, mean, max): grid**3 bins, z-major; bins overlap where the grid does not divide the shape."""
    f = features
    for k in AXES:
        n = shape[k]
        first = F.floor(F.col(k) * grid / n)
        # the bin that holds the place, and the next ones that begin at or before it
        bins = F.filter(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(first + 1, F.lit(grid - 1))), lambda b: (F.col(k) >= F.floor(b * n / grid)) & (F.col(k) < F.ceil((b + 1) * n / grid)))
        f = f.withColumn(f"b{k}", F.explode(bins))
    token = (F.col("bz") * grid + F.col("by")) * grid + F.col("bx")
    return f.groupBy("case_id", token.cast("int").alias("token"), "c").agg(F.avg("v").alias("mean"), F.max("v").alias("max"))


def gaussian_weight(offset: Column, size: int, share: float = 0.125) -> Column:
    """Importance of a place in a window along one axis."""
    sigma, centre = size * share, size // 2
    return F.exp(-0.5 * F.pow((offset - centre) / sigma, F.lit(2.0)))


def overlap_add(windows: DataFrame, least: float = 1e-7) -> DataFrame:
    """(case_id, c, z, y, x, v) of window values (..., v, g): their mean weighted by g."""
    return windows.groupBy("case_id", "c", *AXES).agg((F.sum(F.col("v") * F.col("g")) / F.greatest(F.sum("g"), F.lit(least))).alias("v"))


def nonzero_box(volume: DataFrame) -> DataFrame:
    """(case_id, z0, z1, y0, y1, x0, x1): the half-open box of places where any channel is not 0."""
    v = volume.where("v <> 0").groupBy("case_id")
    return v.agg(*(e for k in AXES for e in (F.min(k).alias(f"{k}0"), (F.max(k) + 1).alias(f"{k}1"))))


def crop(volume: DataFrame, boxes: DataFrame) -> DataFrame:
    j = volume.join(boxes, "case_id")
    for k in AXES:
        j = j.where((F.col(k) >= F.col(f"{k}0")) & (F.col(k) < F.col(f"{k}1"))).withColumn(k, F.col(k) - F.col(f"{k}0"))
    return j.select(*volume.columns)


def uncrop(volume: DataFrame, boxes: DataFrame) -> DataFrame:
    """Places of a cropped volume in the whole one."""
    j = volume.join(boxes, "case_id")
    return j.select(*((F.col(c) + F.col(f"{c}0")).alias(c) if c in AXES else F.col(c) for c in volume.columns))


def _beside(volume: DataFrame, own: DataFrame) -> DataFrame:
    """volume with the figures of its case and channel, which were aggregated rather than held in a window over a whole volume."""
    return volume.join(broadcast_if_small(own), ["case_id", "c"])


def z_score(volume: DataFrame, least: float = 1e-8) -> DataFrame:
    """volume with v less its case's and channel's mean, by the population's deviation."""
    own = volume.groupBy("case_id", "c").agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_deviation"))
    return _beside(volume, own).withColumn("v", (F.col("v") - F.col("_mean")) / F.greatest("_deviation", F.lit(least))).select(volume.columns)


def ct_normalize(v: Column, mean: float, std: float, low: float, high: float) -> Column:
    return (F.least(F.greatest(v, F.lit(low)), F.lit(high)) - mean) / max(std, 1e-8)


def rescale(volume: DataFrame) -> DataFrame:
    """volume with v brought to 0..1 in each case and channel."""
    own = volume.groupBy("case_id", "c").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return _beside(volume, own).withColumn("v", (F.col("v") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-8))).select(volume.columns)


def resampled_size(size: Column, spacing: Column, target: Column) -> Column:
    return F.bround(spacing / target * size).cast("int")


def nearest_index(i: Column, source: int, target: int) -> Column:
    return F.least(F.floor(i * source / target), F.lit(source - 1)).cast("int")


def foreground_locations(voxels: DataFrame, most: int = 10000, share: float = 0.01, seed: int = 1234) -> DataFrame:
    """For each class of a case max(min(most, n), ceil(share n)) of its n places, picked by a seeded hash."""
    w = W.partitionBy("case_id", "label")
    order = F.xxhash64("z", "y", "x", F.lit(seed))
    v = voxels.where("label > 0").withColumns({"_k": F.row_number().over(w.orderBy(order, "z", "y", "x")), "_n": F.count("*").over(w)})
    return v.where(F.col("_k") <= F.greatest(F.least(F.lit(most), F.col("_n")), F.ceil(F.col("_n") * share))).drop("_k", "_n")


def image_tokens(global_tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """(case_id, pos, type_id, region_label, feat): global tokens by number, then regions in the order given by k."""
    g = global_tokens.select("case_id", F.struct(F.lit(0).alias("type_id"), F.col("token").cast("long").alias("k")).alias("o"), F.lit(0).cast("long").alias("region_label"), "feat")
    r = regions.select("case_id", F.struct(F.lit(1).alias("type_id"), F.col("k").cast("long").alias("k")).alias("o"), F.col("label").cast("long").alias("region_label"), "feat")
    w = W.partitionBy("case_id").orderBy("o")
    return g.unionByName(r).select("case_id", (F.row_number().over(w) - 1).alias("pos"), F.col("o.type_id").alias("type_id"), "region_label", "feat")


def pad(arrays: DataFrame, column: str, value: float = 0.0) -> DataFrame:
    """arrays with the column filled up to the longest of its batch and mask, 1 for what was there."""
    longest = arrays.groupBy("batch").agg(F.max(F.size(column)).alias("_longest"))
    fill = F.col("_longest") - F.size(column)
    return arrays.join(broadcast_if_small(longest), "batch").withColumns({"mask": F.concat(F.array_repeat(F.lit(1), F.size(column)), F.array_repeat(F.lit(0), fill)), column: F.concat(column, F.array_repeat(F.lit(value), fill))}).drop("_longest")


def least_weight(weights: DataFrame) -> DataFrame:
    """weights (..., g) with zeros raised to the least weight that is not zero, so that every place counts."""
    least = weights.agg(F.min(F.when(F.col("g") > 0, F.col("g"))).alias("_least"))
    return weights.crossJoin(least).withColumn("g", F.when(F.col("g") > 0, F.col("g")).otherwise(F.col("_least"))).drop("_least")


def crop_to_nonzero(volume: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(volume, labels) cropped to the box of places where a channel is not 0; labels of 0 outside the filled non-zero part become -1."""
    from quarrylake.operators.augmentation import PLACE, filled

    boxes = nonzero_box(volume)
    inner = filled(volume.where("v <> 0").select(*PLACE).distinct(), volume.select(*PLACE).distinct()).withColumn("_in", F.lit(True))
    outside = labels.join(inner, PLACE, "left").withColumn("label", F.when((F.col("label") == 0) & F.col("_in").isNull(), -1).otherwise(F.col("label"))).select(labels.columns)
    return crop(volume, boxes), crop(outside, boxes)


def uncropped_probabilities(probabilities: DataFrame, boxes: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(case_id, c, z, y, x, v): probabilities of a crop in the whole volume; outside of it channel 0, the background, has 1."""
    cases = probabilities.select("case_id", "c").distinct()
    for a in AXES:
        cases = cases.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(sizes[a] - 1))))
    known = uncrop(probabilities, boxes).withColumnRenamed("v", "_v")
    whole = cases.join(known, ["case_id", "c", *AXES], "left").join(broadcast_if_small(boxes), "case_id")
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1"))
    return whole.select("case_id", "c", *AXES, F.when(inside, F.col("_v")).when(F.col("c") == 0, 1.0).otherwise(0.0).alias("v"))


def masked_z_score(volume: DataFrame, least: float = 1e-8) -> DataFrame:
    """volume (..., v, inside) with v standardised by the places inside alone; the others are left at 0."""
    inside = F.when(F.col("inside"), F.col("v"))
    own = volume.groupBy("case_id", "c").agg(F.avg(inside).alias("_mean"), F.stddev_pop(inside).alias("_deviation"))
    z = (F.col("v") - F.col("_mean")) / F.greatest("_deviation", F.lit(least))
    return _beside(volume, own).withColumn("v", F.when(F.col("inside"), z).otherwise(0.0)).select(volume.columns)


def rgb_normalize(v: Column) -> Column:
    """Intensities of 0 to 255 as 0 to 1; others raise."""
    return F.when(v.between(0, 255), v / 255.0).otherwise(F.raise_error(F.lit("not an RGB intensity")).cast("double"))


def separate_axis(spacing: Column, threshold: float = 3.0) -> Column:
    """The axis (0, 1, 2) of a volume that is resampled by itself: the only coarsest one, if it is threshold times the finest; else NULL."""
    most = F.array_max(spacing)
    alone = F.size(F.filter(spacing, lambda s: s == most)) == 1
    return F.when((most / F.array_min(spacing) > threshold) & alone, (F.array_position(spacing, most) - 1).cast("int"))


def resampled(volume: DataFrame, source: dict[str, int], target: dict[str, int], linear: bool = False) -> DataFrame:
    """volume (case_id, ..., z, y, x, v) of the source's size at the target's: the nearest place, or between neighbours along each axis.

    Places are the middles of voxels; beyond the outermost ones their values continue.
    """
    rest = [c for c in volume.columns if c not in (*AXES, "v")]
    for a in AXES:
        n, m = source[a], target[a]
        grid = volume.sparkSession.range(m).select(F.col("id").cast("int").alias("_to"))
        at = F.greatest(F.least((F.col("_to") + 0.5) * n / m - 0.5, F.lit(n - 1.0)), F.lit(0.0))
        if linear:
            low = F.floor(at)
            pairs = grid.select("_to", F.explode(F.array(F.struct(low.alias("k"), (1 - (at - low)).alias("g")), F.struct(F.least(low + 1, F.lit(n - 1)).alias("k"), (at - low).alias("g")))).alias("p")).select("_to", F.col("p.k").cast("int").alias(a), F.col("p.g").alias("g")).where("g > 0")
        else:
            pairs = grid.select("_to", F.least(F.floor((F.col("_to") + 0.5) * n / m), F.lit(n - 1)).cast("int").alias(a), F.lit(1.0).alias("g"))
        others = [b for b in AXES if b != a]
        few = 2 * m <= BROADCAST_ROWS  # a place has two sources at most
        volume = volume.join(F.broadcast(pairs) if few else pairs, a).groupBy(*rest, *others, F.col("_to").alias(a)).agg(F.sum(F.col("v") * F.col("g")).alias("v"))
    return volume.select(*rest, *AXES, "v")


def preprocessed(volume: DataFrame, labels: DataFrame, order: list[int], sizes: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(volume, labels) transposed, cropped to what is not zero, standardised and brought to the sizes, each case from the size of its own crop.

    Intensities are resampled along lines, labels by the nearest place; for splines and target spacings see resampling.preprocessed_cases.
    """
    from quarrylake.operators.planning import transpose
    from quarrylake.operators.resampling import resampled_cases

    v = transpose(volume, order)
    extent = F.array(*(F.col(f"{a}1") - F.col(f"{a}0") for a in AXES))
    grids = nonzero_box(v).select("case_id", extent.alias("n"), F.array(*(F.lit(sizes[a]) for a in AXES)).alias("m"), F.lit(None).cast("int").alias("separate"))
    v, s = crop_to_nonzero(v, transpose(labels, order))
    return resampled_cases(z_score(v), grids, order=1, clip=False), resampled_cases(s.withColumnRenamed("label", "v"), grids, order=0, clip=False).withColumn("label", F.col("v").cast("int")).drop("v")


def grid_affine(affine: Column, origin: Column, scale: Column) -> Column:
    """The affine of a feature grid: 3 x 4 rows of a volume's affine, moved to the crop's origin and scaled by voxels a cell.

    The middle of cell 0 lies (scale - 1) / 2 voxels behind the origin on each axis.
    """
    def row(r):
        cells = [F.get(r, F.lit(k)) * F.get(scale, F.lit(k)) for k in range(3)]
        start = F.get(r, F.lit(3))
        for k in range(3):
            start = start + F.get(r, F.lit(k)) * (F.get(origin, F.lit(k)) + (F.get(scale, F.lit(k)) - 1) / 2)
        return F.array(*cells, start)

    return F.transform(affine, row)
