"""Evaluation of label maps in long form: one row a voxel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators.ordering import ordered_index
from quarrylake.operators.storage import broadcast_if_small, parts_for


def align(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(case_id, z, y, x, ref, pred) of voxels (case_id, z, y, x, label) that both have."""
    at = ["case_id", "z", "y", "x"]
    return reference.withColumnRenamed("label", "ref").join(predicted.withColumnRenamed("label", "pred"), at)


def region_mask(label: Column, region: Column) -> Column:
    """Whether a label belongs to a region, an array of labels."""
    return F.array_contains(region, label)


def confusion(voxels: DataFrame, regions: DataFrame, ignore: int | None = None) -> DataFrame:
    """(case_id, region, tp, fp, fn, tn, n_pred, n_ref, dice, iou); voxels: (case_id, ref, pred), regions: (region, labels).

    The label maps are counted as (case, ref, pred) first, so regions meet counts and not voxels. Dice and IoU are
    NULL where neither side has the region.
    """
    v = voxels if ignore is None else voxels.where(F.col("ref") != ignore)
    c = v.groupBy("case_id", "ref", "pred").agg(F.count("*").alias("n"))
    j = c.crossJoin(broadcast_if_small(regions))
    r, p, n = region_mask(F.col("ref"), F.col("labels")), region_mask(F.col("pred"), F.col("labels")), F.col("n")
    a = j.groupBy("case_id", "region").agg(*(F.sum(F.when(x, n).otherwise(0)).alias(k) for k, x in (("tp", r & p), ("fp", ~r & p), ("fn", r & ~p), ("tn", ~r & ~p))))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select("*", (tp + fp).alias("n_pred"), (tp + fn).alias("n_ref"), F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("dice"), F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).alias("iou"))


def mean_per_region(metrics: DataFrame) -> DataFrame:
    """(region, dice, iou): means that leave missing values out."""
    return metrics.groupBy("region").agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"))


def foreground_mean(metrics: DataFrame) -> DataFrame:
    """One row: means over all regions but 0; a missing region makes them missing."""
    m = mean_per_region(metrics).where("region <> 0")
    return m.agg(*(F.when(F.count(x) == F.count("*"), F.avg(x)).alias(x) for x in ("dice", "iou")))


def softmax(scores: DataFrame, by: list[str]) -> DataFrame:
    w = W.partitionBy(*by)
    e = scores.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def argmax_label(probabilities: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label): the class of the largest p, the lowest one on ties."""
    return probabilities.groupBy(*by).agg(F.min_by("label", F.struct((-F.col("p")).alias("a"), F.col("label").alias("b"))).alias("label"))


def ordered_regions(probabilities: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by..., label) of region probabilities (by..., ord, label, p): the last region in order above the threshold, else 0."""
    hit = F.when(F.col("p") > threshold, F.struct("ord", "label"))
    return probabilities.groupBy(*by).agg(F.coalesce(F.max(hit)["label"], F.lit(0)).alias("label"))


def ensemble(probabilities: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label) of the classes with the largest mean p over models."""
    return argmax_label(probabilities.groupBy(*by, "label").agg(F.avg("p").alias("p")), by)


def incomplete_files(files: DataFrame) -> DataFrame:
    """(file, models) of files (model, file) that not all models have."""
    n = files.agg(F.countDistinct("model").alias("n"))
    return files.groupBy("file").agg(F.countDistinct("model").alias("models")).crossJoin(F.broadcast(n)).where("models < n").select("file", "models")


def repeated_cases(folds: DataFrame) -> DataFrame:
    """(case_id, n) of cases that several folds predict."""
    return folds.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")


def best_configuration(scores: DataFrame) -> DataFrame:
    """The row of scores (name, ord, dice) with the largest dice, the earliest on ties."""
    return scores.orderBy(F.col("dice").desc(), "ord").limit(1)


def model_pairs(models: DataFrame) -> DataFrame:
    """(a, b) of models (name, ord) with a before b."""
    b = models.select(F.col("name").alias("b"), F.col("ord").alias("ord_b"))
    return models.join(b, F.col("ord") < F.col("ord_b")).select(F.col("name").alias("a"), "b")


def results_matrix(results: DataFrame, folds: list[int]) -> DataFrame:
    """One row for each (dataset, config): dice by fold, NULL for missing, and their mean."""
    wide = results.groupBy("dataset", "config").pivot("fold", folds).agg(F.avg("dice"))
    wide = wide.select("dataset", "config", *(F.col(f"`{k}`").alias(f"fold_{k}") for k in folds))
    mean = results.where(F.col("fold").isin(folds)).groupBy("dataset", "config", "fold").agg(F.avg("dice").alias("d")).groupBy("dataset", "config").agg(F.avg("d").alias("mean"))
    return wide.join(mean, ["dataset", "config"], "left")


def benchmark_matrix(runs: DataFrame, gpus: list[str]) -> DataFrame:
    """One row for each dataset: the fastest epoch by GPU as text, MISSING where there is none; rows without any are left out."""
    wide = runs.groupBy("dataset").pivot("gpu", gpus).agg(F.min("epoch_seconds"))
    wide = wide.where(F.coalesce(*(F.col(f"`{g}`") for g in gpus)).isNotNull())
    return wide.select("dataset", *(F.coalesce(F.col(f"`{g}`").cast("decimal(18,3)").cast("string"), F.lit("MISSING")).alias(g) for g in gpus))


def fingerprint(samples: DataFrame) -> DataFrame:
    """(channel, mean, median, std, min, max, p99_5, p0_5) of foreground intensities (channel, value)."""
    a = samples.groupBy("channel").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    # percentiles from counts of values in order, interpolated between neighbouring places
    h = samples.where("value IS NOT NULL").groupBy("channel", "value").agg(F.count("*").alias("c"))
    h = h.withColumn("upto", F.sum("c").over(W.partitionBy("channel").orderBy("value"))).join(broadcast_if_small(a.select("channel", "n")), "channel")
    names = {"median": 0.5, "p99_5": 0.995, "p0_5": 0.005}
    at = {k: (F.col("n") - 1) * F.lit(q) for k, q in names.items()}
    ends = h.groupBy("channel").agg(*(F.min(F.when(F.col("upto") > f(p), F.struct("value", p.alias("p")))).alias(f"{k}_{side}") for k, p in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))))
    value = {k: F.col(f"{k}_lo.value") + (F.col(f"{k}_hi.value") - F.col(f"{k}_lo.value")) * (F.col(f"{k}_lo.p") - F.floor(f"{k}_lo.p")) for k in names}
    return a.join(ends, "channel").select("channel", "mean", value["median"].alias("median"), "std", "min", "max", value["p99_5"].alias("p99_5"), value["p0_5"].alias("p0_5"))


def target_spacing(spacings: DataFrame, sizes: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(axis, spacing): the median spacing; on an anisotropic worst axis the 10th percentile, but above the others.

    spacings: (case_id, axis, spacing), sizes: (case_id, axis, size).
    """
    m = spacings.groupBy("axis").agg(F.percentile("spacing", F.lit(0.5)).alias("spacing"), F.percentile("spacing", F.lit(0.1)).alias("p10"))
    s = sizes.groupBy("axis").agg(F.percentile("size", F.lit(0.5)).alias("size"))
    j = m.join(s, "axis")
    worst = j.agg(F.max_by("axis", F.struct("spacing", -F.col("axis"))).alias("worst"))
    k = j.crossJoin(F.broadcast(worst))
    others = k.where("axis <> worst").agg(F.max("spacing").alias("other_spacing"), F.min("size").alias("other_size"))
    k = k.crossJoin(F.broadcast(others))
    uneven = (F.col("axis") == F.col("worst")) & (F.col("spacing") > threshold * F.col("other_spacing")) & (F.col("size") * threshold < F.col("other_size"))
    floor = F.greatest("other_spacing", "p10")
    return k.select("axis", F.when(uneven, F.when(F.col("p10") < F.col("other_spacing"), floor + 1e-5).otherwise(F.col("p10"))).otherwise(F.col("spacing")).alias("spacing"))


def unexpected_labels(voxels: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, label) that occur and are not in expected (label)."""
    return voxels.select("case_id", "label").distinct().join(broadcast_if_small(expected), "label", "left_anti").select("case_id", "label")


def label_gaps(labels: DataFrame) -> DataFrame:
    """(label, previous) where the numbers of labels are not consecutive."""
    at = ordered_index(labels.select("label").distinct(), ["label"])
    return at.join(at.select(F.col("label").alias("previous"), (F.col("idx") + 1).alias("idx")), "idx").where("label - previous <> 1").select("label", "previous")


def one_hot(voxels: DataFrame, labels: list[int]) -> DataFrame:
    return voxels.select("*", *((F.col("label") == k).cast("int").alias(f"is_{k}") for k in labels))


def remap(voxels: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """voxels with mapped labels; a label without a mapping is NULL, to be found by the caller."""
    return voxels.withColumn("label", F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[F.col("label")])


def adopt_postprocessing(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (adopt): whether the mean over regions improves and no region worsens; both: (region, dice)."""
    j = before.select("region", F.col("dice").alias("b")).join(after.select("region", F.col("dice").alias("a")), "region")
    return j.agg((F.coalesce(F.avg("a") > F.avg("b"), F.lit(False)) & (F.count_if(F.col("a") < F.col("b")) == 0)).alias("adopt"))


#: Places of a tile along the axes, and voxels in a part.
TILE, VOXELS = {"z": 64, "y": 64, "x": 256}, 500_000


def _roots(at: dict):
    """The order of a tile's voxels by (z, y, x), and for each in that order the first voxel of its face-connected component."""
    import numpy as np

    order = np.lexsort((at["x"], at["y"], at["z"]))
    z, y, x = (at[a][order] - at[a].min() for a in "zyx")
    # one place more along an axis, so that ends of lines are no neighbours
    wide, plane = TILE["x"] + 1, (TILE["x"] + 1) * (TILE["y"] + 1)
    code = z * plane + y * wide + x
    first, second = [], []
    for step in (1, wide, plane):
        to = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
        mine = np.flatnonzero(code[to] == code + step)
        first.append(mine)
        second.append(to[mine])
    i, j, root = np.concatenate(first), np.concatenate(second), np.arange(len(code))
    while len(i):
        lo, hi = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return order, root


def _in_tiles(voxels: DataFrame, only: DataFrame | None, brief: bool) -> DataFrame:
    """(case_id, rz, ry, rx, n, z, y, x): each voxel with the first one of its component inside its tile.

    brief: instead, of each tile the voxels on its faces, and with their sizes n (and no place) the components that reach a
    face and the largest one that does not. only: (case_id, _z, _y, _x), the tiles to be looked at.
    """
    import numpy as np
    import pyarrow as pa

    kind, tiles = dict(voxels.dtypes)["case_id"], ["case_id", "_z", "_y", "_x"]
    v = voxels.select("case_id", *(F.col(a).cast("long").alias(a) for a in "zyx"), *(F.floor(F.col(a) / TILE[a]).cast("long").alias(f"_{a}") for a in "zyx"))
    if only is not None:
        v = v.join(broadcast_if_small(only), tiles, "left_semi")
    tile = TILE

    def found(table):
        at = {a: table.column(a).to_numpy() for a in "zyx"}
        order, root = _roots(at)
        at = {a: x[order] for a, x in at.items()}
        if not brief:
            whose, n, places = root, pa.nulls(len(root), pa.int64()), {a: pa.array(x) for a, x in at.items()}
        else:
            face = np.zeros(len(root), bool)
            for a, x in at.items():
                face |= (x % tile[a] == 0) | (x % tile[a] == tile[a] - 1)
            size = np.bincount(root, minlength=len(root))
            open_ = np.zeros(len(root), bool)
            open_[root[face]] = True
            inside = np.where(open_, 0, size)
            if inside.max() > 0:
                open_[inside.argmax()] = True
            own = np.flatnonzero(open_)
            on = np.flatnonzero(face)
            whose = np.concatenate([own, root[on]])
            n = pa.concat_arrays([pa.array(size[own].astype("int64")), pa.nulls(len(on), pa.int64())])
            places = {a: pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(x[on])]) for a, x in at.items()}
        case = pa.array(table.column("case_id").slice(0, 1).to_pylist() * len(whose), table.schema.field("case_id").type)
        return pa.Table.from_arrays([case, *(pa.array(at[a][whose]) for a in "zyx"), n, *(places[a] for a in "zyx")], names=["case_id", "rz", "ry", "rx", "n", "z", "y", "x"])

    out = f"case_id {kind}, rz long, ry long, rx long, n long, z long, y long, x long"
    return v.repartition(parts_for(v, VOXELS), *tiles).distinct().groupBy(*tiles).applyInArrow(lambda table: found(table), out)


def largest_component(voxels: DataFrame) -> DataFrame:
    """Of foreground voxels (case_id, z, y, x) those of each case's largest face-connected component.

    Components are found inside tiles; only those that reach a face of their tile are links of a graph, and only tiles of the
    largest components are gone through again for their voxels.
    """
    from quarrylake.operators.components import connected_components
    from quarrylake.operators.storage import cut

    node = F.concat_ws(":", "case_id", *(F.lpad(F.col(f"r{a}").cast("string"), 9, "0") for a in "zyx"))
    brief = cut(_in_tiles(voxels, None, True).withColumn("node", node))
    face = brief.where("n IS NULL").select("case_id", "z", "y", "x", "node")
    steps = [F.when(F.pmod(F.col(a), F.lit(TILE[a])) == TILE[a] - 1, F.struct(*((F.col(b) + int(a == b)).alias(b) for b in "zyx"))) for a in "zyx"]
    to = face.select("case_id", F.col("node").alias("a"), F.explode(F.array_compact(F.array(*steps))).alias("s")).select("case_id", "a", "s.*")
    edges = cut(to.join(face, ["case_id", "z", "y", "x"]).select("a", F.col("node").alias("b")).distinct())
    joined = connected_components(edges, cut)
    part = brief.where("n IS NOT NULL").join(broadcast_if_small(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = part.groupBy("case_id", "component").agg(F.sum("n").alias("n"))
    best = sizes.groupBy("case_id").agg(F.min_by("component", F.struct((-F.col("n")).alias("a"), F.col("component").alias("b"))).alias("component"))
    own = cut(part.join(best, ["case_id", "component"], "left_semi").select("case_id", "rz", "ry", "rx"))
    tiles = own.select("case_id", *(F.floor(F.col(f"r{a}") / TILE[a]).cast("long").alias(f"_{a}") for a in "zyx")).distinct()
    found = _in_tiles(voxels, tiles, False).join(broadcast_if_small(own), ["case_id", "rz", "ry", "rx"], "left_semi")
    kinds = dict(voxels.dtypes)
    return found.select("case_id", *(F.col(a).cast(kinds[a]).alias(a) for a in "zyx"))


def foreground_slice(voxels: DataFrame) -> DataFrame:
    """(case_id, z): the slice with most foreground, the first on ties."""
    n = voxels.where("label > 0").groupBy("case_id", "z").agg(F.count("*").alias("n"))
    return n.groupBy("case_id").agg(F.min_by("z", F.struct((-F.col("n")).alias("a"), F.col("z").alias("b"))).alias("z"))


def balanced_slice(voxels: DataFrame) -> DataFrame:
    """(case_id, z): the slice with the largest mean share of the case's classes, the first on ties."""
    n = voxels.where("label > 0").groupBy("case_id", "z", "label").agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("case_id", "label")))
    mean = share.groupBy("case_id", "z").agg(F.sum("share").alias("m"))
    return mean.groupBy("case_id").agg(F.min_by("z", F.struct((-F.col("m")).alias("a"), F.col("z").alias("b"))).alias("z"))


def paired_files(reference: DataFrame, predicted: DataFrame, strict: bool = True) -> DataFrame:
    """(file) that both have. Predictions drive: one without a reference raises, and if strict a reference without a prediction."""
    r, p = (df.select("file", F.lit(True).alias(side)).distinct() for df, side in ((reference, "r"), (predicted, "p")))
    j = p.join(r, "file", "full" if strict else "left")
    wrong = F.when(F.col("r").isNull(), "no reference for ").when(F.col("p").isNull(), "no prediction for ")
    return j.select(F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, "file"))).otherwise(F.col("file")).alias("file"))


def accumulated_folds(folds: list[DataFrame]) -> DataFrame:
    """The predictions (case_id, ...) of all folds in one table; a case that several predict raises."""
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f)
    n = out.groupBy("case_id").agg(F.count("*").alias("_n"))
    return out.join(n, "case_id").withColumn("case_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several folds predict "), F.col("case_id").cast("string")))).otherwise(F.col("case_id"))).drop("_n")


def case_problems(cases: DataFrame, channels: int) -> DataFrame:
    """(case_id, problem) of cases (case_id, channels, image_shape, label_shape, image_spacing, label_spacing, undefined)."""
    found = F.array(
        F.when(F.col("channels") != channels, "channels"), F.when(~F.col("image_shape").eqNullSafe(F.col("label_shape")), "shape"),
        F.when(F.exists(F.zip_with("image_spacing", "label_spacing", lambda a, b: F.coalesce(F.abs(a - b) > 1e-5, F.lit(True))), lambda x: x), "spacing"), F.when(F.col("undefined") > 0, "undefined values"))
    return cases.select("case_id", F.explode(F.array_compact(found)).alias("problem"))


def of_version(runs: DataFrame, torch: str, cudnn: int, gpus: int) -> DataFrame:
    """The benchmark runs of one set of versions and number of GPUs."""
    return runs.where((F.col("torch") == torch) & (F.col("cudnn") == cudnn) & (F.col("gpus") == gpus))


def sigmoid(score):
    return 1 / (1 + F.exp(-score))
