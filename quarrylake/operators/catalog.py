"""Names, file sets, labels and configurations: the small relational pieces around a pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def model_identifier(trainer: Column, plans: Column, configuration: Column) -> Column:
    return F.concat_ws("__", trainer, plans, configuration)


def parse_identifier(identifier: Column) -> Column:
    """(trainer, plans, configuration) of a model identifier."""
    p = F.split(identifier, "__")
    return F.struct(F.get(p, F.lit(0)).alias("trainer"), F.get(p, F.lit(1)).alias("plans"), F.get(p, F.lit(2)).alias("configuration"))


def ensemble_name(a: Column, b: Column, folds: Column) -> Column:
    return F.concat(F.lit("ensemble___"), a, F.lit("___"), b, F.lit("___"), F.array_join(folds.cast("array<string>"), "_"))


def missing_files(wanted: DataFrame, present: DataFrame, key: str = "file") -> DataFrame:
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def datasets_by_id(names: DataFrame, number: int) -> DataFrame:
    """Distinct names that begin with the dataset's number; more or fewer than one is the caller's error."""
    return names.where(F.col("name").startswith(f"Dataset{number:03d}_")).select("name").distinct()


def available_folds(folders: DataFrame) -> DataFrame:
    """Numbers of the fold_<n> folders (folder, has_checkpoint) with a checkpoint."""
    return folders.where(F.col("has_checkpoint") & F.col("folder").rlike("^fold_[0-9]+$")).select(F.regexp_extract("folder", "([0-9]+)$", 1).cast("int").alias("fold"))


def label_problems(labels: DataFrame) -> DataFrame:
    """(problem) of a label dictionary (name, value): background must be 0, ignore must follow the largest label."""
    value = {n: F.max(F.when(F.col("name") == n, F.col("value"))) for n in ("background", "ignore")}
    top = F.max(F.when(F.col("name") != "ignore", F.col("value")))
    a = labels.agg(value["background"].alias("b"), value["ignore"].alias("i"), top.alias("top"))
    problems = F.array(F.when(F.coalesce(F.col("b") != 0, F.lit(True)), "background must be 0"), F.when(F.col("i") != F.col("top") + 1, "ignore must be the largest label"))
    return a.select(F.explode(F.array_compact(problems)).alias("problem"))


def resolve_configuration(configurations: dict[str, dict], name: str) -> dict:
    """A configuration with all that it inherits (inherits_from); its own values win. Unknown names and cycles raise."""
    chain: list[str] = []
    while name is not None:
        if name not in configurations:
            raise KeyError(f"unknown configuration {name}")
        if name in chain:
            raise ValueError(f"circular inheritance: {' > '.join([*chain, name])}")
        chain.append(name)
        name = configurations[name].get("inherits_from")
    merged: dict = {}
    for n in reversed(chain):
        merged |= {k: v for k, v in configurations[n].items() if k != "inherits_from"}
    return merged


def overfit_status(exact: Column, change: Column, follows: Column, stays: Column, high: float = 0.9) -> Column:
    """What an overfitting run shows: it has not learned its cases, it repeats them whatever the image, or it uses the image."""
    return F.when(exact < high, "not_memorized").when((change > 0) & (follows > stays), "uses_image").otherwise("ignores_image")


def affine_point(matrix: Column, point: Column) -> Column:
    """The point (x, y, z) under a 3 x 4 matrix given by rows."""
    return F.transform(matrix, lambda r: F.get(r, F.lit(0)) * F.get(point, F.lit(0)) + F.get(r, F.lit(1)) * F.get(point, F.lit(1)) + F.get(r, F.lit(2)) * F.get(point, F.lit(2)) + F.get(r, F.lit(3)))


def window_grid(starts: DataFrame) -> DataFrame:
    """(case_id, z, y, x) of all windows from starts (case_id, z, y, x), arrays of starts by axis."""
    g = starts
    for k in ("z", "y", "x"):
        g = g.withColumn(k, F.explode(k))
    return g


def the_dataset(names: DataFrame, number: int) -> str:
    """The one name of a dataset's number; none or several raise."""
    found = [r["name"] for r in datasets_by_id(names, number).orderBy("name").limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"dataset {number}: {', '.join(found) or 'none'}")
    return found[0]
