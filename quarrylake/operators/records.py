"""Records around a pipeline: keys, summaries, dataset descriptions, plans, run names, upserts and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def label_key(region: Column) -> Column:
    """A label or a region (array of labels) as text: 3, or (1, 2)."""
    return F.when(F.size(region) == 1, region[0].cast("string")).otherwise(F.concat(F.lit("("), F.array_join(region.cast("array<string>"), ", "), F.lit(")")))


def typed_key(key: Column) -> Column:
    """The labels that such a text stands for."""
    return F.transform(F.regexp_extract_all(key, F.lit("-?[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """(by..., summary): JSON of {region: {metric: value}} from metrics (by..., region array, metric, value), keys sorted."""
    per = metrics.groupBy(*by, label_key(F.col("region")).alias("key")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    return per.groupBy(*by).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.to_json("m").alias("m")))))).alias("summary"))


def read_summary(text: Column) -> Column:
    """(region, metrics) of each entry of a summary."""
    return F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(typed_key(e["key"]).alias("region"), F.from_json(e["value"], "map<string,double>").alias("metrics")))


def missing_keys(present: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), present)


def checkpoint_problem(checkpoint: DataFrame, required: list[str]) -> DataFrame:
    """(name, problem) of checkpoints (name, keys array, weights map) that lack a key or hold no weights."""
    lacks = missing_keys(F.col("keys"), required)
    problem = F.when(F.size(lacks) > 0, F.concat(F.lit("missing "), F.array_join(lacks, ", "))).when(F.coalesce(F.size("weights"), F.lit(0)) <= 0, "no weights")
    return checkpoint.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def merged(a: Column, b: Column) -> Column:
    """Two maps in one; b wins."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in order; maxima are taken before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with rows of equal keys replaced by those of new."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def benchmark_key(cudnn: Column, torch: Column, gpu: Column, gpus: Column) -> Column:
    return F.concat(F.lit("cudnn_"), cudnn, F.lit("__torch_"), torch, F.lit("__"), F.regexp_replace(gpu, " ", ""), F.lit("__gpus_"), gpus.cast("string"))


def collated(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): what was gathered under each key, in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def candidates(*roots: DataFrame) -> DataFrame:
    """Distinct names (name) found under any root."""
    out = roots[0].select("name")
    for r in roots[1:]:
        out = out.unionByName(r.select("name"))
    return out.distinct()


def dataset_description(channels: DataFrame, labels: DataFrame, cases: int, ending: str) -> DataFrame:
    """One row (description): JSON with channel_names, labels, numTraining and file_ending; channels: (number, name), labels: (name, value)."""
    c = channels.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("number").cast("string").alias("k"), "name")))).alias("channel_names"))
    n = labels.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("labels"))
    # both are single rows
    return c.join(n).select(F.to_json(F.struct("channel_names", "labels", F.lit(cases).alias("numTraining"), F.lit(ending).alias("file_ending"))).alias("description"))


def migrated(description: Column) -> Column:
    """A former dataset description (JSON): labels inverted to {name: number}, modality renamed to channel_names, lists of files dropped."""
    old = F.from_json(description, "labels map<string,string>, modality map<string,string>, file_ending string, numTraining int")
    labels = F.map_from_entries(F.array_sort(F.transform(F.map_entries(old["labels"]), lambda e: F.struct(e["value"].alias("k"), e["key"].cast("int").alias("v")))))
    return F.to_json(F.struct(old["modality"].alias("channel_names"), labels.alias("labels"), F.coalesce(old["file_ending"], F.lit(".nii.gz")).alias("file_ending"), old["numTraining"].alias("numTraining")))


def rehomed(plans: DataFrame, source: str, target: str, name: str) -> DataFrame:
    """plans (dataset, plans_name, identifier) under another dataset: names are replaced, identifiers only where they begin with the old plans' name."""
    begins = F.col("identifier").startswith(F.concat("plans_name", F.lit("_")))
    p = plans.withColumn("identifier", F.when(begins, F.concat(F.lit(f"{name}_"), F.substr("identifier", F.length("plans_name") + 2))).otherwise(F.col("identifier")))
    return p.withColumns({"dataset": F.when(F.col("dataset") == source, target).otherwise(F.col("dataset")), "plans_name": F.lit(name)})


def relative(path: Column, root: Column) -> Column:
    """A path below root without it; other paths stay."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def inference_command(dataset: Column, configuration: Column, plans: Column, trainer: Column, folds: Column, probabilities: Column) -> Column:
    return F.concat_ws(" ", F.lit("predict -d"), dataset, F.lit("-i INPUT -o OUTPUT -f"), F.array_join(folds.cast("array<string>"), " "), F.lit("-tr"), trainer, F.lit("-c"), configuration,
                       F.lit("-p"), plans, F.when(probabilities, F.lit("--save_probabilities")))


def run_name(stamp: Column, stem: Column, rate: Column, overfit: Column, extension: Column) -> Column:
    """Name of a run: time, configuration, and what departs from it (NULL where nothing does)."""
    return F.concat(F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit("_"), stem, F.coalesce(F.concat(F.lit("-LR"), rate.cast("string")), F.lit("")),
                    F.coalesce(F.concat(F.lit("-overfit"), F.when(overfit > 0, overfit.cast("string"))), F.lit("")), F.coalesce(F.concat(F.lit("-"), F.when(extension != "", extension)), F.lit("")))


def utc_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fastest_epoch(epochs: DataFrame, *by: str) -> DataFrame:
    """(by..., seconds): the shortest time between the starts of neighbouring epochs; epochs: (by..., at timestamp)."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    own = at - F.lag(at).over(W.partitionBy(*by).orderBy("at"))
    return epochs.withColumn("_t", own).groupBy(*by).agg((F.min("_t") / 1e6).alias("seconds"))


def assertion_order(assertions: Column) -> Column:
    """An array of assertions in the order of their fields, NULLs first in each."""
    return F.sort_array(assertions)


def reference_union(assertions: DataFrame) -> DataFrame:
    """Distinct assertions of all reference reports of a case; assertions: (id, report, ...)."""
    return assertions.drop("report").distinct()
