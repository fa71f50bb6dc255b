"""The manifest from end to end: groups, split, weights, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import assertions as A
from quarrylake.operators import dedup, split
from quarrylake.operators.storage import broadcast_if_small, cut


def build(cases: DataFrame, fraction: float = 0.2, seed: int = 42, threshold: float = 0.85, beta: float = 0.99, low: float = 0.25, high: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(manifest, audit) of cases (case_id, feature_path, report_paths, texts); groups never span both splits."""
    reports = cases.select(F.col("case_id").alias("id"), F.explode("texts").alias("text"))
    found = cut(A.extract_assertions(reports))
    groups = dedup.duplicate_groups(reports, threshold).withColumnRenamed("id", "case_id")

    def gathered(labels: DataFrame, name: str) -> DataFrame:
        return labels.groupBy(F.col("id").alias("case_id")).agg(F.array_sort(F.collect_set("label")).alias(name))

    none = F.array().cast("array<string>")
    m = cases.join(groups, "case_id").join(gathered(A.labels(found), "labels"), "case_id", "left").join(gathered(A.labels(found, by_group=False), "weighting_labels"), "case_id", "left")
    m = cut(m.withColumns({"labels": F.coalesce("labels", none), "weighting_labels": F.coalesce("weighting_labels", none)}))
    valid = split.split_by_kinds(m, fraction, seed).withColumn("valid", F.lit(True))
    m = cut(m.join(broadcast_if_small(valid), "duplicate_group", "left").withColumn("split", F.when(F.col("valid"), "valid").otherwise("train")).drop("valid"))
    weights = split.effective_weights(m.where("split = 'train'").select("case_id", F.col("weighting_labels").alias("labels")), beta, low, high)
    m = m.join(weights, "case_id", "left").withColumn("sampling_weight", F.coalesce("weight", F.lit(1.0))).drop("weight")
    return m, split.audit(m.withColumnRenamed("sampling_weight", "weight"))
