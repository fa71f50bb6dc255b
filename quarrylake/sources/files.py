"""Readers and writers of the file layouts that manifests use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "case_id string, feature_path string, report_paths array<string>, labels array<string>, duplicate_group string, template_group string, sampling_weight double"


def stem(path: Column, suffix: str) -> Column:
    """The last part of a path without the suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), rf"\Q{suffix}\E$", "")


def case_id(path: Column, suffix: str = ".nii.gz") -> Column:
    """The case of an input path: the folder above cbct/, or the file's name without its suffix."""
    folder = F.regexp_extract(path, r"([^/]+)/cbct/volume\.nii\.gz$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(folder != "", folder).when(name.endswith(suffix), stem(path, suffix)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def resolve_inputs(paths: DataFrame) -> DataFrame:
    """(case_id, path) of distinct paths (path), by case; raises where a case has several paths or there is none."""
    p = paths.select("path").distinct().withColumn("case_id", case_id(F.col("path")))
    n = F.count("*").over(W.partitionBy("case_id"))
    return p.withColumn("_n", n).select(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate case "), "case_id"))).otherwise(F.col("case_id")).alias("case_id"), "path")


def read_reports(spark: SparkSession, root: str, language: str = "en") -> DataFrame:
    """(case_id, path, text) of <root>/cases/<case>/reports_<language>/*.txt, texts stripped; an empty one raises when read."""
    t = spark.read.text(f"{root}/cases/*/reports_{language}/*.txt", wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text"))
    case = F.regexp_extract("path", r"/cases/([^/]+)/", 1)
    return t.select(case.alias("case_id"), "path", F.when(F.col("text") == "", F.raise_error(F.concat(F.lit("empty report "), "path"))).otherwise(F.col("text")).alias("text"))


def discover(spark: SparkSession, root: str, language: str = "en") -> DataFrame:
    """(case_id, report_paths, texts) of the cases below root, reports in path order."""
    g = read_reports(spark, root, language).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("r"))
    return g.select("case_id", F.transform("r", lambda x: x.path).alias("report_paths"), F.transform("r", lambda x: x.text).alias("texts"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of JSON lines; labels default to none and the weight to 1."""
    m = spark.read.schema(MANIFEST).json(path)
    return m.withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "sampling_weight": F.coalesce("sampling_weight", F.lit(1.0))})


def write_manifest(cases: DataFrame, path: str) -> None:
    """JSON lines by case, keys sorted, without the texts."""
    cases.select(*sorted(c for c in cases.columns if c != "texts")).orderBy("case_id").write.mode("overwrite").json(path)


def pending(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs whose case is not done."""
    return inputs.join(done.select("case_id"), "case_id", "left_anti")


def channels(files: DataFrame, ending: str) -> DataFrame:
    """(id, files) of file names <id>_<four digits><ending>, in channel order."""
    pattern = rf"^(.*)_\d{{4}}\Q{ending}\E$"
    f = files.where(F.col("file").rlike(pattern)).select(F.regexp_extract("file", pattern, 1).alias("id"), "file")
    return f.groupBy("id").agg(F.array_sort(F.collect_list("file")).alias("files"))
