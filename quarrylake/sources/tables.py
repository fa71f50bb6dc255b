"""Further readers and writers: inputs by path, channels, features, tables of patients, metrics, atomic output."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The formats by their files' endings, the most specific first.
FORMATS = {".nii.gz": "nifti", ".nrrd": "nrrd", ".mha": "mha", ".tif": "tiff", ".tiff": "tiff", ".png": "natural", ".bmp": "natural"}


def listed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files below root that match, found by Spark, so on any store it reads; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")


def expanded(paths: DataFrame) -> DataFrame:
    """(input, path) of files (input, path): where an input has files of the form .../cbct/volume.nii.gz those, else all .nii.gz files."""
    f = paths.where(F.col("path").endswith(".nii.gz")).withColumn("own", F.col("path").endswith("/cbct/volume.nii.gz"))
    any_ = f.groupBy("input").agg(F.max("own").alias("any"))
    return f.join(any_, "input").where("own = any").select("input", "path")


def format_of(path: Column, override: Column | None = None) -> Column:
    """The reader for a path, by name where one is given, else by the path's ending; NULL if there is none."""
    by_ending = F.coalesce(*(F.when(F.lower(path).endswith(e), F.lit(f)) for e, f in FORMATS.items()))
    return by_ending if override is None else F.coalesce(override, by_ending)


def only_file(files: DataFrame, ending: str) -> DataFrame:
    """(case_id, path) where a case has exactly one file with the ending; any other number raises."""
    f = files.where(F.col("path").endswith(ending)).groupBy("case_id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    all_ = files.select("case_id").distinct().join(f, "case_id", "left")
    wrong = F.raise_error(F.concat(F.lit("not one input in case "), F.col("case_id").cast("string")))
    return all_.select("case_id", F.when(F.coalesce("n", F.lit(0)) == 1, F.col("path")).otherwise(wrong).alias("path"))


def interface_key(sockets: Column) -> Column:
    """The sorted slugs of an input's sockets, given as JSON."""
    parsed = F.from_json(sockets, "array<struct<socket:struct<slug:string>>>")
    return F.array_sort(F.transform(parsed, lambda s: s["socket"]["slug"]))


def dataset_index(files: DataFrame) -> DataFrame:
    """(case_id, data, properties, previous) of files (folder, file): .npy is preferred to .npz; previous: of the folder "previous"."""
    stem = F.regexp_extract("file", r"^(.*)\.(?:npy|npz|pkl)$", 1)
    kind = F.regexp_extract("file", r"\.(npy|npz|pkl)$", 1)
    f = files.select(stem.alias("case_id"), kind.alias("kind"), "folder", "file").where("case_id <> '' AND NOT endswith(case_id, '_seg')")
    own = F.col("folder") != "previous"
    g = f.groupBy("case_id").agg(*(F.max(F.when(own & (F.col("kind") == k), F.col("file"))).alias(k) for k in ("npy", "npz", "pkl")), F.max(F.when(~own, F.col("file"))).alias("previous"))
    return g.select("case_id", F.coalesce("npy", "npz").alias("data"), F.col("pkl").alias("properties"), "previous").where("data IS NOT NULL")


def broken_files(files: DataFrame, magic: bytes) -> DataFrame:
    """(path) of files (path, content) that are empty or do not begin with magic."""
    return files.where(F.col("content").isNull() | ~F.startswith("content", F.lit(magic))).select("path")


def checked_features(features: DataFrame, channels: int) -> DataFrame:
    """features (case_id, shape array, ...) with four axes (c, z, y, x) and so many channels; others raise when read."""
    problem = F.when(F.size("shape") != 4, "rank").when(F.col("shape")[0] != channels, "channels")
    return features.withColumn("case_id", F.when(problem.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("wrong"), problem, F.lit("in"), F.col("case_id").cast("string")))).otherwise(F.col("case_id")))


def read_patients(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV with a header: the columns of types, by name wherever they stand, cast (values that do not fit are NULL)."""
    t = spark.read.option("header", True).csv(path)
    return t.select(*(F.col(f"`{c}`").try_cast(k).alias(c) for c, k in types.items()))


def unstacked(volumes: DataFrame) -> DataFrame:
    """(file, z, y, x, v) of volumes (name, ending, rank, t, z, y, x, v): a 4-D one's frames get channel suffixes, a 3-D one the first; other ranks raise."""
    channel = F.when(F.col("rank") == 4, F.col("t")).when(F.col("rank") == 3, 0).otherwise(F.raise_error(F.concat(F.lit("rank of "), "name")).cast("int"))
    return volumes.select(F.concat("name", F.format_string("_%04d", channel.cast("int")), "ending").alias("file"), "z", "y", "x", "v")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, fields sorted, in one file order by the first column; types become JSON's own."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_epoch(metrics: DataFrame, predictions: DataFrame, path: str) -> None:
    """metrics and predictions (epoch, ...) as JSON below <path>/metrics and <path>/predictions, a folder for each epoch, replaced when written again."""
    for name, df in (("metrics", metrics), ("predictions", predictions)):
        df.write.partitionBy("epoch").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{path}/{name}")


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """A log (step, metric, value) as CSV, a column for each metric."""
    metrics.groupBy("step").pivot("metric").agg(F.first("value")).write.mode("overwrite").option("header", True).csv(path)


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} cannot become {target}")


def replace_folder(df: DataFrame, path: str, overwrite: bool = True) -> bool:
    """Writes df beside path and moves it there when it is whole; False if path is complete and stays.

    The table before is moved aside, not deleted, until the new one is in place, and comes back if that fails. Readers may find
    no table for the moment between two renames; where they must not, use publish.
    """
    spark = df.sparkSession
    fs, target = _files(spark, path.rstrip("/"))
    if not overwrite and fs.exists(_files(spark, f"{path}/_SUCCESS")[1]):
        return False
    mark = uuid.uuid4().hex
    new, old = (_files(spark, f"{path.rstrip('/')}.{mark}.{kind}")[1] for kind in ("new", "old"))
    try:
        df.write.parquet(new.toString())
        before = fs.exists(target)
        if before:
            _rename(fs, target, old)
        try:
            _rename(fs, new, target)
        except Exception:
            if before:
                _rename(fs, old, target)
            raise
        fs.delete(old, True)
    finally:
        fs.delete(new, True)
    return True


def publish(df: DataFrame, path: str, keep: int = 1) -> str:
    """Writes df as a new version of the table at path and makes it the current one by one rename of a small pointer file.

    At every moment the pointer names a whole version, whatever fails. Returns the version's name. Of the versions that are not
    current the keep newest stay, for readers that are still at them.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = path.rstrip("/")
    df.write.parquet(f"{folder}/{version}")
    fs, beside = _files(spark, f"{folder}/.{version}")
    out = fs.create(beside, True)
    try:
        out.write(version.encode())
    finally:
        out.close()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(option, 1)
    how[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(pointer), how)
    others = sorted(s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if s.isDirectory() and s.getPath().getName()[:1] == "v")
    for name in [n for n in others if n < version][: -keep or None]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name of the version that publish made current last, or None."""
    fs, pointer = _files(spark, f"{path.rstrip('/')}/CURRENT")
    if not fs.exists(pointer):
        return None
    # one line of a known few bytes
    return spark.read.text(pointer.toString()).first()[0]


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of the table at path, or None."""
    version = current_version(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/{version}") if version else None


def discovery_problems(cases: DataFrame, reports: DataFrame, features: DataFrame) -> DataFrame:
    """(case_id, problem): cases (case_id) without a report (case_id, text), with an empty one, or without a feature file (case_id)."""
    r = reports.groupBy("case_id").agg(F.count_if(F.trim("text") == "").alias("empty"))
    f = features.select("case_id").distinct().withColumn("feature", F.lit(True))
    j = cases.select("case_id").distinct().join(r, "case_id", "left").join(f, "case_id", "left")
    problem = F.when(F.col("empty").isNull(), "no report").when(F.col("empty") > 0, "empty report").when(F.col("feature").isNull(), "no feature file")
    return j.select("case_id", problem.alias("problem")).where("problem IS NOT NULL")
