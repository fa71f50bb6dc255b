"""Readers of volume files, registered by name: the one that is named, or else the first for the file's ending that can read it.

Files come through Spark's binaryFile, so from any store it reads, one file in memory of one task at a time (2 GB at
most, as that source has it). A file that no reader can read is reported, not lost; Spark
shows no files without a byte.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Volume:
    """values in z, y, x; spacing and origin in z, y, x, too."""

    values: np.ndarray
    spacing: list[float]
    origin: list[float]


#: Element types of the two text headers, with a reader's name for them.
META_TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_LONG_LONG": "i8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NRRD_TYPES = {"int8": "i1", "signed char": "i1", "uint8": "u1", "unsigned char": "u1", "uchar": "u1", "int16": "i2", "short": "i2", "uint16": "u2", "unsigned short": "u2", "ushort": "u2",
              "int32": "i4", "int": "i4", "uint32": "u4", "unsigned int": "u4", "int64": "i8", "uint64": "u8", "float": "f4", "double": "f8"}


def _shaped(data: bytes, sizes: list[int], kind: str) -> np.ndarray:
    """Values of sizes x, y, z as an array of z, y, x; what is missing or too much raises."""
    values = np.frombuffer(data, kind)
    if len(sizes) != 3 or min(sizes) < 1 or len(values) != int(np.prod(sizes)):
        raise ValueError(f"{len(values)} values do not make {sizes}")
    return values.reshape(sizes[::-1])


def read_mha(content: bytes) -> Volume:
    """A MetaImage with its data behind the header."""
    fields, at = {}, 0
    while "ElementDataFile" not in fields:
        end = content.index(b"\n", at)
        key, sign, value = content[at:end].decode("ascii").partition("=")
        if not sign:
            raise ValueError("no header")
        fields[key.strip()] = value.strip()
        at = end + 1
    if fields["ElementDataFile"] != "LOCAL":
        raise ValueError("the data are in another file")
    data = content[at:]
    if fields.get("CompressedData", "False") == "True":
        data = zlib.decompress(data)
    order = ">" if fields.get("BinaryDataByteOrderMSB", fields.get("ElementByteOrderMSB", "False")) == "True" else "<"
    numbers = lambda k, default: [float(x) for x in fields.get(k, default).split()][::-1]
    values = _shaped(data, [int(x) for x in fields["DimSize"].split()], order + META_TYPES[fields["ElementType"]])
    return Volume(values, numbers("ElementSpacing", "1 1 1"), numbers("Offset", fields.get("Position", "0 0 0")))


def read_nrrd(content: bytes) -> Volume:
    """An attached NRRD, raw or gzip."""
    if content[:4] != b"NRRD":
        raise ValueError("no NRRD")
    head, _, data = content.partition(b"\n\n")
    fields = dict(line.split(": ", 1) for line in head.decode("ascii").split("\n")[1:] if ": " in line and line[0] != "#")
    if "data file" in fields or "datafile" in fields:
        raise ValueError("the data are in another file")
    coding = fields.get("encoding", "raw").strip()
    if coding in ("gzip", "gz"):
        data = gzip.decompress(data)
    elif coding != "raw":
        raise ValueError(f"encoding {coding}")
    vectors = lambda text: [[float(x) for x in v.strip("()").split(",")] for v in text.split()]
    spacing = [float(np.linalg.norm(v)) for v in vectors(fields["space directions"])] if "space directions" in fields else [float(x) for x in fields.get("spacings", "1 1 1").split()]
    origin = vectors(fields["space origin"])[0] if "space origin" in fields else [0.0, 0.0, 0.0]
    order = ">" if fields.get("endian", "little").strip() == "big" else "<"
    return Volume(_shaped(data, [int(x) for x in fields["sizes"].split()], order + NRRD_TYPES[fields["type"].strip()]), spacing[::-1], origin[::-1])


#: name -> (endings, reader), in the order in which they are tried.
READERS: dict[str, tuple[tuple[str, ...], Callable[[bytes], Volume]]] = {"mha": ((".mha",), read_mha), "nrrd": ((".nrrd",), read_nrrd)}


def opened(path: str, content: bytes, readers: dict, override: str | None) -> tuple[str | None, Volume | None, str | None]:
    """(name, volume, problem) by the reader that is named, or else by the first for the ending that succeeds."""
    names = [override] if override else [n for n, (endings, _) in readers.items() if path.lower().endswith(endings)]
    problems = []
    for name in names:
        try:
            return name, readers[name][1](content), None
        except (ValueError, KeyError, IndexError, OSError, EOFError, zlib.error) as e:
            problems.append(f"{name}: {e}")
    return None, None, "; ".join(problems) or "no reader for the ending"


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")


def _known(override: str | None, readers: dict | None) -> dict:
    found = READERS if readers is None else readers
    if override is not None and override not in found:
        raise ValueError(f"no reader is named {override}")
    return dict(found)


def volume_headers(spark: SparkSession, root: str, override: str | None = None, readers: dict | None = None) -> DataFrame:
    """(path, reader, size, spacing, origin, problem) of each file below root, all in z, y, x; reader is NULL where problem says why."""
    known = _known(override, readers)

    def look(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                name, v, problem = opened(path, content.as_py(), known, override)
                rows.append({"path": path, "reader": name, "size": v and list(v.values.shape), "spacing": v and v.spacing, "origin": v and v.origin, "problem": problem})
            yield from pa.Table.from_pylist(rows, pa.schema([("path", pa.string()), ("reader", pa.string()), ("size", pa.list_(pa.int32())), ("spacing", pa.list_(pa.float64())), ("origin", pa.list_(pa.float64())), ("problem", pa.string())])).to_batches()

    return _files(spark, root).mapInArrow(look, "path string, reader string, size array<int>, spacing array<double>, origin array<double>, problem string")


def read_volumes(spark: SparkSession, root: str, override: str | None = None, readers: dict | None = None) -> DataFrame:
    """(path, z, y, x, v) of all files below root that a reader can read, slices at a time; see volume_headers for the others."""
    known = _known(override, readers)

    def voxels(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                _, v, _ = opened(path, content.as_py(), known, override)
                for z, plane in enumerate(v.values if v else ()):
                    y, x = (k.ravel().astype(np.int32) for k in np.indices(plane.shape))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * plane.size), pa.array(np.full(plane.size, z, np.int32)), pa.array(y), pa.array(x), pa.array(plane.ravel().astype(np.float64))], ["path", "z", "y", "x", "v"])

    return _files(spark, root).mapInArrow(voxels, "path string, z int, y int, x int, v double")


def checked_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (case_id, feature_path, report_paths, ...); a row whose feature or a report is not among files (path), or which has no report, raises when read, as does an empty manifest."""
    present = files.select("path").distinct()
    row = manifest.withColumn("_row", F.monotonically_increasing_id())
    needed = row.select("_row", F.explode(F.array_append(F.coalesce("report_paths", F.array().cast("array<string>")), F.col("feature_path"))).alias("path"))
    missing = needed.join(present, "path", "left_anti").groupBy("_row").agg(F.min(F.coalesce("path", F.lit("NULL"))).alias("_missing"))
    problem = F.when(F.coalesce(F.size("report_paths"), F.lit(0)) < 1, F.lit("no report")).when(F.col("_missing").isNotNull(), F.concat(F.lit("no file "), "_missing"))
    out = row.join(missing, "_row", "left").withColumn("case_id", F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(" for case "), F.col("case_id").cast("string")))).otherwise(F.col("case_id"))).select(manifest.columns)
    if manifest.isEmpty():
        raise ValueError("the manifest is empty")
    return out
