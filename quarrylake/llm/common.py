"""Byte-level text kernels and storage helpers that the operators share."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators.storage import broadcast_if_small, checkpoint_folder, small_enough

#: ASCII white space that separates words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text hashed at a time; bounds a worker's memory.
PIECE = 1 << 21
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    """A pseudo-random 64-bit number for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class WordHasher:
    """Hashes white-space words of UTF-8 bytes without making Python strings."""

    def __init__(self, lower: bool = True):
        self.values = byte_values()
        if lower:
            self.values = self.values[LOWER]
        self.up = self.down = np.empty(0, np.uint64)

    def _piece(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(b)
        if n > len(self.up):
            self.up, self.down = powers(_P, max(n, PIECE)), powers(_PINV, max(n, PIECE))
        gap = SPACE[b]
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[b] * self.up[:n], out=h[1:])
        return mix((h[e] - h[s]) * self.down[s] + (e - s).astype(np.uint64)), s, e

    def __call__(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, its length in bytes) of one text; long texts go in pieces cut at white space."""
        out, at = [], 0
        while at < len(b):
            end = min(len(b), at + PIECE)
            while end < len(b):
                gaps = np.flatnonzero(SPACE[b[max(at, end - PIECE):end]])
                if len(gaps):
                    end = max(at, end - PIECE) + int(gaps[-1]) + 1
                    break
                end = min(len(b), end + PIECE)
            h, s, e = self._piece(b[at:end])
            out.append((h, e - s))
            at = end
        if not out:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return (out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out)))

    def many(self, buf: np.ndarray, offs: np.ndarray):
        """Yields (first row, past the last row, hashes, lengths, offsets of the rows' words); several short texts at a time."""
        n, i = len(offs) - 1, 0
        while i < n:
            j = int(np.searchsorted(offs, offs[i] + PIECE, "right")) - 1
            if j <= i:
                h, k = self(buf[offs[i]:offs[i + 1]])
                yield i, i + 1, h, k, np.array([0, len(h)])
                i += 1
                continue
            # a separator between texts keeps words apart
            part, rel = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            joined = np.insert(part, rel[1:-1], 32) if j - i > 1 else part
            starts = rel + np.concatenate((np.arange(j - i), [j - i - 1]))
            h, s, e = self._piece(joined)
            yield i, j, h, e - s, np.searchsorted(s, starts)
            i = j


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster raises."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_ENDS: set[str] = set()


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    """The folder goes when this driver ends, if its session still runs then; results are read before."""
    if folder in _ENDS:
        return
    _ENDS.add(folder)

    def remove():
        try:
            jvm = spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended before
            pass

    atexit.register(remove)


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a table into the shared folder and returns that table: cuts lineage, survives lost executors.

    All tables of an application are in one folder, which is removed when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/quarrylake-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    _remove_at_end(spark, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_dealt(rows: DataFrame, facts: DataFrame, on: list[str], by: Column, share: int, how: str = "inner") -> DataFrame:
    """rows joined with facts, which have one row for each value of on at most; null values meet none and are dealt out too.

    A value of more than share rows is dealt out to several tasks by the hash by, and its facts go to each of them, so that
    no task gets more than about share rows of a value. The counts of large values are at most rows / share in number.
    """
    large = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > share)
    large = broadcast_if_small(stored(large.select(*on, F.ceil(F.col("_n") / share).alias("_parts"))))
    parts = F.coalesce("_parts", F.lit(1))
    found = large.select(*(F.col(c).alias(f"_on_{c}") for c in on), "_parts")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    left = rows.join(found, same, "left").withColumn("_part", F.pmod(by, parts)).drop("_parts", *(f"_on_{c}" for c in on))
    right = facts.join(large, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def ordered_index(df: DataFrame, keys: list, name: str = "idx") -> DataFrame:
    """df with name, the place (from 0) of each row in the order of keys; sorted in ranges, with no task that holds all rows.

    keys must order the rows fully. The driver gets one count for each partition.
    """
    spark = df.sparkSession
    # monotonically_increasing_id: the partition's number in the upper bits, the row's in the lower 33
    parts = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    parts = parts.withColumn("_p", F.shiftright("_m", 33))
    before, total = [], 0
    for p, n in sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        before.append((p, total))
        total += n
    offsets = spark.createDataFrame(before, "_p long, _o long")
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_o")
