"""Operators over a global order, by ranges: no task holds all rows, the driver gets one row for each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.operators.storage import cut


def ranges(df: DataFrame, keys: list) -> DataFrame:
    """df sorted in ranges by keys, with _p, the range, and _k, the row's place in it; ranges follow each other in order."""
    parts = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    # the partition's number is in the upper bits, the row's in the lower 33
    return parts.withColumns({"_p": F.shiftright("_m", 33), "_k": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m")


def carried(parts: DataFrame, value: Column, start, step) -> DataFrame:
    """parts with _before: step folded over the values (an aggregate of each range) of the ranges before, from start."""
    before, at = [], start
    for p, x in sorted(parts.groupBy("_p").agg(value.alias("x")).collect(), key=lambda r: r["_p"]):
        before.append((p, at))
        at = step(at, x)
    kind = parts.groupBy("_p").agg(value.alias("x")).schema["x"].dataType.simpleString()
    return parts.join(F.broadcast(parts.sparkSession.createDataFrame(before, f"_p long, _before {kind}")), "_p")


def ordered_index(df: DataFrame, keys: list, name: str = "idx") -> DataFrame:
    """df with name, the place (from 0) of each row in the order of keys, which should order the rows fully."""
    at = carried(ranges(df, keys), F.count("*"), 0, lambda a, n: a + n)
    return at.withColumn(name, F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def running_max(df: DataFrame, keys: list, value: Column, name: str) -> DataFrame:
    """df with name: the largest value of the rows before, in the order of keys; NULL where there is none."""
    at = carried(ranges(df.withColumn("_v", value), keys), F.max("_v"), None, lambda a, x: x if a is None else a if x is None else max(a, x))
    inside = F.max("_v").over(W.partitionBy("_p").orderBy("_k").rowsBetween(W.unboundedPreceding, -1))
    # greatest() passes over NULLs
    return at.withColumn(name, F.greatest(inside, "_before")).drop("_p", "_k", "_before", "_v")
