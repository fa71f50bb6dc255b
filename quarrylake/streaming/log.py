"""A log of metrics, one value an epoch, kept up by micro-batches: an entry of an epoch that comes again replaces the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.sources.tables import publish, published

KEYS = ["run", "metric", "epoch"]


def latest(entries: DataFrame) -> DataFrame:
    """(run, metric, epoch, value, ts): of entries (run, metric, epoch, value, ts) the last one of each epoch, the larger value of equal times.

    The merge of two such tables is latest of their union, in any order and however often, so batches may be late or replayed.
    """
    top = F.max(F.struct("ts", "value")).alias("m")
    return entries.select(*KEYS, "value", "ts").groupBy(*KEYS).agg(top).select(*KEYS, "m.value", "m.ts")


def merged(spark, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch of entries into the table at path, of which a reader always finds a whole version."""
    def merge(batch: DataFrame, _: int) -> None:
        before = published(spark, path)
        new = latest(batch) if before is None else latest(before.unionByName(batch.select(*KEYS, "value", "ts")))
        publish(new, path)

    return merge


def missing_epochs(log: DataFrame) -> DataFrame:
    """(run, metric, epoch): the first epochs of gaps: an epoch is logged, but the one before is not."""
    before = F.lag("epoch", 1, -1).over(W.partitionBy("run", "metric").orderBy("epoch"))
    return log.withColumn("_before", before).where(F.col("epoch") > F.col("_before") + 1).select("run", "metric", (F.col("_before") + 1).alias("epoch"))


def smoothed(log: DataFrame, metric: str, keep: float = 0.9) -> DataFrame:
    """(run, epoch, value, ema): a metric and its moving average by epochs, made anew from what is logged now."""
    from quarrylake.operators.sampling import moving_average

    own = log.where(F.col("metric") == metric).select("run", "epoch", "value")
    return moving_average(own, "run", "epoch", "value", keep)
