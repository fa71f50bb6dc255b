"""Incremental maintenance of a manifest with Structured Streaming (an addition of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.text import normalize_report


def first_reports(reports: DataFrame, late: str = "1 day") -> DataFrame:
    """Of a stream of reports (case_id, text, ts) the first with each normalised text, within the time that late ones may come."""
    keyed = reports.withColumn("digest", F.sha2(normalize_report(F.col("text")).cast("binary"), 256))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"])


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of a stream of events (ts, event_type, value), by tumbling windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append_new(batch: DataFrame, known: DataFrame) -> DataFrame:
    """What a micro-batch adds to known cases; for foreachBatch."""
    return batch.dropDuplicates(["case_id"]).join(known.select("case_id"), "case_id", "left_anti")
