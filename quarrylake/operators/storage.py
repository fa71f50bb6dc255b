"""Where operators cut lineage, and the size checks before a broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few plain columns that are broadcast at most.
BROADCAST_ROWS = 200_000


def checkpoint_folder(spark) -> str:
    """spark.checkpoint.dir. Only a local session, where driver and executors are one process, may do without and gets a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="quarrylake-")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small_enough(df, rows) else df


def parts_for(df: DataFrame, rows: int) -> int:
    """Into how many parts df is dealt out for so many rows in each: small files of many rows are few parts when read."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
