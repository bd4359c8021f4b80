"""Fixpoints over DataFrames, with the lineage cut each round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; a folder of its own only where that is unset."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='quirelake-')}")
    return df.checkpoint()


def small(df: DataFrame, row_bytes: str) -> DataFrame:
    """Broadcast a table that is cheap to read if its bytes, counted by an SQL expression, are few; leave any other to a shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(row_bytes))).first()[0] or 0) <= BROADCAST_BYTES else df


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that `step` reaches from `start`: semi-naive, only new rows are followed."""
    front = seen = checkpoint(start)
    while not front.isEmpty():
        front = checkpoint(step(front).join(seen, start.columns, "left_anti"))
        seen = checkpoint(seen.unionByName(front))
    return seen
