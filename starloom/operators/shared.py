"""Tables written to the folder that all executors see, in place of caches and local checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join that cannot have more rows than this is broadcast.
BROADCAST_ROWS = 500_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``; a local session where that is unset takes a temporary one, any other is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="starloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/starloom/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df and read it again: lineage ends there, and whatever uses it twice sees the same rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows at most, as the side of a join: broadcast if that is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
