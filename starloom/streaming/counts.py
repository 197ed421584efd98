"""A count map kept up to date by a stream of catalogue files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import catalog
from ..operators.shared import shared_path


def count_stream(spark: SparkSession, folder: str, schema, hashed: Callable[[DataFrame], DataFrame], depth: int, name: str | None = None) -> DataFrame:
    """(cell, n) over a folder's files as they come; state is one row for each non-empty cell. ``hashed`` adds hpx29."""
    options = {"pathGlobFilter": name} if name else {}
    rows = spark.readStream.schema(schema).options(**options).parquet(folder)
    return catalog.count_map(hashed(rows), depth)


def run_once(spark: SparkSession, path: str, hashed: Callable[[DataFrame], DataFrame], depth: int) -> DataFrame:
    """All files that are there now, through the stream, as a batch result."""
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    probe = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(probe).isDirectory()
    stream = count_stream(spark, path if is_folder else folder, schema, hashed, depth, None if is_folder else name)
    out = shared_path(spark, "counts")
    # each batch replaces the table in the shared folder: no cell passes through the driver
    keep = lambda counts, _: counts.write.mode("overwrite").parquet(out)
    options = {"checkpointLocation": shared_path(spark, "stream")}
    query = stream.writeStream.outputMode("complete").options(**options).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
