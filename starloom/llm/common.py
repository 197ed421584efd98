"""Shared pieces of the training-data operators: stored tables, word splitting, let-bindings, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Rows of a few longs that are stored in one file at least, where their number is known.
FILE_ROWS = 250_000
#: Spark's limit on the bytes of an Arrow batch, and what it is set to where the session names none.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in ``spark.checkpoint.dir``; a local session where that is unset takes a temporary one, any other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="starloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/starloom/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows at most, in no more partitions than its rows fill files: small tables of many rounds are not stored in as many files as a large cluster has tasks."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to BATCH_BYTES, unless it has a bound of its own: by Spark's 64 MB all rows of a task are one batch, which the JVM and its worker hold
    several times over. Batches are cut when a query runs, so the setting stays."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with memory that the task leaves behind given back to the system: workers stay for other tasks, and so would what they hold free."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return whole


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where it is used inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null or blank: empty."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)),
    )


def n_words_of(text: Column) -> Column:
    """Number of words of a text as a long."""
    return F.size(words_of(text)).cast("long")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_of(df: DataFrame, bytes_each: int) -> int:
    """Partitions for df so that each has about so many bytes by the optimizer's estimate, and no fewer than the session's number."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # without statistics the estimate is close to the largest long
    return max(n_partitions(df.sparkSession), -(-size // bytes_each) if known else 0)


def text_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose strings in a column have ``most`` bytes or less together, or one row: what a worker makes of a run stays small."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def fold_labels(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i and j: minimum labels spread until nothing changes."""
    while True:
        low = np.minimum(parent[i], parent[j])
        new = parent.copy()
        np.minimum.at(new, parent[i], low)
        np.minimum.at(new, parent[j], low)
        new = new[new]
        while True:
            again = new[new]
            if (again == new).all():
                break
            new = again
        if (new == parent).all() and (new[i] == new[j]).all():
            return new
        parent = new


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b: long), root the smallest node reachable.

    Alternating large-star and small-star rounds; each round is stored, so lineage stays short, and the
    number of rounds grows with the logarithm of the longest chain. No group is gathered in one task:
    minima are aggregates with map-side combining, and joins on a hot hub are left to AQE's skew handling.
    Rows are counted before each round, so that small graphs are stored in few files; links are read twice, so give a stored table.
    """
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(few_files(edges, links.count()), "edges")
    before = state(edges)
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        # large star: each neighbour above u goes to the least node of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(few_files(large, before[0]), "large")
        # small star: the neighbours below u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        small = stored(few_files(small, 2 * before[0]), "small")
        edges, after = small, state(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return few_files(nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), 2 * before[0])
