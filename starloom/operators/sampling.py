"""Selection by position in a sorted catalogue: systematic samples, one pick a chunk, picks that leave out what is taken.

Chunks are aggregated with min over an ordering struct, which combines before the shuffle; no window sorts a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def systematic(df: DataFrame, step: int, recno: str = "recno") -> DataFrame:
    """Rows whose recno is a multiple of step."""
    return df.where(F.pmod(F.col(recno), F.lit(step)) == 0)


def score_key(score: Column) -> Column:
    """An order in which the least score comes first, NaN after all numbers and null last."""
    return F.struct(score.isNull().alias("no"), F.isnan(F.coalesce(score, F.lit(0.0))).alias("nan"), F.coalesce(score, F.lit(0.0)).alias("score"))


def middle_key(recno: Column, start: Column, end: Column) -> Column:
    """An order for [start, end): below the middle first, nearest to it first, then from the middle up."""
    mid = F.floor((start + end) / 2).cast("long")
    return F.struct((recno >= mid).alias("up"), F.abs(recno - mid).alias("far"))


def chunk_of(recno: Column, start: Column, n: Column, parts: Column) -> Column:
    """The chunk, from 0, of a row when [start, start + n) is cut at start + floor(k * n / parts)."""
    offset = recno - start
    return (F.floor(((offset + 1) * parts + n - 1) / n) - 1).cast("long")


def pick_per_chunk(df: DataFrame, size: int, score: str | None = None, recno: str = "recno", total: Column | None = None) -> DataFrame:
    """(chunk, recno): one row of each run of ``size`` recnos: the least score, first recno on ties; without a score the middle row.

    The last run can be shorter; ``total`` is the number of rows, where a middle is asked for.
    """
    chunk = F.floor(F.col(recno) / F.lit(size)).cast("long")
    if score:
        return df.groupBy(chunk.alias("chunk")).agg(F.min(F.struct(score_key(F.col(score)).alias("k"), F.col(recno).alias("r"))).alias("m")).select("chunk", F.col("m.r").alias("recno"))
    ends = df.groupBy(chunk.alias("chunk")).agg(F.max(recno).alias("last"))
    return ends.select("chunk", F.floor((F.col("chunk") * size + F.col("last") + 1) / 2).cast("long").alias("recno"))


def pick_excluding(df: DataFrame, size: int, taken: Column, score: str | None = None, recno: str = "recno") -> DataFrame:
    """(chunk, recno): as pick_per_chunk, among rows that are not ``taken``; chunks without such rows give none."""
    chunk = F.floor(F.col(recno) / F.lit(size)).cast("long")
    cut = df.withColumn("chunk", chunk)
    if score:
        key = score_key(F.col(score))
        marked = cut.where(~taken).select("chunk", F.struct(key.alias("k"), F.col(recno).alias("r")).alias("o"))
    else:
        last = cut.groupBy("chunk").agg((F.max(recno) + 1).alias("_end"))
        key = middle_key(F.col(recno), F.col("chunk") * size, F.col("_end"))
        marked = cut.where(~taken).join(last, "chunk").select("chunk", F.struct(key.alias("k"), F.col(recno).alias("r")).alias("o"))
    return marked.groupBy("chunk").agg(F.min("o").alias("m")).select("chunk", F.col("m.r").alias("recno"))
