"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Sizes are summed by source and hash bucket (12 bits of a 48-bit hash of the id). Running sums over the at most
4096 buckets of a source show the bucket in which its budget ends; only the rows of that bucket are summed again
by the next 12 bits, and so on down to single hash values. Filtering by ``hash < threshold`` then takes the rows,
with no sort and no group of rows in one task. Thresholds are nested: a smaller budget takes a subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import n_words_of, stored

LEVELS, BITS = 4, 12
#: A per-source table of up to this many rows (some 100 bytes each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def id_hash(id_col: Column) -> Column:
    """48 bits of the id's MD5 as a long; null hashes as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from per-source sums (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times the sum of all sizes. Who would
    get over ``most`` times its size stops there, and the excess is shared again: water is filled over the order of
    most * size / weight, the first level that the next source does not reach is the common one.
    """
    one = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    numbered = sizes.withColumn("rank", F.row_number().over(one))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = numbered.withColumns({"w": weight, "cap": F.col("source_size") * F.lit(float(most))}).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "rank")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    filled = caps.withColumn("level", level)
    common = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)
    return filled.withColumn("common", common["level"]).select(
        "source", "source_size", F.when(F.col("cap") < F.col("w") * F.col("common"), F.col("cap")).otherwise(F.col("w") * F.coalesce("common", F.lit(0.0))).alias("target")
    )


def _with(rows: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    """rows joined null-safely with a table of one row per source, broadcast only if its size was checked."""
    side = table.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def thresholds(sized: DataFrame, targets: DataFrame, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, whole, threshold): a row is taken ``whole`` times, and once more if its hash is below threshold.

    sized has (id, source, size), targets (source, source_size, target). A target of k whole source sizes and a rest takes every
    row k times, and for the rest those whose hash lies under the threshold. Of the last hash value at the threshold, the nearer
    side wins. Empty sources have target 0 and nothing is taken from them; a null size counts as 0.
    """
    if most < 1:
        raise ValueError("most must be at least 1")
    n = targets.count()
    goal = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", goal).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    state = stored(plan.withColumns({"low": F.lit(0).cast("long"), "done": F.lit(0).cast("long")}), "plan")
    rows = sized.select("source", id_hash(F.col("id")).alias("h"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    w = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    for k in range(1, LEVELS + 1):
        span = 1 << BITS * (LEVELS - k)
        inside = rows if k == 1 else _with(rows, state.select("source", "low"), n).where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(span << BITS)))
        sums = inside.groupBy("source", F.floor(F.col("h") / F.lit(span)).cast("long").alias("b")).agg(F.sum("size").alias("s"))
        cum = sums.withColumn("c", F.sum("s").over(w))
        upto = _with(cum, state.select("source", "rest", "done"), n)
        # the last bucket that ends within the budget, and the one behind it, in which the budget ends
        fits = F.col("done") + F.col("c") <= F.col("rest")
        found = upto.groupBy("source").agg(
            F.coalesce(F.max(F.when(fits, F.col("c"))), F.lit(0)).alias("got"), F.min(F.when(~fits, F.struct("b", "s"))).alias("edge")
        )
        joined = state.drop("edge_size").join(found.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        over = F.col("edge").isNull() & F.col("got").isNotNull()
        state = joined.select(
            "source", "source_size", "target", "whole", "rest",
            F.when(over, F.col("low") + F.lit(span << BITS)).when(F.col("edge.b").isNotNull(), F.col("edge.b") * F.lit(span)).otherwise(F.col("low")).alias("low"),
            (F.col("done") + F.coalesce(F.col("got"), F.lit(0))).alias("done"), F.col("edge.s").alias("edge_size"),
        )
        state = stored(state, f"thresholds{k}")
    # low is now the first hash value that does not fit whole; it is taken if that comes nearer to the target
    nearer = F.col("edge_size").isNotNull() & (F.col("done") + F.col("edge_size") - F.col("rest") < F.col("rest") - F.col("done"))
    room = F.when(F.col("whole") >= int(most), F.lit(0)).otherwise(F.col("low") + F.when(nearer, 1).otherwise(0))
    return state.select("source", "source_size", "target", "whole", room.alias("threshold"))


def with_copies(rows: DataFrame, limits: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """rows with source_size, target and copies by thresholds(); a filter by hash, without a sort or a shuffle of rows.

    Rows of one id are taken or left together. Raises ValueError if rows has one of these columns already.
    """
    new = {"source_size", "target", "copies", "_source", "_whole", "_threshold"}
    if new & set(rows.columns):
        raise ValueError(f"columns in the way: {sorted(new & set(rows.columns))}")
    side = limits.select(F.col("source").alias("_source"), "source_size", "target", F.col("whole").alias("_whole"), F.col("threshold").alias("_threshold"))
    side = F.broadcast(side) if limits.count() <= BROADCAST_SOURCES else side
    out = rows.join(side, F.col(source_col).eqNullSafe(F.col("_source")), "left")
    copies = F.col("_whole") + F.when(id_hash(F.col(id_col)) < F.col("_threshold"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).drop("_source", "_whole", "_threshold")


def plan_mix(sized: DataFrame) -> DataFrame:
    """thresholds() of sized (id, source, size) for the standard weights."""
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    return stored(thresholds(sized, targets), "limits")


def sizes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, size) per row of docs, stored; size is the number of words, null text: 0."""
    return stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words_of(F.col(text_col)).alias("size")), "sizes")


def mix_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as they are, no row order.

    Null and empty texts have size 0 and are taken with the other rows of their hash; a null source is a source of its own, the last; rows of one id
    (null too) hash alike, so that they are taken or left together; an empty table gives an empty result.
    The names of docs' columns do not matter.
    """
    limits = plan_mix(sizes(docs, text_col, id_col, source_col))
    narrow = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    taken = with_copies(narrow, limits, "id", "source").where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op2_mix(spark, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    Null texts have size 0; null sources are one source, the last in order; rows of one id are taken or left together; repeated rows each count; an
    empty table gives an empty result; other columns are not looked at.
    """
    sized = sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = with_copies(sized, plan_mix(sized), "id", "source")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3e0, 1e0, 2e0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
-- the level of the water: caps below it are full, the others share the rest by weight
r AS (SELECT a.source_size * 2e0 / a.w AS ratio, (SELECT sum(source_size) * 1.5e0 FROM s) - coalesce(sum(b.source_size * 2e0) FILTER (b.source_size * 2e0 / b.w < a.source_size * 2e0 / a.w), 0) AS rest,
             sum(b.w) FILTER (b.source_size * 2e0 / b.w >= a.source_size * 2e0 / a.w) AS weight FROM s a, s b GROUP BY a.source, a.source_size, a.w),
l AS (SELECT arg_min(rest / weight, ratio) AS level FROM r WHERE rest / weight <= ratio),
t AS (SELECT source, source_size, CASE WHEN source_size * 2e0 < w * level THEN source_size * 2e0 ELSE w * coalesce(level, 0) END AS target FROM s LEFT JOIN l ON true),
k AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole, greatest(0, target - whole * source_size) AS rest FROM t),
b AS (SELECT source, h, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS c FROM d GROUP BY source, h)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN whole < 2 AND (c <= rest OR c - s <= rest AND c - rest < rest - (c - s)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.h = b.h
"""
