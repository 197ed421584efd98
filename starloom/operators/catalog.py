"""Sorted catalogues, their indexes and coverage: what sort, mkidx and qidx do, over DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import healpix as H
from ..functions import regions as R
from .shared import small_side, stored

#: The folder of a sorted catalogue that holds the number of rows before each part.
STARTS = "_starts"
#: Cones that are covered at a time.
CONES_AT_ONCE = 1000


def sort_catalogue(df: DataFrame, path: str, lon: str = "ra", lat: str = "dec", tie: str = "row_id", partitions: int | None = None) -> DataFrame:
    """Write df to parquet in the order of its depth-29 cells (ties by ``tie``) and return it with ``hpx29`` and ``recno``.

    Rows are dealt by ranges of the cell, sorted inside each part, and numbered by adding the sizes of the parts before: no
    row passes through one task. Row groups then hold narrow cell ranges, so a region's filter skips most of them.
    """
    spark = df.sparkSession
    keyed = H.with_hash(df, "hpx29", H.MAX_DEPTH, lon, lat)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = keyed.repartitionByRange(n, "hpx29", tie).sortWithinPartitions("hpx29", tie)
    _placed(part).write.parquet(path)
    # how many rows each part has is kept beside the rows (readers skip the folder, as its name says), so that no query counts them again
    _starts(spark.read.parquet(path)).coalesce(1).write.parquet(f"{path}/{STARTS}")
    return read_catalogue(spark, path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue that sort_catalogue wrote; one small row per part is broadcast to number the rows."""
    return _numbered(spark.read.parquet(path), "recno", spark.read.schema("_part int, _start long").parquet(f"{path}/{STARTS}"))


def _placed(part: DataFrame) -> DataFrame:
    """part with each row's partition and its place there."""
    place = F.monotonically_increasing_id()
    return part.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))})


def _starts(rows: DataFrame) -> DataFrame:
    """(_part, _start): the number of rows in the parts before, of rows of _placed() that were written."""
    sizes = rows.groupBy("_part").count()
    before = F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    return sizes.select("_part", F.coalesce(before, F.lit(0)).cast("long").alias("_start"))


def _numbered(rows: DataFrame, name: str, starts: DataFrame | None = None) -> DataFrame:
    """Rows of _placed() that were written, numbered by adding the sizes of the parts before."""
    starts = _starts(rows) if starts is None else starts
    return rows.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_part", "_at", "_start")


def with_recno(df: DataFrame, by: list[str | Column], name: str = "recno") -> DataFrame:
    """df numbered from 0 in the order of ``by``. The sorted parts are written first: dealt again, their borders could differ."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _numbered(stored(_placed(df.repartitionByRange(n, *by).sortWithinPartitions(*by)), "sorted"), name)


def count_map(df: DataFrame, depth: int, cell: str = "hpx29") -> DataFrame:
    """(cell, n): rows of each non-empty cell at a depth."""
    return df.groupBy(H.parent(F.col(cell), H.MAX_DEPTH, depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def cumulative_index(df: DataFrame, depth: int, implicit: bool = False, cell: str = "hpx29") -> DataFrame:
    """(cell, row_start, n) in the sorted catalogue. Explicit: non-empty cells and an end mark; implicit: all cells and the end."""
    spark = df.sparkSession
    counts = count_map(df, depth, cell)
    # running sums in two steps: within blocks of cells, and over the few blocks
    block = F.shiftright("cell", 10)
    sums = counts.groupBy(block.alias("block")).agg(F.sum("n").alias("total"))
    starts = sums.withColumn("base", F.coalesce(F.sum("total").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    end = F.lit(H.n_cells(depth)).cast("long")
    if implicit:
        every = spark.range(H.n_cells(depth)).select(F.col("id").alias("cell"))
        dense = every.join(counts, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        sums = dense.groupBy(block.alias("block")).agg(F.sum("n").alias("total"))
        starts = sums.withColumn("base", F.coalesce(F.sum("total").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        counts = dense
    inner = counts.withColumn("block", block).withColumn("_in", F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    body = inner.join(starts.select("block", "base"), "block").select("cell", (F.col("base") + F.col("_in")).cast("long").alias("row_start"), F.col("n").cast("long").alias("n"))
    mark = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_start")).select(end.alias("cell"), "row_start", F.lit(0).cast("long").alias("n"))
    return body.unionByName(mark)


def n_nonempty(df: DataFrame, depth: int = 2, cell: str = "hpx29") -> DataFrame:
    """One row: the number of non-empty cells at a depth."""
    return df.agg(F.countDistinct(H.parent(F.col(cell), H.MAX_DEPTH, depth)).alias("n_cells"))


def subcell_coverage(df: DataFrame, depth: int, cell: str = "hpx29") -> DataFrame:
    """(cell, cov3): how many of the 64 cells three levels deeper are not empty, by a bit mask that combines before the shuffle."""
    if depth > H.MAX_DEPTH - 3:
        raise ValueError("three levels below the depth are needed")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), H.parent(F.col(cell), H.MAX_DEPTH, depth + 3).bitwiseAND(F.lit(63)).cast("int"))
    return df.groupBy(H.parent(F.col(cell), H.MAX_DEPTH, depth).alias("cell")).agg(F.bit_count(F.bit_or(bit)).cast("long").alias("cov3"))


def unsorted_rows(df: DataFrame, order: str = "recno", cell: str = "hpx29", blocks: int = 1 << 20) -> DataFrame:
    """Rows whose cell is below that of the row before them by ``order``: none in a sorted catalogue."""
    block = F.floor(F.col(order) / F.lit(blocks)).cast("long")
    cut = df.withColumn("_block", block)
    # the last cell of each block is compared with the first of the next one that has rows: one row a block
    ends = cut.groupBy("_block").agg(F.max_by(cell, order).alias("_end"))
    last = ends.select("_block", F.lag("_end").over(W.orderBy("_block")).alias("_last"))
    before = F.lag(cell).over(W.partitionBy("_block").orderBy(order))
    return cut.join(last, "_block", "left").withColumn("_before", F.coalesce(before, F.col("_last"))).where(F.col(cell) < F.col("_before")).drop("_block", "_last", "_before")


def moc(df: DataFrame, depth: int, cell: str = "hpx29") -> DataFrame:
    """(start, end): the merged ranges of depth-29 cells that are not empty at a depth."""
    shift = 2 * (H.MAX_DEPTH - depth)
    cells = df.select(H.parent(F.col(cell), H.MAX_DEPTH, depth).alias("c")).distinct()
    return merge_cells(cells).select(F.shiftleft("start", shift).alias("start"), F.shiftleft("end", shift).alias("end"))


def merge_cells(cells: DataFrame) -> DataFrame:
    """Half-open runs (start, end) of consecutive values of c. A run starts where c - 1 is lacking and ends where c + 1 is."""
    one = stored(cells.select("c"), "cells")
    starts = one.join(one.select((F.col("c") + 1).alias("c")), "c", "left_anti").select(F.col("c").alias("v"), F.lit(0).alias("kind"))
    ends = one.join(one.select((F.col("c") - 1).alias("c")), "c", "left_anti").select((F.col("c") + 1).alias("v"), F.lit(1).alias("kind"))
    # the k-th start belongs to the k-th end: of a start, the end is the least end above it
    both = stored(starts.unionAll(ends), "bounds")
    block = F.shiftright("v", 20)
    numbered = both.withColumn("b", block)
    # windows run from the last row on: frames that begin at a row would be gone through anew for each
    w = W.partitionBy("b").orderBy(F.desc("v"), "kind").rowsBetween(W.unboundedPreceding, -1)
    near = numbered.withColumn("end", F.min(F.when(F.col("kind") == 1, F.col("v"))).over(w))
    # a run that goes on behind its block ends at the first end in a later one: looked up over blocks of blocks first, then over the few of these
    firsts = numbered.groupBy("b").agg(F.min(F.when(F.col("kind") == 1, F.col("v"))).alias("first")).withColumn("bb", F.shiftright("b", 20))
    after = lambda by: F.min("first").over(by.rowsBetween(W.unboundedPreceding, -1))
    inner = firsts.withColumn("near", after(W.partitionBy("bb").orderBy(F.desc("b"))))
    outer = firsts.groupBy("bb").agg(F.min("first").alias("first")).select("bb", after(W.orderBy(F.desc("bb"))).alias("far"))
    later = inner.join(outer, "bb").select("b", F.coalesce("near", "far").alias("later"))
    closed = near.where("kind = 0 and end is not null").select(F.col("v").alias("start"), "end")
    open_runs = near.where("kind = 0 and end is null").select("v", "b").join(later, "b").select(F.col("v").alias("start"), F.col("later").alias("end"))
    return closed.unionAll(open_runs)


def coverage(ranges: DataFrame) -> DataFrame:
    """One row: sky_fraction of ranges (start, end) of depth-29 cells."""
    return ranges.agg((F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)) / F.lit(float(H.n_cells(H.MAX_DEPTH)))).alias("sky_fraction"))


def mean_centre(df: DataFrame, lon: str = "ra", lat: str = "dec") -> DataFrame:
    """One row: lon, lat in degrees of the mean direction of all placed rows, and max_distance in degrees of a row from it."""
    placed = df.where(~(F.isnan(lon) | F.isnan(lat)) & F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(lon).alias("lo"), F.col(lat).alias("la"))
    lo, la = F.radians("lo"), F.radians("la")
    mean = placed.agg(F.avg(F.cos(la) * F.cos(lo)).alias("x"), F.avg(F.cos(la) * F.sin(lo)).alias("y"), F.avg(F.sin(la)).alias("z"))
    centre = mean.select(F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)).alias("lon"), F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))).alias("lat"))
    far = placed.join(F.broadcast(centre)).agg(F.degrees(F.max(H.distance(F.col("lo"), F.col("la"), F.col("lon"), F.col("lat")))).alias("max_distance"))
    return centre.join(F.broadcast(far))


def multicone(df: DataFrame, centres: DataFrame, radius: float, lon: str = "ra", lat: str = "dec", cell: str = "hpx29", clon: str = "ra", clat: str = "dec") -> DataFrame:
    """Rows within ``radius`` degrees of any centre, each once: an equi-join on the cells that centres' cones touch, then the distance.

    A cell that lies wholly in some cone is kept once and needs no distance; of the others, each is joined with the centres whose cones' borders may cross it.
    """
    spark, depth = df.sparkSession, 0
    while depth < 12 and H.radius_np(depth + 1) > float(radius) * 3.14159 / 180:
        depth += 1
    # cells of about the cone's size are never wholly inside: two levels deeper, those of a dense field of centres mostly are
    depth += 2
    cover = R.ConeCovers(radius, depth)

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            for part in (batch.slice(k, CONES_AT_ONCE) for k in range(0, batch.num_rows, CONES_AT_ONCE)):
                lo, la = part.column(0).to_numpy(zero_copy_only=False) % 360, part.column(1).to_numpy(zero_copy_only=False)
                at, found, full = cover(lo, la)
                none = np.full(len(full), np.nan)
                columns = [pa.array(np.concatenate([v[at], none]), pa.float64(), from_pandas=True) for v in (lo, la)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([found, full]), pa.int64())], ["_lo", "_la", "_cell"])

    known = centres.select(F.col(clon).cast("double").alias("_lo"), F.col(clat).cast("double").alias("_la")).where(_placed_at("_lo", "_la"))
    # dealt to a number of tasks: covers cost much more than their centres' bytes tell
    dealt = known.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_lo", "_la").distinct()
    touched = stored(dealt.mapInArrow(cells, "_lo double, _la double, _cell long"), "touched")
    full = touched.where("_lo is null").distinct()
    inside = small_side(full.select("_cell"), H.n_cells(depth))
    tests = stored(touched.where("_lo is not null").join(inside, "_cell", "left_anti").select(*touched.columns).unionAll(full), "cones")
    near = F.col("_lo").isNull() | (H.distance(F.col(lon), F.col(lat), F.col("_lo"), F.col("_la")) <= F.radians(F.lit(float(radius))))
    return df.where(_placed_at(lon, lat)).join(small_side(tests, tests.count()), (H.parent(F.col(cell), H.MAX_DEPTH, depth) == F.col("_cell")) & near, "left_semi")


def _placed_at(lon: str, lat: str) -> Column:
    """Whether a row has a position: others lie in cell 0, but in no region."""
    return F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
