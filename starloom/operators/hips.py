"""HiPS catalogues: layers of a sorted catalogue, from an all-sky sample down to every row, and their tile statistics.

The recursion goes over cells, whose rows are neighbours in a sorted catalogue. A cell with few rows is placed whole, down to
its last level, by one task that gets its rows once. Larger cells are gone through level by level by all tasks: their few
picks are stored, not their rows, which stay where they are. So rows are dealt once, however many levels there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import healpix as H
from . import catalog, sampling
from .shared import small_side, stored

#: Cells with no more rows than this are placed by one task, which holds fewer than twice as many rows at a time.
LOCAL_ROWS = 250_000


@dataclass(frozen=True)
class Budget:
    """Rows of layers 1 and 2: per whole sky, and for the part that is covered at depth 2."""

    n1: int
    n2: int
    n12: int
    step: int

    @classmethod
    def of(cls, covered: int, n1: int = 3000, r21: int = 3) -> Budget:
        n12 = n1 * (1 + r21) * covered // 192
        first = n12 // (1 + r21)
        return cls(first, n12 - first, n12, 1 + r21)


def case_of(n_rows: int, budget: Budget) -> str:
    """A: all rows fit layer 1; B: they fit layers 1 and 2; C: deeper layers are needed."""
    return "A" if n_rows <= 3 * budget.n1 // 2 else "B" if n_rows <= 3 * budget.n12 // 2 else "C"


def case_a(df: DataFrame) -> DataFrame:
    """df with depth 1 for all rows."""
    return df.withColumn("depth", F.lit(1))


def case_b(df: DataFrame, step: int, score: str | None = None) -> DataFrame:
    """df with depth 1 for one row of every ``step`` and 2 for the others."""
    if not score:
        return df.withColumn("depth", F.when(F.pmod("recno", F.lit(step)) == 0, 1).otherwise(2))
    picks = sampling.pick_per_chunk(df, step, score).select(F.col("recno").alias("_r"), F.lit(1).alias("_d"))
    return df.join(picks, F.col("recno") == F.col("_r"), "left").withColumn("depth", F.coalesce("_d", F.lit(2))).drop("_r", "_d")


def first_picks(df: DataFrame, n_rows: int, budget: Budget, score: str | None = None) -> DataFrame:
    """(recno, depth): the picks of layers 1 and 2 of case C, no more than the budget has."""
    size = -(-n_rows // max(1, budget.n12))
    return sampling.pick_per_chunk(df, size, score).select("recno", F.when(F.pmod("chunk", F.lit(budget.step)) == 0, 1).otherwise(2).alias("depth"))


def marked(df: DataFrame, picks: DataFrame, n_picks: int) -> DataFrame:
    """df with the depth of those rows that are among the picks (recno, depth), null for the rest."""
    picks = picks.select(F.col("recno").alias("_r"), F.col("depth").alias("_d"))
    return df.join(small_side(picks, n_picks), F.col("recno") == F.col("_r"), "left").withColumn("depth", F.col("_d")).drop("_r", "_d")


def first_layers(df: DataFrame, n_rows: int, budget: Budget, score: str | None = None) -> DataFrame:
    """df with depth 1 or 2 for the picks of case C, null for the rest."""
    return marked(df, first_picks(df, n_rows, budget, score), max(1, budget.n12))


def cells_of(df: DataFrame, depth: int, n_tot: int) -> DataFrame:
    """Of each active cell at a depth: n rows, first recno, rows taken before, rows to take (sel) and whether it is a leaf."""
    cell = H.parent(F.col("hpx29"), H.MAX_DEPTH, depth)
    deep = min(depth + 3, H.MAX_DEPTH)
    sub = H.parent(F.col("hpx29"), H.MAX_DEPTH, deep).bitwiseAND(F.lit((1 << (2 * (deep - depth))) - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), sub)
    out = df.groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min("recno").alias("start"), F.count("depth").alias("taken"), F.bit_count(F.bit_or(bit)).cast("long").alias("cov3")
    )
    whole = 1 << (2 * (deep - depth))
    out = out.withColumn("sel", F.greatest(F.lit(1), F.floor(F.col("cov3") * n_tot / whole)).cast("long"))
    leaf = (F.col("n") - F.col("taken") <= F.floor(3 * F.col("sel") / 2)) | F.lit(depth >= H.MAX_DEPTH)
    return out.withColumn("leaf", leaf)


def within(df: DataFrame, cells: DataFrame, depth: int, n_cells: int, *columns: str) -> DataFrame:
    """Rows of df in the cells of a depth, with these columns of cells_of()."""
    cells = cells.select(F.col("cell").alias("_cell"), *columns)
    return df.join(small_side(cells, n_cells), H.parent(F.col("hpx29"), H.MAX_DEPTH, depth) == F.col("_cell"))


def layer_picks(rows: DataFrame, score: str | None = None) -> DataFrame:
    """(recno): of rows with depth and ``_cell, n, start, sel`` of their open cells, the pick of each chunk among those not taken."""
    chunk = sampling.chunk_of(F.col("recno"), F.col("start"), F.col("n"), F.col("sel"))
    bound = lambda k: F.col("start") + F.floor(k * F.col("n") / F.col("sel")).cast("long")
    key = sampling.score_key(F.col(score)) if score else sampling.middle_key(F.col("recno"), bound(F.col("_chunk")), bound(F.col("_chunk") + 1))
    free = rows.where(F.col("depth").isNull()).withColumn("_chunk", chunk).select("_cell", "_chunk", F.struct(key.alias("k"), F.col("recno").alias("r")).alias("o"))
    return free.groupBy("_cell", "_chunk").agg(F.min("o").alias("m")).select(F.col("m.r").alias("recno"))


def next_layer(df: DataFrame, depth: int, n_tot: int = 500, score: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of active cells with the depth of those that this layer takes, and its cells' statistics.

    df has recno, hpx29 and depth (null: not taken yet). The first result has a column ``_leaf``: rows in leaf cells are done.
    """
    cells = cells_of(df, depth, n_tot)
    rows = within(df, cells, depth, H.n_cells(depth), "n", "start", "sel", "leaf")
    picks = layer_picks(rows.where(~F.col("leaf")), score).select(F.col("recno").alias("_r"), F.lit(True).alias("_pick"))
    out = rows.join(small_side(picks, H.n_cells(depth) * max(1, n_tot)), F.col("recno") == F.col("_r"), "left")
    now = F.col("depth").isNull() & (F.col("leaf") | F.coalesce("_pick", F.lit(False)))
    out = out.withColumn("depth", F.when(now, F.lit(depth)).otherwise(F.col("depth"))).withColumnRenamed("leaf", "_leaf").drop("_cell", "_r", "_pick", "n", "start", "sel")
    return out, cells


def _ranks(score: pa.ChunkedArray) -> np.ndarray:
    """The place of each score in the order of sampling.score_key; equal scores have one place."""
    null = score.is_null().to_numpy()
    value = score.fill_null(0.0).to_numpy()
    kind = np.where(null, 2, np.isnan(value))
    value = np.where(kind > 0, 0.0, value)
    order = np.lexsort((value, kind))
    rank = np.zeros(len(order), np.int64)
    rank[order[1:]] = np.cumsum((np.diff(value[order]) != 0) | (np.diff(kind[order]) != 0))
    return rank


def place_cells(rows: pa.Table, n_tot: int) -> pa.Table:
    """(recno, hpx29, depth, leaf) of rows of whole cells, each a root at its depth ``_root``, with depth null where none is taken yet.

    ``leaf`` is the depth of the leaf cell that a row is the first of, null for other rows. All cells of a level are gone
    through at once; ``at`` are the rows that are in open cells still.
    """
    rows = rows.take(np.argsort(rows["recno"].to_numpy()))
    cell, root, depth = rows["hpx29"].to_numpy(), rows["_root"].to_numpy(), rows["depth"].fill_null(0).to_numpy().copy()
    rank = _ranks(rows["_score"]) if "_score" in rows.column_names else None
    size, leaf, at = len(cell), np.zeros(len(cell), np.int32), np.zeros(0, np.int64)
    for d in range(int(root.min()), H.MAX_DEPTH + 1):
        at = np.sort(np.concatenate([at, np.flatnonzero(root == d)]))
        if not at.size:
            continue
        deep = min(d + 3, H.MAX_DEPTH)
        begins = lambda k: np.diff(cell[at] >> (2 * (H.MAX_DEPTH - k)), prepend=-1) != 0  # noqa: B023, E731
        head = np.flatnonzero(begins(d))
        n = np.diff(head, append=at.size)
        free = depth[at] == 0
        sel = np.maximum(1, np.add.reduceat(begins(deep).astype(np.int64), head) * n_tot // 4 ** (deep - d))
        done = (np.add.reduceat(free.astype(np.int64), head) <= 3 * sel // 2) | (d == H.MAX_DEPTH)
        leaf[at[head[done]]] = d
        in_leaf = np.repeat(done, n)
        depth[at[in_leaf & free]] = d
        own = np.flatnonzero(~in_leaf & free)
        if own.size:
            c = np.repeat(np.arange(len(head)), n)[own]
            n, sel, offset = n[c], sel[c], own - head[c]
            chunk = ((offset + 1) * sel + n - 1) // n - 1
            if rank is None:
                far = offset - (chunk * n // sel + (chunk + 1) * n // sel) // 2
                key = (far >= 0) * size + np.abs(far)
            else:
                key = rank[at[own]]
            chunks = np.flatnonzero((np.diff(c, prepend=-1) != 0) | (np.diff(chunk, prepend=-1) != 0))
            depth[np.minimum.reduceat(key * size + at[own], chunks) % size] = d
        at = at[~in_leaf]
    return pa.table({"recno": rows["recno"], "hpx29": rows["hpx29"], "depth": pa.array(depth, pa.int32()), "leaf": pa.array(leaf, pa.int32(), mask=leaf == 0)})


def deeper_layers(rows: DataFrame, picks: DataFrame, n_picks: int, n_tot: int, score: str | None = None) -> DataFrame:
    """(recno, hpx29, depth, leaf) of all rows of case C, as place_cells gives them; rows are stored ones, picks those of layers 1 and 2.

    Of cells with more than LOCAL_ROWS rows, whose number a level bounds by rows / LOCAL_ROWS, only counts and picks are made here.
    """
    small, leaves, large, n_large = [], [], None, 0
    for depth in range(3, H.MAX_DEPTH + 1):
        active = within(rows, large, depth - 1, n_large).drop("_cell") if large else rows
        cells = stored(cells_of(marked(active, picks, n_picks), depth, n_tot), f"cells{depth}")
        few = F.col("n") <= LOCAL_ROWS
        found = cells.agg(F.count_if(few).alias("few"), F.count_if(~few & F.col("leaf")).alias("leaves"), F.count_if(~few & ~F.col("leaf")).alias("large")).first()
        if found["few"]:
            dealt = within(rows, cells.where(few), depth, found["few"], "start").withColumn("_bin", F.floor(F.col("start") / LOCAL_ROWS).cast("int"))
            small.append(dealt.withColumn("_root", F.lit(depth)).drop("_cell", "start"))
        if found["leaves"]:
            done = marked(within(rows, cells.where(~few & F.col("leaf")), depth, found["leaves"], "start"), picks, n_picks)
            leaves.append(done.select("recno", "hpx29", F.coalesce("depth", F.lit(depth)).alias("depth"), F.when(F.col("recno") == F.col("start"), depth).alias("leaf")))
        if not found["large"]:
            break
        large, n_large = cells.where(~few & ~F.col("leaf")), found["large"]
        open_rows = marked(within(rows, large, depth, n_large, "n", "start", "sel"), picks, n_picks)
        picks = picks.unionAll(stored(layer_picks(open_rows, score).withColumn("depth", F.lit(depth)), f"layer{depth}"))
        n_picks += n_large * max(1, n_tot)
    parts = list(leaves)
    if small:
        dealt = marked(reduce(DataFrame.unionAll, small), picks, n_picks)
        parts.append(dealt.groupBy("_bin").applyInArrow(lambda cells: place_cells(cells, n_tot), "recno long, hpx29 long, depth int, leaf int"))
    return reduce(DataFrame.unionAll, parts)


def build(df: DataFrame, score: str | None = None, n1: int = 3000, r21: int = 3, n_tot: int = 500) -> tuple[DataFrame, DataFrame]:
    """(rows with depth, leaf cells (depth, cell)) of a sorted catalogue with recno and hpx29.

    Every row gets exactly one depth. Leaf cells are the coverage: of cases A and B, the non-empty cells at the last depth.
    """
    covered = catalog.n_nonempty(df).first()["n_cells"]
    n_rows = df.count()
    budget = Budget.of(covered, n1, r21)
    case = case_of(n_rows, budget)
    leaf = lambda d: df.select(F.lit(d).alias("depth"), H.parent(F.col("hpx29"), H.MAX_DEPTH, d).alias("cell")).distinct()
    if case == "A":
        return case_a(df), leaf(1)
    if case == "B":
        return case_b(df, budget.step, score), leaf(2)
    key = "_score" if score else None
    narrow = stored(df.select("recno", "hpx29", *([F.col(score).cast("double").alias(key)] if score else [])), "rows")
    picks = stored(first_picks(narrow, n_rows, budget, key), "layers12")
    placed = stored(deeper_layers(narrow, picks, max(1, budget.n12), n_tot, key), "layers")
    ends = placed.where("leaf is not null").select(F.col("leaf").alias("depth"), F.call_function("shiftright", "hpx29", 2 * (H.MAX_DEPTH - F.col("leaf"))).alias("cell"))
    return df.join(placed.select("recno", "depth"), "recno"), ends


def tile_stats(layers: DataFrame) -> DataFrame:
    """(depth, cell, cumul_count, tot_count) of all tiles: rows in this and shallower layers, and rows in all layers.

    A row counts in its ancestors at all depths down to the deepest of the catalogue, as far as its tile has rows of that layer.
    """
    # rows are counted by position and dealt by its order: most tiles then lie in one task, which adds them up before they are shuffled
    counts = stored(layers.groupBy("hpx29", "depth").agg(F.count(F.lit(1)).alias("n")), "counts")
    deepest = counts.agg(F.max("depth")).first()[0] or 1
    spread = counts.repartitionByRange("hpx29").select("hpx29", "depth", "n", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("d"))
    cell = F.call_function("shiftright", F.col("hpx29"), (2 * (H.MAX_DEPTH - F.col("d"))).cast("int"))
    sums = spread.groupBy(F.col("d").alias("depth"), cell.alias("cell")).agg(
        F.sum(F.when(F.col("depth") <= F.col("d"), F.col("n")).otherwise(0)).cast("long").alias("cumul_count"),
        F.sum("n").cast("long").alias("tot_count"),
        F.sum(F.when(F.col("depth") == F.col("d"), F.col("n")).otherwise(0)).alias("own"),
    )
    return sums.where("own > 0").drop("own")
