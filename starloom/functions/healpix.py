"""HEALPix in the NESTED scheme (Górski et al. 2005): as Spark columns for rows, and in numpy for region covers.

Depth 29 is the finest; its hashes fit a signed long. Angles are degrees in columns, radians in numpy functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 29
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def n_cells(depth: int) -> int:
    """Number of cells at a depth."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth {depth} is not in 0..{MAX_DEPTH}")
    return 12 << (2 * depth)


def with_hash(df: DataFrame, name: str = "hpx29", depth: int = MAX_DEPTH, lon: str = "ra", lat: str = "dec") -> DataFrame:
    """df with the cell of (lon, lat) at a depth as a long; NaN or null positions lie in cell 0.

    Steps are columns of their own, so that no expression is repeated; helper columns start with ``_h_`` and are dropped.
    """
    n_cells(depth)
    side = 1 << depth
    lo, la = F.col(lon).cast("double"), F.col(lat).cast("double")
    bad = lo.isNull() | la.isNull() | F.isnan(lo) | F.isnan(la)
    turn = F.pmod(F.when(bad, F.lit(0.0)).otherwise(lo), F.lit(360.0)) / 90.0
    out = df.withColumns({"_h_bad": bad, "_h_t": F.when(turn >= 4.0, F.lit(0.0)).otherwise(turn), "_h_la": F.radians(F.when(bad, F.lit(0.0)).otherwise(la))})
    out = out.withColumn("_h_z", F.sin("_h_la"))
    z, t = F.col("_h_z"), F.col("_h_t")
    belt = F.abs(z) <= F.lit(2.0 / 3.0)
    out = out.withColumns(
        {
            "_h_q": F.least(F.floor(t), F.lit(3)).cast("long"),
            # sqrt(3 (1 - |sin lat|)) without cancellation near the poles
            "_h_s": F.lit(side * 6.0**0.5) * F.sin((F.lit(np.pi / 2) - F.abs("_h_la")) / 2),
        }
    )
    s, q = F.col("_h_s"), F.col("_h_q")
    top = F.lit(side - 1).cast("long")
    out = out.withColumns(
        {
            "_h_jp": F.when(belt, F.floor(side * (0.5 + t) - 0.75 * side * z)).otherwise(F.least(F.floor((t - q) * s), top)).cast("long"),
            "_h_jm": F.when(belt, F.floor(side * (0.5 + t) + 0.75 * side * z)).otherwise(F.least(F.floor((1 - t + q) * s), top)).cast("long"),
        }
    )
    jp, jm = F.col("_h_jp"), F.col("_h_jm")
    p, m = F.shiftright(jp, depth), F.shiftright(jm, depth)
    face = F.when(belt, F.when(p == m, p.bitwiseOR(F.lit(4))).when(p < m, p).otherwise(m + 8)).otherwise(F.when(z > 0, q).otherwise(q + 8))
    low = lambda v: v.bitwiseAND(F.lit(side - 1))
    x = F.when(belt, low(jm)).otherwise(F.when(z > 0, side - 1 - jm).otherwise(jp))
    y = F.when(belt, side - 1 - low(jp)).otherwise(F.when(z > 0, side - 1 - jp).otherwise(jm))
    # a point on the border of the last base cell can round up into a fifth column
    out = out.withColumns({"_h_f": F.when(belt & (p == m), p.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(4))).otherwise(face), "_h_x": x.cast("long"), "_h_y": y.cast("long")})
    for shift, mask in _MASKS:
        spread = lambda c: F.col(c).bitwiseOR(F.shiftleft(F.col(c), shift)).bitwiseAND(F.lit(mask))  # noqa: B023, E731
        out = out.withColumns({"_h_x": spread("_h_x"), "_h_y": spread("_h_y")})
    code = F.shiftleft(F.col("_h_f"), 2 * depth).bitwiseOR(F.col("_h_x")).bitwiseOR(F.shiftleft(F.col("_h_y"), 1))
    # a term that counts as non-deterministic keeps filters above the hash: pushed below, each of their comparisons would repeat it
    once = F.spark_partition_id() < 0
    out = out.withColumn(name, F.when(F.col("_h_bad") | once, F.lit(0)).otherwise(code).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("_h_")])


def parent(cell: Column, depth: int, up: int) -> Column:
    """The cell at the coarser depth ``up`` that holds a cell of ``depth``."""
    return F.shiftright(cell, 2 * (depth - up))


def zuniq(depth: Column | int, cell: Column) -> Column:
    """Depth and cell in one number that sorts in z-order."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftleft", F.shiftleft(cell, 1).bitwiseOR(F.lit(1)), (2 * (MAX_DEPTH - d)).cast("int"))


def from_zuniq(value: int) -> tuple[int, int]:
    """(depth, cell) of a zuniq number."""
    zeros = (value & -value).bit_length() - 1
    return MAX_DEPTH - zeros // 2, value >> (zeros + 1)


def distance(lon: Column, lat: Column, lon0: float | Column, lat0: float | Column) -> Column:
    """Great-circle distance in radians between positions in degrees (haversine)."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    dlat, dlon = F.radians(lat - as_col(lat0)), F.radians(lon - as_col(lon0))
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat)) * F.cos(F.radians(as_col(lat0))) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


# --- numpy, on the driver or in Arrow functions -------------------------------------------------------------------


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for shift, mask in _MASKS:
        v = (v | (v << shift)) & mask
    return v


def _squeeze(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64) & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> shift)) & mask
    return v


def split_cell(depth: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base cell and x, y inside it."""
    cell = np.asarray(cell, np.int64)
    inner = cell & ((1 << (2 * depth)) - 1)
    return cell >> (2 * depth), _squeeze(inner), _squeeze(inner >> 1)


def join_cell(depth: int, face: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.asarray(face, np.int64) << (2 * depth)) | _spread(np.asarray(x)) | (_spread(np.asarray(y)) << 1)


def hash_np(depth: int, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Cells of positions in radians."""
    side = 1 << depth
    t = np.mod(np.asarray(lon, float), 2 * np.pi) / (np.pi / 2)
    t = np.where(t >= 4, 0.0, t)
    lat = np.asarray(lat, float)
    z = np.sin(lat)
    belt = np.abs(z) <= 2 / 3
    q = np.minimum(np.floor(t), 3).astype(np.int64)
    s = side * np.sqrt(6) * np.sin((np.pi / 2 - np.abs(lat)) / 2)
    jp = np.where(belt, np.floor(side * (0.5 + t) - 0.75 * side * z), np.minimum(np.floor((t - q) * s), side - 1)).astype(np.int64)
    jm = np.where(belt, np.floor(side * (0.5 + t) + 0.75 * side * z), np.minimum(np.floor((1 - t + q) * s), side - 1)).astype(np.int64)
    p, m = jp >> depth, jm >> depth
    face = np.where(belt, np.where(p == m, (p & 3) | 4, np.where(p < m, p, m + 8)), np.where(z > 0, q, q + 8))
    x = np.where(belt, jm & (side - 1), np.where(z > 0, side - 1 - jm, jp))
    y = np.where(belt, side - 1 - (jp & (side - 1)), np.where(z > 0, side - 1 - jp, jm))
    return join_cell(depth, face, x, y)


_RING, _TURN = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]), np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


def centre_np(depth: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes, in radians, of cells' centres."""
    side = 1 << depth
    face, x, y = split_cell(depth, cell)
    ring = _RING[face] * side - x - y - 1
    north, south = ring < side, ring > 3 * side
    near = np.where(north, ring, np.where(south, 4 * side - ring, side)).astype(float)
    cap = near**2 / (3.0 * side**2)
    z = np.where(north, 1 - cap, np.where(south, cap - 1, (2 * side - ring) * 2.0 / (3.0 * side)))
    odd = np.where(north | south, 0, (ring - side) & 1)
    turn = (_TURN[face] * near + x - y + 1 + odd) / 2
    lon = np.mod((turn - (odd + 1) / 2) * (np.pi / 2) / near, 2 * np.pi)
    colat = 2 * np.arcsin(np.sqrt(np.minimum(1, cap / 2)))
    lat = np.where(north, np.pi / 2 - colat, np.where(south, colat - np.pi / 2, np.arcsin(np.clip(z, -1, 1))))
    return lon, lat


def radius_np(depth: int) -> float:
    """No point of a cell is farther from its centre, in radians."""
    side = 1 << depth
    a = np.array([np.sqrt(1 - 4 / 9) * np.cos(np.pi / (4 * side)), np.sqrt(1 - 4 / 9) * np.sin(np.pi / (4 * side)), 2 / 3])
    z = 1 - (1 - 1 / side) ** 2 / 3
    b = np.array([np.sqrt(1 - z * z), 0, z])
    return float(np.arctan2(np.linalg.norm(np.cross(a, b)), a @ b)) * 1.0001


#: Steps around a cell, and what lies beyond each side of each base cell, with how axes turn there.
_STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
_BEYOND = {
    (-1, -1): ([8, 9, 10, 11, -1, -1, -1, -1, 10, 11, 8, 9], (0, 0, 3)), (0, -1): ([5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8], (0, 0, 6)),
    (1, -1): ([-1, -1, -1, -1, 5, 6, 7, 4, -1, -1, -1, -1], (0, 0, 0)), (-1, 0): ([4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10], (0, 0, 5)),
    (0, 0): (list(range(12)), (0, 0, 0)), (1, 0): ([1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4], (5, 0, 0)),
    (-1, 1): ([-1, -1, -1, -1, 7, 4, 5, 6, -1, -1, -1, -1], (0, 0, 0)), (0, 1): ([3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7], (6, 0, 0)),
    (1, 1): ([2, 3, 0, 1, -1, -1, -1, -1, 0, 1, 2, 3], (3, 0, 0)),
}


def neighbours(depth: int, cell: int) -> list[int]:
    """The 6 to 8 cells around a cell."""
    side = 1 << depth
    face, x, y = (int(v) for v in split_cell(depth, np.array(cell)))
    out = []
    for dx, dy in _STEPS:
        u, v = x + dx, y + dy
        over = (int(u >= side) - int(u < 0), int(v >= side) - int(v < 0))
        faces, turns = _BEYOND[over]
        to, turn = faces[face], turns[face >> 2]
        if to < 0:
            continue
        u, v = u - over[0] * side, v - over[1] * side
        u, v = (side - 1 - u if turn & 1 else u), (side - 1 - v if turn & 2 else v)
        u, v = (v, u) if turn & 4 else (u, v)
        out.append(int(join_cell(depth, np.array(to), np.array(u), np.array(v))))
    return sorted(set(out))


def border(depth: int, cell: int, deeper: int) -> list[int]:
    """Cells at a deeper depth that touch a cell from outside."""
    if deeper < depth:
        raise ValueError("the border's depth must not be coarser than the cell's")
    k = deeper - depth
    side = 1 << k
    first = cell << (2 * k)
    inner = set()
    for i in range(side):
        for x, y in ((i, 0), (i, side - 1), (0, i), (side - 1, i)):
            inner.add(first | int(_spread(np.array(x))) | int(_spread(np.array(y))) << 1)
    return sorted({n for c in inner for n in neighbours(deeper, c) if n >> (2 * k) != cell})
