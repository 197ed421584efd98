"""Sky regions: an exact test for each row as a Column, and a cover of HEALPix ranges that prunes what is read.

A region knows, in numpy, whether it contains a point and a lower bound of a point's distance to its border. A cell whose
circumscribed circle does not reach the border is wholly in or out; the others are split down to the cover's depth. So a
cover can hold too much, never too little. Borders belong to cones, rings, ellipses, zones and polygons (<=), cells hold
what hashes to them. Rows without a position (NaN or null) are in no region.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import healpix as H

_TOP = 2 * H.MAX_DEPTH


def _lon(deg: float) -> float:
    if not 0 <= deg < 360:
        raise ValueError(f"longitude {deg} is not in [0, 360[")
    return float(deg)


def _lat(deg: float) -> float:
    if not -90 <= deg <= 90:
        raise ValueError(f"latitude {deg} is not in [-90, 90]")
    return float(deg)


def _vector(lon, lat) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(axis=-1))


def merge(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint half-open ranges with the same members."""
    out: list[list[int]] = []
    for a, b in sorted(r for r in ranges if r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Region:
    """Base of all regions; combine with &, | and ~."""

    def column(self, lon: Column, lat: Column, cell: Column | None = None) -> Column:
        """The exact test of a position in degrees; ``cell`` is its depth-29 cell, which cell regions need."""
        raise NotImplementedError

    def inside(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def border(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """A lower bound of the distance to the region's border, radians."""
        raise NotImplementedError

    def __and__(self, other: Region) -> Region:
        return _Both(self, other)

    def __or__(self, other: Region) -> Region:
        return _Either(self, other)

    def __invert__(self) -> Region:
        return _Not(self)

    def relation(self, depth: int, cells: np.ndarray) -> np.ndarray:
        """1: cells wholly inside, -1: wholly outside, 0: not known."""
        lon, lat = H.centre_np(depth, cells)
        known = self.border(lon, lat) > H.radius_np(depth)
        return np.where(known, np.where(self.inside(lon, lat), 1, -1), 0)

    def cover(self, depth: int = 9) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Half-open ranges of depth-29 cells: those that may hold members, and those of them that hold members only."""
        some: list[tuple[int, int]] = []
        full: list[tuple[int, int]] = []
        cells = np.arange(12, dtype=np.int64)
        for d in range(depth + 1):
            rel = self.relation(d, cells)
            shift = _TOP - 2 * d
            full += [(int(c) << shift, int(c + 1) << shift) for c in cells[rel > 0]]
            open_cells = cells[rel == 0]
            if d == depth:
                some += [(int(c) << shift, int(c + 1) << shift) for c in open_cells]
            cells = (open_cells[:, None] * 4 + np.arange(4)).ravel()
        return merge(some + full), merge(full)


class _Both(Region):
    def __init__(self, a: Region, b: Region):
        self.a, self.b = a, b

    def column(self, lon, lat, cell=None):
        return self.a.column(lon, lat, cell) & self.b.column(lon, lat, cell)

    def relation(self, depth, cells):
        return np.minimum(self.a.relation(depth, cells), self.b.relation(depth, cells))


class _Either(_Both):
    def column(self, lon, lat, cell=None):
        return self.a.column(lon, lat, cell) | self.b.column(lon, lat, cell)

    def relation(self, depth, cells):
        return np.maximum(self.a.relation(depth, cells), self.b.relation(depth, cells))


class _Not(Region):
    def __init__(self, a: Region):
        self.a = a

    def column(self, lon, lat, cell=None):
        return ~self.a.column(lon, lat, cell)

    def relation(self, depth, cells):
        return -self.a.relation(depth, cells)


class Cone(Region):
    """Points within ``radius`` degrees, in ]0, 180[, of a centre."""

    def __init__(self, lon: float, lat: float, radius: float):
        if not 0 < radius < 180:
            raise ValueError("a cone's radius must be in ]0, 180[")
        self.lon, self.lat, self.radius = _lon(lon), _lat(lat), float(radius)
        self._c = _vector(np.radians(self.lon), np.radians(self.lat))

    def _distance(self, lon, lat):
        return _angle(_vector(lon, lat), self._c)

    def column(self, lon, lat, cell=None):
        return H.distance(lon, lat, self.lon, self.lat) <= float(np.radians(self.radius))

    def inside(self, lon, lat):
        return self._distance(lon, lat) <= np.radians(self.radius)

    def border(self, lon, lat):
        return np.abs(self._distance(lon, lat) - np.radians(self.radius))


class ConeCovers:
    """Covers of many cones of one radius, all at once, by cells of one depth."""

    def __init__(self, radius: float, depth: int):
        self.radius, self.depth = np.radians(Cone(0.0, 0.0, radius).radius), depth

    def __call__(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cone, cell) of cells that a cone's border may cross and that lie wholly in no cone, and the cells that lie wholly in one, each once."""
        for bad in lat[~(np.abs(lat) <= 90)]:
            _lat(bad)
        for bad in lon[~np.isfinite(lon)]:
            _lon(bad)
        vectors = _vector(np.radians(lon), np.radians(lat))
        at, cells = np.repeat(np.arange(len(lon)), 12), np.tile(np.arange(12, dtype=np.int64), len(lon))
        full = [np.zeros(0, np.int64)]
        for d in range(self.depth + 1):
            if d:
                at, cells = np.repeat(at, 4), (cells[:, None] * 4 + np.arange(4)).ravel()
            some, place = np.unique(cells, return_inverse=True)
            away = _angle(_vector(*H.centre_np(d, some))[place], vectors[at]) - self.radius
            reach = H.radius_np(d)
            deeper = 2 * (self.depth - d)
            full.append(((np.unique(cells[away < -reach]) << deeper)[:, None] + np.arange(1 << deeper)).ravel())
            crossed = np.abs(away) <= reach
            at, cells = at[crossed], cells[crossed]
        whole = np.unique(np.concatenate(full))
        rest = ~np.isin(cells, whole)
        return at[rest], cells[rest], whole


class Ring(Cone):
    """Points between ``inner`` and ``outer`` degrees, 0 <= inner < outer < 180, from a centre."""

    def __init__(self, lon: float, lat: float, inner: float, outer: float):
        super().__init__(lon, lat, outer)
        if not 0 <= inner < outer:
            raise ValueError("a ring's inner radius must be in [0, outer[")
        self.inner = float(inner)

    def column(self, lon, lat, cell=None):
        return H.distance(lon, lat, self.lon, self.lat).between(float(np.radians(self.inner)), float(np.radians(self.radius)))

    def inside(self, lon, lat):
        return (d := self._distance(lon, lat)) <= np.radians(self.radius) if not self.inner else (np.radians(self.inner) <= (d := self._distance(lon, lat))) & (d <= np.radians(self.radius))

    def border(self, lon, lat):
        d = self._distance(lon, lat)
        return np.minimum(np.abs(d - np.radians(self.inner)), np.abs(d - np.radians(self.radius)))


class EllipticalCone(Cone):
    """Points whose orthographic projection at the centre lies in the ellipse of semi-axes sin a and sin b, on the centre's side.

    a in ]0, 90], b in ]0, a[, degrees; the position angle of the major axis, in [0, 180[, runs from north to east.
    """

    def __init__(self, lon: float, lat: float, a: float, b: float, angle: float):
        if not 0 < a <= 90 or not 0 < b < a or not 0 <= angle < 180:
            raise ValueError("an ellipse needs a in ]0, 90], b in ]0, a[ and a position angle in [0, 180[")
        super().__init__(lon, lat, a)
        self.a, self.b, self.angle = float(a), float(b), float(angle)

    def column(self, lon, lat, cell=None):
        dlon, la, la0 = F.radians(lon - self.lon), F.radians(lat), float(np.radians(self.lat))
        s0, c0, sp, cp = (float(f(np.radians(v))) for v in (self.lat, self.angle) for f in (np.sin, np.cos))
        del la0
        east = F.cos(la) * F.sin(dlon)
        north = F.sin(la) * c0 - F.cos(la) * s0 * F.cos(dlon)
        near = F.sin(la) * s0 + F.cos(la) * c0 * F.cos(dlon)
        along, across = east * sp + north * cp, east * cp - north * sp
        sa, sb = float(np.sin(np.radians(self.a))), float(np.sin(np.radians(self.b)))
        return (near >= 0) & (F.pow(along / sa, F.lit(2.0)) + F.pow(across / sb, F.lit(2.0)) <= 1)

    def inside(self, lon, lat):
        dlon, la0, pa = lon - np.radians(self.lon), np.radians(self.lat), np.radians(self.angle)
        east, north = np.cos(lat) * np.sin(dlon), np.sin(lat) * np.cos(la0) - np.cos(lat) * np.sin(la0) * np.cos(dlon)
        near = np.sin(lat) * np.sin(la0) + np.cos(lat) * np.cos(la0) * np.cos(dlon)
        along, across = east * np.sin(pa) + north * np.cos(pa), east * np.cos(pa) - north * np.sin(pa)
        return (near >= 0) & ((along / np.sin(np.radians(self.a))) ** 2 + (across / np.sin(np.radians(self.b))) ** 2 <= 1)

    def border(self, lon, lat):
        d = self._distance(lon, lat)
        return np.maximum(0, np.maximum(d - np.radians(self.a), np.radians(self.b) - d))


class Zone(Region):
    """Longitudes [lon_min, lon_max], around 0 if lon_min > lon_max, and latitudes [lat_min, lat_max]."""

    def __init__(self, lon_min: float, lat_min: float, lon_max: float, lat_max: float):
        self.lon_min, self.lon_max, self.lat_min, self.lat_max = _lon(lon_min), _lon(lon_max), _lat(lat_min), _lat(lat_max)
        if lat_min > lat_max:
            raise ValueError("a zone's latitudes must ascend")

    def column(self, lon, lat, cell=None):
        lon = F.pmod(lon, F.lit(360.0))
        inner = lon.between(self.lon_min, self.lon_max) if self.lon_min <= self.lon_max else (lon >= self.lon_min) | (lon <= self.lon_max)
        return inner & lat.between(self.lat_min, self.lat_max)

    def inside(self, lon, lat):
        lon, lat = np.degrees(lon), np.degrees(lat)
        inner = (self.lon_min <= lon) & (lon <= self.lon_max) if self.lon_min <= self.lon_max else (lon >= self.lon_min) | (lon <= self.lon_max)
        return inner & (self.lat_min <= lat) & (lat <= self.lat_max)

    def border(self, lon, lat):
        to_lat = [np.abs(lat - np.radians(v)) for v in (self.lat_min, self.lat_max)]
        to_lon = [np.arcsin(np.clip(np.abs(np.sin(lon - np.radians(v))) * np.cos(lat), 0, 1)) for v in (self.lon_min, self.lon_max)]
        return reduce(np.minimum, to_lat + to_lon)


def jname_zone(name: str, round_: bool = False, epsilon: float = 0.0) -> Zone:
    """The zone of positions whose name by truncation (or rounding) is JHHMMSS[.s]+DDMMSS[.s], widened by epsilon degrees."""
    m = re.fullmatch(r".*?J?(\d{2})(\d{2})(\d{2}(?:\.\d+)?)?([+-])(\d{2})(\d{2})?(\d{2}(?:\.\d+)?)?", name.strip())
    if not m:
        raise ValueError(f"not a JNAME: {name}")
    h, mi, s, sign, d, dm, ds = m.groups()
    part = lambda sec, base: base if sec is None else 10.0 ** -(len(sec.partition(".")[2]))
    lon = int(h) * 15 + int(mi) / 4 + float(s or 0) / 240
    lat = int(d) + int(dm or 0) / 60 + float(ds or 0) / 3600
    dlon = part(s, 60.0) / 240
    dlat = part(ds, 60.0) / 3600 if dm else 1.0
    if round_:
        lo, hi, a, b = lon - dlon / 2, lon + dlon / 2, lat - dlat / 2, lat + dlat / 2
    else:
        lo, hi, a, b = lon, lon + dlon, lat, lat + dlat
    a, b = (-b, -a) if sign == "-" else (a, b)
    return Zone((lo - epsilon) % 360, max(-90, a - epsilon), (hi + epsilon) % 360, min(90, b + epsilon))


class Polygon(Region):
    """A spherical polygon with great-circle edges; inside is the side that does not hold the antipode of the vertices' mean."""

    def __init__(self, vertices: list[tuple[float, float]], complement: bool = False):
        if len(vertices) < 3:
            raise ValueError("a polygon needs three vertices")
        self.vertices, self.complement = [(_lon(a), _lat(b)) for a, b in vertices], complement
        rad = np.radians(np.array(self.vertices))
        self._v = _vector(rad[:, 0], rad[:, 1])
        self._lons = rad[:, 0]
        self._n = np.cross(self._v, np.roll(self._v, -1, axis=0))
        mean = -self._v.sum(axis=0)
        mean = mean / (np.linalg.norm(mean) or 1)
        self._flip = False
        self._flip = bool(self._odd(np.arctan2(mean[1], mean[0]), np.arcsin(np.clip(mean[2], -1, 1))))

    @classmethod
    def from_text(cls, text: str, complement: bool = False) -> Polygon:
        """From ``(lon,lat),(lon,lat),...`` in degrees."""
        values = [float(v) for v in text.replace("(", "").replace(")", "").split(",")]
        return cls(list(zip(values[::2], values[1::2], strict=True)), complement)

    @classmethod
    def from_box(cls, lon: float, lat: float, a: float, b: float, angle: float) -> Polygon:
        """A box of semi-axes a in ]0, 90[ and b in ]0, a] about a centre, a's position angle in [0, 180[ from north to east.

        Its corners are those of the rectangle in the tangent plane.
        """
        if not 0 < a < 90 or not 0 < b <= a or not 0 <= angle < 180:
            raise ValueError("a box needs a in ]0, 90[, b in ]0, a] and a position angle in [0, 180[")
        lo, la, pa = np.radians(_lon(lon)), np.radians(_lat(lat)), np.radians(angle)
        c, east = _vector(lo, la), np.array([-np.sin(lo), np.cos(lo), 0])
        north = np.array([-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)])
        u, v = np.sin(pa) * east + np.cos(pa) * north, np.cos(pa) * east - np.sin(pa) * north
        corners = [c + s * np.tan(np.radians(a)) * u + t * np.tan(np.radians(b)) * v for s, t in ((1, 1), (1, -1), (-1, -1), (-1, 1))]
        corners = [p / np.linalg.norm(p) for p in corners]
        return cls([(float(np.degrees(np.arctan2(p[1], p[0])) % 360), float(np.degrees(np.arcsin(p[2])))) for p in corners])

    def _odd(self, lon, lat):
        """Whether the meridian from a point to the north pole crosses an odd number of edges, turned so that outside is even."""
        odd = np.zeros(np.shape(lon), bool)
        for k in range(len(self._v)):
            a, b, n = self._lons[k], self._lons[(k + 1) % len(self._v)], self._n[k]
            da, db = (np.mod(v - lon + np.pi, 2 * np.pi) - np.pi for v in (a, b))
            cross = ((da <= 0) != (db <= 0)) & (np.abs(da - db) < np.pi)
            with np.errstate(divide="ignore", invalid="ignore"):
                edge = np.arctan(-(n[0] * np.cos(lon) + n[1] * np.sin(lon)) / n[2]) if n[2] else np.full(np.shape(lon), -np.pi)
            odd ^= cross & (edge > lat)
        return odd ^ self._flip

    def column(self, lon, lat, cell=None):
        lo, la = F.radians(lon), F.radians(lat)
        count = F.lit(int(self._flip))
        two_pi = float(2 * np.pi)
        for k in range(len(self._v)):
            a, b, n = float(self._lons[k]), float(self._lons[(k + 1) % len(self._v)]), [float(v) for v in self._n[k]]
            if n[2] == 0:
                continue
            da, db = (F.pmod(F.lit(v + np.pi) - lo, F.lit(two_pi)) - float(np.pi) for v in (a, b))
            cross = ((da <= 0) != (db <= 0)) & (F.abs(da - db) < float(np.pi))
            edge = F.atan(-(n[0] * F.cos(lo) + n[1] * F.sin(lo)) / n[2])
            count = count + F.when(cross & (edge > la), 1).otherwise(0)
        odd = count % 2 == 1
        return ~odd if self.complement else odd

    def inside(self, lon, lat):
        return self._odd(lon, lat) ^ self.complement

    def border(self, lon, lat):
        p = _vector(lon, lat)
        out = np.full(np.shape(lon), np.inf)
        for k in range(len(self._v)):
            a, b = self._v[k], self._v[(k + 1) % len(self._v)]
            n = self._n[k] / (np.linalg.norm(self._n[k]) or 1)
            between = (np.cross(n, a) @ p.T >= 0) & (np.cross(b, n) @ p.T >= 0)
            far = np.minimum(_angle(p, a), _angle(p, b))
            out = np.minimum(out, np.where(between, np.abs(np.arcsin(np.clip(p @ n, -1, 1))), far))
        return out


class Ranges(Region):
    """Cells at a depth by half-open ranges; kept merged, at depth 29."""

    def __init__(self, depth: int, ranges: Iterable[tuple[int, int]]):
        top, shift = H.n_cells(depth), _TOP - 2 * depth
        self.ranges = []
        for a, b in ranges:
            if not 0 <= a < b <= top:
                raise ValueError(f"range [{a}, {b}[ is not within [0, {top}[")
            self.ranges.append((a << shift, b << shift))
        self.ranges = merge(self.ranges)

    @classmethod
    def cell(cls, depth: int, cell: int, border_depth: int | None = None) -> Ranges:
        """One cell, with the cells around it at ``border_depth`` if given."""
        if border_depth is None:
            return cls(depth, [(cell, cell + 1)])
        shift = 2 * (border_depth - depth)
        return cls(border_depth, [(cell << shift, (cell + 1) << shift)] + [(c, c + 1) for c in H.border(depth, cell, border_depth)])

    @classmethod
    def from_text(cls, depth: int, text: str) -> Ranges:
        """From ``FROM-TO`` or ``FROM+N``, several joined by commas."""
        out = []
        for item in text.split(","):
            m = re.fullmatch(r"\s*(\d+)\s*([-+])\s*(\d+)\s*", item)
            if not m:
                raise ValueError(f"'{item}' is neither FROM-TO nor FROM+N")
            a, b = int(m[1]), int(m[3])
            out.append((a, b if m[2] == "-" else a + b))
        return cls(depth, out)

    def column(self, lon, lat, cell=None):
        if cell is None:
            raise ValueError("cell regions need the depth-29 cell of each row")
        return in_ranges(cell, self.ranges)

    def relation(self, depth, cells):
        shift = _TOP - 2 * depth
        out = np.full(len(cells), -1)
        starts, ends = np.array([a for a, _ in self.ranges], object), np.array([b for _, b in self.ranges], object)
        for i, c in enumerate(cells.tolist()):
            a, b = c << shift, (c + 1) << shift
            hit = (starts < b) & (ends > a)
            if hit.any():
                out[i] = int(bool((hit & (starts <= a) & (ends >= b)).any()))
        return out

    def cover(self, depth: int = 9):
        return self.ranges, self.ranges


def in_ranges(cell: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a cell lies in one of half-open ranges; the first and last ends come first, as one comparison that files can prune by."""
    if not ranges:
        return F.lit(False)
    tests = [(cell >= a) & (cell < b) for a, b in ranges]
    return reduce(lambda x, y: x | y, tests)


def moc_from_text(text: str) -> Ranges:
    """A coverage map from its ASCII form (``3/1-4,7 4/100``; ends included) or JSON form (``{"3": [1, 2]}``)."""
    ranges: list[tuple[int, int]] = []
    text = text.strip()
    if text.startswith("{"):
        for d, cells in json.loads(text).items():
            shift = _TOP - 2 * int(d)
            ranges += [(c << shift, (c + 1) << shift) for c in cells]
    else:
        for d, items in re.findall(r"(\d+)/([\d\s,+-]*?)(?=\s*\d+/|\s*$)", text):
            shift = _TOP - 2 * int(d)
            for item in filter(None, re.split(r"[\s,]+", items)):
                a, _, b = item.partition("-")
                ranges.append((int(a) << shift, (int(b or a) + 1) << shift))
    return Ranges(H.MAX_DEPTH, merge(ranges))


def moc_to_text(ranges: list[tuple[int, int]], form: str = "ascii") -> str:
    """Ranges of depth-29 cells as the fewest cells by depth, in ASCII or JSON form."""
    by: dict[int, list[int]] = {}
    for a, b in merge(ranges):
        while a < b:
            d = H.MAX_DEPTH
            while d > 0 and a % (1 << (2 * (H.MAX_DEPTH - d + 1))) == 0 and a + (1 << (2 * (H.MAX_DEPTH - d + 1))) <= b:
                d -= 1
            size = 1 << (2 * (H.MAX_DEPTH - d))
            by.setdefault(d, []).append(a // size)
            a += size
    if form == "json":
        return json.dumps({str(d): sorted(c) for d, c in sorted(by.items())})
    out = []
    for d, cells in sorted(by.items()):
        runs = merge((c, c + 1) for c in cells)
        out.append(f"{d}/" + ",".join(str(a) if b == a + 1 else f"{a}-{b - 1}" for a, b in runs))
    return " ".join(out)


def parse_stcs(text: str) -> Region:
    """A region in STC-S: Circle, Ellipse, Box, Polygon, PositionInterval, AllSky; Union, Intersection, Not and Difference of them.

    Frames and reference positions are read over: positions count as equatorial degrees.
    """
    tokens = re.findall(r"[()]|[^\s()]+", text)
    flavours = {"ICRS", "FK5", "FK4", "J2000", "B1950", "ECLIPTIC", "GALACTIC", "UNKNOWNFRAME", "BARYCENTER", "GEOCENTER", "TOPOCENTER", "HELIOCENTER", "UNKNOWNREFPOS", "SPHERICAL2", "CARTESIAN2"}
    at = 0

    def numbers() -> list[float]:
        nonlocal at
        while at < len(tokens) and tokens[at].upper() in flavours:
            at += 1
        out = []
        while at < len(tokens) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", tokens[at]):
            out.append(float(tokens[at]))
            at += 1
        return out

    def region() -> Region:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("the STC-S text ends early")
        word = tokens[at].lower()
        at += 1
        if word in ("union", "intersection", "not", "difference"):
            while at < len(tokens) and tokens[at] != "(":
                at += 1
            at += 1
            parts = []
            while at < len(tokens) and tokens[at] != ")":
                parts.append(region())
            at += 1
            if word == "not":
                return ~parts[0]
            if word == "difference":
                return parts[0] & ~parts[1]
            return reduce((lambda a, b: a | b) if word == "union" else (lambda a, b: a & b), parts)
        v = numbers()
        if word == "circle":
            return Cone(*v[:3])
        if word == "ellipse":
            return EllipticalCone(*v[:5])
        if word == "box":
            return Polygon.from_box(v[0], v[1], max(v[2], v[3]) / 2, min(v[2], v[3]) / 2, 90.0 if v[2] > v[3] else 0.0)
        if word == "polygon":
            return Polygon(list(zip(v[::2], v[1::2], strict=True)))
        if word == "positioninterval":
            return Zone(*v[:4])
        if word == "allsky":
            return Ranges(0, [(0, 12)])
        raise ValueError(f"unknown STC-S word: {word}")

    out = region()
    if at != len(tokens):
        raise ValueError(f"the STC-S text goes on: {' '.join(tokens[at:])}")
    return out


def parse_centres(text: str, sep: str = " ") -> list[tuple[float, float]]:
    """Cone centres, one ``lon<sep>lat`` in degrees a line; blank lines and those that start with # are skipped."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            lon, lat = (float(v) for v in (line.split() if sep == " " else line.split(sep)))
            out.append((_lon(lon), _lat(lat)))
    return out


#: At most so many ranges go into a filter; beyond, those with the smallest gaps between them are joined.
MAX_RANGES = 64


def coarser(ranges: list[tuple[int, int]], most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all members of the given ones."""
    ranges = merge(ranges)
    if len(ranges) <= most:
        return ranges
    gaps = sorted(range(1, len(ranges)), key=lambda k: ranges[k][0] - ranges[k - 1][1])[: len(ranges) - most]
    joined, closed = [list(ranges[0])], set(gaps)
    for k in range(1, len(ranges)):
        if k in closed:
            joined[-1][1] = ranges[k][1]
        else:
            joined.append(list(ranges[k]))
    return [(a, b) for a, b in joined]


def select(df: DataFrame, region: Region, lon: str = "ra", lat: str = "dec", cell: str = "hpx29", depth: int = 9) -> DataFrame:
    """Rows of df in the region. The cover's ranges on ``cell`` reach the scan and skip row groups of a sorted catalogue;
    the exact test runs only in cells that the border may cross."""
    some, full = region.cover(depth)
    some, c = coarser(some), F.col(cell)
    placed = ~(F.isnan(F.col(lon)) | F.isnan(F.col(lat))) & F.col(lon).isNotNull() & F.col(lat).isNotNull()
    if not some:
        return df.where(F.lit(False))
    bounds = (c >= some[0][0]) & (c < some[-1][1])
    exact = region.column(F.col(lon), F.col(lat), c)
    if isinstance(region, Ranges):
        return df.where(bounds & in_ranges(c, some) & placed & (exact if some != region.ranges else F.lit(True)))
    inner = [r for r in full if r[1] - r[0] >= 1 << (_TOP - 2 * depth)]
    test = in_ranges(c, inner) | exact if 0 < len(inner) <= MAX_RANGES else exact
    return df.where(bounds & in_ranges(c, some) & placed & test)
