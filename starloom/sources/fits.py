"""FITS files as a Spark data source: ``spark.read.format("fits")`` after ``register(spark)``.

Views: ``rows`` of a binary table (the default), ``hdus``, ``columns`` and ``keywords``. Rows are read by ranges, each a
task that seeks to its bytes and decodes them with numpy's big-endian types into Arrow batches; only headers are read on
the driver. A folder stands for all ``*.fits`` files in it, whose first binary tables must have one schema and no heap.
Writing makes one file: tasks write row parts, and the commit puts header, rows and heap together.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK, CARD = 2880, 80
TASK_BYTES, CHUNK_ROWS = 32 << 20, 16384


class FitsError(ValueError):
    """The file is not FITS, or holds what is asked for in a form that cannot be read."""


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pa.fs.LocalFileSystem(), path)


# --- cards ----------------------------------------------------------------------------------------------------------


def card_value(raw: str):
    """The value of a card's text behind ``KEYWORD =``: bool, int, Decimal for reals, str, or None."""
    text = raw.strip()
    if text.startswith("'"):
        out, at = [], 1
        while at < len(text):
            if text[at] == "'":
                if text[at + 1 : at + 2] != "'":
                    break
                at += 1
            out.append(text[at])
            at += 1
        return "".join(out).rstrip()
    text = text.split("/", 1)[0].strip()
    if text in ("T", "F"):
        return text == "T"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([EDed][+-]?\d+)?", text):
        return Decimal(text.upper().replace("D", "E"))
    return text or None


def read_cards(cards: list[str]) -> dict[str, object]:
    """Keywords and values; the first of repeated keywords counts. CONTINUE strings are joined, HIERARCH names keep their spaces."""
    out: dict[str, object] = {}
    last = None
    for card in cards:
        if card.startswith("CONTINUE") and last is not None and isinstance(out.get(last), str):
            head = out[last]
            more = card_value(card[8:])
            out[last] = (head[:-1] if head.endswith("&") else head) + str(more if more is not None else "")
            continue
        last = None
        if card.startswith("HIERARCH") and "=" in card:
            name, _, value = card[8:].partition("=")
        elif card[8:10] == "= ":
            name, value = card[:8], card[10:]
        else:
            continue
        name = name.strip()
        if name not in out:
            out[name] = card_value(value)
            last = name
    return out


def format_card(key: str, value, comment: str = "") -> bytes:
    """A fixed-format card of 80 bytes."""
    if value is None:
        text = f"{key:<8}{comment}"
    elif isinstance(value, bool):
        text = f"{key:<8}= {'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{key:<8}= {value:>20d}"
    elif isinstance(value, (float, Decimal)):
        text = f"{key:<8}= {repr(float(value)).upper():>20}"
    else:
        quoted = str(value).replace("'", "''")
        text = f"{key:<8}= '{quoted:<8}'"
    if comment and value is not None:
        text = f"{text:<30} / {comment}"
    if len(text) > CARD and not comment:
        raise FitsError(f"the value of {key} is too long for a card")
    return text[:CARD].ljust(CARD).encode("ascii")


def text_cards(key: str, value: str) -> list[bytes]:
    """The cards of a string: one, or with CONTINUE cards where it is too long for that."""
    pieces, room = [""], 67
    for c in value.encode("ascii", "replace").decode():
        size = len(pieces[-1].replace("'", "''")) + (2 if c == "'" else 1)
        if size > room:
            pieces.append("")
        pieces[-1] += c
    quoted = [p.replace("'", "''") + ("&" if k < len(pieces) - 1 else "") for k, p in enumerate(pieces)]
    return [format_card(key, value) if len(pieces) == 1 else f"{key:<8}= '{quoted[0]}'".ljust(CARD).encode(), *[f"CONTINUE  '{q}'".ljust(CARD).encode() for q in quoted[1:]]]


def engineering(value: float, digits: int) -> str:
    """A number with so many significant digits and an exponent that is a multiple of 3."""
    if not value or not math.isfinite(value):
        return f"{value:.{max(0, digits - 1)}f}" if not value else str(value)
    power = math.floor(math.log10(abs(float(f"{value:.{digits - 1}e}"))))
    exponent = power - power % 3
    return f"{value / 10**exponent:.{max(0, digits - 1 - (power - exponent))}f}E{exponent:+d}"


# --- headers --------------------------------------------------------------------------------------------------------

_SIZES = {"L": 1, "B": 1, "I": 2, "J": 4, "K": 8, "E": 4, "D": 8, "C": 8, "M": 16, "A": 1}
_DTYPES = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16", "A": "u1", "X": "u1"}
_UNSIGNED = {"B": -128, "I": 1 << 15, "J": 1 << 31, "K": 1 << 63}


@dataclass
class Column:
    """A column of a binary table, from its keywords."""

    idx: int
    name: str
    tform: str
    repeat: int = 1
    code: str = "D"
    pointer: str = ""
    most: int | None = None
    offset: int = 0
    unit: str | None = None
    ucd: str | None = None
    desc: str | None = None
    tnull: int | None = None
    tscal: float = 1.0
    tzero: int | Decimal = 0
    tdisp: str | None = None
    tdim: tuple[int, ...] | None = None
    tdmin: str | None = None
    tdmax: str | None = None

    def __post_init__(self):
        m = re.fullmatch(r"\s*(\d*)(?:([PQ])([LXBIJKEDCMA])(?:\((\d+)\))?|([LXBIJKEDCMA]))[^\s]*\s*", self.tform)
        if not m:
            raise FitsError(f"column {self.name}: TFORM '{self.tform}' is not known")
        self.repeat = int(m[1]) if m[1] else 1
        self.pointer, self.code = m[2] or "", m[3] or m[5]
        self.most = int(m[4]) if m[4] else None

    @property
    def width(self) -> int:
        if self.pointer:
            return self.repeat * (8 if self.pointer == "P" else 16)
        return (self.repeat + 7) // 8 if self.code == "X" else self.repeat * _SIZES[self.code]

    @property
    def is_unsigned(self) -> bool:
        return self.tscal == 1 and self.code in _UNSIGNED and self.tzero == _UNSIGNED[self.code]

    @property
    def is_scaled(self) -> bool:
        return self.code in "BIJKED" and not (self.tscal == 1 and self.tzero == 0) and not self.is_unsigned

    def element(self) -> T.DataType:
        if self.is_scaled:
            return T.FloatType() if self.code in "BIE" else T.DoubleType()
        if self.is_unsigned:
            return {"B": T.ByteType(), "I": T.IntegerType(), "J": T.LongType(), "K": T.DecimalType(20, 0)}[self.code]
        part = T.FloatType() if self.code == "C" else T.DoubleType()
        pair = T.StructType([T.StructField("re", part), T.StructField("im", part)])
        return {"L": T.BooleanType(), "X": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType(), "C": pair, "M": pair, "A": T.StringType()}[self.code]

    def spark_type(self) -> T.DataType:
        if self.code == "A" or not self.pointer and self.repeat == 1 and self.code != "X" or not self.repeat:
            return self.element()
        return T.ArrayType(self.element())

    def storage(self) -> dict | None:
        """How single whole numbers are stored, for writing them so again; None: no such column."""
        if self.pointer or self.repeat != 1 or self.code not in "BIJ" or not self.tscal:
            return None
        zero = int(self.tzero) if self.tzero == int(self.tzero) else float(self.tzero)
        return {"code": self.code, "scal": self.tscal, "zero": zero, "scaled": self.is_scaled} | ({} if self.tnull is None else {"null": self.tnull})

    def display(self) -> str:
        """The type as text: ``i64?`` may be null, ``f32[3]`` has a fixed length, ``h32(i16[5])`` lies in the heap."""
        base = {"L": "bool?", "X": "bit", "B": "u8", "I": "i16", "J": "i32", "K": "i64", "E": "f32", "D": "f64", "C": "C32", "M": "C64", "A": "c"}[self.code]
        if self.is_unsigned:
            base = {"B": "i8", "I": "u16", "J": "u32", "K": "u64"}[self.code]
        if self.is_scaled:
            base = f"{'f32' if self.code in 'BIE' else 'f64'}({ {'B': 'i8'}.get(self.code, base)})"
        elif self.tnull is not None and self.code in "BIJK":
            base += "?"
        if self.pointer:
            size = "" if self.most is None else str(self.most)
            return f"h{32 if self.pointer == 'P' else 64}({'s' if self.code == 'A' else base}[{size}])"
        if not self.repeat:
            return f"void({base})"
        if self.code == "X":
            return f"bits[{self.repeat}]"
        if self.code == "A" and self.repeat > 1:
            return f"s[{self.repeat}]"
        return base if self.repeat == 1 else f"{base}[{self.repeat}]"


@dataclass
class Hdu:
    """A header and where its data lie."""

    idx: int
    kind: str
    head_start: int
    head_bytes: int
    data_start: int
    data_bytes: int
    cards: list[str]
    keys: dict[str, object]
    dims: list[int] = field(default_factory=list)
    xtension: str = ""

    @property
    def n_rows(self) -> int:
        return int(self.keys.get("NAXIS2", 0))

    @property
    def row_bytes(self) -> int:
        return int(self.keys.get("NAXIS1", 0))

    @property
    def heap_start(self) -> int:
        """First byte of the heap in the file; a THEAP inside the rows counts as no gap."""
        main = self.row_bytes * self.n_rows
        return self.data_start + max(main, int(self.keys.get("THEAP", main)))

    def columns(self) -> list[Column]:
        k, out, at = self.keys, [], 0
        for i in range(1, int(k.get("TFIELDS", 0)) + 1):
            text = lambda name: None if k.get(f"{name}{i}") is None else str(k[f"{name}{i}"])  # noqa: B023, E731
            if f"TFORM{i}" not in k:
                raise FitsError(f"column {i} has no TFORM")
            zero = k.get(f"TZERO{i}", 0)
            dims = re.findall(r"\d+", text("TDIM") or "")
            null = k.get(f"TNULL{i}")
            column = Column(
                i - 1, text("TTYPE") or f"col_{i - 1}", str(k[f"TFORM{i}"]), unit=text("TUNIT"), ucd=text("TUCD") or text("UCD__"), desc=text("TCOMM"),
                tnull=int(null) if isinstance(null, (int, Decimal)) and not isinstance(null, bool) else None, tscal=float(k.get(f"TSCAL{i}", 1)), tzero=int(zero) if zero == int(zero) else zero,
                tdisp=text("TDISP"), tdim=tuple(map(int, dims)) or None, tdmin=text("TDMIN"), tdmax=text("TDMAX"), offset=at,
            )
            column.offset = at
            at += column.width
            out.append(column)
        return out


def parse_display(tdisp: str) -> tuple[str, int, int | None, int | None]:
    """(letter, width, digits, exponent digits) of a TDISP value."""
    m = re.fullmatch(r"\s*(A|L|I|B|O|Z|F|E|EN|ES|G|D)(\d+)(?:\.(\d+)(?:E(\d+))?)?\s*", tdisp)
    if not m:
        raise FitsError(f"TDISP '{tdisp}' is not known")
    return m[1], int(m[2]), int(m[3]) if m[3] else None, int(m[4]) if m[4] else None


def iter_hdus(source) -> Iterator[Hdu]:
    """The HDUs of a seekable file, headers only: data are skipped by arithmetic."""
    at, idx = 0, 0
    source.seek(0, 2)
    size = source.tell()
    while at + BLOCK <= size:
        source.seek(at)
        cards: list[str] = []
        start, ended = at, False
        while not ended:
            block = source.read(BLOCK)
            if len(block) < BLOCK:
                raise FitsError(f"the header at byte {start} has no END")
            at += BLOCK
            for k in range(0, BLOCK, CARD):
                card = bytes(block[k : k + CARD]).decode("latin-1")
                if card[:8].rstrip() == "END":
                    ended = True
                    break
                cards.append(card)
        if not cards or cards[0][:8] not in ("SIMPLE  ", "XTENSION"):
            raise FitsError(f"the header at byte {start} starts with neither SIMPLE nor XTENSION")
        keys = read_cards(cards)
        dims = [int(keys.get(f"NAXIS{i}", 0)) for i in range(1, int(keys.get("NAXIS", 0)) + 1)]
        pixels = math.prod(dims) if dims else 0
        width = abs(int(keys.get("BITPIX", 8))) // 8
        pcount, gcount = int(keys.get("PCOUNT", 0)), int(keys.get("GCOUNT", 1))
        xtension = str(keys.get("XTENSION", "")).strip()
        kind = "PRIMARY" if cards[0].startswith("SIMPLE") else {"BINTABLE": "BINTABLE", "TABLE": "ASCIITABLE", "IMAGE": "IMAGE"}.get(xtension, "UNKNOWN")
        length = width * gcount * (pcount + pixels) if kind != "PRIMARY" and dims else width * pixels
        yield Hdu(idx, kind, start, at - start, at, length, cards, keys, dims, xtension)
        at += -(-length // BLOCK) * BLOCK
        idx += 1


def open_hdus(path: str) -> list[Hdu]:
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        return list(iter_hdus(f))


def tables_of(path: str) -> list[str]:
    """The files that a path stands for: itself, or the FITS files of a folder by name."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.NotFound:
        raise FitsError(f"there is no {path}")
    if info.type == pa.fs.FileType.File:
        return [path]
    files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.path.endswith(".fits"))
    if not files:
        raise FitsError(f"no FITS files are in {path}")
    prefix = path[: path.index(at)] if at in path else ""
    return [prefix + f for f in files]


def binary_table(path: str, hdu: int | None = None) -> Hdu:
    """The HDU asked for, or the first binary table."""
    hdus = open_hdus(path)
    if hdu is not None:
        if not 0 <= hdu < len(hdus):
            raise FitsError(f"{path} has no HDU {hdu}")
        if hdus[hdu].kind != "BINTABLE":
            raise FitsError(f"HDU {hdu} of {path} is {hdus[hdu].kind}, whose data cannot be read as rows")
        return hdus[hdu]
    for h in hdus:
        if h.kind == "BINTABLE":
            return h
    raise FitsError(f"{path} holds no binary table")


# --- rows to Arrow --------------------------------------------------------------------------------------------------


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _plain(column: Column, raw: np.ndarray) -> pa.Array:
    """Stored values, one after the other, as an Arrow array of the column's element type."""
    t = _arrow(column.element())
    if column.code == "L":
        known = (raw == 84) | (raw == 70)
        return pa.array(raw == 84, t, mask=~known)
    if column.code in "CM":
        part = np.float32 if column.code == "C" else np.float64
        return pa.StructArray.from_arrays([pa.array(raw.real.astype(part)), pa.array(raw.imag.astype(part))], ["re", "im"])
    null = raw == column.tnull if column.tnull is not None and column.code in "BIJK" else None
    if column.is_unsigned:
        if column.code == "K":
            shifted = (raw.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).tolist()
            return pa.array([None if null is not None and null[i] else Decimal(v) for i, v in enumerate(shifted)], t)
        value = (raw.astype(np.int64) + int(column.tzero)).astype(t.to_pandas_dtype())
    elif column.is_scaled:
        real = np.float32 if column.code in "BIE" else np.float64
        value = raw.astype(real) * real(column.tscal) + real(float(column.tzero))
    else:
        value = raw.astype(t.to_pandas_dtype())
    return pa.array(value, t, mask=null)


def _string(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1").rstrip()


#: Bytes of a heap that are read along rather than skipped between one cell and the next.
HEAP_GAP = 1 << 16


def _heap_parts(starts: np.ndarray, sizes: np.ndarray, heap) -> list[bytes]:
    """The bytes of cells in the heap, by one read for each run of near cells: in a sorted table a chunk's cells can lie anywhere."""
    parts = [b""] * len(starts)
    order = np.flatnonzero(sizes > 0)
    order = order[np.argsort(starts[order], kind="stable")]
    if not len(order):
        return parts
    reach = np.maximum.accumulate(starts[order] + sizes[order])
    cuts = np.flatnonzero(starts[order][1:] > reach[:-1] + HEAP_GAP) + 1
    for run in np.split(order, cuts):
        first = int(starts[run[0]])
        data = heap(first, int((starts[run] + sizes[run]).max()))
        for k in run.tolist():
            at = int(starts[k]) - first
            parts[k] = data[at : at + int(sizes[k])]
    return parts


def decode_rows(columns: list[Column], raw: np.ndarray, heap) -> pa.RecordBatch:
    """Rows (n, row bytes) to an Arrow batch; ``heap(first, end)`` gives heap bytes."""
    n, arrays = len(raw), []
    for c in columns:
        cells = np.ascontiguousarray(raw[:, c.offset : c.offset + c.width])
        if not c.repeat:
            arrays.append(pa.nulls(n, _arrow(c.spark_type())))
        elif c.pointer:
            place = cells.view(">i4" if c.pointer == "P" else ">i8").reshape(n, -1)[:, :2].astype(np.int64)
            size = 1 if c.code == "X" else _SIZES[c.code]
            lengths = place[:, 0]
            spans = (lengths + 7) // 8 if c.code == "X" else lengths * size
            parts = _heap_parts(place[:, 1], spans, heap)
            if c.code == "A":
                arrays.append(pa.array([_string(p) for p in parts], pa.string()))
                continue
            if c.code == "X":
                flat = pa.array(np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8))[:k] for p, k in zip(parts, lengths.tolist(), strict=True)] or [np.zeros(0)]).astype(bool))
            else:
                flat = _plain(c, np.frombuffer(b"".join(parts), _DTYPES[c.code]))
            arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), flat))
        elif c.code == "A":
            arrays.append(pa.array([_string(v) for v in cells.view(f"S{c.width}").ravel().tolist()], pa.string()))
        elif c.code == "X":
            bits = np.unpackbits(cells, axis=1)[:, : c.repeat].astype(bool)
            arrays.append(pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * c.repeat).astype(np.int32)), pa.array(bits.ravel())))
        else:
            flat = _plain(c, cells.view(_DTYPES[c.code]).ravel())
            arrays.append(flat if c.repeat == 1 else pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * c.repeat).astype(np.int32)), flat))
    return pa.RecordBatch.from_arrays(arrays, [c.name for c in columns])


# --- the data source ------------------------------------------------------------------------------------------------

VIEWS = {
    "hdus": "path string, idx int, type string, head_start bigint, n_blocks int, head_bytes bigint, data_start bigint, data_bytes bigint, simple boolean, bitpix int, naxis int, dims array<bigint>, n_cols int, n_rows bigint, row_bytes int, heap_bytes bigint, pcount bigint, gcount bigint",
    "columns": "path string, hdu int, idx int, name string, type string, unit string, ucd string, desc string, tform string, tdisp string, tdim string, tnull bigint, tscal double, tzero string, tdmin string, tdmax string",
    "keywords": "path string, hdu int, pos int, raw string",
}


def hdu_row(path: str, h: Hdu) -> tuple:
    table = h.kind == "BINTABLE"
    pcount = h.keys.get("PCOUNT")
    heap = h.data_bytes - h.row_bytes * h.n_rows if table else None
    return (
        path, h.idx, h.kind, h.head_start, h.head_bytes // BLOCK, h.head_bytes, h.data_start, h.data_bytes, h.keys.get("SIMPLE"), int(h.keys.get("BITPIX", 8)), len(h.dims), h.dims,
        int(h.keys.get("TFIELDS", 0)) if h.kind in ("BINTABLE", "ASCIITABLE") else None, h.n_rows if h.kind in ("BINTABLE", "ASCIITABLE") else None, h.row_bytes if h.kind in ("BINTABLE", "ASCIITABLE") else None,
        heap, int(pcount) if pcount is not None else None, int(h.keys["GCOUNT"]) if "GCOUNT" in h.keys else None,
    )


def view_rows(path: str, view: str) -> Iterator[tuple]:
    for h in open_hdus(path):
        if view == "hdus":
            yield hdu_row(path, h)
        elif view == "keywords":
            for pos, card in enumerate(h.cards):
                yield (path, h.idx, pos, card)
        elif h.kind == "BINTABLE":
            for c in h.columns():
                dims = None if c.tdim is None else "(" + ",".join(map(str, c.tdim)) + ")"
                yield (path, h.idx, c.idx, c.name, c.display(), c.unit, c.ucd, c.desc, c.tform.strip(), c.tdisp, dims, c.tnull, c.tscal, str(c.tzero), c.tdmin, c.tdmax)


def table_schema(columns: list[Column]) -> T.StructType:
    names = [c.name for c in columns]
    if len(set(names)) < len(names):
        raise FitsError("two columns have the same name")
    about = lambda c: {k: v for k, v in (("unit", c.unit), ("ucd", c.ucd), ("desc", c.desc), ("tform", c.tform), ("tdisp", c.tdisp), ("tdmin", c.tdmin), ("tdmax", c.tdmax), ("stored", c.storage())) if v is not None}
    return T.StructType([T.StructField(c.name, c.spark_type(), True, about(c)) for c in columns])


class FitsSource(DataSource):
    """Options: ``path``; ``view`` (rows, hdus, columns, keywords); ``hdu``: which table, else the first; ``rows``: half-open ranges a-b,c-d of the
    rows of one file, the others are not read; ``number``: the name of a column of row numbers from 0, put behind the others."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self):
        view = self.options.get("view", "rows")
        if view in VIEWS:
            return VIEWS[view]
        if view != "rows":
            raise FitsError(f"there is no view {view}")
        out = table_schema(_same_tables(self.options)[0][1].columns())
        number = self.options.get("number")
        if number in out.names:
            raise FitsError(f"there is a column {number} already")
        return out.add(number, T.LongType(), False) if number else out

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return _Writer(dict(self.options), schema, overwrite)


def _same_tables(options) -> list[tuple[str, Hdu]]:
    """The tables to read. Several files must agree in their columns and have no heap."""
    number = options.get("hdu")
    files = tables_of(options["path"])
    tables = [(f, binary_table(f, None if number is None else int(number))) for f in files]
    if len(tables) > 1:
        first = [(c.name, c.tform.strip(), c.tscal, c.tzero, c.tnull) for c in tables[0][1].columns()]
        for f, h in tables:
            if [(c.name, c.tform.strip(), c.tscal, c.tzero, c.tnull) for c in h.columns()] != first:
                raise FitsError(f"{f} has other columns than {tables[0][0]}")
            if any(c.pointer for c in h.columns()):
                raise FitsError(f"{f} has a heap, which folders cannot have")
    return tables


@dataclass
class _Part(InputPartition):
    path: str
    hdu: int
    first: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.view = options, options.get("view", "rows")

    def partitions(self):
        if self.view != "rows":
            return [_Part(f, -1, 0, 0) for f in tables_of(self.options["path"])]
        out = []
        for f, h in _same_tables(self.options):
            step = max(1, int(self.options.get("task_bytes", TASK_BYTES)) // max(1, h.row_bytes))
            wanted = self.options.get("rows")
            if wanted is not None and len(tables_of(self.options["path"])) > 1:
                raise FitsError("rows by number are those of one file")
            ranges = [(0, h.n_rows)] if wanted is None else [tuple(map(int, r.split("-"))) for r in wanted.split(",") if r]
            out += [_Part(f, h.idx, a, min(end, h.n_rows, a + step)) for first, end in ranges for a in range(first, min(end, h.n_rows), step)]
        return out or [_Part("", -2, 0, 0)]

    def read(self, part: _Part):
        if part.hdu == -2:
            return
        if self.view != "rows":
            yield from view_rows(part.path, self.view)
            return
        fs, at = file_system(part.path)
        with fs.open_input_file(at) as f:
            h = next(x for x in iter_hdus(f) if x.idx == part.hdu)
            columns = h.columns()

            def heap(first: int, end: int) -> bytes:
                f.seek(h.heap_start + first)
                return bytes(f.read(end - first))

            for a in range(part.first, part.end, CHUNK_ROWS):
                b = min(part.end, a + CHUNK_ROWS)
                f.seek(h.data_start + a * h.row_bytes)
                raw = np.frombuffer(f.read((b - a) * h.row_bytes), np.uint8).reshape(b - a, h.row_bytes)
                batch = decode_rows(columns, raw, heap)
                yield batch.append_column(self.options["number"], pa.array(np.arange(a, b))) if "number" in self.options else batch


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)


def read(spark: SparkSession, path: str, view: str = "rows", hdu: int | None = None, rows: list[tuple[int, int]] | None = None, number: str | None = None) -> DataFrame:
    """A file's table or a view of it; ``rows``: only these half-open ranges are read; ``number``: with a column of row numbers."""
    register(spark)
    reader = spark.read.format("fits").option("path", path).option("view", view)
    if rows is not None:
        reader = reader.option("rows", ",".join(f"{a}-{b}" for a, b in rows))
    if number is not None:
        reader = reader.option("number", number)
    return (reader if hdu is None else reader.option("hdu", hdu)).load()


# --- writing --------------------------------------------------------------------------------------------------------


def _plan(schema: T.StructType, about: dict) -> list[dict]:
    """How each field is stored: TFORM, stored dtype, shift and null mark. ``about`` has string widths and null marks by name."""
    out = []
    for f in schema:
        t, own = f.dataType, about.get(f.name, {})
        array = isinstance(t, T.ArrayType)
        e = t.elementType if array else t
        code, zero = {
            T.BooleanType: ("L", 0), T.ByteType: ("B", -128), T.ShortType: ("I", 0), T.IntegerType: ("J", 0), T.LongType: ("K", 0), T.DecimalType: ("K", 1 << 63),
            T.FloatType: ("E", 0), T.DoubleType: ("D", 0), T.StringType: ("A", 0),
        }.get(type(e), ("", 0))
        if isinstance(e, T.StructType) and e.fieldNames() == ["re", "im"]:
            code = "C" if isinstance(e["re"].dataType, T.FloatType) else "M"
        if not code or array and code == "A" or isinstance(e, T.DecimalType) and (e.scale or e.precision > 20):
            raise FitsError(f"column {f.name}: {t.simpleString()} cannot be stored")
        scal = 1
        if own.get("as_read"):
            how = f.metadata["stored"]
            code, zero, scal, own = how["code"], how["zero"], how["scal"], {"null": how.get("null")}
        form = f"1Q{code}" if array else f"{max(1, own.get('width', 1))}A" if code == "A" else f"1{code}"
        out.append({"name": f.name, "code": code, "array": array, "form": form, "zero": zero, "scal": scal, "null": own.get("null"), "width": 16 if array else max(1, own.get("width", 1)) if code == "A" else _SIZES[code], "meta": dict(f.metadata or {})})
    return out


def _stored(values: pa.Array, how: dict) -> np.ndarray:
    """Values as stored numbers; nulls as the null mark, NaN or 0."""
    code, dtype = how["code"], np.dtype(_DTYPES[how["code"]])
    if code == "L":
        return np.array([0 if v is None else 84 if v else 70 for v in values.to_pylist()], np.uint8)
    if code in "CM":
        return np.array([complex(np.nan, np.nan) if v is None else complex(v["re"], v["im"]) for v in values.to_pylist()], dtype)
    if code in "ED":
        return values.cast(pa.float64() if code == "D" else pa.float32()).to_numpy(zero_copy_only=False).astype(dtype)
    if values.null_count and how["null"] is None:
        raise FitsError(f"column {how['name']} has nulls but no null mark")
    if how["scal"] != 1 or isinstance(how["zero"], float) or pa.types.is_floating(values.type):
        real = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        raw = np.rint((real - float(how["zero"])) / how["scal"])
        return np.where(values.is_null().to_numpy(zero_copy_only=False), how["null"] or 0, raw).astype(dtype)
    if how["zero"] == 1 << 63:
        return np.array([how["null"] if v is None else int(v) - (1 << 63) for v in values.to_pylist()], dtype)
    if not values.null_count:
        return (values.to_numpy(zero_copy_only=False).astype(np.int64) - how["zero"]).astype(dtype)
    return np.array([how["null"] if v is None else v - how["zero"] for v in values.to_pylist()], dtype)


@dataclass
class _Written(WriterCommitMessage):
    part: int
    path: str
    rows: int
    heap: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.plan = _plan(schema, json.loads(options.get("about", "{}")))
        self.like, self.tail = options.get("like"), options.get("tail") == "true"
        fs, at = file_system(self.path)
        if not overwrite and fs.get_file_info(at).type != pa.fs.FileType.NotFound:
            raise FitsError(f"{self.path} is there already")

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        attempt = context.taskAttemptId() if context else 0
        fs, at = file_system(self.path)
        fs.create_dir(f"{at}.parts", recursive=True)
        name = f"{at}.parts/{part:06d}-{attempt}"
        rows = heap = 0
        with fs.open_output_stream(f"{name}.rows") as main, fs.open_output_stream(f"{name}.heap") as side:
            for batch in iterator:
                cells = []
                for c, how in enumerate(self.plan):
                    values = batch.column(c)
                    if how["array"]:
                        lengths = np.array([0 if v is None else v for v in values.value_lengths().to_pylist()], np.int64)
                        data = _stored(values.flatten(), how).tobytes()
                        size = _SIZES[how["code"]]
                        place = np.stack([lengths, heap + np.concatenate(([0], np.cumsum(lengths[:-1]))) * size], axis=1) if len(lengths) else np.zeros((0, 2))
                        side.write(data)
                        heap += len(data)
                        cells.append(place.astype(">i8").view(np.uint8).reshape(batch.num_rows, 16))
                    elif how["code"] == "A":
                        text = np.array([("" if v is None else v).encode("latin-1", "replace") for v in values.to_pylist()] or [b""], f"S{how['width']}")
                        cells.append(text.view(np.uint8).reshape(-1, how["width"])[: batch.num_rows])
                    else:
                        cells.append(_stored(values, how).view(np.uint8).reshape(batch.num_rows, how["width"]))
                main.write(np.concatenate(cells, axis=1).tobytes() if cells else b"")
                rows += batch.num_rows
        return _Written(part, name, rows, heap)

    def commit(self, messages):
        messages = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        fs, at = file_system(self.path)
        rows, heap, width = sum(m.rows for m in messages), sum(m.heap for m in messages), sum(h["width"] for h in self.plan)
        shifts = [sum(h["width"] for h in self.plan[:k]) for k, h in enumerate(self.plan) if h["array"]]
        with fs.open_output_stream(at) as out:
            if self.like:
                h = binary_table(self.like)
                _copy(self.like, 0, h.head_start, out)
            else:
                out.write(primary_header())
            out.write(table_header(self.plan, rows, heap))
            base = 0
            for m in messages:
                with fs.open_input_stream(f"{m.path}.rows") as f:
                    while block := f.read(width * CHUNK_ROWS):
                        if shifts and base:
                            table = np.frombuffer(block, np.uint8).reshape(-1, width).copy()
                            for s in shifts:
                                place = np.ascontiguousarray(table[:, s + 8 : s + 16]).view(">i8") + base
                                table[:, s + 8 : s + 16] = place.astype(">i8").view(np.uint8).reshape(-1, 8)
                            block = table.tobytes()
                        out.write(block)
                base += m.heap
            for m in messages:
                with fs.open_input_stream(f"{m.path}.heap") as f:
                    while block := f.read(8 << 20):
                        out.write(block)
            out.write(b"\0" * (-(rows * width + heap) % BLOCK))
            if self.like and self.tail:
                _copy(self.like, h.data_start + -(-h.data_bytes // BLOCK) * BLOCK, None, out)
        fs.delete_dir(f"{at}.parts")

    def abort(self, messages):
        fs, at = file_system(self.path)
        if fs.get_file_info(f"{at}.parts").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{at}.parts")


def _copy(path: str, start: int, end: int | None, out) -> None:
    """Append bytes of a file, up to its end if that is None."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        end = f.size() if end is None else end
        f.seek(start)
        while (left := end - f.tell()) > 0 and (piece := f.read(min(left, 8 << 20))):
            out.write(piece)


def _block(cards: list[bytes]) -> bytes:
    text = b"".join([*cards, b"END".ljust(CARD)])
    return text.ljust(-(-len(text) // BLOCK) * BLOCK)


def primary_header(extra: list[bytes] | None = None) -> bytes:
    return _block([format_card("SIMPLE", True), format_card("BITPIX", 8, "Data element bit size"), format_card("NAXIS", 0), format_card("EXTEND", True), *(extra or [])])


_KEYWORDS = {"unit": "TUNIT", "ucd": "TUCD", "desc": "TCOMM", "tdmin": "TDMIN", "tdmax": "TDMAX", "tdisp": "TDISP"}


def table_header(plan: list[dict], rows: int, heap: int) -> bytes:
    width = sum(h["width"] for h in plan)
    cards = [format_card("XTENSION", "BINTABLE"), format_card("BITPIX", 8, "Data element bit size"), format_card("NAXIS", 2), format_card("NAXIS1", width), format_card("NAXIS2", rows), format_card("PCOUNT", heap), format_card("GCOUNT", 1), format_card("TFIELDS", len(plan))]
    for i, h in enumerate(plan, 1):
        cards += [format_card(f"TTYPE{i}", h["name"]), format_card(f"TFORM{i}", h["form"])]
        if h["zero"] or h["scal"] != 1:
            cards += [format_card(f"TSCAL{i}", h["scal"]), format_card(f"TZERO{i}", h["zero"])]
        if h["null"] is not None:
            cards.append(format_card(f"TNULL{i}", h["null"]))
        kept = ["unit", "ucd", "desc", "tdmin", "tdmax"]
        if re.search(r"[A-Z]", h["meta"].get("tform", "")) and re.search(r"[A-Z]", h["meta"]["tform"])[0] == h["code"]:
            kept.append("tdisp")  # a display format is of the stored type
        for name in kept:
            if h["meta"].get(name):
                cards += text_cards(f"{_KEYWORDS[name]}{i}", str(h["meta"][name]))
    return _block(cards)


def _as_read(f: T.StructField):
    """Whether a row's value can be stored as the column's file did it (null: if there is a mark): it is what the stored number stands for."""
    how = (f.metadata or {}).get("stored")
    if not how or not isinstance(f.dataType, (T.FloatType, T.DoubleType) if how["scaled"] else (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return None
    c = F.col(f"`{f.name}`")
    raw = F.rint((c.cast("double") - F.lit(float(how["zero"]))) / F.lit(float(how["scal"])))
    low, high = {"B": (0, 255), "I": (-(1 << 15), (1 << 15) - 1), "J": (-(1 << 31), (1 << 31) - 1)}[how["code"]]
    real = "float" if isinstance(f.dataType, T.FloatType) else "double"
    again = raw.cast(real) * F.lit(float(how["scal"])).cast(real) + F.lit(float(how["zero"])).cast(real)
    fits_in = raw.between(low, high) & (again == c.cast(real))
    return F.when(c.isNull(), F.lit("null" in how)).otherwise(fits_in & (raw != how["null"]) if "null" in how else fits_in)


def write(df: DataFrame, path: str, overwrite: bool = True, like: str | None = None, tail: bool = True) -> None:
    """Write df, in its partitions' order, as one FITS file with a binary table.

    One pass finds the widths of strings and, for whole-number columns with nulls, a stored value that no row has. Columns that still have
    the metadata of the file they were read from keep its storage (type, scale, null mark) if that gives each of their values again.
    ``like``: a FITS file whose bytes before its first table, and with ``tail`` behind it, are taken over.
    """
    ranges = {T.ByteType: (-128, 127), T.ShortType: (-(1 << 15), (1 << 15) - 1), T.IntegerType: (-(1 << 31), (1 << 31) - 1), T.LongType: (-(1 << 63), (1 << 63) - 1), T.DecimalType: (0, (1 << 64) - 1)}
    asked = []
    for k, f in enumerate(df.schema):
        c, exact = F.col(f"`{f.name}`"), _as_read(f)
        if exact is not None:
            asked.append(F.count(F.when(~exact, 1)).alias(f"x{k}"))
        if isinstance(f.dataType, T.StringType):
            asked.append(F.max(F.octet_length(c)).alias(f"w{k}"))
        elif type(f.dataType) in ranges:
            asked += [F.count(F.when(c.isNull(), 1)).alias(f"n{k}"), F.min(c).alias(f"a{k}"), F.max(c).alias(f"b{k}")]
    found = df.agg(*asked).first().asDict() if asked else {}
    about: dict[str, dict] = {}
    for k, f in enumerate(df.schema):
        if f"w{k}" in found:
            about[f.name] = {"width": found[f"w{k}"] or 1}
        elif found.get(f"x{k}") == 0:
            about[f.name] = {"as_read": True}
        elif found.get(f"n{k}"):
            low, high = ranges[type(f.dataType)]
            least, most = found[f"a{k}"], found[f"b{k}"]
            mark = low if least is None or least > low else high if most < high else None
            if mark is None:
                raise FitsError(f"column {f.name} has nulls and leaves no value for them")
            zero = -128 if isinstance(f.dataType, T.ByteType) else 1 << 63 if isinstance(f.dataType, T.DecimalType) else 0
            about[f.name] = {"null": int(mark) - zero}
    register(df.sparkSession)
    writer = df.write.format("fits").option("path", path).option("about", json.dumps(about))
    if like is not None:
        writer = writer.option("like", like).option("tail", "true" if tail else "false")
    writer.mode("overwrite" if overwrite else "append").save()


# --- text -----------------------------------------------------------------------------------------------------------


def struct_text(path: str) -> str:
    """The structure of a file: of each HDU where head and data lie, its type and sizes."""
    out = []
    for h in open_hdus(path):
        out += [f"HDU[{h.idx}]:", f" * HEAD starting byte: {h.head_start}; n_blocks: {h.head_bytes // BLOCK}; byte size: {h.head_bytes}", f" * DATA starting byte: {h.data_start}; byte size: {h.data_bytes}."]
        dims = "x".join(map(str, h.dims))
        bitpix = h.keys.get("BITPIX")
        if h.kind == "PRIMARY":
            out += [" * TYPE: PRIMARY", f"   + simple: {str(bool(h.keys.get('SIMPLE'))).lower()}; naxis: {len(h.dims)}; bitpix : {bitpix}; dimensions: {dims}."]
        elif h.kind == "IMAGE":
            out += [" * TYPE: IMAGE", f"   + naxis: {len(h.dims)}; bitpix : {bitpix}; dimensions: {dims}."]
        elif h.kind in ("BINTABLE", "ASCIITABLE"):
            heap = f"; heap_byte_size: {h.data_bytes - h.row_bytes * h.n_rows}" if h.kind == "BINTABLE" else ""
            out += [f" * TYPE: {h.kind}", f"   + n_cols: {h.keys.get('TFIELDS', 0)}; n_rows : {h.n_rows}; row_byte_size: {h.row_bytes}{heap}."]
        else:
            out += [f" * TYPE: UNKNOWN({h.xtension})", f"   + naxis: {len(h.dims)}; bitpix : {bitpix}; dimensions: {dims}; pcount: {h.keys.get('PCOUNT')}; gcount: {h.keys.get('GCOUNT')}."]
    return "\n".join(out) + "\n"


def head_text(path: str) -> str:
    """All cards of each HDU, END left out."""
    return "".join(f"HDU[{h.idx}]:\n" + "".join(f"{c}\n" for c in h.cards) + "\n" for h in open_hdus(path))
