"""Rows as CSV or TSV text: how each kind of cell is written, as columns where Spark can and in Arrow batches for floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def float_text(value, single: bool = False) -> str:
    """A scalar: shortest digits that read back the same, always with a point or exponent; an exponent from 1e16 and below 1e-4."""
    if value is None or value != value:
        return ""
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    if value == 0:
        return "-0.0" if np.signbit(value) else "0.0"
    x = np.float32(value) if single else np.float64(value)
    if 1e-4 <= abs(float(x)) < 1e16 if not single else 1e-4 <= abs(float(x)) < 1e16:
        return np.format_float_positional(x, unique=True, trim="0")
    digits, _, power = np.format_float_scientific(x, unique=True, trim="-").partition("e")
    return f"{digits.rstrip('.')}e{int(power)}"


def float_item(value, single: bool = False) -> str:
    """An array's element: shortest digits, never an exponent, no point if whole."""
    if value is None or value != value:
        return ""
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    return np.format_float_positional(np.float32(value) if single else np.float64(value), unique=True, trim="-")


def _scientific(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Digits without a point, and the power of the first one, of texts such as 1.25e+17."""
    parts = pc.split_pattern(text, "e")
    return pc.replace_substring(pc.list_element(parts, 0), ".", ""), pc.cast(pc.utf8_ltrim(pc.list_element(parts, 1), "+"), pa.int32())


def _positional(digits: pa.Array, power: pa.Array) -> pa.Array:
    """Digits whose first one has this power of ten, without an exponent and without a point if whole."""
    out = pa.nulls(len(digits), pa.string())
    for e in pc.unique(power).to_pylist():
        own = pc.equal(power, e)
        d = digits.filter(own)
        if e < 0:
            text = pc.binary_join_element_wise("0." + "0" * (-e - 1), d, "")
        else:
            tail = pc.utf8_slice_codeunits(d, e + 1)
            whole = pc.utf8_rpad(pc.utf8_slice_codeunits(d, 0, e + 1), e + 1, "0")
            text = pc.if_else(pc.equal(tail, ""), whole, pc.binary_join_element_wise(whole, tail, "."))
        out = pc.replace_with_mask(out, own, text)
    return out


def float_texts(values: pa.Array, item: bool = False) -> pa.Array:
    """float_text (``item``: float_item) of an array of floats or doubles, by kernels that give the shortest digits; null: empty."""
    x = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    size = np.abs(x)
    out = pc.cast(pa.array(size, values.type), pa.string())
    finite = np.isfinite(x)
    exponent = pc.match_substring(out, "e").to_numpy(zero_copy_only=False) & finite

    def put(mask: np.ndarray, change) -> None:
        nonlocal out
        if mask.any():
            where = pa.array(mask)
            out = pc.replace_with_mask(out, where, change(out.filter(where)))

    if item:
        put(exponent, lambda t: _positional(*_scientific(t)))
    else:
        plain = (size.astype(np.float64) >= 1e-4) & (size.astype(np.float64) < 1e16)
        put(exponent & plain, lambda t: _positional(*_scientific(t)))
        put(exponent & ~plain, lambda t: pc.replace_substring(t, "e+", "e"))

        def small(t: pa.Array) -> pa.Array:
            after = pc.utf8_slice_codeunits(t, 2)
            digits = pc.utf8_ltrim(after, "0")
            power = pc.cast(pc.add(pc.subtract(pc.utf8_length(after), pc.utf8_length(digits)), 1), pa.string())
            first, rest = pc.utf8_slice_codeunits(digits, 0, 1), pc.utf8_slice_codeunits(digits, 1)
            return pc.binary_join_element_wise(pc.if_else(pc.equal(rest, ""), first, pc.binary_join_element_wise(first, rest, ".")), power, "e-")

        put(~exponent & ~plain & (size > 0) & finite, small)
        put(finite & ~pc.match_substring_regex(out, "[.e]").to_numpy(zero_copy_only=False), lambda t: pc.binary_join_element_wise(t, "0", "."))
    put(np.signbit(x) & ~np.isnan(x), lambda t: pc.binary_join_element_wise("-", t, ""))
    put(np.isnan(x), lambda t: pa.array([""] * len(t), pa.string()))
    return out


def _listed(values: pa.Array, items: pa.Array) -> pa.Array:
    """The cells of arrays whose elements have these texts."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), items)
    return pc.if_else(pa.array(sizes > 0), pc.binary_join_element_wise('"[', pc.binary_join(lists, ", "), ']"', ""), "")


def _complex_texts(values: pa.Array) -> pa.Array:
    re, im = (float_texts(part, True) for part in values.flatten())
    return pc.binary_join_element_wise("(", re, ", ", im, ")", "")


@arrow_udf(T.StringType())
def _floats(values: pa.Array) -> pa.Array:
    return float_texts(values)


@arrow_udf(T.StringType())
def _float_arrays(values: pa.Array) -> pa.Array:
    return _listed(values, float_texts(values.flatten(), True))


@arrow_udf(T.StringType())
def _complexes(values: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise('"', _complex_texts(values), '"', "")


@arrow_udf(T.StringType())
def _complex_arrays(values: pa.Array) -> pa.Array:
    return _listed(values, _complex_texts(values.flatten()))


def _is_complex(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == ["re", "im"]


def quoted(text: Column, sep: str) -> Column:
    """A string cell: right-trimmed; in quotes, inner ones doubled, if it holds a quote, the separator or a line break."""
    trimmed = F.rtrim(text)
    return F.when(trimmed.contains('"') | trimmed.contains(sep) | trimmed.contains("\n"), F.concat(F.lit('"'), F.replace(trimmed, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(trimmed)


def cell(df: DataFrame, name: str, sep: str = ",") -> Column:
    """The text of a column's cells; null is empty."""
    t, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(t, T.BooleanType):
        out = F.when(c, "true").when(~c, "false")
    elif isinstance(t, _INTS):
        out = c.cast("string")
    elif isinstance(t, T.DecimalType):
        out = c.cast("string")
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        out = _floats(c)
    elif isinstance(t, T.StringType):
        out = quoted(c, sep)
    elif _is_complex(t):
        out = F.when(c.isNotNull(), _complexes(c))
    elif isinstance(t, T.ArrayType):
        e = t.elementType
        if isinstance(e, (T.FloatType, T.DoubleType)):
            out = _float_arrays(c)
        elif _is_complex(e):
            out = _complex_arrays(c)
        elif isinstance(e, T.BooleanType):
            items = F.transform(c, lambda x: F.when(x, "T").when(~x, "F").otherwise(""))
            out = F.when(F.size(c) > 0, F.concat(F.lit('"['), F.array_join(items, ", "), F.lit(']"')))
        elif isinstance(e, (*_INTS, T.DecimalType)):
            items = F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("")))
            out = F.when(F.size(c) > 0, F.concat(F.lit('"['), F.array_join(items, ", "), F.lit(']"')))
        else:
            raise ValueError(f"column {name}: no text for arrays of {e.simpleString()}")
    elif isinstance(t, T.NullType):
        out = F.lit("")
    else:
        out = quoted(c.cast("string"), sep)
    return F.coalesce(out, F.lit(""))


def lines(df: DataFrame, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """df's rows as one string column ``line``, in df's order."""
    names = columns or df.columns
    return df.select(F.concat_ws(sep, *[cell(df, c, sep) for c in names]).alias("line"))


def header(names: list[str], sep: str = ",") -> str:
    """Column names, unquoted."""
    return sep.join(names)


def render(df: DataFrame, sep: str = ",", with_header: bool = True) -> Iterator[str]:
    """The text of df piece by piece, one partition at a time: the header, each row after a line break, and a last line break.

    Without a header the text starts with an empty line.
    """
    if with_header:
        yield header(df.columns, sep)
    for row in lines(df, sep).toLocalIterator():
        yield "\n" + row["line"]
    yield "\n"


def write(df: DataFrame, path: str, sep: str = ",", with_header: bool = True) -> None:
    """Write df as text files, one for each partition, in order; with a header, the first line of each file is it."""
    names = header(df.columns, sep)

    def prepend(batches):
        first = True
        for batch in batches:
            values = batch.column(0)
            if first and batch.num_rows:
                values = pa.concat_arrays([pa.array([names], pa.string()), values.cast(pa.string())])
                first = False
            yield pa.RecordBatch.from_arrays([values], ["line"])

    out = lines(df, sep)
    (out.mapInArrow(prepend, "line string") if with_header else out).write.text(path)


def numbered_name(path: str, table: int, hdu: int) -> str:
    """The output of the table-th table, from 0: the given path, or for later ones with the HDU's number before the extension."""
    if table == 0:
        return path
    stem, dot, ext = path.rpartition(".")
    return f"{stem}.{hdu}.{ext}" if dot and "/" not in ext else f"{path}.{hdu}.csv"
