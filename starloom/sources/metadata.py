"""Column metadata: VOTable documents, FITS-plus files, merging, and aligned listings."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fits

_VOT_TYPES = {"L": "boolean", "X": "bit", "B": "unsignedByte", "I": "short", "J": "int", "K": "long", "E": "float", "D": "double", "C": "floatComplex", "M": "doubleComplex", "A": "char"}


def merge_frames(own: DataFrame, other: DataFrame, overwrite: bool = False) -> DataFrame:
    """Columns (idx, name, type, unit, ucd, desc) with attributes of other, by position, where own's are empty (or always).

    Name and type are never changed.
    """
    side = other.select("idx", *[F.col(c).alias(f"_{c}") for c in ("unit", "ucd", "desc")])
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    pick = lambda c: F.coalesce(given(f"_{c}"), given(c)) if overwrite else F.coalesce(given(c), given(f"_{c}"))
    return own.join(side, "idx", "left").select("idx", "name", "type", *[pick(c).alias(c) for c in ("unit", "ucd", "desc")])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def votable_fields(text: str | bytes) -> list[dict]:
    """Name, unit, ucd, datatype, arraysize, width, precision, description, null mark and limits of the first table's fields."""
    root = ET.fromstring(text)
    table = next((e for e in root.iter() if _local(e.tag) == "TABLE"), None)
    out = []
    for e in table if table is not None else ():
        if _local(e.tag) == "FIELD":
            about = next((d.text for d in e if _local(d.tag) == "DESCRIPTION"), None)
            values = next((v for v in e if _local(v.tag) == "VALUES"), None)
            limit = lambda which: None if values is None else next((v.get("value") for v in values if _local(v.tag) == which), None)  # noqa: B023, E731
            null = None if values is None else values.get("null")
            out.append({**{k: e.get(k) for k in ("name", "ID", "unit", "ucd", "datatype", "arraysize", "width", "precision")}, "desc": about.strip() if about else None, "null": null, "min": limit("MIN"), "max": limit("MAX")})
    return out


def embedded_votable(path: str) -> bytes | None:
    """The VOTable in the primary HDU of a FITS-plus file, or None."""
    first = fits.open_hdus(path)[0]
    if first.keys.get("VOTMETA") is not True:
        return None
    fs, at = fits.file_system(path)
    with fs.open_input_file(at) as f:
        f.seek(first.data_start)
        return bytes(f.read(first.data_bytes)).rstrip(b"\0 ")


def columns(path: str, use_votable: bool = True, overwrite: bool = False) -> list[fits.Column]:
    """Columns of the first binary table. If the file holds a VOTable of as many fields, empty attributes (or all) come from it."""
    out = fits.binary_table(path).columns()
    vot = embedded_votable(path) if use_votable else None
    if vot:
        fields = votable_fields(vot)
        if len(fields) == len(out):
            for c, f in zip(out, fields, strict=True):
                for mine, theirs in (("unit", "unit"), ("ucd", "ucd"), ("desc", "desc"), ("tdmin", "min"), ("tdmax", "max")):
                    if f[theirs] and (overwrite or not getattr(c, mine)):
                        setattr(c, mine, f[theirs])
                if c.tnull is None and re.fullmatch(r"[+-]?\d+", f["null"] or ""):  # a null mark is never replaced, and whole
                    c.tnull = int(f["null"])
    return out


def info_text(path: str, use_votable: bool = True, overwrite: bool = False, only_votable: bool = False) -> str:
    """An aligned listing: number, name, type, unit, ucd and description of all columns."""
    if only_votable:
        return (embedded_votable(path) or b"").decode()
    table = fits.binary_table(path)
    rows = [("#", "name", "type", "unit", "ucd", "desc")]
    rows += [(str(c.idx), c.name, c.display(), c.unit or "---", c.ucd or "---", c.desc or "") for c in columns(path, use_votable, overwrite)]
    width = [max(w, *(len(r[k]) for r in rows)) for k, w in enumerate((4, 4, 4, 4, 3, 4))]
    body = [" ".join([*(f"{r[k]:>{width[k]}}" for k in range(5)), f"{r[5]:<{width[5]}}"]) for r in rows]
    return "\n".join([f" BINTABLE  n_cols: {len(rows) - 1}; n_rows : {table.n_rows}", *body]) + "\n"


def to_votable(cols: list[fits.Column], n_rows: int | None = None, name: str = "catalogue") -> str:
    """A VOTable that describes columns, without data."""
    root = ET.Element("VOTABLE", {"version": "1.4", "xmlns": "http://www.ivoa.net/xml/VOTable/v1.3"})
    table = ET.SubElement(ET.SubElement(root, "RESOURCE"), "TABLE", {"name": name} | ({"nrows": str(n_rows)} if n_rows is not None else {}))
    for c in cols:
        kind = {"B": "short", "I": "int", "J": "long", "K": "long"}[c.code] if c.is_unsigned else ("float" if c.code in "BIE" else "double") if c.is_scaled else _VOT_TYPES[c.code]
        attributes = {"name": c.name, "datatype": kind}
        if c.pointer:
            attributes["arraysize"] = "*" if c.most is None else f"{c.most}*"
        elif c.tdim:
            attributes["arraysize"] = "x".join(map(str, c.tdim))
        elif c.repeat != 1:
            attributes["arraysize"] = str(c.repeat)
        attributes |= {k: v for k, v in (("unit", c.unit), ("ucd", c.ucd)) if v}
        if c.tdisp:
            try:
                _, wide, digits, _ = fits.parse_display(c.tdisp)
                attributes |= {"width": str(wide)} | ({"precision": str(digits)} if digits is not None else {})
            except fits.FitsError:
                pass
        element = ET.SubElement(table, "FIELD", attributes)
        if c.desc:
            ET.SubElement(element, "DESCRIPTION").text = c.desc
        if c.tnull is not None or c.tdmin or c.tdmax:
            values = ET.SubElement(element, "VALUES", {"null": str(c.tnull)} if c.tnull is not None else {})
            for tag, limit in (("MIN", c.tdmin), ("MAX", c.tdmax)):
                if limit:
                    ET.SubElement(values, tag, {"value": str(limit)})
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"
