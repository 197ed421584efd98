"""HiPS catalogues on disk: written from layers, served tile by tile, and exported as the standard's folder tree.

A store is a folder of Parquet tables (``layers``, split by depth and sorted by cell; ``tiles``; ``moc``) beside ``properties.toml``
and ``metadata.xml``. A tile is one partition filter and one cell range, so a request reads the row groups that hold it.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix as H
from ..functions import regions as R
from ..functions import text
from ..operators import catalog, hips
from ..operators.shared import shared_path
from . import fits, metadata

BUILDER = "starloom"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%MZ")


@dataclass
class Properties:
    """The keywords of a HiPS catalogue in the order of the text form; None and empty lists are left out of it."""

    creator_did: str = "ivo://UNK.AUTH/P/unknown"
    publisher_id: str | None = None
    obs_collection: str | None = None
    obs_title: str = "Untitled catalogue"
    obs_description: str | None = None
    obs_ack: str | None = None
    prov_progenitor: list[str] = field(default_factory=list)
    bib_reference: list[str] = field(default_factory=list)
    bib_reference_url: list[str] = field(default_factory=list)
    obs_copyright: str | None = None
    obs_copyright_url: str | None = None
    obs_regime: list[str] = field(default_factory=list)
    data_ucd: list[str] = field(default_factory=list)
    hips_version: str = "1.0"
    hips_builder: str | None = BUILDER
    hips_publisher: str | None = None
    hips_creation_date: str | None = None
    hips_release_date: str = field(default_factory=now)
    hips_service_url: str | None = None
    hips_status: str = "public master clonableOnce"
    hips_estsize: int | None = None
    hips_frame: str = "equatorial"
    hips_order_min: int = 1
    hips_order: int = 1
    hips_tile_format: str = "tsv"
    dataproduct_type: str = "catalog"
    hips_cat_nrows: int | None = None
    hips_initial_ra: float | None = None
    hips_initial_dec: float | None = None
    hips_initial_fov: float | None = None
    t_min: float | None = None
    t_max: float | None = None
    em_min: float | None = None
    em_max: float | None = None
    client_category: str | None = None
    moc_sky_fraction: float | None = None

    def __post_init__(self):
        self.hips_creation_date = self.hips_creation_date or self.hips_release_date

    def items(self) -> Iterator[tuple[str, object]]:
        """(keyword, value), repeated for keywords of several values."""
        for f in fields(self):
            value = getattr(self, f.name)
            for v in value if isinstance(value, list) else [] if value is None else [value]:
                yield f.name, v

    def to_text(self) -> str:
        return "".join(f"{k:<20} = {v}\n" for k, v in self.items())

    def to_toml(self) -> str:
        quoted = lambda v: '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
        one = lambda v: quoted(v) if isinstance(v, str) else "[" + ", ".join(map(quoted, v)) + "]" if isinstance(v, list) else repr(v)
        return "".join(f"{f.name} = {one(v)}\n" for f in fields(self) if (v := getattr(self, f.name)) not in (None, []))

    @classmethod
    def from_toml(cls, content: str) -> Properties:
        return cls(**tomllib.loads(content))


def _put(path: str, content: str) -> None:
    fs, at = fits.file_system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(content.encode())


def _get(path: str) -> str:
    fs, at = fits.file_system(path)
    with fs.open_input_stream(at) as f:
        return f.read().decode()


def write(catalogue: DataFrame, path: str, score: str | None = None, n1: int = 3000, r21: int = 3, n_tot: int = 500, properties: Properties | None = None, columns: list[fits.Column] | None = None, lon: str = "ra", lat: str = "dec") -> "Hips":
    """Build the layers of a sorted catalogue (with hpx29 and recno) and store them under path. score: an expression; the lowest rows come first.

    An empty catalogue gives a store with no tile. ``columns`` describe the table in metadata.xml; without them names and types do.
    """
    from ..functions import expr

    spark, names = catalogue.sparkSession, [c for c in catalogue.columns if c not in ("hpx29", "recno")]
    rows = catalogue.withColumn("_score", expr.number(catalogue, score)) if score else catalogue
    layers, leaves = hips.build(rows, "_score" if score else None, n1, r21, n_tot)
    layers = layers.drop("_score")
    by = layers.repartitionByRange("depth", "hpx29", "recno").sortWithinPartitions("depth", "hpx29", "recno")
    by.write.partitionBy("depth").mode("overwrite").parquet(f"{path}/layers")
    stored = spark.read.parquet(f"{path}/layers") if _has_files(f"{path}/layers") else layers.limit(0)
    hips.tile_stats(stored).write.mode("overwrite").parquet(f"{path}/tiles")
    _moc_of(leaves).write.mode("overwrite").parquet(f"{path}/moc")
    found = stored.agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("order")).first()
    centre = catalog.mean_centre(stored, lon, lat).first()
    p = properties or Properties()
    p.hips_cat_nrows, p.hips_order = found["n"], found["order"] or 1
    described = columns or plain_columns(stored.select(*names))
    p.hips_estsize = found["n"] * sum(c.width for c in described) // 1024
    p.hips_initial_ra, p.hips_initial_dec, p.hips_initial_fov = (round(v, 6) if v is not None else None for v in (centre["lon"], centre["lat"], centre["max_distance"]))
    p.moc_sky_fraction = spark.read.parquet(f"{path}/moc").transform(catalog.coverage).first()["sky_fraction"]
    _put(f"{path}/properties.toml", p.to_toml())
    _put(f"{path}/metadata.xml", metadata.to_votable(described, found["n"]))
    return Hips(spark, path)


def _has_files(path: str) -> bool:
    fs, at = fits.file_system(path)
    return any(f.path.endswith(".parquet") for f in fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True, allow_not_found=True)))


def _moc_of(leaves: DataFrame) -> DataFrame:
    """Depth-29 ranges (start, end) of leaf cells (depth, cell); leaves do not overlap, so the ranges are disjoint."""
    shift = (2 * (H.MAX_DEPTH - F.col("depth"))).cast("int")
    ranges = leaves.select(F.call_function("shiftleft", "cell", shift).alias("start"), F.call_function("shiftleft", F.col("cell") + 1, shift).alias("end"))
    return ranges.distinct()


def plain_columns(df: DataFrame) -> list[fits.Column]:
    """Columns as a FITS file of df would have them; strings and arrays by a pointer, as their lengths are not looked at."""
    letters = {"boolean": "L", "tinyint": "B", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D", "string": "QA"}
    return [fits.Column(k, f.name, "1" + letters.get(f.dataType.simpleString(), "QA")) for k, f in enumerate(df.schema)]


class Hips:
    """Reads a stored HiPS catalogue."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def properties(self) -> Properties:
        return Properties.from_toml(_get(f"{self.path}/properties.toml"))

    def metadata(self) -> str:
        return _get(f"{self.path}/metadata.xml")

    def layer(self, depth: int) -> DataFrame:
        """The rows of a layer in catalogue order, with the catalogue's columns."""
        rows = self.spark.read.parquet(f"{self.path}/layers").where(F.col("depth") == depth).orderBy("recno")
        return rows.drop("depth", "hpx29", "recno")

    def tile(self, depth: int, cell: int) -> tuple[tuple[int, int], DataFrame] | None:
        """((cumul, total), rows) of a tile, or None if there is no such tile."""
        stats = self.tiles().where((F.col("depth") == depth) & (F.col("cell") == cell)).first()
        if stats is None:
            return None
        shift = 2 * (H.MAX_DEPTH - depth)
        rows = self.spark.read.parquet(f"{self.path}/layers").where((F.col("depth") == depth) & (F.col("hpx29") >= cell << shift) & (F.col("hpx29") < (cell + 1) << shift))
        return (stats["cumul_count"], stats["tot_count"]), rows.orderBy("recno").drop("depth", "hpx29", "recno")

    def tiles(self) -> DataFrame:
        """(depth, cell, cumul_count, tot_count) of all tiles."""
        return self.spark.read.parquet(f"{self.path}/tiles")

    def moc(self) -> DataFrame:
        """(start, end) of depth-29 cells."""
        return self.spark.read.parquet(f"{self.path}/moc")

    # the text forms

    def tile_text(self, depth: int, cell: int) -> Iterator[str]:
        found = self.tile(depth, cell)
        if found:
            yield f"# Completeness = {found[0][0]}/{found[0][1]}\n"
            yield from text.render(found[1], "\t")

    def allsky_text(self, depth: int) -> Iterator[str]:
        return text.render(self.layer(depth), "\t")

    def list_text(self) -> Iterator[str]:
        yield "depth,cell,cumul_count,tot_count\n"
        for r in self.tiles().orderBy(H.zuniq(F.col("depth"), F.col("cell"))).toLocalIterator():
            yield f"{r['depth']},{r['cell']},{r['cumul_count']},{r['tot_count']}\n"

    def moc_text(self, form: str = "ascii") -> str:
        return R.moc_to_text([(r["start"], r["end"]) for r in self.moc().toLocalIterator()], form)

    def info_html(self) -> str:
        """A landing page with the main properties and links to the products."""
        import html

        p = self.properties()
        rows = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v))}</td></tr>" for k, v in p.items())
        links = "".join(f'<li><a href="{n}">{n}</a></li>' for n in ("properties", "metadata.xml", "Moc.fits", "Norder1/Allsky.tsv", "Norder2/Allsky.tsv"))
        return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(p.obs_title)}</title></head><body><h1>{html.escape(p.obs_title)}</h1><ul>{links}</ul><table>{rows}</table></body></html>\n'

    def write_moc(self, path: str) -> None:
        """The coverage as a FITS file of one column of range bounds."""
        bounds = self.moc().orderBy("start").select(F.explode(F.array("start", "end")).alias("RANGE"))
        fits.write(bounds, path)

    def moc_bytes(self) -> bytes:
        """The coverage as the bytes of a FITS file."""
        path = shared_path(self.spark, "Moc.fits")
        self.write_moc(path)
        fs, at = fits.file_system(path)
        with fs.open_input_stream(at) as f:
            content = f.read()
        fs.delete_file(at)
        return content

    def export(self, path: str) -> None:
        """The standard tree: Norder{d}/Dir{n}/Npix{cell}.tsv, Allsky.tsv of depths 1 and 2, properties, metadata.xml, Moc.fits, index.html.

        Tiles are written by the tasks that hold their rows: rows are dealt by tile, and no tile holds more than a layer's pick.
        """
        layers = self.spark.read.parquet(f"{self.path}/layers")
        names = [c for c in layers.columns if c not in ("depth", "hpx29", "recno")]
        cell = F.call_function("shiftright", "hpx29", (2 * (H.MAX_DEPTH - F.col("depth"))).cast("int"))
        lines = layers.select("depth", cell.alias("cell"), "recno", F.concat_ws("\t", *[text.cell(layers, c, "\t") for c in names]).alias("line"))
        rows = lines.join(self.tiles(), ["depth", "cell"]).repartition("depth", "cell").sortWithinPartitions("depth", "cell", "recno")
        head = text.header(names, "\t")

        def put(rows):
            out, at = None, None
            for r in rows:
                if (r["depth"], r["cell"]) != at:
                    if out:
                        out.write(b"\n")
                        out.close()
                    at = (r["depth"], r["cell"])
                    fs, folder = fits.file_system(f"{path}/Norder{at[0]}/Dir{at[1] // 10000 * 10000}")
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/Npix{at[1]}.tsv")
                    out.write(f"# Completeness = {r['cumul_count']}/{r['tot_count']}\n{head}".encode())
                out.write(f"\n{r['line']}".encode())
            if out:
                out.write(b"\n")
                out.close()

        rows.foreachPartition(put)
        for depth in (1, 2):
            _put(f"{path}/Norder{depth}/Allsky.tsv", "".join(self.allsky_text(depth)))
        for name, content in (("properties", self.properties().to_text()), ("metadata.xml", self.metadata()), ("Metadata.xml", self.metadata()), ("index.html", self.info_html())):
            _put(f"{path}/{name}", content)
        self.write_moc(f"{path}/Moc.fits")


@dataclass(frozen=True)
class Response:
    """What a request gives: a status, the content's type and its pieces."""

    status: int
    kind: str
    body: Iterator[str] | list[str] | list[bytes]


def route(spark: SparkSession, root: str, path_info: str = "", query: str = "", method: str = "GET") -> Response:
    """Answer a request for a HiPS product under root, by a path (``some/hips/Norder3/Dir0/Npix5.tsv``) or a query (``input=some/hips&action=tile&depth=3&hash=5``)."""
    import re
    from urllib.parse import parse_qs

    def refuse(status: int, why: str) -> Response:
        return Response(status, "text/plain", [why])

    if method != "GET":
        return refuse(501 if method in ("POST", "PUT", "HEAD", "DELETE", "OPTIONS", "PATCH", "TRACE", "CONNECT") else 400, f"Only GET is answered, not {method}")
    asked = {k: v[0] for k, v in parse_qs(query).items()}
    depth = cell = None
    if "action" in asked:
        folder, action = asked.get("input", ""), asked["action"].lower()
        try:
            depth, cell = (int(asked[k]) if k in asked else None for k in ("depth", "hash"))
        except ValueError:
            return refuse(400, "depth and hash must be whole numbers")
    else:
        folder, _, name = path_info.strip("/").rpartition("/") if "/" in path_info.strip("/") else ("", "", path_info.strip("/"))
        low = name.lower()
        plain = {"": "info", "index.html": "info", "info": "info", "properties": "properties", "metadata.xml": "metadata", "moc.fits": "moc", "tiles.csv": "list"}
        if not path_info:
            return refuse(400, "No path and no action.")
        if low in plain:
            action = plain[low]
        elif m := re.fullmatch(r"allsky([12])\.tsv", low):
            action, depth = "allsky", int(m[1])
        elif low.endswith(".tsv"):
            pattern = r"(?:(.*)/)?Norder(\d+)" if low == "allsky.tsv" else r"(?:(.*)/)?Norder(\d+)/[^/]*"
            order, pix = re.fullmatch(pattern, folder), re.fullmatch(r"Npix(\d+)\.tsv", name)
            if not order or not (pix or low == "allsky.tsv"):
                return refuse(400, f"No tile at {path_info}")
            folder, depth = order[1] or "", int(order[2])
            action, cell = ("allsky", None) if low == "allsky.tsv" else ("tile", int(pix[1]))
        else:
            folder, action = f"{folder}/{name}".strip("/"), "info"
    if ".." in folder.split("/"):
        return refuse(400, "The path leaves the root.")
    store = Hips(spark, f"{root.rstrip('/')}/{folder}".rstrip("/"))
    if not _has_files(f"{store.path}/tiles"):
        return refuse(404, f"No HiPS at {folder}")
    if action == "tile":
        if depth is None or cell is None:
            return refuse(400, "A tile needs depth and hash.")
        body = store.tile_text(depth, cell)
        first = next(body, None)
        return refuse(404, f"The catalogue has no tile at order {depth}, pixel {cell}") if first is None else Response(200, "text/plain", _chain(first, body))
    if action == "allsky":
        return refuse(400, "Whole layers are given for orders 1 and 2 alone") if depth is None or depth > 2 else Response(200, "text/plain", store.allsky_text(depth))
    if action == "list":
        return Response(200, "text/plain", store.list_text())
    if action == "moc":
        return Response(200, "application/fits", [store.moc_bytes()])
    if action == "properties":
        return Response(200, "text/plain", [store.properties().to_text()])
    if action == "metadata":
        return Response(200, "text/xml", [store.metadata()])
    return Response(200, "text/html", [store.info_html()]) if action == "info" else refuse(400, f"Action {action} is not known.")


def _chain(first: str, rest: Iterator[str]) -> Iterator[str]:
    yield first
    yield from rest
