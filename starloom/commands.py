"""The commands: struct, head, info, csv, sort, mkidx, qidx, mkhips, qhips, and cgi; as functions and as ``python -m starloom``.

A sorted catalogue is a folder of Parquet files (or, for ``*.fits`` outputs, one FITS file); an index is a Parquet table of
(cell, row_start, n) beside a note of the catalogue that it belongs to, with its size and time of change. Queries take the row ranges of
a region's cells from the index, and of a FITS catalogue only these rows are read.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import regions as R
from .functions import text
from .operators import catalog
from .operators.shared import shared_path
from .sources import fits, hips_store, metadata


def load(spark: SparkSession, path: str, hdu: int | None = None) -> DataFrame:
    """The rows of a FITS file, of a folder of FITS files, or of a Parquet table."""
    return fits.read(spark, path, hdu=hdu) if _is_fits(path) else spark.read.parquet(path)


def _is_fits(path: str) -> bool:
    if path.endswith((".fits", ".fit")):
        return True
    fs, at = fits.file_system(path)
    info = fs.get_file_info(at)
    return info.type.name == "Directory" and any(f.path.endswith(".fits") for f in fs.get_file_info(fits.pa.fs.FileSelector(at)))


def column_of(df: DataFrame, which: int | str) -> str:
    """A column by name, or by number from 1."""
    if isinstance(which, int) or which.isdigit():
        if not 1 <= int(which) <= len(df.columns):
            raise ValueError(f"there is no column {which}; the table has {len(df.columns)}")
        return df.columns[int(which) - 1]
    if which not in df.columns:
        raise ValueError(f"there is no column {which}")
    return which


def write_rows(df: DataFrame, path: str) -> None:
    """Rows as one FITS file (``*.fits``), as CSV or TSV text in a folder, or as Parquet."""
    if path.endswith((".fits", ".fit")):
        fits.write(df, path)
    elif path.endswith((".csv", ".tsv")):
        text.write(df, path, "\t" if path.endswith(".tsv") else ",")
    else:
        df.write.mode("overwrite").parquet(path)


def csv(spark: SparkSession, path: str, out: str | None = None, header: bool = True) -> Iterable[str]:
    """The text of every binary table of a file, in order; with ``out``, each table goes to a file of its own and nothing is returned.

    A file is put together from the texts of partitions, which tasks write in parallel to the shared folder; only bytes pass through the driver.
    """
    tables = [h for h in fits.open_hdus(path) if h.kind == "BINTABLE"]
    for k, h in enumerate(tables):
        rows = fits.read(spark, path, hdu=h.idx)
        if out is None:
            yield from text.render(rows, ",", header)
            continue
        parts = shared_path(spark, "csv")
        text.lines(rows).write.text(parts)
        source, inner = fits.file_system(parts)
        fs, at = fits.file_system(text.numbered_name(out, k, h.idx))
        with fs.open_output_stream(at) as f:
            f.write(((text.header(rows.columns) if header else "") + "\n").encode())
            for part in _files(parts):
                with source.open_input_stream(part) as g:
                    while piece := g.read(1 << 23):
                        f.write(piece)
        source.delete_dir(inner)


def _files(folder: str) -> list[str]:
    """Paths of the data files that Spark wrote to a folder, in the order of partitions."""
    fs, at = fits.file_system(folder)
    found = fs.get_file_info(fits.pa.fs.FileSelector(at))
    return sorted(f.path for f in found if f.base_name.startswith("part-"))


def sort(spark: SparkSession, path: str, out: str, lon: int | str, lat: int | str, partitions: int | None = None, depth: int = 10) -> None:
    """Sort a file or a folder of files by depth-29 cell, rows of one cell in their first order; positions must be plain doubles.

    A FITS output keeps how columns are stored and what the file (of a folder, the first one) holds before its table; of a single file also
    what lies behind it. Sorting a folder to FITS also writes ``NAME.countmap.fits``: the rows n of each non-empty cell of ``depth``, by cell.
    """
    df = load(spark, path)
    lon, lat = column_of(df, lon), column_of(df, lat)
    for c in (lon, lat):
        if df.schema[c].dataType.simpleString() != "double":
            raise ValueError(f"column {c} is not of doubles")
    ordered = df.withColumn("_row", F.monotonically_increasing_id())
    if out.endswith((".fits", ".fit")):
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        cells = catalog.H.with_hash(ordered, "hpx29", lon=lon, lat=lat).repartitionByRange(n, "hpx29", "_row").sortWithinPartitions("hpx29", "_row")
        files = fits.tables_of(path) if _is_fits(path) else []
        single = files == [path]
        fits.write(cells.select(*df.columns), out, like=files[0] if files else None, tail=single)
        if files and not single:
            fits.write(catalog.count_map(cells, depth).repartitionByRange(n, "cell").sortWithinPartitions("cell"), f"{out.rpartition('.')[0]}.countmap.fits")
    else:
        catalog.sort_catalogue(ordered, out, lon, lat, "_row", partitions)


def catalogue(spark: SparkSession, path: str, lon: int | str, lat: int | str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """A sorted catalogue with hpx29 and recno, from what ``sort`` wrote; ``ranges`` of row numbers: of a FITS file no others are read.

    In a Parquet catalogue the cells' own ranges prune the scan. Neither form is shuffled or sorted again: a Parquet catalogue holds its cells and numbers, a FITS file's rows are numbered as they are read.
    """
    if not _is_fits(path):
        rows = spark.read.parquet(path)
        if "_part" in rows.columns:
            return catalog.read_catalogue(spark, path).drop("_row")
    if not path.endswith((".fits", ".fit")):
        rows = load(spark, path)
        df = rows.withColumn("_row", F.monotonically_increasing_id())
        hashed = catalog.H.with_hash(df, "hpx29", lon=column_of(rows, lon), lat=column_of(rows, lat))
        return catalog.with_recno(hashed, ["hpx29", "_row"]).drop("_row")
    df = fits.read(spark, path, rows=ranges, number="recno")
    return catalog.H.with_hash(df, "hpx29", lon=column_of(df, lon), lat=column_of(df, lat))


def _state(path: str) -> tuple[int, int]:
    """Bytes of a file, or of all files in a folder, and the last change in nanoseconds."""
    fs, at = fits.file_system(path)
    info = fs.get_file_info(at)
    files = [info] if info.is_file else [f for f in fs.get_file_info(fits.pa.fs.FileSelector(at, recursive=True)) if f.is_file]
    return sum(f.size for f in files), max((f.mtime_ns or 0 for f in files), default=0)


def mkidx(spark: SparkSession, path: str, out: str, lon: int | str, lat: int | str, depth: int = 9, explicit: bool = True, ratio: float | None = None) -> None:
    """Write the cumulative index of a sorted catalogue; refuses one that is not sorted.

    With ``ratio`` the form is chosen by size: explicit if the implicit one would have more than so many times its bytes.
    """
    rows = load(spark, path)
    lon, lat = column_of(rows, lon), column_of(rows, lat)
    own = catalogue(spark, path, lon, lat)
    if _is_fits(path) and not catalog.unsorted_rows(own).isEmpty():
        raise ValueError(f"{path} is not sorted by its positions")
    if ratio is not None:  # a start for each cell and the end, or a cell and a start for each that is not empty and the end
        explicit = 8 * (catalog.H.n_cells(depth) + 1) > ratio * 16 * (catalog.n_nonempty(own, depth).first()["n_cells"] + 1)
    size, changed = _state(path)
    about = [F.lit(v).alias(k) for k, v in (("file", path), ("depth", depth), ("lon", lon), ("lat", lat), ("bytes", size), ("changed", changed))]
    catalog.cumulative_index(own, depth, implicit=not explicit).select("*", *about).write.mode("overwrite").parquet(out)


def indexed(spark: SparkSession, index: str, region: R.Region | None = None) -> tuple[DataFrame, str, str]:
    """The catalogue that an index belongs to, and its position columns; with a region, the rows of the cells that it touches.

    Raises ValueError if the catalogue is not what it was when the index was made.
    """
    table = spark.read.parquet(index)
    about = table.select("file", "depth", "lon", "lat", "bytes", "changed").first()
    if about is None:
        raise ValueError(f"{index} holds no index")
    if _state(about["file"]) != (about["bytes"], about["changed"]):
        raise ValueError(f"{about['file']} has changed since {index} was made")
    ranges = None if region is None else row_ranges(table, about["depth"], region)
    return catalogue(spark, about["file"], about["lon"], about["lat"], ranges), about["lon"], about["lat"]


def row_ranges(index: DataFrame, depth: int, region: R.Region) -> list[tuple[int, int]]:
    """Half-open ranges of row numbers of the cells that a region touches, by one pass over the index."""
    shift = 2 * (catalog.H.MAX_DEPTH - depth)
    cover, _ = region.cover(min(depth, 9))
    cells = R.coarser(R.merge([(a >> shift, -(-b >> shift)) for a, b in cover]))
    if not cells:
        return []
    # the first row of the first cell at or behind a bound; the end mark is behind all cells
    start = lambda c: F.min(F.when(F.col("cell") >= c, F.col("row_start")))
    found = index.agg(*[start(c).alias(f"c{k}_{i}") for k, r in enumerate(cells) for i, c in enumerate(r)]).first()
    return [(found[f"c{k}_0"], found[f"c{k}_1"]) for k in range(len(cells)) if found[f"c{k}_0"] < found[f"c{k}_1"]]


def qidx(spark: SparkSession, index: str, region: R.Region, out: str | None = None, limit: int | None = None) -> DataFrame:
    """The catalogue's rows in a region, in catalogue order, at most ``limit``; written to ``out`` if given."""
    rows, lon, lat = indexed(spark, index, region)
    return _give(R.select(rows, region, lon, lat), out, limit)


def qidx_cones(spark: SparkSession, index: str, centres: DataFrame, radius: float, out: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows within ``radius`` degrees of any of the centres (ra, dec), each once."""
    rows, lon, lat = indexed(spark, index)
    return _give(catalog.multicone(rows, centres, radius, lon, lat), out, limit)


def _give(found: DataFrame, out: str | None, limit: int | None) -> DataFrame:
    found = found.orderBy("recno")
    found = (found if limit is None else found.limit(limit)).drop("hpx29", "recno")
    if out:
        write_rows(found, out)
    return found


def mkhips(spark: SparkSession, index: str, out: str, n1: int = 3000, r21: int = 3, n_tot: int = 500, score: str | None = None, properties: hips_store.Properties | None = None) -> hips_store.Hips:
    """Build a HiPS store from an indexed catalogue."""
    rows, lon, lat = indexed(spark, index)
    return hips_store.write(rows, out, score, n1, r21, n_tot, properties, lon=lon, lat=lat)


def region_of(kind: str, args: list[str], **options) -> R.Region:
    """A region from a command's words: cone, ellipse, ring, zone, jname, box, polygon, hpx, hpxrange, hpxranges, moc, stcs, stcsfile."""
    numbers = lambda n: [float(x) for x in args[:n]]
    if kind == "cone":
        return R.Cone(*numbers(3))
    if kind == "ellipse":
        return R.EllipticalCone(*numbers(5))
    if kind == "ring":
        return R.Ring(*numbers(4))
    if kind == "zone":
        return R.Zone(*numbers(4))
    if kind == "jname":
        return R.jname_zone(args[0], options.get("round_", False), options.get("epsilon", 0.0))
    if kind == "box":
        return R.Polygon.from_box(*numbers(5))
    if kind == "polygon":
        return R.Polygon.from_text(args[0], options.get("complement", False))
    if kind == "hpx":
        return R.Ranges.cell(*[int(x) for x in args[:3]])
    if kind in ("hpxrange", "hpxranges"):
        return R.Ranges.from_text(int(args[0]), args[1])
    if kind == "moc":
        return load_moc(args[0], options.get("form"))
    if kind == "stcs":
        return R.parse_stcs(args[0])
    if kind == "stcsfile":
        return R.parse_stcs(hips_store._get(args[0]))
    raise ValueError(f"no region named {kind}")


def load_moc(path: str, form: str | None = None) -> R.Ranges:
    """A coverage map from a FITS, ASCII or JSON file, by ``form`` or else by the file's extension."""
    form = form or {"fits": "fits", "json": "json"}.get(path.rpartition(".")[2].lower(), "ascii")
    if form != "fits":
        return R.moc_from_text(hips_store._get(path))
    table = fits.binary_table(path)
    if table.keys.get("MOCDIM", "SPACE") != "SPACE":
        raise ValueError(f"{path} is not a coverage map of the sky")
    fs, at = fits.file_system(path)
    with fs.open_input_file(at) as f:
        f.seek(table.data_start)
        raw = fits.np.frombuffer(f.read(table.n_rows * table.row_bytes), fits.np.uint8).reshape(table.n_rows, table.row_bytes)
    values = fits.decode_rows(table.columns(), raw, lambda a, b: b"").column(0).to_pylist()
    ordering = table.keys.get("ORDERING", "RANGE")
    if ordering == "NUNIQ":
        cells = [((v.bit_length() - 3) // 2, v) for v in values]
        ranges = [((v - (4 << 2 * d)) << 2 * (29 - d), (v - (4 << 2 * d) + 1) << 2 * (29 - d)) for d, v in cells]
    else:
        ranges = list(zip(values[::2], values[1::2], strict=True))
    return R.Ranges(29, R.merge(ranges))


def _session() -> SparkSession:
    return SparkSession.builder.appName("starloom").config("spark.sql.caseSensitive", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("starloom", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("struct", "head"):
        sub.add_parser(name).add_argument("file")
    info = sub.add_parser("info")
    info.add_argument("file")
    info.add_argument("-n", "--no-vot", action="store_true")
    info.add_argument("-o", "--only-vot", action="store_true")
    info.add_argument("-m", "--no-merge", action="store_true")
    info.add_argument("-w", "--vot-overwrite", action="store_true")
    c = sub.add_parser("csv")
    c.add_argument("file")
    c.add_argument("-o", "--out")
    c.add_argument("-n", "--no-header", action="store_true")
    for name in ("sort", "mkidx"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("output")
        s.add_argument("-l", "--lon", required=True)
        s.add_argument("-b", "--lat", required=True)
        if name == "mkidx":
            s.add_argument("-d", "--depth", type=int, default=9)
            s.add_argument("-e", "--explicit", action="store_true")
            s.add_argument("-r", "--ratio", type=float)
    q = sub.add_parser("qidx")
    q.add_argument("index")
    q.add_argument("output")
    q.add_argument("region")
    q.add_argument("args", nargs="*")
    q.add_argument("-l", "--limit", type=int)
    q.add_argument("-r", "--round", action="store_true")
    q.add_argument("-e", "--epsilon", type=float, default=0.0)
    q.add_argument("-c", "--complement", action="store_true")
    q.add_argument("-f", "--form")
    q.add_argument("-s", "--sep", default=" ")
    m = sub.add_parser("mkhips")
    m.add_argument("index")
    m.add_argument("output")
    m.add_argument("-n", "--n1", type=int, default=3000)
    m.add_argument("-r", "--r21", type=int, default=3)
    m.add_argument("-m", "--n-tot", type=int, default=500)
    m.add_argument("-s", "--score")
    for f in hips_store.fields(hips_store.Properties):
        if f.name.startswith(("creator", "publisher", "obs_", "prov_", "bib_", "data_", "hips_publisher", "hips_creation", "hips_service", "hips_status", "t_m", "em_m", "client")):
            many = "list" in str(f.type)
            m.add_argument("--" + f.name.replace("_", "-"), dest=f.name, action="append" if many else "store", type=float if "float" in str(f.type) else str)
    h = sub.add_parser("qhips")
    h.add_argument("dir")
    h.add_argument("action", choices=("properties", "metadata", "moc", "allsky", "tile", "list", "info", "export"))
    h.add_argument("args", nargs="*")
    g = sub.add_parser("cgi")
    g.add_argument("root")
    return p


def run(spark: SparkSession, words: list[str]) -> Iterable[str | bytes]:
    """The text that a command prints, or the bytes of a file."""
    a = parser().parse_args(words)
    if a.command == "struct":
        yield fits.struct_text(a.file)
    elif a.command == "head":
        yield fits.head_text(a.file)
    elif a.command == "info":
        yield metadata.info_text(a.file, not (a.no_vot or a.no_merge), a.vot_overwrite, a.only_vot)
    elif a.command == "csv":
        yield from csv(spark, a.file, a.out, not a.no_header)
    elif a.command == "sort":
        sort(spark, a.input, a.output, a.lon, a.lat)
    elif a.command == "mkidx":
        mkidx(spark, a.input, a.output, a.lon, a.lat, a.depth, a.explicit, a.ratio)
    elif a.command == "qidx" and a.region == "multicone":
        centres = R.parse_centres(hips_store._get(a.args[0]), a.sep)
        qidx_cones(spark, a.index, spark.createDataFrame(centres, "ra double, dec double"), float(a.args[1]), a.output, a.limit)
    elif a.command == "qidx":
        qidx(spark, a.index, region_of(a.region, a.args, round_=a.round, epsilon=a.epsilon, complement=a.complement, form=a.form), a.output, a.limit)
    elif a.command == "mkhips":
        names = {f.name for f in hips_store.fields(hips_store.Properties)}
        given = {k: v for k, v in vars(a).items() if k in names and v is not None}
        mkhips(spark, a.index, a.output, a.n1, a.r21, a.n_tot, a.score, hips_store.Properties(**given))
    elif a.command == "qhips":
        store = hips_store.Hips(spark, a.dir)
        numbers = [int(x) for x in a.args] if a.action in ("allsky", "tile") else []
        if a.action == "export":
            store.export(a.args[0])
        else:
            yield from {
                "properties": lambda: [store.properties().to_text()], "metadata": lambda: [store.metadata()], "moc": lambda: [store.moc_bytes()], "allsky": lambda: store.allsky_text(*numbers),
                "tile": lambda: store.tile_text(*numbers), "list": store.list_text, "info": lambda: [store.info_html()],
            }[a.action]()
    else:
        r = hips_store.route(spark, a.root, os.environ.get("PATH_INFO", ""), os.environ.get("QUERY_STRING", ""), os.environ.get("REQUEST_METHOD", "GET"))
        yield f"Status: {r.status}\nContent-Type: {r.kind}\n\n"
        yield from r.body


def main(words: list[str] | None = None) -> int:
    try:
        for piece in run(_session(), sys.argv[1:] if words is None else words):
            sys.stdout.buffer.write(piece if isinstance(piece, bytes) else piece.encode())
        sys.stdout.flush()
    except (ValueError, OSError) as error:
        print(f"starloom: {error}", file=sys.stderr)
        return 1
    return 0
