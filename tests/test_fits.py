"""The FITS source and sink, on files built byte by byte: every column type, nulls, scaling, arrays, heaps, structure and metadata."""

import math
from decimal import Decimal

import pytest
from fits_bytes import card, header, pack, primary, table
from pyspark.sql import functions as F
from starloom import commands
from starloom.sources import fits, metadata


def save(path, *hdus):
    path.write_bytes(b"".join(hdus))
    return str(path)


def test_bitpix_cards():
    for value in (8, 16, 32, 64, -32, -64):
        assert fits.format_card("BITPIX", value, "Data element bit size") == f"BITPIX  = {value:>20} / Data element bit size".ljust(80).encode()


def test_scalars(spark, tmp_path):
    columns = [("l", "L", {}), ("b", "B", {}), ("i", "1I", {}), ("j", "J", {}), ("k", "K", {}), ("e", "E", {}), ("d", "D", {}), ("c", "C", {}), ("m", "M", {}), ("a", "A", {}), ("s", "12A", {})]
    row = lambda l, b, i, j, k, e, d, a, s: pack("cBhiqfd", l, b, i, j, k, e, d) + pack("ff", 1.5, -2) + pack("dd", 0.25, 3) + a + s.ljust(12, b" ")  # noqa: E731, E741
    rows = [row(b"T", 0, -(2**15), -(2**31), -(2**63), 1.5, 1e16, b"x", b"abc\0def"), row(b"F", 255, 2**15 - 1, 2**31 - 1, 2**63 - 1, math.inf, 1e-5, b"\0", b"  lead"), row(b"\0", 1, 0, 0, 0, math.nan, math.nan, b"z", b""), row(b"Q", 1, 0, 0, 0, 0, 0, b"z", b"full twelve.")]
    got = fits.read(spark, save(tmp_path / "a.fits", primary(), table(columns, rows))).collect()
    assert [r["l"] for r in got] == [True, False, None, None]
    assert [r["b"] for r in got][:2] == [0, 255]
    assert [(r["i"], r["j"], r["k"]) for r in got][:2] == [(-(2**15), -(2**31), -(2**63)), (2**15 - 1, 2**31 - 1, 2**63 - 1)]
    assert got[0]["e"] == 1.5 and got[1]["e"] == math.inf and math.isnan(got[2]["e"]) and got[0]["d"] == 1e16
    assert tuple(got[0]["c"]) == (1.5, -2) and tuple(got[0]["m"]) == (0.25, 3)
    assert [r["s"] for r in got] == ["abc", "  lead", "", "full twelve."] and [r["a"] for r in got][:2] == ["x", ""]


def test_unsigned_null_and_scaled(spark, tmp_path):
    columns = [
        ("ub", "B", {"TZERO": -128, "TSCAL": 1}), ("ui", "I", {"TZERO": 32768}), ("uj", "J", {"TZERO": 2147483648, "TNULL": 7}), ("uk", "K", {"TZERO": 9223372036854775808}),
        ("n", "I", {"TNULL": -99}), ("sb", "B", {"TSCAL": 0.1}), ("sj", "J", {"TSCAL": 0.1, "TZERO": 5}), ("se", "E", {"TZERO": 2.5}),
    ]
    rows = [pack("Bhiqh", a, b, c, d, n) + pack("Bif", 3, 10, 1.0) for a, b, c, d, n in ((0, -(2**15), -(2**31), -(2**63), -99), (255, 2**15 - 1, 7, 2**63 - 1, 5), (128, 0, 0, 0, 0))]
    df = fits.read(spark, save(tmp_path / "a.fits", primary(), table(columns, rows)))
    got = df.collect()
    assert [r["ub"] for r in got] == [-128, 127, 0] and [r["ui"] for r in got] == [0, 65535, 32768]
    assert [r["uj"] for r in got] == [0, None, 2**31] and [r["uk"] for r in got] == [Decimal(0), Decimal(2**64 - 1), Decimal(2**63)]
    assert [r["n"] for r in got] == [None, 5, 0]
    import numpy as np

    assert got[0]["sb"] == float(np.float32(3) * np.float32(0.1)) and got[0]["sj"] == 10 * 0.1 + 5 and got[0]["se"] == 3.5
    assert dict(df.dtypes)["sb"] == "float" and dict(df.dtypes)["sj"] == "double"


def test_arrays_bits_and_empty_columns(spark, tmp_path):
    columns = [("l", "3L", {}), ("i", "3I", {"TNULL": 0}), ("e", "2E", {}), ("c", "2C", {}), ("x", "11X", {}), ("none", "0J", {}), ("j", "6J", {"TDIM": "(2,3)"})]
    rows = [b"TF\0" + pack("hhh", 0, 1, 2) + pack("ff", 1, math.nan) + pack("ffff", 1, 2, 3, 4) + bytes([0b10100000, 0b00100000]) + pack("6i", *range(6))]
    got = fits.read(spark, save(tmp_path / "a.fits", primary(), table(columns, rows))).first()
    assert got["l"] == [True, False, None] and got["i"] == [None, 1, 2] and got["e"][0] == 1 and math.isnan(got["e"][1])
    assert [tuple(v) for v in got["c"]] == [(1, 2), (3, 4)]
    assert got["x"] == [True, False, True] + [False] * 7 + [True] and got["none"] is None and got["j"] == list(range(6))


@pytest.mark.parametrize("kind", "PQ")
def test_heap(spark, tmp_path, kind):
    heap = pack("5h", 1, 2, 3, 4, 5) + b"hello\0x " + pack("2d", 0.5, -1) + pack("4f", 1, 2, 3, 4)
    place = lambda n, at: pack("ii" if kind == "P" else "qq", n, at)
    columns = [("i", f"{kind}I(5)", {}), ("a", f"1{kind}A(100)", {}), ("d", f"{kind}D", {}), ("c", f"{kind}C(2)", {})]
    rows = [place(5, 0) + place(8, 10) + place(2, 18) + place(2, 34), place(0, 0) + place(0, 0) + place(0, 0) + place(0, 0), place(2, 2) + place(2, 10) + place(1, 26) + place(1, 42)]
    for gap in (0, 24):
        got = fits.read(spark, save(tmp_path / f"{gap}.fits", primary(), table(columns, rows, heap, gap))).collect()
        assert [r["i"] for r in got] == [[1, 2, 3, 4, 5], [], [2, 3]]
        assert [r["a"] for r in got] == ["hello", "", "he"]
        assert [r["d"] for r in got] == [[0.5, -1], [], [-1]]
        assert [[tuple(v) for v in r["c"]] for r in got] == [[(1, 2), (3, 4)], [], [(3, 4)]]


def structure(tmp_path):
    image = header([card("XTENSION", "IMAGE"), card("BITPIX", -32), card("NAXIS", 2), card("NAXIS1", 3), card("NAXIS2", 5), card("PCOUNT", 0), card("GCOUNT", 1)]) + bytes(2880)
    odd = header([card("XTENSION", "FOREIGN"), card("BITPIX", 8), card("NAXIS", 1), card("NAXIS1", 10), card("PCOUNT", 2990), card("GCOUNT", 1)]) + bytes(5760)
    text = header([card("XTENSION", "TABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 10), card("NAXIS2", 3), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 1)]) + bytes(2880)
    one, two = table([("x", "J", {})], [pack("i", k) for k in range(3)]), table([("y", "D", {})], [pack("d", k / 2) for k in range(4)])
    return save(tmp_path / "many.fits", primary(naxis=(7, 3), data=bytes(21)), image, text, odd, one, two)


def test_heap_is_read_in_runs_of_near_cells():
    import numpy as np

    body, reads = bytes(k * k % 251 for k in range(1 << 20)), []

    def heap(first, end):
        reads.append((first, end))
        return body[first:end]

    starts, sizes = np.array([900_000, 5, 0, 400_000, 900_010, 7, 400_000]), np.array([20, 10, 0, 3, 5, 2, 3])
    assert fits._heap_parts(starts, sizes, heap) == [body[a : a + n] for a, n in zip(starts, sizes, strict=True)]
    assert reads == [(5, 15), (400_000, 400_003), (900_000, 900_020)]
    assert fits._heap_parts(starts[:0], sizes[:0], heap) == [] and fits._heap_parts(starts[2:3], sizes[2:3], heap) == [b""]


def test_structure_and_views(spark, tmp_path):
    path = structure(tmp_path)
    hdus = fits.read(spark, path, view="hdus").orderBy("idx").collect()
    assert [h["type"] for h in hdus] == ["PRIMARY", "IMAGE", "ASCIITABLE", "UNKNOWN", "BINTABLE", "BINTABLE"]
    assert [h["data_bytes"] for h in hdus] == [21, 60, 30, 3000, 12, 32]
    assert "UNKNOWN(FOREIGN)" in fits.struct_text(path) and fits.head_text(path).count("HDU[") == 6
    assert fits.read(spark, path).count() == 3 and [r["y"] for r in fits.read(spark, path, hdu=5).collect()] == [0, 0.5, 1, 1.5]
    assert fits.read(spark, path, view="keywords").where("raw like 'XTENSION%'").count() == 5
    for hdu in (1, 2, 9):
        with pytest.raises(Exception, match="HDU"):
            fits.read(spark, path, hdu=hdu).count()


def test_metadata(spark, tmp_path):
    columns = [("a", "D", {"TUNIT": "deg", "TUCD": "pos.eq.ra", "TCOMM": "it''s here", "TDISP": "F10.4", "TDMIN": 0}), (None, "J", {"TDMAX": "9"})]
    path = save(tmp_path / "a.fits", primary(), table(columns, [pack("di", 1, 2)], extra=[card("UCD__2", "meta.id")]))
    a, b = fits.binary_table(path).columns()
    assert (a.name, a.unit, a.ucd, a.desc, a.tdmin) == ("a", "deg", "pos.eq.ra", "it's here", "0") and (b.name, b.tdmax, b.ucd) == ("col_1", "9", "meta.id")
    assert "deg" in metadata.info_text(path) and 'arraysize' not in metadata.to_votable([a, b], 1)
    assert fits.read(spark, path).columns == ["a", "col_1"]
    vot = b'<VOTABLE><RESOURCE><TABLE><FIELD name="a" unit="rad" ucd="x" datatype="double"/><FIELD name="z" unit="s" datatype="int"><DESCRIPTION>seconds</DESCRIPTION></FIELD></TABLE></RESOURCE></VOTABLE>'
    plus = save(tmp_path / "b.fits", primary([card("VOTMETA", True), card("NTABLE", 1)], (len(vot),), vot), table(columns, [pack("di", 1, 2)]))
    assert [(c.unit, c.desc) for c in metadata.columns(plus)] == [("deg", "it's here"), ("s", "seconds")]
    assert [c.unit for c in metadata.columns(plus, overwrite=True)] == ["rad", "s"] and [c.unit for c in metadata.columns(plus, False)] == ["deg", None]


def test_votable_null_marks_and_limits(tmp_path):
    columns = [("a", "J", {"TNULL": 3}), ("b", "J", {}), ("c", "J", {"TDMIN": 1})]
    field = '<FIELD name="{0}" datatype="int"><VALUES null="{1}"><MIN value="0"/><MAX value="9"/></VALUES></FIELD>'
    vot = ("<VOTABLE><RESOURCE><TABLE>" + field.format("a", 5) + field.format("b", 6) + field.format("c", "x") + "</TABLE></RESOURCE></VOTABLE>").encode()
    path = save(tmp_path / "a.fits", primary([card("VOTMETA", True), card("NTABLE", 1)], (len(vot),), vot), table(columns, [pack("iii", 1, 2, 3)]))
    assert [(c.tnull, c.tdmin, c.tdmax) for c in metadata.columns(path)] == [(3, "0", "9"), (6, "0", "9"), (None, "1", "9")]
    assert [(c.tnull, c.tdmin) for c in metadata.columns(path, overwrite=True)] == [(3, "0"), (6, "0"), (None, "0")]


def test_sort_keeps_storage_cards_and_other_hdus(spark, tmp_path):
    long = "it's a comment of more than one card, " * 4 + "end"
    parts = [f"CONTINUE  '{long[k : k + 50].replace(chr(39), chr(39) * 2)}{'&' if k + 50 < len(long) else ''}'".ljust(80) for k in range(50, len(long), 50)]
    comment = [f"TCOMM3  = '{long[:50].replace(chr(39), chr(39) * 2)}&'".ljust(80), *parts]
    columns = [
        ("ra", "D", {"TDISP": "F10.6", "TUNIT": "deg"}), ("dec", "D", {"TDMIN": "-90", "TDMAX": "90"}), ("mag", "I", {"TSCAL": 0.001, "TZERO": 20, "TNULL": -32768, "TDISP": "F8.3"}),
        ("flux", "J", {"TSCAL": 0.25}), ("u", "I", {"TZERO": 32768}), ("byte", "B", {}), ("n", "J", {"TNULL": 0}),
    ]
    rows = [pack("ddhihBi", 40 * k % 360, k - 4, -32768 if k == 3 else 100 * k - 7, 3 * k, k - 5, 250 + k % 5, k) for k in range(9)]
    image = header([card("XTENSION", "IMAGE"), card("BITPIX", 8), card("NAXIS", 1), card("NAXIS1", 4), card("PCOUNT", 0), card("GCOUNT", 1)]) + b"abcd".ljust(2880, b"\0")
    first = primary([card("OBSERVER", "someone"), card("HISTORY", None)])
    path = save(tmp_path / "a.fits", first, image, table(columns, rows, extra=comment), image)
    out = str(tmp_path / "out.fits")
    commands.sort(spark, path, out, "ra", "dec", partitions=2)
    data = (tmp_path / "out.fits").read_bytes()
    assert data.startswith(first + image) and data.endswith(image) and len(data) % 2880 == 0
    assert [h.kind for h in fits.open_hdus(out)] == ["PRIMARY", "IMAGE", "BINTABLE", "IMAGE"]
    same = ("name", "code", "unit", "desc", "tnull", "tscal", "tzero", "tdisp", "tdmin", "tdmax")
    before, after = (fits.binary_table(p).columns() for p in (path, out))
    assert [[getattr(c, k) for k in same] for c in before] == [[getattr(c, k) for k in same] for c in after] and before[2].desc == long
    h = fits.binary_table(out)
    assert sorted(rows) == sorted(data[h.data_start + k * h.row_bytes : h.data_start + (k + 1) * h.row_bytes] for k in range(9))


def test_changed_values_are_stored_as_they_are(spark, tmp_path):
    path = save(tmp_path / "a.fits", primary(), table([("x", "I", {"TSCAL": 0.5}), ("y", "B", {}), ("z", "J", {})], [pack("hBi", 3, 7, 1), pack("hBi", 4, 9, 2)]))
    df = fits.read(spark, path)
    kept = {f.name: f.metadata for f in df.schema}
    odd = df.select((F.col("x") + F.lit(0.3).cast("float")).alias("x", metadata=kept["x"]), (F.col("y") - 10).cast("short").alias("y", metadata=kept["y"]), F.when(F.col("z") > 1, F.col("z")).alias("z", metadata=kept["z"]))
    fits.write(odd, str(tmp_path / "b.fits"))
    key = lambda r: r["y"]
    assert sorted(fits.read(spark, str(tmp_path / "b.fits")).collect(), key=key) == sorted(odd.collect(), key=key)


def test_folder_sort_writes_a_count_map(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        save(tmp_path / "in" / f"{k}.fits", primary([card("FILE", k)]), table([("ra", "D", {}), ("dec", "D", {})], [pack("dd", 10 * i, 5 * k) for i in range(6)]))
    commands.sort(spark, str(tmp_path / "in"), str(tmp_path / "out.fits"), "ra", "dec", partitions=2, depth=1)
    found = fits.read(spark, str(tmp_path / "out.countmap.fits")).collect()
    assert [r["cell"] for r in found] == sorted(r["cell"] for r in found) and sum(r["n"] for r in found) == 12
    assert fits.open_hdus(str(tmp_path / "out.fits"))[0].keys["FILE"] == 0 and fits.read(spark, str(tmp_path / "out.fits")).count() == 12


def test_directory(spark, tmp_path):
    for k in range(3):
        save(tmp_path / f"{k}.fits", primary(), table([("x", "J", {})], [pack("i", 10 * k + i) for i in range(4)]))
    assert sorted(r["x"] for r in fits.read(spark, str(tmp_path)).collect()) == sorted(10 * k + i for k in range(3) for i in range(4))
    save(tmp_path / "3.fits", primary(), table([("y", "D", {})], [pack("d", 1)]))
    with pytest.raises(Exception, match="schema|differ|column"):
        fits.read(spark, str(tmp_path)).count()


def test_round_trip(spark, tmp_path):
    df = spark.sql(
        "SELECT id, CAST(id AS INT) i, CAST(id AS SHORT) s, CAST(id % 100 AS BYTE) b, id % 2 = 0 flag, CAST(id / 3 AS FLOAT) f, id / 7 d, concat('name ', id) name, IF(id % 3 = 0, NULL, id) n, "
        "array(CAST(id AS DOUBLE), 0.5D) arr, transform(sequence(1, CAST(id % 4 AS INT)), x -> CAST(x AS INT)) heap, CAST(id + 18446744073709551000 AS DECIMAL(20,0)) u FROM range(500)"
    ).withColumn("heap", F.when(F.col("id") % 4 == 0, F.array().cast("array<int>")).otherwise(F.col("heap")))
    path = str(tmp_path / "out.fits")
    fits.write(df, path)
    back = fits.read(spark, path)
    assert back.count() == 500 and (tmp_path / "out.fits").stat().st_size % 2880 == 0
    key = lambda r: r["id"]
    for a, b in zip(sorted(df.collect(), key=key), sorted(back.collect(), key=key), strict=True):
        assert all(a[c] == b[c] for c in df.columns if c != "u") and int(a["u"]) == int(b["u"])


def test_broken_files(spark, tmp_path):
    for k, data in enumerate((b"", b"no fits at all".ljust(2880), primary()[:100])):
        path = tmp_path / f"{k}.fits"
        path.write_bytes(data)
        with pytest.raises(Exception):
            fits.read(spark, str(path)).count()


def test_engineering_and_cards():
    assert fits.engineering(12345.678, 4) == "12.35E+3" and fits.engineering(0.00012, 2) == "120E-6" and fits.engineering(999.96, 4) == "1.000E+3"
    keys = fits.read_cards([card("A", "it''s"), card("B", 5), "LONG    = 'one &'".ljust(80), "CONTINUE  'two'".ljust(80), "HIERARCH ESO DET X = 3.5D2 / comment".ljust(80), card("C", "T", False)])
    assert keys == {"A": "it's", "B": 5, "LONG": "one two", "ESO DET X": Decimal("350"), "C": True}
