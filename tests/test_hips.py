"""HiPS layers against a recursive plain-Python model, the stored catalogue, its text forms, and the commands end to end."""

import math
import random

import pytest
from fits_bytes import pack, primary, table
from pyspark.sql import functions as F
from starloom import commands
from starloom.functions import healpix as H
from starloom.operators import catalog, hips
from starloom.sources import fits, hips_store


def model(cells, scores, n1, r21, n_tot):
    """Depth of each row of a sorted catalogue: by recursion over cells, row by row."""
    n = len(cells)
    covered = len({c >> 54 for c in cells})
    n12 = n1 * (1 + r21) * covered // 192
    first = n12 // (1 + r21)
    depth = [None] * n

    def pick(a, b):
        free = [k for k in range(a, b) if depth[k] is None]
        if not free:
            return None
        if scores:
            return min(free, key=lambda k: (scores[k], k))
        mid = (a + b) // 2
        return min(free, key=lambda k: (k >= mid, abs(k - mid)))

    if n <= 3 * first // 2:
        return [1] * n
    if n <= 3 * n12 // 2:
        for a in range(0, n, 1 + r21):
            depth[pick(a, min(n, a + 1 + r21)) if scores else a] = 1
        return [d or 2 for d in depth]
    size = math.ceil(n / n12)
    for i, a in enumerate(range(0, n, size)):
        b = min(n, a + size)
        depth[pick(a, b) if scores else (a + b) // 2] = 1 if i % (1 + r21) == 0 else 2

    def cell(d, a, b):
        if a == b:
            return
        sub = len({c >> 2 * (29 - min(29, d + 3)) for c in cells[a:b]})
        sel = max(1, sub * n_tot // 4 ** (min(29, d + 3) - d))
        free = [k for k in range(a, b) if depth[k] is None]
        if len(free) <= 3 * sel // 2 or d == 29:
            for k in free:
                depth[k] = d
            return
        count = b - a
        for k in range(sel):
            at = pick(a + k * count // sel, a + (k + 1) * count // sel)
            if at is not None:
                depth[at] = d
        while a < b:
            end = a
            while end < b and cells[end] >> 2 * (28 - d) == cells[a] >> 2 * (28 - d):
                end += 1
            cell(d + 1, a, end)
            a = end

    a = 0
    while a < n:
        end = a
        while end < n and cells[end] >> 52 == cells[a] >> 52:
            end += 1
        cell(3, a, end)
        a = end
    return depth


def sample(kind, n, seed):
    rng = random.Random(seed)
    if kind == "patch":
        return [(100 + rng.random(), 10 + rng.random()) for _ in range(n - 20)] + [(rng.uniform(0, 360), rng.uniform(-80, 80)) for _ in range(20)]
    if kind == "one":
        return [(33.0, 44.0)] * n
    return [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(n)]


@pytest.mark.parametrize(("kind", "n", "n1", "r21", "n_tot", "scored"), [("all", 40, 3000, 3, 500, False), ("all", 200, 100, 3, 20, True), ("all", 200, 100, 3, 20, False), ("all", 1200, 60, 3, 8, False), ("patch", 600, 400, 2, 10, True), ("one", 60, 400, 3, 3, False)])
def test_layers_equal_the_model(spark, kind, n, n1, r21, n_tot, scored):
    rows = [(k, *p, float(k * 7919 % 97)) for k, p in enumerate(sample(kind, n, n))]
    df = catalog.with_recno(H.with_hash(spark.createDataFrame(rows, "row_id long, ra double, dec double, s double")), ["hpx29", "row_id"]).cache()
    local = sorted(df.collect(), key=lambda r: r["recno"])
    want = model([r["hpx29"] for r in local], [r["s"] for r in local] if scored else None, n1, r21, n_tot)
    layers, leaves = hips.build(df, "s" if scored else None, n1, r21, n_tot)
    got = sorted(((r["recno"], r["depth"]) for r in layers.collect()))
    assert got == list(enumerate(want))
    covered = {(r["depth"], r["cell"]) for r in leaves.collect()}
    assert all(any((d, r["hpx29"] >> 2 * (29 - d)) in covered for d in range(1, 30)) for r in local)


@pytest.mark.parametrize(("kind", "n", "n1", "r21", "n_tot", "scored"), [("all", 300, 60, 3, 8, True), ("patch", 300, 40, 2, 10, False), ("one", 60, 400, 3, 3, True)])
def test_large_cells_give_the_same_layers(spark, monkeypatch, kind, n, n1, r21, n_tot, scored):
    """Cells that are gone through by all tasks, with some of their descendants placed by one, and scores that are NaN or null."""
    monkeypatch.setattr(hips, "LOCAL_ROWS", 20)
    rows = [(k, *p, None if k % 7 == 3 else math.nan if k % 7 == 5 else float(k % 11)) for k, p in enumerate(sample(kind, n, n))]
    df = catalog.with_recno(H.with_hash(spark.createDataFrame(rows, "row_id long, ra double, dec double, s double")), ["hpx29", "row_id"]).cache()
    local = sorted(df.collect(), key=lambda r: r["recno"])
    scores = [(r["s"] is None, r["s"] is not None and math.isnan(r["s"]), 0.0 if r["s"] is None or math.isnan(r["s"]) else r["s"]) for r in local]
    want = model([r["hpx29"] for r in local], scores if scored else None, n1, r21, n_tot)
    layers, leaves = hips.build(df, "s" if scored else None, n1, r21, n_tot)
    got = sorted((r["recno"], r["depth"]) for r in layers.collect())
    monkeypatch.undo()
    again, same = hips.build(df, "s" if scored else None, n1, r21, n_tot)
    assert got == list(enumerate(want)) == sorted((r["recno"], r["depth"]) for r in again.collect())
    assert sorted(map(tuple, leaves.collect())) == sorted(map(tuple, same.collect()))


def test_rows_are_stored_once_however_many_levels_there_are(spark, monkeypatch):
    df = catalog.with_recno(H.with_hash(spark.createDataFrame([(k, 33.0, 44.0) for k in range(60)], "row_id long, ra double, dec double")), ["hpx29", "row_id"]).cache()
    kept, store = [], hips.stored
    monkeypatch.setattr(hips, "stored", lambda t, name="table": kept.append(store(t, name)) or kept[-1])
    layers, _ = hips.build(df, None, 400, 3, 3)
    assert layers.agg(F.max("depth")).first()[0] == 29 and sum(t.count() for t in kept) <= 4 * 60


def test_tiles_read_their_layers_once(spark):
    rng, seen = random.Random(5), spark.sparkContext.accumulator(0)
    rows = [(rng.choice([5 << 50, (5 << 50) + 1, 77 << 48, rng.randrange(12 << 58)]), rng.choice([1, 2, 4])) for _ in range(200)]

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = {tuple(r) for r in hips.tile_stats(spark.createDataFrame(rows, "hpx29 long, depth int").mapInArrow(watch, "hpx29 long, depth int")).collect()}
    under = {(d, c >> 2 * (29 - d)): [e for x, e in rows if x >> 2 * (29 - d) == c >> 2 * (29 - d)] for c, d in rows}
    assert got == {(d, c, sum(e <= d for e in es), len(es)) for (d, c), es in under.items()}
    assert seen.value == 200


def catalogue_file(tmp_path, n=700):
    columns = [("id", "K", {}), ("RA", "D", {"TUNIT": "deg"}), ("DEC", "D", {}), ("mag", "E", {}), ("name", "8A", {})]
    rows = [pack("qddf", k, *p, math.nan if k % 50 == 0 else k % 17) + f"n{k}".encode().ljust(8) for k, p in enumerate(sample("all", n, 3))]
    path = tmp_path / "cat.fits"
    path.write_bytes(primary() + table(columns, rows))
    return str(path)


def test_commands_end_to_end(spark, tmp_path):
    source, run = catalogue_file(tmp_path), lambda *words: "".join(commands.run(spark, [str(w) for w in words]))
    assert "BINTABLE" in run("struct", source) and "TTYPE2" in run("head", source) and "f64" in run("info", source)
    csv = run("csv", source).split("\n")
    assert csv[0] == "id,RA,DEC,mag,name" and len(csv) == 702 and csv[1].startswith("0,") and csv[1].split(",")[3] == "" and csv[2].split(",")[3] == "1.0"
    assert run("csv", source, "-o", tmp_path / "o.csv") == "" and (tmp_path / "o.csv").read_text() == "\n".join(csv)
    run("sort", source, tmp_path / "sorted", "-l", 2, "-b", 3)
    run("sort", source, tmp_path / "sorted.fits", "-l", "RA", "-b", "DEC")
    assert run("csv", tmp_path / "sorted.fits").count("\n") == 701
    for name in ("sorted", "sorted.fits"):
        run("mkidx", tmp_path / name, tmp_path / f"{name}.idx", "-l", "RA", "-b", "DEC", "-d", 5)
        run("qidx", tmp_path / f"{name}.idx", tmp_path / f"{name}.cone.fits", "cone", 10, 20, 40)
        run("qidx", tmp_path / f"{name}.idx", tmp_path / f"{name}.few", "cone", 10, 20, 40, "-l", 5)
    a, b = (sorted(r["id"] for r in fits.read(spark, str(tmp_path / f"{n}.cone.fits")).collect()) for n in ("sorted", "sorted.fits"))
    assert a == b and len(a) > 20 and spark.read.parquet(str(tmp_path / "sorted.few")).count() == 5
    table_ = spark.read.parquet(str(tmp_path / "sorted.fits.idx"))
    ranges = commands.row_ranges(table_, 5, commands.R.Cone(10, 20, 15))
    read = fits.read(spark, str(tmp_path / "sorted.fits"), rows=ranges, number="at")
    assert 0 < read.count() == sum(b - a for a, b in ranges) < 300 and all(any(a <= r["at"] < b for a, b in ranges) for r in read.collect())
    assert "Exchange" not in commands.indexed(spark, str(tmp_path / "sorted.fits.idx"), commands.R.Cone(10, 20, 15))[0]._jdf.queryExecution().executedPlan().toString()
    for ratio, n in ((0.1, None), (50, 12 * 4**5 + 1)):
        run("mkidx", tmp_path / "sorted.fits", tmp_path / "ratio.idx", "-l", "RA", "-b", "DEC", "-d", 5, "-r", ratio)
        assert (spark.read.parquet(str(tmp_path / "ratio.idx")).count() == n) == (n is not None)
    stale = tmp_path / "stale.fits"
    stale.write_bytes((tmp_path / "sorted.fits").read_bytes())
    run("mkidx", stale, tmp_path / "stale.idx", "-l", "RA", "-b", "DEC", "-d", 5)
    stale.write_bytes((tmp_path / "sorted.fits").read_bytes()[:-2880])
    with pytest.raises(ValueError, match="changed"):
        run("qidx", tmp_path / "stale.idx", tmp_path / "x", "cone", 10, 20, 4)
    with pytest.raises(ValueError, match="sorted"):
        run("mkidx", source, tmp_path / "bad.idx", "-l", "RA", "-b", "DEC")
    (tmp_path / "centres").write_text("# c\n10 20\n11 20\n")
    run("qidx", tmp_path / "sorted.idx", tmp_path / "multi", "multicone", tmp_path / "centres", 40)
    assert spark.read.parquet(str(tmp_path / "multi")).count() >= len(a)
    run("mkhips", tmp_path / "sorted.idx", tmp_path / "hips", "-n", 50, "-m", 10, "-s", "mag != mag ? 99 : mag", "--obs-title", "A <title>", "--obs-regime", "Optical", "--obs-regime", "Radio")
    assert "obs_title            = A <title>\n" in run("qhips", tmp_path / "hips", "properties") and run("qhips", tmp_path / "hips", "properties").count("obs_regime") == 2
    listed = [x.split(",") for x in run("qhips", tmp_path / "hips", "list").splitlines()]
    assert listed[0] == ["depth", "cell", "cumul_count", "tot_count"]
    total = 0
    for d in range(1, 30):
        total += max(0, run("qhips", tmp_path / "hips", "allsky", d).count("\n") - 1) if str(d) in {x[0] for x in listed} else 0
    assert total == 700
    d, c, cumul, tot = listed[-1]
    tile = run("qhips", tmp_path / "hips", "tile", d, c)
    assert tile.startswith(f"# Completeness = {cumul}/{tot}\nid\tRA\tDEC\tmag\tname\n") and run("qhips", tmp_path / "hips", "tile", 9, 1) == ""
    assert "VOTABLE" in run("qhips", tmp_path / "hips", "metadata") and "&lt;title&gt;" in run("qhips", tmp_path / "hips", "info")
    run("qhips", tmp_path / "hips", "export", tmp_path / "tree")
    assert len(list((tmp_path / "tree").glob("Norder*/Dir*/Npix*.tsv"))) == len(listed) - 1
    assert (tmp_path / "tree" / f"Norder{d}" / f"Dir{int(c) // 10000 * 10000}" / f"Npix{c}.tsv").read_text() == tile
    moc = commands.load_moc(str(tmp_path / "tree" / "Moc.fits"))
    assert moc.ranges == commands.R.moc_from_text(hips_store.Hips(spark, str(tmp_path / "hips")).moc_text()).ranges and moc.ranges
    content = b"".join(commands.run(spark, ["qhips", str(tmp_path / "hips"), "moc"]))
    served = hips_store.route(spark, str(tmp_path), "/hips/Moc.fits")
    assert (served.status, served.kind, b"".join(served.body)) == (200, "application/fits", content) and content == (tmp_path / "tree" / "Moc.fits").read_bytes()

    ask = lambda path, query="", method="GET": (lambda r: (r.status, "".join(r.body)))(hips_store.route(spark, str(tmp_path), path, query, method))
    assert ask(f"/hips/Norder{d}/Dir0/Npix{c}.tsv") == (200, tile) and ask("", f"input=hips&action=tile&depth={d}&hash={c}") == (200, tile)
    assert ask("/hips/Norder9/Dir0/Npix1.tsv")[0] == 404 and ask("/hips/Norder3/Allsky.tsv")[0] == 400 and ask("/hips/Norder1/Allsky.tsv")[0] == 200 and ask("/hips/Allsky1.tsv")[0] == 200
    assert ask("/hips/properties")[0] == 200 and ask("/hips")[0] == 200 and ask("/other/properties")[0] == 404 and ask("/hips/properties", method="POST")[0] == 501 and ask("")[0] == 400 and ask("/../x/properties")[0] == 400


def test_properties_round_trip():
    p = hips_store.Properties(obs_title='q"u\\o\nte', bib_reference=["a", "b"], hips_initial_ra=1.5, hips_cat_nrows=7)
    assert hips_store.Properties.from_toml(p.to_toml()) == p


def test_empty_catalogue(spark, tmp_path):
    df = catalog.sort_catalogue(spark.createDataFrame([], "row_id long, ra double, dec double"), str(tmp_path / "s"))
    store = hips_store.write(df, str(tmp_path / "hips"))
    assert store.tiles().count() == 0 and store.properties().hips_cat_nrows == 0


def test_multi_table_csv(spark, tmp_path):
    path = tmp_path / "two.fits"
    path.write_bytes(primary() + table([("x", "J", {})], [pack("i", 1)]) + table([("y", "J", {})], [pack("i", 2)]))
    list(commands.csv(spark, str(path), str(tmp_path / "t.csv")))
    assert (tmp_path / "t.csv").read_text() == "x\n1\n" and (tmp_path / "t.2.csv").read_text() == "y\n2\n"
    assert F is not None
