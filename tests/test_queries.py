"""Registered catalogue queries against DuckDB, and the driver contract."""

import numpy as np
import pytest
from oracle import of_duckdb, of_spark
from starloom.plans import catalogue_queries

QUERIES, ORACLES = catalogue_queries.queries(), catalogue_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_duckdb(ORACLES[name], sf_dir)


def repeated(sf_dir, folder, **times):
    """A folder with tables of ``sf_dir`` so many times over, under shifted keys."""
    import duckdb

    for table, n in times.items():
        key, source = catalogue_queries.TABLES[table][0], f"read_parquet('{sf_dir}/{table}.parquet')"
        duckdb.sql(f"COPY (SELECT t.* REPLACE ({key} + k * (SELECT max({key}) + 1 FROM {source}) AS {key}) FROM {source} t, range({n}) r(k)) TO '{folder}/{table}.parquet'")
    return str(folder)


def test_case_a_is_case_a_whatever_the_number_of_rows(spark, sf_dir, tmp_path):
    large = repeated(sf_dir, tmp_path, supplier=60)
    got = of_spark(QUERIES["hips_case_a"](spark, large))
    assert got == of_duckdb(ORACLES["hips_case_a"], large) and len(got[1]) > 4500


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_oracle_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_coverage_and_centre_are_registered_over_all_rows(spark, sf_dir):
    rows = catalogue_queries.hashed(spark, sf_dir).select("ra", "dec", "hpx29").collect()
    cells = {r["hpx29"] >> 46 for r in rows}
    ranges = QUERIES["moc_build"](spark, sf_dir).collect()
    assert {c for r in ranges for c in range(r["start"] >> 46, r["end"] >> 46)} == cells
    fraction = QUERIES["coverage_fraction"](spark, sf_dir).first()["sky_fraction"]
    assert fraction == len(cells) / 49152 and 0 < fraction < 1
    centre = QUERIES["mean_center"](spark, sf_dir).first()
    lo, la = (np.radians([r[c] for r in rows]) for c in ("ra", "dec"))
    x, y, z = (np.cos(la) * np.cos(lo)).mean(), (np.cos(la) * np.sin(lo)).mean(), np.sin(la).mean()
    assert abs(centre["lon"] - np.degrees(np.arctan2(y, x)) % 360) < 2e-6 and abs(centre["lat"] - np.degrees(np.arctan2(z, np.hypot(x, y)))) < 2e-6


def test_contract(spark):
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    if not __import__("os").path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert entry.entry(spark).columns == ["row_id", "ra", "dec"]
