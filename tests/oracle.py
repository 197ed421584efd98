"""Results of a query and of its DuckDB text, in a form that compares: rows sorted, floats as they are."""

from pathlib import Path

import duckdb


def canonical(names: list[str], rows) -> list[tuple]:
    """Rows with columns by name, sorted as text."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


def of_spark(df):
    return sorted(df.columns), canonical(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(sql: str, sf_dir: str):
    with duckdb.connect() as db:
        for p in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        return sorted(names), canonical(names, found.fetchall())
