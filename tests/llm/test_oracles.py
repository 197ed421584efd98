"""Queries of the training-data operators against DuckDB, and that the whole pipeline runs."""

import corpus_pipeline
import pytest
from oracle import of_duckdb, of_spark
from starloom.llm import queries

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_duckdb(ORACLES[name], sf_dir)


def test_all_ten_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    assert {f"op{k}" for k in range(1, 11)} | {"pipeline"} == {name.split("_")[0] for name in QUERIES}
    assert QUERIES.keys() <= entry.queries().keys()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "bpe"]
