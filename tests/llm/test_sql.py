"""Registered queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from conftest import SF_SMALL
from gleaner.llm import queries


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF_SMALL)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, want))
