"""Every registered query against its DuckDB twin on the smallest tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from gleaner.plans import catalog

sys.path.insert(0, "scripts")
from check_oracles import TABLES, fingerprint  # noqa: E402

NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "rank" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert fingerprint(got) == fingerprint(want)


def test_queries_apply_utc_to_a_foreign_session(spark, con):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    got = entry.queries()["parse_item_dates"](spark, SF_SMALL).toPandas()
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert fingerprint(got) == fingerprint(con.execute(entry.oracle_sql()["parse_item_dates"]).df())
