"""Every registered query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from tessera.plans.fixtures import BASE_TABLES
from tessera.plans.registry import ORACLE, QUERIES, load_all
from tools.oracle_check import rows_of

load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 188  # app_admin of `view` reads every row of it, null owners too


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    o_cols, o_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert rows_of(s_cols, s_rows) == rows_of(o_cols, o_rows)


@pytest.mark.parametrize("name", ["j13_stale_token_exposure", "w2_trailing_hour_counts", "a9_rate_cap_history",
                                  "f14_expiring_sessions", "a3_table_checksum", "s7_export_account_list"])
def test_time_queries_do_not_depend_on_the_session_zone(spark, name):
    def run():
        df = QUERIES[name](spark, SMALL)
        return rows_of(df.columns, [tuple(r) for r in df.collect()])
    zone = spark.conf.get("spark.sql.session.timeZone")
    utc = run()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        other = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert utc == other
