"""Every query against its SQL, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from kithlink.plans.queries import QUERIES
from tools.check_oracle import TABLES, canonical


@pytest.fixture(scope="module")
def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.count() == 1 and "error_pair" in result.columns


@pytest.mark.parametrize("arm", ["em_linkage", "em_deduplication", "active_linkage", "active_deduplication", "supervised_linkage"])
def test_every_arm_finds_most_persons(spark, folder, arm):
    row = entry.queries()[arm](spark, folder).first()
    assert row.tpr_any > 0.8 and row.prc_any > 0.6


def test_the_arms_are_compared_over_the_whole_grid(spark, folder):
    rows = entry.queries()["arm_comparison"](spark, folder).groupBy("framework", "budget").count().collect()
    # both frameworks and all six budgets: three sizes, three arms, five runs of each side, 1,000 resamples
    assert {(r.framework, r.budget) for r in rows} == {
        (f, b) for f in ("deduplication", "record_linkage") for b in (20, 40, 80, 200, 500, 1000)}
    assert {r["count"] for r in rows} == {3 * 3 * 5 * 5 * 1000}


def test_oracle_names_are_queries():
    from kithlink.plans import oracle
    assert set(oracle.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, folder, name):
    got = canonical(entry.queries()[name](spark, folder).toPandas())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    want = canonical(database.execute(sql).fetch_df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)
