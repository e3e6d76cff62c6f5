"""Each query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from forecourt.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.execute(ORACLES[name])
    expected = rows_of([c[0] for c in want.description], want.fetchall())
    assert rows_of(got.columns, got.collect()) == expected


@pytest.mark.parametrize("name", ["canonical_ad", "exclude_by_title", "ad_verdict", "spec_first_match", "page_lines"])
def test_no_python_in_plan(spark, name):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_exclusion_is_broadcast(spark):
    plan = QUERIES["exclude_by_url"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in plan and "LeftAnti" in plan
