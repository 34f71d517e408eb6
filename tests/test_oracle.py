"""Every registered query with oracle SQL matches DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from plotline.sources.tables import TABLE_NAMES
from tools.oracle_check import TYPE_MAP, TYPE_MAP_D, rows_of

SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQLS[name])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    stypes = {f.name: TYPE_MAP.get(f.dataType.simpleString()) for f in df.schema.fields}
    dtypes = {c[0]: TYPE_MAP_D.get(str(c[1])) for c in cur.description}
    assert stypes == dtypes
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["province", "avg_price", "median_price", "max_price", "min_price", "listings_count"]
