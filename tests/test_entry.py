"""The driver contract, and every query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from lagline import queries as features

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


#: build_269_columns holds all of build_197_columns.
@pytest.mark.parametrize("name", sorted(set(features.oracle_sql()) - {"build_197_columns"}))
def test_query_equals_sql(spark, duck, name):
    got, want = features.queries()[name](spark, D).toPandas(), duck.sql(features.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    keys = [c for c in columns if c in ("transaction_id", "src")] or columns
    got, want = (x[columns].sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert not [c for c in columns if not got[c].equals(want[c])] and len(got) == len(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_numbers_of_columns():
    from lagline.plans.build import RAW, column_names

    sets = [(dict(), 194), (dict(graph=False), 190), (dict(graph=False, backward=True), 262), (dict(graph=False, context=True), 208)]
    for chosen, n in sets:
        names = column_names(**chosen)
        assert len(names) == len(set(names)) == n and not set(names) & set(RAW)
    assert len(RAW) == 7
