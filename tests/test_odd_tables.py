"""Queries against their SQL on small tables with values that the test tables lack."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd

from lagline import queries as features

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def compared(spark, folder, name, values):
    """A query's rows and its SQL's, over events with these values."""
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 3, "error" if i % 4 == 0 else "click", v, f'{{"k": {i % 5}}}') for i, v in enumerate(values)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    got, want = features.queries()[name](spark, str(folder)).toPandas(), con.sql(features.oracle_sql()[name]).df()
    return (x.sort_values("transaction_id").reset_index(drop=True) for x in (got, want))


def test_clip_has_no_score_for_amounts_that_are_not_positive(spark, tmp_path):
    got, want = compared(spark, tmp_path, "exp4_clip", [0.0, 0.004, -3.0, 0.01, 99.0, 100.0, 250.0, 399.99, 400.0, 560.21, None])
    pd.testing.assert_frame_equal(got, want[got.columns.tolist()])
    assert got["z"].isna().tolist() == [True, True, True, *[False] * 7, True]
