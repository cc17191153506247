"""Segmented scans over blocks against window functions, and the build with entities that hold half of all rows."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagline.operators import history as h
from lagline.operators.scan import LAST, N, State, prior_states, text_key

D = "/root/testdata/sf0.001"
SCHEMA = "transaction_id string, us long, customer_id string, device_id string, amount double, _x long"


def fact(spark, n=700, seed=4):
    """Half of all rows of one customer, ties in time, null keys and amounts of every kind."""
    rng = random.Random(seed)
    rows = [(f"T{i:04d}", rng.randrange(n // 3) * 1_000_000, "hot" if i % 2 else rng.choice(["a", "b", "c", None]), rng.choice(["d1", "d2", "d3", None]), rng.randrange(1, 10_000) / 100, None if i % 9 == 0 else rng.randrange(-50, 50)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("block_rows", [1, 2, 23, 10_000])
def test_states_equal_windows(spark, block_rows):
    df = fact(spark, 200 if block_rows < 3 else 700)
    states = [N, LAST, State("sum", "_x"), State("max", "_x"), State("min", "_x")]
    keys = {"c": (text_key("customer_id"), states), "pair": (text_key("customer_id", "device_id"), states), "all": (text_key(), [N, State("max", "_x")])}
    got = prior_states(df, keys, block_rows)
    by = {"c": ["customer_id"], "pair": ["customer_id", "device_id"], "all": [F.lit(0)]}
    want = df
    for k, (_, wanted) in keys.items():
        w = Window.partitionBy(*by[k]).orderBy("us", "transaction_id")
        frame = w.rowsBetween(Window.unboundedPreceding, -1)
        for s in wanted:
            if s == LAST:
                want = want.withColumns({f"_{k}_last_{j}": F.lag("us", j).over(w) for j in (1, 2)})
            else:
                c = F.count(F.lit(1)) if s == N else getattr(F, s.how)(s.column)
                want = want.withColumn(f"_{k}_{s.name}", c.over(frame))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_families_are_the_same_through_scans(spark):
    df = fact(spark).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    plain = [*h.pair_novelty("customer_id", "device_id", "dev"), *h.hour_profile("customer_id", "c"), *h.expanding("customer_id", "c"), *h.log_zscore("customer_id", "c"), *h.gaps("customer_id", "c")]
    want = h.add(df.drop("_x"), plain)
    held = h.scanned(df.drop("_x"), "customer_id", "c", pairs={"dev": "device_id"}, profile=True, block_rows=50)
    past = h.Scanned("c")
    got = h.plan(held, [*h.pair_novelty("customer_id", "device_id", "dev", past, h.Scanned("dev")), *h.hour_profile("customer_id", "c", past, h.Scanned("c_hour")), *h.expanding("customer_id", "c", past=past), *h.log_zscore("customer_id", "c", past=past), *h.gaps("customer_id", "c", past)]).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_build_with_a_merchant_of_half_the_rows(spark):
    from lagline.plans.build import build_features
    from lagline.sources.adapters import lineitem_fact

    fact = lineitem_fact(spark, D).where("us % 7 < 4").withColumn("merchant_id", F.when(F.crc32("transaction_id") % 2 == 0, 1).otherwise(F.col("merchant_id")))
    want = {r.transaction_id: r for r in build_features(fact, graph=False).collect()}
    got = {r.transaction_id: r for r in build_features(fact, graph=False, spread_rows=len(want) // 4).collect()}
    assert got == want and len(want) > 1000


def test_no_rows(spark):
    df = fact(spark).where("us < 0")
    assert prior_states(df, {"all": (text_key(), [N, LAST])}).count() == 0
    assert h.running_max_ratio(df, "amount", "r").count() == 0


def test_small_entities_are_not_scanned(spark, monkeypatch):
    """Scans are for entities of many rows; every entity was scanned before, at several times its rows in states."""
    import random

    from lagline.operators import history as h

    rng = random.Random(3)
    rows = [(i, rng.randrange(60) * 1_000_000, "hot" if i % 3 else rng.choice(["a", "b", None]), float(rng.randrange(1, 900))) for i in range(400)]
    df = spark.createDataFrame(rows, "transaction_id long, us long, e string, amount double")
    names = ["transaction_id", "e_history_count", "e_amt_sum_prior", "e_log_amt_zscore", "e_seconds_since_last2"]
    of = lambda d: sorted(map(tuple, d.select(*names).collect()))
    scanned, seen = h.scanned, []
    monkeypatch.setattr(h, "scanned", lambda d, *a, **k: seen.append(d.select("e").distinct().count()) or scanned(d, *a, **k))
    by_windows = of(h.expanding_in_blocks(df, "e", "e"))
    assert not seen
    assert of(h.expanding_in_blocks(df, "e", "e", spread_rows=100)) == by_windows and seen == [1]
    assert of(h.expanding_in_blocks(df, "e", "e", block_rows=32)) == by_windows


def test_context_looks_windows_up_by_place_and_time(spark, monkeypatch):
    """Rows with all their columns were doubled to see the windows; now a row for each place and time is."""
    import random

    from lagline.operators import ranges as r
    from lagline.plans.spec import plan

    rng = random.Random(4)
    rows = [(i, rng.randrange(90) * 1_800_000_000, rng.choice(["x", "y", None]), rng.choice(["k", None]), float(rng.randrange(1, 900))) for i in range(500)]
    df = spark.createDataFrame(rows, "transaction_id long, us long, place string, kind string, amount double")
    halo, seen = r.trailing_with_halo, []
    monkeypatch.setattr(r, "trailing_with_halo", lambda d, *a: seen.extend(d.columns) or halo(d, *a))
    got, want = r.context_by_blocks(df, "place", "kind", block_rows=64), plan(df, r.context("place", "kind"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)
    assert seen == ["_at", "us", "_c", "_s"]


def test_places_in_a_hashed_order_need_no_window_over_rows(spark):
    """Windows by label and range put several ranges into one task."""
    from lagline.operators.evaluate import stratified_split

    df = spark.range(1000).selectExpr("id AS transaction_id", "cast(id % 3 = 0 AS int) AS label")
    got = stratified_split(df, 0.2)
    assert not [s for s in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in s and "_hash" in s]
    assert got.where("held_out").groupBy("label").count().orderBy("label").collect() == [(0, 133), (1, 67)]
