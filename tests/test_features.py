"""Literal expectations for the feature families, and properties that hold for all of them."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lagline.functions.scalar import DAY, HOUR, MINUTE
from lagline.operators import history as h
from lagline.operators import ranges as r
from lagline.operators.guards import GuardError, check_frame, check_model_columns, frozen_encodings
from lagline.plans.spec import Direction, Feature, FutureFeatureError, guard, plan

T0 = 1_767_225_600_000_000  # 2026-01-01


def at(text):
    hours, minutes = map(int, text.split(":"))
    return T0 + hours * HOUR + minutes * MINUTE


def fact(spark, rows, schema="transaction_id string, customer_id string, merchant_id string, device_id string, us long, amount decimal(18,2)"):
    from decimal import Decimal

    return spark.createDataFrame([tuple(Decimal(str(x)) if isinstance(x, float) else x for x in row) for row in rows], schema)


def by_id(df):
    return {row["transaction_id"]: row.asDict() for row in df.collect()}


@pytest.fixture(scope="module")
def five(spark):
    return fact(spark, [("T0", "C1", "M1", "D1", at("0:00"), 100.0), ("T1", "C1", "M1", "D1", at("1:00"), 200.0), ("T2", "C1", "M2", "D1", at("2:00"), 300.0), ("T3", "C2", "M1", "D2", at("0:30"), 50.0), ("T4", "C1", "M1", "D2", at("3:00"), 9999.0)])


def test_build_on_five_rows(five):
    rows = by_id(h.add(five, h.expanding("customer_id", "cust"), h.robust("customer_id", "cust"), h.pair_novelty("customer_id", "device_id", "device"), h.gaps("customer_id", "cust")))
    t4 = rows["T4"]
    assert (t4["cust_history_count"], t4["cust_amt_mean_prior"], t4["is_new_device"]) == (3, 200.0, 1)
    assert t4["cust_amt_median_prior"] == 200 and t4["cust_amt_mad_prior"] == 125
    assert t4["cust_amt_robust_z"] == pytest.approx(9799 / (125 + 1e-6))
    assert rows["T0"]["cust_amt_mean_prior"] is None and rows["T0"]["is_new_device"] == 1 and rows["T0"]["cust_amt_sum_prior"] == 0
    assert rows["T4"]["cust_seconds_since_last"] == 3600 and rows["T3"]["cust_seconds_since_last"] is None


def test_tie_rules_differ(spark):
    times = ["0:00", "0:30", "0:30", "0:30", "1:00", "1:30"]
    df = fact(spark, [(f"T{i}", "c", "m", "d", at(t), 10.0) for i, t in enumerate(times)])
    rows = by_id(h.add(df, r.trailing_ladder("customer_id", "c", [HOUR]), r.backward("customer_id", "c", [HOUR]), h.expanding("customer_id", "p")))
    assert [rows[f"T{i}"]["c_cnt_1h"] for i in range(6)] == [0, 1, 1, 1, 4, 4]
    assert [rows[f"T{i}"]["c_bwd_cnt_1h"] for i in range(6)] == [0, 1, 2, 3, 4, 4]
    assert [rows[f"T{i}"]["p_history_count"] for i in range(6)] == list(range(6))


def test_forward_and_symmetric_windows(spark):
    df = fact(spark, [("0", "c1", "m", "d", at("0:00"), 10.0), ("1", "c1", "m", "d", at("0:30"), 20.0), ("2", "c1", "m", "d", at("0:45"), 30.0), ("3", "c1", "m", "d", at("5:00"), 40.0), ("4", "c2", "m", "d", at("0:10"), 99.0)])
    rows = by_id(plan(df, r.ahead("customer_id", "c", [HOUR]), allow_future=True))
    assert (rows["0"]["c_fwd_cnt_1h"], rows["0"]["c_fwd_amtsum_1h"]) == (2, 50.0)
    assert rows["2"]["c_fwd_cnt_1h"] == 0 and (rows["1"]["c_sym_cnt_1h"], rows["1"]["c_sym_amtsum_1h"]) == (2, 40.0)
    assert rows["4"]["c_fwd_cnt_1h"] == rows["4"]["c_sym_cnt_1h"] == 0
    assert (rows["0"]["c_seconds_to_next"], rows["2"]["c_seconds_to_next"], rows["3"]["c_seconds_to_next"], rows["4"]["c_seconds_to_next"]) == (1800, 15300, None, None)


def test_rich_forward_and_backward(spark):
    df = fact(spark, [("0", "c1", "m", "d", at("0:00"), 10.0), ("1", "c1", "m", "d", at("0:10"), 20.0), ("2", "c1", "m", "d", at("0:20"), 30.0), ("3", "c1", "m", "d", at("9:00"), 40.0), ("4", "c2", "m", "d", at("0:05"), 99.0)])
    w = [15 * MINUTE]
    rows = by_id(plan(df, [*r.ahead("customer_id", "c", w), *r.backward("customer_id", "c", w)], allow_future=True))
    one = rows["1"]
    assert (one["c_fwd_cnt_15m"], one["c_fwd_amtsum_15m"], one["c_sym_cnt_15m"], one["c_sym_amtsum_15m"], one["c_accel_15m"]) == (1, 30.0, 2, 40.0, 1.0)
    assert one["c_amt_vs_sym_15m"] == pytest.approx(1, abs=1e-6) and rows["0"]["c_accel_15m"] == 2.0 and rows["3"]["c_sym_cnt_15m"] == 0
    assert (rows["0"]["c_seconds_to_next"], rows["0"]["c_seconds_to_next2"]) == (600, 1200)
    assert [rows[str(i)]["c_bwd_cnt_15m"] for i in range(5)] == [0, 1, 1, 0, 0] and rows["2"]["c_bwd_amtsum_15m"] == 20


def test_target_encoding_is_frozen_without_labels(spark):
    data = [("0", "c1", 0, 1), ("1", "c1", 1, 0), ("2", "c1", 2, 1), ("3", "c1", 3, None), ("4", "c1", 4, None), ("5", "c2", 5, 0)]
    df = spark.createDataFrame(data, "transaction_id string, customer_id string, us long, label int")
    out = h.add(df, h.target_encoding("customer_id", "c", rate=F.lit(0.5)))
    rows = by_id(out)
    assert [(rows[k]["te_c_n"], rows[k]["te_c_pos"]) for k in "0234"] == [(0, 0), (2, 1), (3, 2), (3, 2)] and rows["5"]["te_c_n"] == 0
    assert rows["3"]["te_c"] == pytest.approx((2 + 20 * 0.5) / 23)
    assert frozen_encodings(out, "customer_id", "te_c").first().changing == 0


def test_missing_attributes_are_values(spark):
    schema = "transaction_id string, customer_id string, us long, amount decimal(18,2), location string, kind string"
    df = fact(spark, [("0", "c", at("0:00"), 1.0, None, "k"), ("1", "c", at("0:10"), 2.0, None, None), ("2", "c", at("0:20"), 3.0, "L", "k"), ("3", "c", at("0:30"), 4.0, None, "k")], schema)
    rows = by_id(h.frequency_share(h.add(df, h.pair_novelty("customer_id", "location", "loc"), r.context("location", "kind"), r.freshness("customer_id", "location", "c", [HOUR])), "location"))
    assert [rows[str(i)]["is_new_loc"] for i in range(4)] == [1, 0, 1, 0]
    assert [rows[str(i)]["customer_id_nunique_loc_prior"] for i in range(4)] == [0, 1, 1, 2]
    assert [rows[str(i)]["location_freq_share_prior"] for i in range(4)] == [0.0, 1.0, 0.0, pytest.approx(2 / 3)]
    assert rows["3"]["loc_cnt_1h"] == 2 and rows["3"]["c_fresh_location_1h"] == 2 and rows["0"]["c_fresh_location_share_1h"] is None
    assert rows["3"]["amt_vs_cat_mean_prior"] == pytest.approx(4 / (2 + 1e-6))


def test_context_does_not_read_ahead(spark):
    schema = "transaction_id string, us long, amount decimal(18,2), location string, kind string"
    rows = [("0", at("0:00"), 10.0, "L1", "p"), ("1", at("0:30"), 20.0, "L1", "p"), ("2", at("1:00"), 30.0, "L1", "p")]
    base = by_id(h.add(fact(spark, rows, schema), r.context("location", "kind")))
    moved = by_id(h.add(fact(spark, [*rows[:2], ("2", at("1:00"), 9999.0, "L1", "p")], schema), r.context("location", "kind")))
    assert base["0"]["loc_cnt_1h"] == 0
    assert all(base[k][c] == moved[k][c] for k in "01" for c in base["0"])


def test_direction_guard(spark):
    with pytest.raises(FutureFeatureError):
        guard(r.ahead("customer_id", "c", [HOUR]))
    guard(r.backward("customer_id", "c", [HOUR]) + h.expanding("customer_id", "c") + r.trailing_ladder("customer_id", "c", [HOUR]))
    with pytest.raises(FutureFeatureError):
        guard([Feature("x", F.lit(1), Direction.SYMMETRIC)])
    with pytest.raises(GuardError):
        check_model_columns(["amount", "customer_id"])


def families():
    return [
        h.expanding("customer_id", "c"),
        h.robust("customer_id", "c"),
        h.log_zscore("customer_id", "l"),
        h.gaps("customer_id", "c"),
        r.trailing_ladder("customer_id", "t", [HOUR, 24 * HOUR]),
        r.recent("customer_id", "r", [5 * MINUTE, 3 * HOUR]),
        h.pair_novelty("customer_id", "device_id", "device"),
        r.freshness("customer_id", "device_id", "f", [HOUR]),
        h.hour_profile("customer_id", "h"),
        r.backward("customer_id", "b", [HOUR]),
    ]


def random_fact(spark, rng, n=120):
    rows = [(f"T{i:03d}", f"c{rng.randrange(4)}", f"m{rng.randrange(3)}", f"d{rng.randrange(5)}", T0 + rng.randrange(60) * 10 * MINUTE, float(rng.randrange(1, 500))) for i in range(n)]
    return rows, fact(spark, rows)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-9, abs=1e-9)
    return a == b


def test_no_prior_feature_reads_the_future(spark):
    rng = random.Random(5)
    rows, df = random_fact(spark, rng)
    cut = sorted(x[4] for x in rows)[80]
    moved = fact(spark, [(*x[:3], "zz", x[4], x[5] * 100) if x[4] > cut else x for x in rows])
    a, b = by_id(h.add(df, *families())), by_id(h.add(moved, *families()))
    for x in rows:
        if x[4] <= cut:
            assert all(close(a[x[0]][k], b[x[0]][k]) for k in a[x[0]]), x


def test_row_order_and_other_entities_do_not_matter(spark):
    rng = random.Random(6)
    rows, df = random_fact(spark, rng)
    base = by_id(h.add(df, *families()))
    shuffled = by_id(h.add(fact(spark, rng.sample(rows, len(rows))), *families()))
    alone = by_id(h.add(fact(spark, [x for x in rows if x[1] == "c1"]), *families()))
    assert all(close(base[t][k], shuffled[t][k]) for t in base for k in base[t])
    assert all(close(base[t][k], alone[t][k]) for t in alone for k in alone[t])


def test_brute_force_windows(spark):
    rng = random.Random(7)
    rows, df = random_fact(spark, rng)
    got = by_id(h.add(df, h.expanding("customer_id", "c"), r.trailing_ladder("customer_id", "t", [3 * HOUR]), r.backward("customer_id", "b", [3 * HOUR]), h.pair_novelty("customer_id", "device_id", "device")))
    for t, c, _, dev, us, _ in rows:
        before = [x for x in rows if x[1] == c and (x[4], x[0]) < (us, t)]
        window = [x for x in rows if x[1] == c and us - 3 * HOUR <= x[4] < us]
        assert got[t]["c_history_count"] == len(before) and got[t]["c_amt_sum_prior"] == sum(x[5] for x in before)
        assert got[t]["t_cnt_3h"] == len(window) and got[t]["t_amtsum_3h"] == sum(x[5] for x in window)
        assert got[t]["b_bwd_cnt_3h"] == len(window) + sum(x[4] == us for x in before)
        assert got[t]["is_new_device"] == (dev not in {x[3] for x in before}) and got[t]["customer_id_nunique_device_prior"] == len({x[3] for x in before})


def test_bucketed_forms_equal_plain_ones(spark):
    _, df = random_fact(spark, random.Random(8), 200)
    plain = by_id(h.add(df, h.expanding("customer_id", "c"), r.trailing_ladder("customer_id", "t", [2 * HOUR])))
    buckets = by_id(h.expanding_in_blocks(df, "customer_id", "c", block_rows=16))
    halo = by_id(r.trailing_with_halo(df, "customer_id", 2 * HOUR, {"n": r.count}))
    for t, row in plain.items():
        assert (row["c_history_count"], row["c_amt_sum_prior"]) == (buckets[t]["c_history_count"], buckets[t]["c_amt_sum_prior"])
        assert row["t_cnt_2h"] == halo[t]["n"]


def test_empty_table(spark):
    df = fact(spark, [])
    assert h.frequency_share(h.add(df, *families()), "merchant_id").count() == 0


def test_frame_check(spark, five):
    check_frame(five)
    with pytest.raises(GuardError):
        check_frame(five.union(five.limit(1)))


def test_sources_and_sinks(spark, tmp_path):
    from lagline.sources import io
    from lagline.sources.adapters import combine

    csv = tmp_path / "train.csv"
    head = "transaction_id,customer_id,timestamp,amount,merchant_id,merchant_category,device_id,device_type,location,payment_method,transaction_type,account_age_days,fraud"
    csv.write_text(f"{head}\nT0,C0,2026-01-01 00:00:43,672.80,M0,fuel,D0,mobile,LOC_028,wallet,p2p,143,0\nT1,C0,2026-01-02 00:00:43,1.00,M0,,D0,mobile,,wallet,p2p,143,\n")
    df = io.first_readable(spark, [str(tmp_path / "none.csv"), str(csv)])
    assert df.count() == 2 and df.where("us is null").count() == 0
    with pytest.raises(FileNotFoundError):
        io.first_readable(spark, [str(tmp_path / "none.csv")])
    assert combine(df, df.drop("fraud")).groupBy("is_test").count().count() == 2
    io.write_features(df, str(tmp_path / "features"))
    back = io.read_features(spark, str(tmp_path / "features"))
    assert back.where("event_date = '2026-01-02'").count() == 1
    sample = spark.createDataFrame([("T1", 0), ("T0", 1)], "transaction_id string, position int")
    scores = spark.createDataFrame([("T0", 0.25), ("T1", 0.5)], "transaction_id string, score double")
    assert [x.transaction_id for x in io.submission(sample, scores).collect()] == ["T1", "T0"]
    with pytest.raises(Exception, match="no valid score"):
        io.submission(sample, scores.where("transaction_id = 'T0'")).collect()


def test_calendar(spark):
    from lagline.functions.scalar import calendar

    us = int(datetime(2026, 1, 4, 5, tzinfo=timezone.utc).timestamp()) * 1_000_000  # a Sunday
    df = spark.createDataFrame([(us,)], "us long").select(*[c.alias(n) for n, c in calendar().items()]).first()
    assert (df.hour_of_day, df.day_of_week, df.is_night) == (5, 6, 1)
    assert DAY == 24 * HOUR


def test_backward_windows_sort_their_rows_once(spark):
    """Ties and ranges share one order of the rows behind one exchange: a task holds them once."""
    from pyspark.sql import functions as F

    from lagline.operators import ranges
    from lagline.plans.spec import plan

    df = spark.range(40).select(F.col("id").cast("string").alias("transaction_id"), (F.floor(F.col("id") / 3) * ranges.MINUTE).alias("us"), (F.col("id") % 2).alias("e"), F.col("id").cast("decimal(18,2)").alias("amount"))
    text = plan(df, ranges.backward("e", "x", [2 * ranges.MINUTE, 5 * ranges.MINUTE], rates=[(2 * ranges.MINUTE, 5 * ranges.MINUTE)]))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Sort [") == 1 and text.count("Exchange hashpartitioning") == 1
