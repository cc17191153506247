"""Samples, selections and models on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lagline.functions.scalar import HOUR
from lagline.operators import evaluate as ev
from lagline.operators import models as ml
from lagline.operators import ordered

SMALL = ml.Spec(rounds=3, depth=2)


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(2)
    rows = []
    for i in range(360):
        y = int(rng.random() < 0.3)
        rows.append((i, i * HOUR, i % 9, None if i % 17 == 0 else rng.random() + y, rng.choice(["a", "b", None]), y))
    return spark.createDataFrame(rows, "transaction_id long, us long, customer_id long, x double, kind string, label int").repartition(3).cache()


FOLDS = [ev.Fold("one", 160 * HOUR, 240 * HOUR), ev.Fold("two", 240 * HOUR, 300 * HOUR)]
LAST = ev.Fold("last", 300 * HOUR, 360 * HOUR)


def test_stratified_sample_and_split(df):
    n = Counter(r.label for r in df.collect())
    got = ev.stratified_sample(df, 100)
    again = ev.stratified_sample(df.repartition(5), 100)
    assert {r.transaction_id for r in got.collect()} == {r.transaction_id for r in again.collect()} and got.columns == df.columns
    held = Counter(r.label for r in got.collect())
    assert held[1] == round(n[1] * 100 / 360) and sum(held.values()) == 100
    assert ev.stratified_sample(df, 1000).count() == 360
    few = ev.stratified_sample(df.withColumn("label", (F.col("transaction_id") == 5).cast("int")), 20)
    assert few.where("label = 1").count() == 1 and few.count() == 20
    split = ev.stratified_split(df, 0.2).collect()
    assert Counter(r.label for r in split if r.held_out) == {k: round(v * 0.2) for k, v in n.items()}


def test_selections(df):
    columns = ev.feature_columns(df)
    assert columns == ["x", "kind"] and ev.families(["cust_a", "dev_a", "dev_b"], ["dev_"]) == ["dev_a", "dev_b"]
    assert dict(ev.model_frame(df, columns).dtypes) == {"transaction_id": "bigint", "label": "int", "x": "float", "kind": "string"}
    with pytest.raises(TypeError, match="customer_id"):
        ev.model_frame(df, ["customer_id"])
    with pytest.raises(TypeError, match="timestamp"):
        ev.model_frame(df.withColumn("t", F.lit("2026-01-01").cast("timestamp")), ["t"])
    assert [r.transaction_id for r in ev.top_rows(df.withColumn("one", F.lit(1)), "one", 3).collect()] == [0, 1, 2]
    gains = df.sparkSession.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0)], "feature string, gain double")
    assert ml.top_features(gains, 2) == ["b", "c"]


def test_pseudo_labels(df):
    fold = LAST
    late = fold.validate(df)
    scores = late.select("transaction_id", (F.col("transaction_id") / 360).alias("score"))
    hard = ev.hard_labels(fold.train(df), late.drop("label"), scores, top=0.1, weight=0.5).collect()
    assert len(hard) == 360 and sorted(r.transaction_id for r in hard if r.weight == 0.5 and r.label == 1) == list(range(354, 360))
    soft = ev.soft_labels(fold.train(df), late.drop("label"), scores)
    assert soft.count() == 300 + 120 and soft.where("weight < 0 or weight > 1").count() == 0


def test_models_learn_and_stop(df):
    columns = ev.feature_columns(df)
    truth = LAST.validate(df).select("transaction_id", "label")
    precision = lambda s: ml.AveragePrecision()._evaluate(truth.join(s, "transaction_id"))
    rate = truth.agg(F.avg("label")).first()[0]
    early = ml.fit(LAST.train(df), columns, ml.Spec(rounds=12, depth=2, patience=0.05), valid=LAST.validate(df))
    assert 1 <= early.rounds < 12 and precision(early.score(LAST.validate(df))) > rate + 0.2
    shares = {r.feature: r.gain for r in early.importance(df).collect()}
    assert set(shares) == set(columns) and shares["x"] > shares["kind"] and sum(shares.values()) == pytest.approx(1)
    for spec in (ml.Spec("linear", one_hot=True), ml.Spec("mlp", rounds=40, hidden=(4,))):
        fitted = ml.fit(LAST.train(df), columns, spec, prepare_on=LAST.recent(5).train(df))
        assert fitted.score(LAST.validate(df)).count() == 60 and precision(fitted.score(LAST.validate(df))) > rate + 0.2
    assert ml.AveragePrecision().isLargerBetter()


def test_out_of_fold_rows_and_stack(df):
    columns = ["x", "kind"]
    oof = ml.out_of_fold(df, FOLDS, columns, SMALL).collect()
    assert Counter(r.fold for r in oof) == {"one": 80, "two": 60}
    got = ml.stacked(df, FOLDS, LAST, columns, {"c": "customer_id"}, 12 * HOUR, SMALL, SMALL).collect()
    assert sorted(r.transaction_id for r in got) == list(range(300, 360)) and all(0 <= r.stacked <= 1 for r in got)
    many = ml.refit(df, LAST, LAST.validate(df), columns, SMALL, seeds=(0, 1)).collect()
    assert len(many) == 60 and all(0 <= r.score <= 1 for r in many)


def test_grid_blends_and_ranks(df):
    table = ml.grid(df, [LAST], ["x"], {"linear": ml.Spec("linear", rounds=5)}).collect()
    assert [(r.arm, r.window) for r in table] == [("linear", "last")] and 0 < table[0].metric <= 1
    a = df.select("transaction_id", F.col("us").cast("double").alias("score"))
    b = df.select("transaction_id", (-F.col("us")).cast("double").alias("score"))
    blends = {r.weight: r.metric for r in ml.blend_grid(df, ev.blend_weights([1.0, 0.0], a, b)).collect()}
    assert blends[1.0] != blends[0.0]
    ranks = {r.transaction_id: r.score for r in ev.rank_mean([(a, 1.0), (b, 1.0)]).collect()}
    assert all(v == pytest.approx(361 / 720) for v in ranks.values())
    auc, gains = ml.adversarial(LAST.train(df), LAST.validate(df), ["x", "kind"], ev.stratified_split, SMALL)
    assert 0 <= auc.first().auc <= 1 and gains.count() == 2


def test_running_sums_over_ranges(spark):
    """Against a plain loop, with ties, nulls and few ranges; how many there are never changes a result."""
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice([None, *range(12)]), rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, v long, w long").repartition(3)
    for descending in (False, True):
        want = {}
        for i, g, v, _ in rows:
            key = lambda r: (r[2] is None, 0 if r[2] is None else -r[2], r[0]) if descending else (r[2] is not None, r[2] or 0, r[0])  # noqa: E731, B023
            want[i] = sum(r[3] for r in rows if r[1] == g and key(r) < key((i, g, v)))
        for ranges in ("1", "4", "9"):
            before = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            try:
                got = {r.id: r.s for r in ordered.running(df, ["g"], ["v", "id"], {"s": "w"}, descending).collect()}
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", before)
            assert got == want
    assert ordered.running(df.limit(0), [], ["v"], {"s": "w"}).count() == 0


def test_side_tables(spark, tmp_path):
    from lagline.sources import io

    (tmp_path / "sample.csv").write_text("transaction_id,score\nT0,0\nT1,0\n")
    assert io.read_side_table(spark, str(tmp_path / "sample.csv"), "transaction_id string, score double").count() == 2
