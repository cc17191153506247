"""Stopping by average precision, boosting of sampled rows and with dropped trees, tables in buckets of an entity."""

import random
import uuid

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lagline.functions.scalar import DAY
from lagline.operators import models as ml
from lagline.operators.history import add, expanding
from lagline.operators.metrics import average_precision
from lagline.sources.io import read_by_entity, replace_days, save_by_entity


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    data = []
    for i in range(1500):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        data.append((i, i * 1000, x, y, rng.choice(["a", "b", None]), int(x * y + rng.gauss(0, 0.7) > 1)))
    return spark.createDataFrame(data, "transaction_id long, us long, x double, y double, kind string, label int").cache()


def ap(df):
    return average_precision(df).first().ap


@pytest.mark.parametrize("kind", ["gbt", "goss", "dart"])
def test_rounds_are_those_of_a_loop(rows, kind):
    """One scan over all rounds chooses what fitting, truncating and scoring for each number of trees would."""
    train, valid = rows.where("us < 1000000"), rows.where("us >= 1000000")
    spec = ml.Spec(kind, rounds=6, depth=3, rate=0.5, stop="precision")
    fitted = ml.fit(train, ["x", "y", "kind"], spec, valid=valid)
    full = ml.fit(train, ["x", "y", "kind"], spec)
    trees = full.model if isinstance(full.model, ml.Boosted) else ml.Boosted(list(full.model.trees), list(full.model.treeWeights))
    truth, by = valid.select("transaction_id", "label"), {}
    for k in range(1, 7):
        some = ml.Fitted(full.columns, full.inputs, ml.Boosted(trees.trees[:k], trees.weights[:k]), spec)
        by[k] = ap(truth.join(some.score(valid), "transaction_id"))
    assert fitted.rounds == max(by, key=lambda k: (by[k], -k))
    got = ap(truth.join(fitted.score(valid), "transaction_id"))
    assert got == pytest.approx(max(by.values()), abs=1e-9) and got > 2 * valid.agg(F.avg("label")).first()[0]
    if kind == "gbt":  # staged margins end where the library's own scores do
        whole = ml.Fitted(full.columns, full.inputs, trees, spec).score(valid)
        both = whole.join(full.score(valid).withColumnRenamed("score", "own"), "transaction_id")
        assert both.agg(F.max(F.abs(F.col("score") - F.col("own")))).first()[0] < 1e-9


def test_dropped_trees_keep_the_sum_of_weights(spark):
    held = spark.range(200).select(array_to_vector(F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double"))).alias("features"), (F.col("id") % 2).cast("double").alias("_y"), F.col("id").alias("_key"))
    model = ml.boosted(held, ml.Spec("dart", rounds=5, depth=2, rate=0.4, drop=1.0))
    assert model.weights == pytest.approx([0.4 / 5] * 5)  # every round makes room for the new tree
    assert ml.boosted(held, ml.Spec("dart", rounds=3, depth=2, rate=0.4, drop=0.0)).weights == [0.4] * 3


def test_windows_over_an_entity_store_need_no_exchange(spark):
    name = f"store_{uuid.uuid4().hex}"
    rows = [(i, i * DAY // 7, f"c{i % 5}", float(i % 13)) for i in range(100)]
    df = spark.createDataFrame(rows, "transaction_id long, us long, customer_id string, amount double")
    save_by_entity(df, name, "customer_id", 4)
    held = read_by_entity(spark, name)
    windows = add(held, expanding("customer_id", "c"))
    assert "Exchange" not in windows._jdf.queryExecution().executedPlan().toString()
    day = 3 * DAY
    replace_days(df.where((F.col("us") >= day) & (F.col("us") < day + DAY)).withColumn("amount", F.lit(100.0)), name, "customer_id", 4)
    got = {r.transaction_id: (r.amount, r.c_amt_sum_prior) for r in add(read_by_entity(spark, name), expanding("customer_id", "c")).collect()}
    now = {i: 100.0 if day <= us < day + DAY else x for i, us, _, x in rows}
    assert got == {i: (now[i], sum(now[j] for j, u, e, _ in rows if e == c and u < us)) for i, us, c, _ in rows}
    pruned = held.where(F.col("event_date") == F.lit("1970-01-04").cast("date"))
    assert "PartitionFilters: [isnotnull(event_date" in pruned._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["goss", "dart"])
def test_rounds_write_no_table_each(rows, kind, monkeypatch):
    """The features were written anew in every round; now only after WRITTEN rounds, with the same trees."""
    held, made, spec = ml.matrix_rows(rows, ["x", "y", "kind"], ml.Spec()).rows, [], ml.Spec(kind, rounds=5, depth=2, rate=0.4, drop=0.5)
    keep = ml.stored
    monkeypatch.setattr(ml, "stored", lambda df, name: made.append(name) or keep(df, name))
    whole = ml.boosted(held, spec)
    assert not made
    monkeypatch.setattr(ml, "WRITTEN", 2)
    parts = ml.boosted(held, spec)
    assert made == ["boost", "boost"] and parts.weights == whole.weights
    assert [t.toDebugString.split("\n", 1)[1] for t in parts.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees]


def test_arms_that_code_inputs_alike_share_a_matrix(rows, monkeypatch):
    """A matrix was written for each arm."""
    made, keep = [], ml.matrix_rows
    monkeypatch.setattr(ml, "matrix_rows", lambda *a, **k: made.append(1) or keep(*a, **k))
    fold = ml.Fold("late", 1_000_000, 2_000_000)
    arms = {"flat": ml.Spec(rounds=2, depth=2), "deep": ml.Spec(rounds=2, depth=3), "line": ml.Spec("linear", rounds=5), "weighted": ml.Spec("linear", rounds=5, weight="y")}
    held = rows.withColumn("y", F.lit(2.0))
    got = {r.arm: r.metric for r in ml.grid(held, [fold], ["x"], arms).collect()}
    assert len(made) == 2
    alone = {a: ap(fold.validate(held).select("transaction_id", "label").join(ml.fit(fold.train(held), ["x"], s).score(fold.validate(held)), "transaction_id")) for a, s in arms.items()}
    assert got == pytest.approx(alone)
