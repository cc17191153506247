"""Feature tables and matrices of many columns: exchanges, flags that say nothing, methods that the JVM compiles."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from lagline.functions.scalar import HOUR
from lagline.operators import models as ml
from lagline.operators.history import add, expanding, gaps, pair_novelty
from lagline.operators.ranges import recent, trailing_ladder
from lagline.queries import models as q
from lagline.queries.base import events_fact
from lagline.sources.scratch import METHODS

D = "/root/testdata/sf0.001"


def test_features_take_one_exchange_an_entity(spark):
    """Six exchanges before, one for each change of the entity; columns and values stay."""
    got = q.featured(spark, D)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    fact = events_fact(spark, D)
    want = add(fact, expanding("customer_id", "cust"), expanding("device_id", "dev"), gaps("customer_id", "cust"), pair_novelty("customer_id", "device_id", "device"), trailing_ladder("device_id", "dev", [HOUR, 24 * HOUR]), recent("customer_id", "cust", [12 * HOUR]))
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i * 7 % 13), None if i % 5 == 0 else float(i * 3 % 11), float(i % 3), int(i * 7 % 13 > 6)) for i in range(200)]
    return spark.createDataFrame(data, "transaction_id long, a double, b double, c double, label int").repartition(2).cache()


def test_flags_of_whole_columns_are_left_out(rows):
    """Each column had a flag; the places left have the values that they had."""
    for spec in (ml.Spec(), ml.Spec("mlp")):
        inputs = ml.fit_inputs(rows, rows, ["a", "b", "c"], spec)
        assert inputs.live() == [True, True, True, False, True, False]
        got = {r.transaction_id: r.features.toArray() for r in inputs.transform(rows, ["a", "b", "c"], 1.0).collect()}
        held = {r.transaction_id: [r.a, r.b, r.c, float(r.b is None)] for r in rows.collect()}
        middle = rows.approxQuantile("b", [0.5], 0.001)[0]
        table = np.array([[middle if x is None else x for x in v] for _, v in sorted(held.items())])
        if not spec.trees:
            table = np.clip((table - table.mean(0)) / table.std(0, ddof=1), -1, 1)
        assert np.allclose(table, [v for _, v in sorted(got.items())])


def test_network_is_that_over_all_places(spark, rows):
    """Left-out places are 0 in all rows: the network with them learns the same from the weights that it draws."""
    spec = ml.Spec("mlp", rounds=8, hidden=(3,))
    fitted = ml.fit(rows, ["a", "b", "c"], spec)
    assert fitted.model.getLayers() == [4, 3, 2]
    held = fitted.inputs.transform(rows, ["a", "b", "c"], spec.clip)
    x = ml.vector_to_array("features")
    wide = held.select("transaction_id", F.col("label").cast("double").alias("label"), ml.array_to_vector(F.array(x[0], x[1], x[2], F.lit(0.0), x[3], F.lit(0.0))).alias("features"))
    model = MultilayerPerceptronClassifier(maxIter=8, layers=[6, 3, 2], seed=spec.seed).fit(wide)
    want = {r.transaction_id: r.score for r in model.transform(wide).select("transaction_id", ml.vector_to_array("probability")[1].alias("score")).collect()}
    assert {r.transaction_id: r.score for r in fitted.score(rows).collect()} == pytest.approx(want, abs=1e-6)


def test_matrix_is_written_by_compiled_methods(spark, rows, monkeypatch):
    seen, keep, before = [], ml.stored, spark.conf.get(METHODS)
    monkeypatch.setattr(ml, "stored", lambda df, name: seen.append(int(spark.conf.get(METHODS))) or keep(df, name))
    ml.matrix_rows(rows, ["a", "b"], ml.Spec())
    assert seen == [8000] and spark.conf.get(METHODS) == before


def test_scores_of_a_stack_are_written_by_compiled_methods(spark, rows, monkeypatch):
    """Out-of-fold scores were worked out inside the neighbourhood's joins, by interpreted methods."""
    seen, keep, none = [], ml.stored, rows.sparkSession.createDataFrame([], "transaction_id long, fold string, score double")
    monkeypatch.setattr(ml, "out_of_fold", lambda *a: none)
    monkeypatch.setattr(ml, "stored", lambda df, name: seen.append((name, df.columns, int(spark.conf.get(METHODS)))) or keep(df, name))
    monkeypatch.setattr(ml, "neighbourhood", lambda df, scores, *a: scores.withColumn("label", F.lit(0)))

    class Scores:
        def score(self, rows):
            return none.select("transaction_id", "score")

    monkeypatch.setattr(ml, "fit", lambda *a, **k: Scores())
    last = ml.Fold("last", 0, 1)
    ml.stacked(rows.withColumn("us", F.col("transaction_id")), [last], last, ["a"], {}, HOUR)
    assert seen[:2] == [("stack", none.columns, 8000), ("stack", ["transaction_id", "score"], 8000)]
