"""Scores of a model are rows of a table, whatever the model reads."""

from pyspark.sql import functions as F

from lagline.operators import models as ml
from lagline.operators.metrics import average_precision


def test_filters_on_scores_are_not_planned_over_a_models_columns(spark):
    """All metrics drop rows without a score; pushed below the model, such a filter held every column twice over and took the driver's memory."""
    rows = spark.range(80).select(F.col("id").alias("transaction_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), *[F.when(F.col("id") % 7 != 0, F.rand(k)).alias(f"x{k}") for k in range(4)])
    columns = [f"x{k}" for k in range(4)]
    for kind in ("linear", "gbt", "dart"):
        scores = ml.fit(rows, columns, ml.Spec(kind, rounds=2, depth=2)).score(rows)
        plan = scores.where("score is not null")._jdf.queryExecution().optimizedPlan().toString()
        assert "x0" not in plan and "UDF" not in plan and scores.columns == ["transaction_id", "score"]
        assert average_precision(rows.join(scores, "transaction_id")).first().n == 80
