"""Checks of tables before they are used or handed over; each is one pass that counts violations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frames import ID, US, ordered
from .evaluate import ROLES


class GuardError(AssertionError):
    pass


def frame_violations(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Counts: rows, null keys, amounts not above 0, and (us, transaction_id) keys that repeat."""
    keys = df.groupBy(US, ID).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(amount) <= 0).alias("low"))
    null = F.col(US).isNull() | F.col(ID).isNull()
    return keys.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"), F.sum("low").alias("low_amounts"), F.count_if(F.col("n") > 1).alias("repeated_keys"))


def check_frame(df: DataFrame, amount: str = "amount") -> None:
    bad = {k: v for k, v in frame_violations(df, amount).first().asDict().items() if k != "n_rows" and v}
    if bad:
        raise GuardError(f"fact table: {bad}")


def first_row_violations(df: DataFrame, entity: str, empty: str, new: str) -> DataFrame:
    """An entity's first row must have a null history mean and a new pair."""
    first = df.withColumn("_n", F.row_number().over(ordered(entity))).where("_n = 1")
    return first.agg(F.count(F.lit(1)).alias("first_rows"), F.count_if(F.col(empty).isNotNull()).alias("not_empty"), F.count_if(F.col(new) != 1).alias("not_new"))


def check_model_columns(columns: Iterable[str]) -> None:
    bad = sorted(ROLES.intersection(columns))
    if bad:
        raise GuardError(f"ids, times and labels are not model inputs: {bad}")


def score_violations(scores: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows missing, extra, null, out of range, and whether all scores are 0 or 1."""
    both = sample.select(F.col(ID).alias("_s")).join(scores.select(ID, "score"), F.col("_s") == F.col(ID), "full")
    s = F.col("score")
    return both.agg(
        F.count_if(F.col(ID).isNull()).alias("missing"),
        F.count_if(F.col("_s").isNull()).alias("extra"),
        F.count_if(F.col(ID).isNotNull() & (s.isNull() | F.isnan(s))).alias("empty"),
        F.count_if((s < 0) | (s > 1)).alias("outside"),
        (F.count_if(~s.isin(0.0, 1.0)) == 0).alias("hard"),
    )


def frozen_encodings(df: DataFrame, entity: str, column: str, label: str = "label") -> DataFrame:
    """Entities whose encoding changes over rows without a label: there must be none."""
    still = df.where(F.col(label).isNull()).groupBy(entity).agg(F.count_distinct(column).alias("values"))
    return still.agg(F.count_if(F.col("values") > 1).alias("changing"), F.count(F.lit(1)).alias("entities"))


