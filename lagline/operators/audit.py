"""Rule audits, lifts, clustering, coverage and acceptance over results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dbl
from ..plans.frames import US


def month(us: str = US) -> Column:
    return F.date_format(F.timestamp_micros(F.col(us)), "yyyy-MM")


def ratio(a: Column, b: Column) -> Column:
    return dbl(a) / F.nullif(dbl(b), F.lit(0.0))


def rule_decay(df: DataFrame, rules: Mapping[str, Column], label: str = "label") -> DataFrame:
    """Per month and rule: rows it fires on, label rate there, lift over the month's rate, coverage and recall."""
    flags = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("hit")) for n, c in rules.items()])
    long = df.select(month().alias("month"), F.col(label).cast("long").alias("y"), F.explode(flags).alias("x")).select("month", "y", "x.rule", F.col("x.hit").cast("long").alias("hit"))
    g = long.groupBy("month", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.sum("hit").alias("hits"), F.sum(F.col("hit") * F.col("y")).alias("both"))
    rate = ratio(F.col("both"), F.col("hits"))
    return g.select("month", "rule", "n", "hits", rate.alias("rate"), (rate / F.nullif(ratio(F.col("pos"), F.col("n")), F.lit(0.0))).alias("lift"), ratio(F.col("hits"), F.col("n")).alias("coverage"), ratio(F.col("both"), F.col("pos")).alias("recall"))


def category_shift(df: DataFrame, column: str, early: Column, late: Column, label: str = "label", least_rows: int = 200, least_positives: int = 15) -> DataFrame:
    """Label rate of each value in two periods, for values with enough rows in both; flagged where positives are enough to trust."""
    y = F.col(label).cast("long")
    g = df.where(early | late).groupBy(F.col(column).alias("value")).agg(*(f.alias(n) for n, f in (("n_early", F.count_if(early)), ("n_late", F.count_if(late)), ("pos_early", F.sum(F.when(early, y).otherwise(0))), ("pos_late", F.sum(F.when(late, y).otherwise(0))))))
    g = g.where((F.col("n_early") >= least_rows) & (F.col("n_late") >= least_rows))
    a, b = ratio(F.col("pos_early"), F.col("n_early")), ratio(F.col("pos_late"), F.col("n_late"))
    return g.select("value", "n_early", "n_late", a.alias("rate_early"), b.alias("rate_late"), (b - a).alias("delta"), (F.col("pos_late") >= least_positives).alias("trusted"))


def label_clustering(df: DataFrame, entity: str, label: str = "label") -> DataFrame:
    """Pairs of rows of one entity: the chance that both are positive, that the other is given that one is, and its lift over the rate of all labelled rows."""
    g = df.where(F.col(label).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("k"))
    several = lambda c: F.sum(F.when(F.col("n") > 1, c))
    s = g.agg(several(F.col("k") * (F.col("k") - 1)).alias("both"), several(F.col("n") * (F.col("n") - 1)).alias("pairs"), several(F.col("k") * (F.col("n") - 1)).alias("given"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    conditional, base = ratio(F.col("both"), F.col("given")), ratio(F.col("k"), F.col("n"))
    return s.select(F.lit(entity).alias("entity"), ratio(F.col("both"), F.col("pairs")).alias("p_joint"), conditional.alias("p_given"), base.alias("p_base"), (conditional / F.nullif(base, F.lit(0.0))).alias("lift"))


def distinct_by_group(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows, and distinct values of a column, of each group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(column).alias("n_distinct"))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of groups, mean rows of a group, share of groups with a single row."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), ratio(F.sum("n"), F.count(F.lit(1))).alias("mean_rows"), ratio(F.count_if(F.col("n") == 1), F.count(F.lit(1))).alias("single_share"))


def sibling_coverage(df: DataFrame, entity: str, block_us: int) -> DataFrame:
    """Share of rows with another row of the entity in the same block of time."""
    g = df.groupBy(entity, F.floor(F.col(US) / F.lit(block_us)).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(ratio(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.sum("n")).alias("coverage"))


def fold_summary(results: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Mean, population standard deviation, least and greatest value of a metric."""
    m = F.col(metric)
    return results.groupBy(*by).agg(F.round(F.avg(m), 9).alias("mean"), F.round(F.stddev_pop(m), 9).alias("std"), F.min(m).alias("least"), F.max(m).alias("greatest"))


def acceptance(results: DataFrame, baseline: str, least_mean: float = 0.004, least_up: int = 2, least_delta: float = -0.003) -> DataFrame:
    """arm, window, metric rows: an arm is accepted for a mean gain, enough windows up and no window much worse."""
    base = results.where(F.col("arm") == baseline).select("window", F.col("metric").alias("_base"))
    delta = results.where(F.col("arm") != baseline).join(base, "window").withColumn("delta", F.round(F.col("metric") - F.col("_base"), 9).cast("decimal(20,9)"))
    g = delta.groupBy("arm").agg(F.round(dbl(F.sum("delta")) / F.count(F.lit(1)), 9).alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("windows_up"), dbl(F.min("delta")).alias("worst"))
    return g.withColumn("accepted", (F.col("mean_delta") >= least_mean) & (F.col("windows_up") >= least_up) & (F.col("worst") >= least_delta))


def importance_shares(importance: DataFrame) -> DataFrame:
    """feature, gain: share of the whole gain and rank."""
    whole = Window.partitionBy(F.lit(0))  # one row a feature
    return importance.select("feature", ratio(F.col("gain"), F.sum("gain").over(whole)).alias("share"), F.row_number().over(whole.orderBy(F.desc("gain"), "feature")).alias("rank"))
