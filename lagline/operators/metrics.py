"""Rank metrics over scored rows. All are groupings: no score list is collected."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dbl
from ..plans.frames import ID
from .ordered import quantiles, running


def _steps(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row a distinct score: _s, _n rows, _p positives. Rows without a label or score count nowhere."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*by, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision, ties of a score taken together; null without positives. One row a group of `by`. Reads df more than once."""
    steps = _steps(df, score, label, by)
    curve = running(steps, by, ["_s"], {"_tp": "_p", "_seen": "_n"}, descending=True)
    # sums of p / seen * tp as decimals of rounded terms: the same whatever the order
    tp, seen = F.col("_tp") + F.col("_p"), F.col("_seen") + F.col("_n")
    whole = steps.groupBy(*by).agg(F.sum("_p").alias("_all"))
    if by:
        whole = whole.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(by)], "_all")
        curve = curve.join(whole, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(by)]))
    else:
        curve = curve.join(F.broadcast(whole), F.lit(True))  # one row
    term = F.round(dbl("_p") / F.nullif(dbl("_all"), F.lit(0.0)) * dbl(tp) / dbl(seen), 12).cast("decimal(30,12)")
    return curve.groupBy(*by).agg(dbl(F.sum(term)).alias("ap"), F.sum("_n").alias("n"), F.sum("_p").alias("positives"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    steps = _steps(df, score, label).withColumn("_m", F.col("_n") - F.col("_p"))
    held = running(steps, [], ["_s"], {"_below": "_m"})
    pairs = held.select("_p", "_m", (F.col("_p").cast("decimal(19,0)") * (2 * F.col("_below") + F.col("_m")).cast("decimal(19,0)")).cast("decimal(38,0)").alias("_twice"))
    out = pairs.agg(F.sum("_twice").alias("t"), F.sum("_p").alias("p"), F.sum("_m").alias("m"))
    return out.select((dbl("t") / F.nullif(2.0 * dbl("p") * dbl("m"), F.lit(0.0))).alias("auc"), F.col("p").alias("positives"), F.col("m").alias("negatives"))


def at_fractions(df: DataFrame, fractions: Sequence[float], score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall among the k = max(1, round-half-even(n * f)) best rows; ties by id.

    The best rows are not gathered: the score at which each cut falls comes from running counts of distinct scores, and
    only the rows of that score are ordered by id, in ranges.
    """
    steps = _steps(df, score, label)
    n, positives = steps.agg(F.sum("_n"), F.sum("_p")).first()
    ks = {f: max(1, round((n or 0) * f)) for f in fractions}
    curve = running(steps, [], ["_s"], {"_tp": "_p", "_seen": "_n"}, descending=True)
    cut = lambda k: (F.col("_seen") < k) & (F.col("_seen") + F.col("_n") >= k)
    found = curve.where(reduce(Column.__or__, [cut(k) for k in ks.values()])).collect()  # a row a fraction at most
    rows = []
    for f, k in ks.items():
        at = next((r for r in found if r["_seen"] < k <= r["_seen"] + r["_n"]), None)
        if at is None:  # fewer rows than k
            hits = positives or 0
        elif at["_p"] in (0, at["_n"]) or k == at["_seen"] + at["_n"]:
            hits = at["_tp"] + min(at["_p"], k - at["_seen"])
        else:
            tied = df.where((F.col(score) == F.lit(at["_s"])) & F.col(label).isNotNull()).select(ID, F.col(label).cast("long").alias("_y"), F.lit(1).cast("long").alias("_one"))
            first = running(tied, [], [ID], {"_before": "_one"}).where(F.col("_before") < k - at["_seen"])
            hits = at["_tp"] + first.agg(F.coalesce(F.sum("_y"), F.lit(0))).first()[0]
        rows.append((f, k, hits, hits / k, hits / positives if positives else None))
    return df.sparkSession.createDataFrame(rows, "fraction double, k long, hits long, precision double, recall double")


def split_precision(df: DataFrame, flag: Column, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision apart for rows with and without the flag (for example: has a history)."""
    return average_precision(df.withColumn("part", flag), score, label, ["part"])


def univariate(df: DataFrame, columns: Sequence[str], period: str, label: str = "label", missing: str = "median") -> DataFrame:
    """Average precision of each column alone, in both directions, per period.

    missing: nulls take the column's median over the table ("median") or 0 ("zero").
    A column that is constant in a period gets null.
    """
    if missing == "median":
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), dbl(c).alias("v")) for c in columns])).alias("x")
        found = quantiles(df.select(each).select("x.feature", "x.v"), ["feature"], "v", [0.5]).collect()  # a row a column
        fill = dict.fromkeys(columns) | {r.feature: r.quantiles[0] for r in found}
    else:
        fill = dict.fromkeys(columns, 0.0)
    values = [F.struct(F.lit(c).alias("feature"), F.coalesce(dbl(c), F.lit(fill[c]).cast("double")).alias("v")) for c in columns]
    long = df.select(period, label, F.explode(F.array(*values)).alias("x")).select(period, label, "x.feature", "x.v")
    signed = long.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("score", F.col("v") * F.col("sign"))
    spread = long.groupBy(period, "feature").agg((F.min("v") < F.max("v")).alias("varies"))
    ap = average_precision(signed, "score", label, [period, "feature", "sign"])
    return ap.join(spread, [period, "feature"]).select(period, "feature", "sign", F.when(F.col("varies"), F.col("ap")).alias("ap"), "positives")


def decays(first: Column, last: Column, margin: float = 0.02) -> Column:
    return last < first - F.lit(margin)
