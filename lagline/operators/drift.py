"""Distribution shift: time-local percentiles, population stability, ranks and correlation of ranks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAY, dbl
from ..plans.frames import ID, US
from ..sources.scratch import stored
from .ordered import in_ranges, quantile_values, quantiles, running
from .sorted_groups import count_below, group_starts, whole_groups


def local_percentile(df: DataFrame, value: str, name: str, days: int = 14) -> DataFrame:
    """Share of the values of the previous `days` observed days that are strictly below this one.

    Days are counted as they occur, not by the calendar; the first day and null values give null. Each distinct value of a
    day is one weighted point. "Smaller and of the last days" is dominance in two dimensions: points are cut into ranges of
    values, and a range gets one row a day that stands for all smaller ranges. So a point is written once, whatever `days`
    is, and neither a day nor a value that many rows have is one task's work.
    """
    day = F.floor(F.col(US) / F.lit(DAY))
    observed = df.select(day.alias("_day")).distinct()
    numbered = observed.withColumn("_d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_day")))  # one row a day
    held = df.withColumn("_day", day).join(numbered, "_day").select(F.col(ID).alias("_id"), dbl(value).alias("_v"), "_d")
    # rows without a value can neither have a percentile nor be a reference
    points = in_ranges(held.where("_v is not null").groupBy("_d", "_v").agg(F.count(F.lit(1)).alias("_w")), [], ["_v"])  # equal values share a range
    totals = points.groupBy("_range", "_d").agg(F.sum("_w").alias("_w"))
    ranges = points.select("_range").distinct()
    each = totals.groupBy("_d").agg(F.sum("_w").alias("_all"))
    grid = ranges.join(F.broadcast(each.select("_d")), F.lit(True)).join(totals, ["_range", "_d"], "left")  # a row a range and day
    before = Window.partitionBy("_d").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = grid.select("_range", "_d", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w"), F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_head"))

    def answer(rows: pa.Table, group: np.ndarray) -> pa.Table:
        code = rows.column("_d").to_numpy().astype(np.int64)
        weight, head = rows.column("_w").to_numpy(), rows.column("_head").to_numpy(zero_copy_only=False).astype(bool)
        v = rows.column("_v").to_numpy(zero_copy_only=False)
        start = group_starts(group)
        same = np.concatenate(([False], (v[1:] == v[:-1]) & (start[1:] == start[:-1])))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(v))))  # the first row of the value
        below = [count_below(code, start, first, np.maximum(c, 0), weight) for c in (code - days, code)]
        return rows.append_column("_below", pa.array(below[1] - below[0])).filter(pa.array(~head)).select(["_d", "_v", "_below"])

    rows = points.withColumn("_head", F.lit(False)).unionByName(heads)
    below = whole_groups(rows, ["_range"], [F.desc("_head"), "_v", "_d"], answer, "_d int, _v double, _below long")
    last = Window.partitionBy(F.lit(0)).orderBy("_d").rowsBetween(-days, -1)  # one row a day
    below = below.join(F.broadcast(each.select("_d", F.sum("_all").over(last).alias("_all"))), "_d")
    shares = held.join(below, ["_d", "_v"]).select("_id", (dbl("_below") / F.nullif(dbl("_all"), F.lit(0.0))).alias(name))
    return df.join(shares, F.col(ID) == F.col("_id"), "left").drop("_id")


def _edges(values: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    found = quantiles(values, [key], value, [k / bins for k in range(bins + 1)])
    return found.select(key, F.array_distinct("quantiles").alias("edges"), "n")


def stability_index(early: DataFrame, late: DataFrame, columns: Sequence[str], bins: int = 10, open_ends: bool = True) -> DataFrame:
    """Population stability index of each column between two windows, one pass over each.

    Bins are quantiles of the early window. open_ends: outer bins reach to
    infinity, fewer than 100 rows on a side give 0. Otherwise values outside the
    early range are left out and fewer than 10 rows give null. Shares are at least 1e-6.
    """
    long = lambda d: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), dbl(c).alias("v")) for c in columns])).alias("x")).select("x.feature", "x.v").where("v is not null")
    least, other = (100, F.lit(0.0)) if open_ends else (10, F.lit(None).cast("double"))
    a, b = long(early), long(late)
    edges = stored(_edges(a, "feature", "v", bins), "edges")  # one row a column
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    bin_ = F.size(F.filter(inner, lambda e: e <= F.col("v")))
    top = F.element_at("edges", -1)

    def counted(d: DataFrame, name: str) -> DataFrame:
        held = d.join(F.broadcast(edges.select("feature", "edges")), "feature")
        if not open_ends:
            held = held.where((F.col("v") >= F.element_at("edges", 1)) & (F.col("v") <= top))
        return held.groupBy("feature", bin_.alias("bin")).agg(F.count(F.lit(1)).alias(name))

    places = edges.select("feature", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"), F.size("edges").alias("n_edges"))
    both = places.join(counted(a, "p"), ["feature", "bin"], "left").join(counted(b, "q"), ["feature", "bin"], "left").na.fill(0, ["p", "q"])
    by = Window.partitionBy("feature")
    both = both.withColumn("np", F.sum("p").over(by)).withColumn("nq", F.sum("q").over(by))
    share = lambda x, n: F.greatest(dbl(x) / F.nullif(dbl(n), F.lit(0.0)), F.lit(1e-6))
    p, q = share("p", "np"), share("q", "nq")
    term = F.round((q - p) * F.ln(q / p), 12).cast("decimal(30,12)")
    out = both.groupBy("feature").agg(F.sum(term).alias("psi"), F.first("np").alias("n_early"), F.first("nq").alias("n_late"))
    enough = (F.col("n_early") >= least) & (F.col("n_late") >= least)
    return out.select("feature", "n_early", "n_late", F.when(enough, dbl("psi")).otherwise(other).alias("psi"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average-tie percent rank over the table: (rows below + (ties + 1) / 2) / rows, from counts of distinct values.

    Distinct values are counted first and summed up in ranges, so the table is never
    one sorted partition.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(dbl(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"))
    ranks = running(counts, [], ["_v"], {"_before": "_n"}).join(F.broadcast(whole), F.lit(True))  # one row
    share = (dbl("_before") + (dbl("_n") + 1) / 2) / dbl("_all")
    return df.join(ranks.select("_v", share.alias(name)), dbl(value) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns, over rows that have both."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.round(F.corr("_ra", "_rb"), 9).alias("spearman"), F.count(F.lit(1)).alias("n"))


def quantile_cut(df: DataFrame, value: str, share: float) -> float | None:
    """The exact quantile of a column, as a number."""
    return quantile_values(df, value, [share])[0]
