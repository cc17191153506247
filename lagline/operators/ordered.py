"""Running sums, places and quantiles over an order, without sorting a table in one task.

Rows are cut into ranges of the order by Spark's range partitioning, as many as the
session has shuffle partitions, and written once with the number of their range.
Sums run inside a range, which is a window partition of its own, and the ranges'
totals, one row each, are summed up and joined back. How rows fall into ranges only
decides how even the work is, never a result; a value that a third of the rows have
is counted into one row by the callers before it gets here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dbl
from ..sources.scratch import stored


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """df, written once, with _range: numbers of contiguous ranges of (by, order), in that order."""
    lead = F.col(order[0]).desc() if descending else F.col(order[0]).asc()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *by, lead, *order[1:]).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str], descending: bool = False) -> DataFrame:
    """Adds the sums (new name: column) over all rows of `by` that stand before a row in the order; descending turns the first column of the order."""
    lead = order[0]
    held = in_ranges(df, by, order, descending)
    way = F.desc if descending else F.asc
    inside = Window.partitionBy(*by, "_range").orderBy(way(lead), *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    ranges = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t_{n}").over(ranges), F.lit(0)).alias(f"_b_{n}") for n in sums])
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)], F.col("_range") == F.col("_r"))
    if not by:
        before = F.broadcast(before)  # a row a range
    out = held.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()]).join(before, same)
    return out.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by, n (rows with a value) and quantiles, an array as long as shares: exact, linear between neighbours.

    Different values are counted first; where a wanted place falls follows from running counts. A few rows a group come together.
    """
    points = df.where(F.col(value).isNotNull()).groupBy(*by, dbl(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    below = running(points, by, ["_v"], {"_below": "_n"})
    whole = below.groupBy(*by).agg(F.sum("_n").alias("n")).select(*[F.col(b).alias(f"_q{i}") for i, b in enumerate(by)], "n")
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_q{i}")) for i, b in enumerate(by)], F.lit(True))
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1).cast("double")
    ends = [F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), f(place(q)).cast("long").alias("at"), place(q).alias("place")) for k, q in enumerate(shares) for s, f in enumerate((F.floor, F.ceil))]
    rows = below.join(whole, same) if by else below.join(F.broadcast(whole), same)
    hit = F.explode(F.filter(F.array(*ends), lambda e: (e["at"] >= F.col("_below")) & (e["at"] < F.col("_below") + F.col("_n"))))
    found = rows.select(*by, "n", "_v", hit.alias("e")).groupBy(*by, "n", "e.k").agg(F.max("e.place").alias("place"), *[F.max(F.when(F.col("e.s") == s, F.col("_v"))).alias(c) for s, c in enumerate(("low", "high"))])
    under = F.floor("place")
    exact = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((under + 1 - F.col("place")) * F.col("low") + (F.col("place") - under) * F.col("high"))
    return found.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", exact.alias("v")))), lambda x: x["v"]).alias("quantiles"))


def quantile_values(df: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """The quantiles of a whole column, as numbers."""
    row = quantiles(df.select(value), [], value, shares).first()
    return list(row.quantiles) if row else [None] * len(shares)


def placed(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds the row's place in its group in the given order, gapless from 0; written once to the shared folder.

    No group is one task's: rows are cut into ranges of (groups, order, a number of the row's own), numbered as they are
    sorted inside their range, and a table of one row a group and range tells where the group's part of a range begins.
    Rows equal in groups and order are placed as they come.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *groups, *order, "_tie").sortWithinPartitions(*groups, *order, "_tie")
    held = stored(cut.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "placed")  # range << 33 | place in the range
    part = F.shiftright("_at", 33)
    parts = held.groupBy(*groups, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], part == F.col("_part"))
    return held.join(before, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
