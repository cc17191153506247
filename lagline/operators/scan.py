"""What a key's earlier rows add up to, for keys of any size: segmented scans over blocks of rows.

A window partitioned by a key is one task's, so a key with a third of the rows
(a busy counterparty, a category, all rows) would be too. Here all rows are
numbered by (us, transaction_id) and cut into blocks of equally many rows, and
windows run inside (block, value), for all keys behind one exchange by block. What
earlier blocks add up to enters as a row at the head of each block that has the
value, with the state in the place of a row's values; so the same window functions
continue it. Any state that can be put together from parts will do: counts, sums,
greatest and least values, the last two times. How many rows a block holds follows
from the number of rows, never from the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import text_or
from ..plans.frames import ID, US, ordered, prior, rank_before
from .ordered import placed

#: Rows of a block: enough to be worth a task, few enough for its memory.
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 18


@dataclass(frozen=True)
class State:
    """n: rows; sum, max, min: of a column; last: the time of the last row and of the one before."""

    how: str
    column: str = ""

    @property
    def name(self) -> str:
        return f"{self.how}_{self.column.strip('_')}" if self.column else self.how


N, LAST = State("n"), State("last")


class Prior:
    """What an entity's earlier rows add up to, by window functions."""

    def __init__(self, *entity: str) -> None:
        self.entity = entity

    def count(self) -> Column:
        return rank_before(*self.entity)

    def sum(self, c: str) -> Column:
        return F.sum(c).over(prior(*self.entity))

    def max(self, c: str) -> Column:
        return F.max(c).over(prior(*self.entity))

    def min(self, c: str) -> Column:
        return F.min(c).over(prior(*self.entity))

    def last(self, k: int) -> Column:
        return F.lag(US, k).over(ordered(*self.entity))


class Scanned(Prior):
    """The same, from the columns that prior_states() adds for a key."""

    def __init__(self, key: str) -> None:
        self.key = key

    def held(self, how: str, c: str = "") -> Column:
        return F.col(f"_{self.key}_{State(how, c).name}")

    def count(self) -> Column:
        return self.held("n")

    def sum(self, c: str) -> Column:
        return self.held("sum", c)

    def max(self, c: str) -> Column:
        return self.held("max", c)

    def min(self, c: str) -> Column:
        return self.held("min", c)

    def last(self, k: int) -> Column:
        return F.col(f"_{self.key}_last_{k}")


def text_key(*columns: str) -> Column:
    """One text for the columns' values; nulls are values, no columns are one value."""
    return F.to_json(F.struct(*columns)) if columns else F.lit("")


def prior_states(df: DataFrame, keys: Mapping[str, tuple[Column, Sequence[State]]], block_rows: int | None = None) -> DataFrame:
    """keys: name -> (text, never null; states). Adds _{key}_{state} of the rows before this one that have its value: 0 rows, else null, where there are none."""
    states = list(dict.fromkeys(s for _, wanted in keys.values() for s in wanted))
    value = {s: F.lit(1).cast("long") if s == N else F.col(s.column) for s in states if s != LAST}
    held = placed(df.withColumns({f"_v_{k}": v for k, (v, _) in keys.items()} | {f"_s_{s.name}": v for s, v in value.items()}), [], [US, ID], "_place")
    if block_rows is None:
        n = held.count()  # of a written table
        block_rows = max(LEAST_ROWS, min(MOST_ROWS, -(-n // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    rows = held.withColumns({"_b": F.floor(F.col("_place") / block_rows), "_head": F.lit(0)}).drop("_place")

    names = [f"_s_{s.name}" for s in value]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_v_{k}").alias("v")) for k in keys]))
    long = rows.select("_b", US, *names, each.alias("x")).select("_b", US, *names, "x.k", "x.v")
    join = {"n": F.sum, "sum": F.sum, "max": F.max, "min": F.min}
    parts = [join[s.how](f"_s_{s.name}").alias(f"_s_{s.name}") for s in value]
    if LAST in states:
        parts.append(F.slice(F.reverse(F.array_sort(F.collect_list(US))), 1, 2).alias("_recent"))  # a block's rows at most
    totals = long.groupBy("k", "v", "_b").agg(F.count(F.lit(1)).alias("_rows"), *parts)
    by_block = Window.partitionBy("k", "v").orderBy("_b")  # a row a block
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carried = [join[s.how](f"_s_{s.name}").over(before).alias(f"_s_{s.name}") for s in value]
    none = F.array().cast("array<long>")
    if LAST in states:
        carried.append(F.slice(F.concat(*[F.coalesce(F.lag("_recent", j).over(by_block), none) for j in (1, 2)]), 1, 2).alias("_recent"))
    heads = totals.select("k", "v", "_b", F.sum("_rows").over(before).alias("_rows"), *carried).where("_rows is not null")
    own = [F.when(F.col("k") == k, F.col("v")).alias(f"_v_{k}") for k in keys]
    newest = F.element_at("_recent", 1) if LAST in states else F.lit(None).cast("long")
    first = heads.select("_b", F.lit(1).alias("_head"), newest.alias(US), *own, *names)
    rows = rows.unionByName(first, allowMissingColumns=True)
    if LAST in states:
        rows = rows.unionByName(heads.where(F.size("_recent") > 1).select("_b", F.lit(2).alias("_head"), F.element_at("_recent", 2).alias(US), *own), allowMissingColumns=True)

    out = {}
    for k, (_, wanted) in keys.items():
        w = Window.partitionBy("_b", f"_v_{k}").orderBy(F.desc("_head"), US, ID)
        frame = w.rowsBetween(Window.unboundedPreceding, -1)
        for s in wanted:
            if s == LAST:
                out |= {f"_{k}_last_{j}": F.lag(US, j).over(w) for j in (1, 2)}
            else:
                c = join[s.how](f"_s_{s.name}").over(frame)
                out[f"_{k}_{s.name}"] = F.coalesce(c, F.lit(0)) if s == N else c
    done = rows.repartition("_b").select(*df.columns, "_head", *[c.alias(n) for n, c in out.items()])
    return done.where("_head = 0").drop("_head")


def large_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """_large: values of the key, null among them, that more than so many rows have."""
    return df.groupBy(F.col(key).alias("_large")).count().where(F.col("count") > rows).select("_large")


def prior_by_keys(df: DataFrame, keys: Mapping[str, tuple[str, str]], whole: str | None = None, block_rows: int | None = None) -> DataFrame:
    """{name}_n and {name}_s: the number of earlier rows with this row's value and the sum of their _cents.

    keys: name -> (column, text for a missing value). whole: a name for the same over all rows.
    """
    texts = {n: text_or(c, missing) for n, (c, missing) in keys.items()} | ({whole: F.lit("")} if whole else {})
    states = [N, State("sum", "_cents")]
    held = prior_states(df, {n: (v, states) for n, v in texts.items()}, block_rows)
    own = [c for n in texts for c in (F.col(f"_{n}_n").alias(f"{n}_n"), F.coalesce(f"_{n}_sum_cents", F.lit(0)).alias(f"{n}_s"))]
    return held.select(*df.columns, *own)
