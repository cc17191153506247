"""Mixing sources to target weights by Poisson replication.

A source with share w of the target and size s of the corpus T has the mean
repetition rate w * T / s. Every document draws its number of copies from the
Poisson distribution with that mean by inverting its distribution function at a
uniform number that a hash of seed, doc_id, text and the row's number among rows
equal in both gives. Such rows are numbered in the order of a hash of their other
columns, so the same document gets the same count in every run, on every cluster
and in every order of rows, and documents without ids of their own draw apart. Documents are
exploded by their count and dealt to partitions by a hash of that draw and the
copy, and sorted by another inside them: a global shuffle without a global sort,
in which no source meets in one place.

Sizes are UTF-8 bytes of text plus one a document. Only one row a source is
aggregated and joined back. Sources are counted first: up to broadcast_sources
that side is broadcast and the text is shuffled once, for the deal; beyond, the
join is left to Spark, which splits a source that holds a third of the rows. Rows
are numbered only if some are equal in doc_id and text, by positions(), so that no
group of them is one task's.

Defined results: a null source is a source of its own; null and empty texts are
documents of size one; texts of any length count whole; a source without a weight
(or weight 0) is left out; an empty table gives an empty table; columns of the
input named copy, mix_rate or mix_u (in any case) give way to the operator's own,
all others are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.window import Window

from .common import positions, stored

#: Digits of md5 that make the uniform number, and their range.
HEX_DIGITS, HEX_RANGE = 13, float(1 << 52)


def uniform(seed: str, *parts: Column) -> Column:
    """In [0, 1), from a hash of the seed and the parts."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(HEX_RANGE)


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """rates: source and rate. Adds least and cdf: P(X <= least), P(X <= least + 1), ... up to where the rest is below 1e-15.

    Terms are summed from logarithms, so large rates don't underflow. From a rate of 1000 on, values that are as unlikely
    as 1e-30 are left out below as well: 24 standard deviations are the array's length.
    """
    key, rate = "source", F.col("rate")
    least = F.when(rate < 1000, 0).otherwise(F.floor(rate - 12 * F.sqrt("rate") - 20)).cast("long")
    n = F.greatest("least", F.lit(1)).cast("double")  # Stirling's series: exact to the last digits for n of hundreds
    log_factorial = F.when(F.col("least") == 0, 0.0).otherwise((n + 0.5) * F.ln(n) - n + F.lit(math.log(2 * math.pi) / 2) + 1 / (12 * n) - 1 / (360 * n * n * n))
    up_to = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = rates.withColumn("least", least).withColumn("k", F.explode(F.sequence(F.col("least"), F.ceil(rate + 12 * F.sqrt("rate") + 20))))
    factorial = log_factorial + F.sum(F.when(F.col("k") > F.col("least"), F.ln(F.greatest("k", F.lit(1)).cast("double"))).otherwise(0.0)).over(up_to)
    terms = terms.withColumn("log_term", F.col("k") * F.ln("rate") - rate - factorial)
    points = terms.withColumn("cdf", F.sum(F.exp("log_term")).over(up_to))
    return points.groupBy(key, "rate", "least").agg(F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("p")).select(key, "rate", "least", F.col("p.cdf").alias("cdf"))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5) -> DataFrame:
    """source, rate: mean copies of a document. Without weights a source's target share is its size to the power alpha."""
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    sizes = docs.groupBy("source").agg(size.alias("size"))
    if weights is None:
        target = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        target = sizes.join(given, F.col("source").eqNullSafe(F.col("name"))).where("weight > 0").drop("name")
    whole = target.agg(F.sum("weight").alias("weights"))
    corpus = sizes.agg(F.sum("size").alias("corpus"))
    # two one-row sides
    target = target.join(F.broadcast(whole), F.lit(True)).join(F.broadcast(corpus), F.lit(True))
    return target.select("source", (F.col("weight") / F.col("weights") * F.col("corpus") / F.col("size")).alias("rate"))


def others_hash(row: StructType) -> Column:
    """A hash of all columns of `row` but doc_id and text, by name: tells rows apart that are equal in both."""
    parts = [F.to_json(F.col(f"row.`{f.name}`")) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"row.`{f.name}`").cast("string") for f in sorted(row.fields, key=lambda f: f.name) if f.name not in ("doc_id", "text")]
    return F.md5(F.concat_ws(":", *(F.coalesce(p, F.lit("null")) for p in parts)))


def repeat_numbers(rows: DataFrame) -> DataFrame:
    """rows: row (struct), id, hash. Adds nth: the row's number among rows of its id and hash, in the order of their other columns."""
    repeats = rows.groupBy("id", "hash").count().where("count > 1").select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    if repeats.limit(1).isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    held = stored(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    keys = stored(repeats, "repeats")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    twins = held.select("id", "hash", "number", others_hash(rows.schema["row"].dataType).alias("others")).join(keys, same, "left_semi")
    nth = positions(twins, ["id", "hash"], ["others"], "twins").select("number", F.col("position").alias("nth"))
    return held.join(nth, "number", "left").withColumn("nth", F.coalesce("nth", F.lit(0)).cast("long")).drop("number")


def draw_copies(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, seed: str = "mix", broadcast_sources: int = 10_000) -> DataFrame:
    """row (a struct of all columns of docs), as often as drawn, with copy (from 0), mix_rate and mix_u; globally shuffled."""
    rates = poisson_cdf(source_rates(docs, weights, alpha))
    if rates.select("source").limit(broadcast_sources + 1).count() <= broadcast_sources:
        rates = F.broadcast(rates)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col("doc_id").alias("id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("hash"))  # no column of docs stands beside the operator's
    rows = repeat_numbers(rows).withColumn("mix_u", uniform(seed, F.col("id"), F.col("hash"), F.col("nth")))
    drawn = rows.join(rates, F.col("row.source").eqNullSafe(F.col("source")))
    count = F.col("least") + F.size(F.filter("cdf", lambda c: c <= F.col("mix_u")))
    copies = drawn.select("row", "mix_u", F.col("rate").alias("mix_rate"), F.explode(F.sequence(F.lit(1).cast("long"), F.nullif(count, F.lit(0).cast("long")))).alias("copy"))
    copies = copies.withColumn("copy", (F.col("copy") - 1).cast("int")).withColumn("at", F.xxhash64(F.lit(seed), "mix_u", "copy"))
    return copies.repartition("at").sortWithinPartitions(F.xxhash64("at")).select("row", "copy", "mix_rate", "mix_u")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, seed: str = "mix", broadcast_sources: int = 10_000) -> DataFrame:
    """All columns of docs but those that draw_copies names itself, and those of draw_copies."""
    own = [f"row.`{c}`" for c in docs.columns if c.lower() not in ("copy", "mix_rate", "mix_u")]
    return draw_copies(docs, weights, alpha, seed, broadcast_sources).select(*own, "copy", "mix_rate", "mix_u")
