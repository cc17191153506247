"""Readers and sinks: CSV with a declared schema, Parquet feature tables by day, feature tables by entity, ordered submissions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adapters import CANONICAL, micros


def read_transactions(spark: SparkSession, path: str, schema: T.StructType = CANONICAL) -> DataFrame:
    """CSV with header; nothing is inferred, a bad row fails."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path).withColumn("us", micros("timestamp"))


def read_side_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with header that is no transaction table (a sample submission, results of a run, a list of columns); nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def first_readable(spark: SparkSession, paths: Iterable[str], schema: T.StructType = CANONICAL) -> DataFrame:
    """The first path that Spark can list; works for any store that Spark reads."""
    tried = []
    for path in paths:
        tried.append(path)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return read_transactions(spark, path, schema)
    raise FileNotFoundError(", ".join(tried))


def write_features(df: DataFrame, path: str) -> None:
    """Parquet by event day, so a later read of a time range prunes folders."""
    day = F.to_date(F.timestamp_micros("us"))
    df.withColumn("event_date", day).repartition("event_date").write.mode("overwrite").partitionBy("event_date").parquet(path)


def save_by_entity(df: DataFrame, table: str, entity: str, buckets: int) -> None:
    """A table of the catalog, by event day and in buckets of an entity: windows by that entity then need no exchange, and single days can be replaced."""
    held = df.withColumn("event_date", F.to_date(F.timestamp_micros("us"))).repartition(buckets, entity)  # a task writes its bucket of every day
    held.write.mode("overwrite").format("parquet").partitionBy("event_date").bucketBy(buckets, entity).sortBy(entity, "us").saveAsTable(table)


def replace_days(df: DataFrame, table: str, entity: str, buckets: int) -> None:
    """Writes the days of df anew, whole; all other days of the table stay as they are."""
    spark, name = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    held = df.withColumn("event_date", F.to_date(F.timestamp_micros("us"))).repartition(buckets, entity)
    spark.conf.set(name, "dynamic")
    try:
        held.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(name, before)


def read_by_entity(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def submission(sample: DataFrame, scores: DataFrame, position: str = "position") -> DataFrame:
    """Scores in the sample's order; fails on a missing score or one outside [0, 1]."""
    joined = sample.join(scores, "transaction_id", "left")
    fine = F.col("score").isNotNull() & F.col("score").between(0.0, 1.0)
    checked = F.when(fine, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("no valid score for "), F.col("transaction_id").cast("string"))).cast("double"))
    return joined.withColumn("score", checked).orderBy(position)
