"""Canonical fact table and the adapters that make one from other tables.

transaction_id (tie-break), us (epoch microseconds, long), amount
decimal(18,2) (so sums don't depend on order), entities customer_id,
merchant_id, device_id, attributes, label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("amount", T.DecimalType(18, 2), False),
        T.StructField("merchant_id", T.StringType(), False),
        T.StructField("merchant_category", T.StringType(), True),
        T.StructField("device_id", T.StringType(), False),
        T.StructField("device_type", T.StringType(), True),
        T.StructField("location", T.StringType(), True),
        T.StructField("payment_method", T.StringType(), False),
        T.StructField("transaction_type", T.StringType(), False),
        T.StructField("account_age_days", T.IntegerType(), True),
        T.StructField("fraud", T.IntegerType(), True),
    ]
)


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def events_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transactions: customer = user, device = props.k, label = error events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("transaction_id"),
        micros("ts").alias("us"),
        F.col("user_id").alias("customer_id"),
        F.get_json_object("props", "$.k").cast("long").alias("device_id"),
        F.col("event_type").alias("transaction_type"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def lineitem_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined with orders: day-grain times, so ties are the rule. device_type is the order's status, account_age_days the quantity."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line, orders = read("lineitem"), read("orders")
    part = read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("merchant_category"))
    place = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("location"))
    key = F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), (micros("l_shipdate") / 1_000_000).cast("long").cast("string"), F.lpad(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), 14, "0"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, "l_partkey", "left").join(place, "l_suppkey", "left")
    return joined.select(
        key.alias("transaction_id"),
        micros("l_shipdate").alias("us"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_suppkey").alias("merchant_id"),
        F.col("l_partkey").alias("device_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        "merchant_category",
        F.col("o_orderstatus").alias("device_type"),
        "location",
        F.col("o_orderpriority").alias("payment_method"),
        F.col("l_linestatus").alias("transaction_type"),
        F.col("l_quantity").cast("int").alias("account_age_days"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def combine(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows in one table, tagged, with the label null on test rows."""
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)), allowMissingColumns=True)
