"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set on the context. Where neither is, a local session gets a folder in its warehouse; a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = held.get() if held.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return path.rstrip("/")


#: Spark's setting that a finished query's shuffle files go at once, and not when the driver's memory is next cleaned.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The JVM leaves methods of more bytes uncompiled; Spark makes one of a stage's columns all the same, up to the size set here.
METHODS = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting, for the queries that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def many_columns(spark: SparkSession):
    """For queries inside that compute many columns at once: a stage too large for one compiled method is made of several, not interpreted."""
    return setting(spark, METHODS, "8000")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again. The write's shuffle files are deleted with its end: only the table is read from here on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lagline-{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all parts, alike in columns, as one table. A part is written and its shuffle files deleted before the next one begins."""
    path = None
    for df in parts:
        spark = df.sparkSession
        path, schema = path or f"{shared_dir(spark)}/lagline-{name}-{uuid.uuid4().hex}", df.schema
        with setting(spark, CLEANUP, "true"):
            df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of stored(), once everything that reads it has been written."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lagline-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
