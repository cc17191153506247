"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one in its warehouse; a cluster is refused."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = held.get() if held.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return set_dir.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lagline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of stored(), once everything that reads it has been written."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lagline-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a record batch that Spark hands to Python. Its own bound of 64 MB is a large part of a small executor's memory.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(df: DataFrame) -> DataFrame:
    """Has Spark cut the batches it hands to Python by bytes: a number of rows bounds nothing where texts are long. A session's own setting stays."""
    if df.sparkSession.conf.get(_BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(_BATCH_SETTING, BATCH_BYTES)
    return df


def release() -> None:
    """Gives back memory at the end of a task: Python workers are kept for later tasks, and what is free inside one would stay its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def reserved(df: DataFrame, *names: str) -> None:
    """Refuses a table that has a column of the operator's own."""
    clash = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if clash:
        raise ValueError(f"reserved column names: {', '.join(clash)}")


def numbered(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """The table with a number of its own for each row, and a hash of the row's values to order rows by.

    Both are written once to the shared folder, so every plan that reads the result sees the same numbers. The hash does
    not depend on how the table is cut into files; rows that the number must tell apart are equal in all hashed columns.
    """
    return stored(df.withColumns({order: row_hash(df), key: F.monotonically_increasing_id()}), name)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's values, without those of nested columns."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds position (long): the row's place in its group in the given order, gapless from 0; written once to the shared folder.

    No group is one task's: rows are cut into ranges of (groups, order, a number of the row's own), numbered inside their
    range as they are sorted, and a table of one row a group and range tells where the group's part of a range begins.
    Rows equal in groups and order are placed as they come. The table may not have the columns position and _lag_*.
    """
    reserved(df, "position", "_lag_tie", "_lag_place", "_lag_first")
    tied = df.withColumn("_lag_tie", F.monotonically_increasing_id())
    n = partitions(df.sparkSession)
    cut = tied.repartitionByRange(n, *groups, *order, "_lag_tie").sortWithinPartitions(*groups, *order, "_lag_tie")
    held = stored(cut.drop("_lag_tie").withColumn("_lag_place", F.monotonically_increasing_id()), name)  # range << 33 | place in the range
    part = F.shiftright("_lag_place", 33)
    parts = held.groupBy(*groups, part.alias("_lag_part")).agg(F.min("_lag_place").alias("_lag_first"), F.count(F.lit(1)).alias("_lag_n"))
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_lag_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = parts.select(*[F.col(g).alias(f"_lag_g{i}") for i, g in enumerate(groups)], "_lag_part", (F.coalesce(F.sum("_lag_n").over(earlier), F.lit(0)) - F.col("_lag_first")).alias("_lag_shift"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_lag_g{i}")) for i, g in enumerate(groups)], part == F.col("_lag_part"))
    return held.join(before, same).select(*df.columns, (F.col("_lag_place") + F.col("_lag_shift")).alias("position"))


def id_array(batch: pa.RecordBatch, column: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """An integer column as int64, nulls as the least value, and where it is null."""
    col = batch.column(column)
    null = col.is_null().to_numpy(zero_copy_only=False)
    return col.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64), null


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return lean(df).mapInArrow(f, schema)


class LabelledSample:
    """A bounded set of labelled document ids, small enough to travel with every task.

    The bound, max_rows, is a parameter: the rows with the smallest hashed ids
    are taken, so that the same rows are chosen whatever the partitioning.
    Rows with a null id or label are left out; of several rows of an id the
    largest label counts.
    """

    def __init__(self, labels: DataFrame, label: str, max_rows: int, where=None):
        rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
        if where is not None:
            rows = rows.where(where)
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("y")).limit(max_rows)
        found: dict[int, int] = {}
        for r in rows.collect():
            found[r.doc_id] = max(r.y, found.get(r.doc_id, 0))
        self.ids = np.array(sorted(found), np.int64)
        self.y = np.array([found[i] for i in self.ids.tolist()], np.int8)

    def __len__(self) -> int:
        return len(self.ids)

    def lookup(self, ids: np.ndarray) -> np.ndarray:
        """The label of each id, -1 where it has none."""
        if not len(self.ids):
            return np.full(len(ids), -1, np.int8)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.y[at], np.int8(-1))


def youden_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The cut c that makes "score >= c" separate y best (sensitivity + specificity); the middle of the gap there."""
    if not len(y) or not (0 < y.sum() < len(y)):
        return -np.inf
    order = np.argsort(score, kind="stable")
    s, t = score[order], y[order].astype(float)
    below_pos = np.concatenate(([0.0], np.cumsum(t))) / t.sum()
    below_neg = np.concatenate(([0.0], np.cumsum(1 - t))) / (1 - t).sum()
    gain = below_neg - below_pos
    gain[1:-1][s[1:] == s[:-1]] = -np.inf
    k = int(np.argmax(gain))
    return -np.inf if k == 0 else np.inf if k == len(s) else float((s[k - 1] + s[k]) / 2)


def best_f1_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The cut c that makes "score >= c" find y = 1 with the best F1; the middle of the gap there."""
    if not len(y) or not (0 < y.sum() < len(y)):
        return -np.inf
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + hits[-1])
    f1[:-1][s[1:] == s[:-1]] = -1.0
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])
