"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has n_cells cells. Every shard owns n_virtual of them (virtual nodes,
placed by a hash of shard and number); a key, which is all of a row's columns, is
hashed to a cell and belongs to the first virtual node from there clockwise. Loads are bounded: a shard takes
floor(rows / shards) rows, the first rows % shards shards one more, and keys
overflowing a full shard continue clockwise to the next shard with room. Since
the bounds add up to the number of rows, every shard ends exactly full: row
counts differ by one at most, whatever the hash does.

The walk needs only the number of keys in each cell, so it runs over n_cells
counts (a constant), not over rows. Its result, (cell, first rank, shard, slot
of the first rank), has n_cells + n_shards entries at most and is joined back by
cell and rank inside the cell. Equal rows are counted together before that shuffle
and told apart by a running count, and rows that share an id, or have none, but
differ otherwise hash apart: neither meets in one task if it holds a third of all
rows. A cell holds about rows / n_cells different rows.

Adding a shard moves the keys of its virtual nodes and those that the lower
bounds push on; the rest stays.

Defined results: a null text is empty (size 8, crc32 0) and a text of any length
counts whole; rows without an id are placed by what else they hold; repeated rows
get slots of their own; an empty table gives an empty table; columns named shard or
slot give way to the operator's own, all others are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N_CELLS = 1 << 16


def ring(n_shards: int, n_virtual: int = 128, n_cells: int = N_CELLS, seed: int = 0) -> np.ndarray:
    """The shard of each virtual node in ring order, as (cell, shard) rows; two nodes never share a cell."""
    taken: dict[int, int] = {}
    for v in range(n_virtual):
        for s in range(n_shards):
            cell = int.from_bytes(hashlib.blake2b(f"{seed}/{s}/{v}".encode(), digest_size=8).digest(), "little") % n_cells
            while cell in taken:
                cell = (cell + 1) % n_cells
            taken[cell] = s
    return np.array(sorted(taken.items()), np.int64)


def walk(counts: np.ndarray, nodes: np.ndarray, n_shards: int) -> list[tuple[int, int, int, int]]:
    """Places the keys of every cell under the bounds: rows (cell, first rank, shard, slot of that rank).

    Cells are taken in an order fixed by a hash, so that no arc of the ring is favoured.
    """
    n_cells, rows = len(counts), int(counts.sum())
    room = np.full(n_shards, rows // n_shards, np.int64)
    room[: rows % n_shards] += 1
    used, node_cells, node_shards = np.zeros(n_shards, np.int64), nodes[:, 0], nodes[:, 1].tolist()
    following = list(range(len(node_shards)))  # to the next node whose shard may have room, with path halving
    owner = np.searchsorted(node_cells, np.arange(n_cells)) % len(node_shards)
    order = np.argsort((np.arange(n_cells, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), kind="stable")
    out = []
    for cell in order[counts[order] > 0].tolist():
        left, rank, at = int(counts[cell]), 0, int(owner[cell])
        while left:
            while following[at] != at:
                following[at] = following[following[at]]
                at = following[at]
            shard = node_shards[at]
            take = min(left, int(room[shard] - used[shard]))
            if take:
                out.append((cell, rank, shard, int(used[shard])))
                used[shard] += take
                left, rank = left - take, rank + take
            if used[shard] == room[shard]:
                following[at] = (at + 1) % len(node_shards)
                at = following[at] if left else at
    return out


def shard_rows(keys: DataFrame, n_shards: int, n_virtual: int = 128, n_cells: int = N_CELLS, seed: int = 0) -> DataFrame:
    """keys: any columns that can be ordered; all of them are the key. Adds shard (int) and slot (long, gapless from 0 in each shard)."""
    spark: SparkSession = keys.sparkSession
    others = [c for c in keys.columns if c.lower() not in ("shard", "slot")]
    cell = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in others], F.lit(seed)), F.lit(n_cells)).cast("int")
    rows = keys.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), cell.alias("cell"))  # no column of keys stands beside the operator's
    held = rows.groupBy("row", "cell").agg(F.count(F.lit(1)).alias("copies"))
    counts = np.zeros(n_cells, np.int64)
    for at, n in rows.groupBy("cell").count().collect():  # n_cells rows at most
        counts[at] = n
    plan = walk(counts, ring(n_shards, n_virtual, n_cells, seed), n_shards)
    limits: dict[int, int] = {}
    pieces = []
    for at, rank, shard, slot in reversed(plan):  # the rank at which the next piece of the cell begins
        pieces.append((at, rank, limits.get(at, int(counts[at])), shard, slot))
        limits[at] = rank
    layout = spark.createDataFrame(pieces, "cell int, least long, limit long, shard int, first_slot long")
    order = Window.partitionBy("cell").orderBy("row")
    ranked = held.withColumn("end", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("begin", F.col("end") - F.col("copies"))
    # n_cells + n_shards rows at most, a constant: safe to broadcast
    placed = ranked.join(F.broadcast(layout), "cell").where("begin < limit and end > least")
    first, last = F.greatest("begin", "least"), F.least("end", "limit") - 1
    placed = placed.withColumn("rank", F.explode(F.sequence(first, last)))
    return placed.select("row.*", "shard", (F.col("first_slot") + F.col("rank") - F.col("least")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; the text itself is not shuffled."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + F.lit(8)).alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(keys, n_shards, seed=seed)
