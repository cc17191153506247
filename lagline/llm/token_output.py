"""Token-ID output: best-fit-decreasing packing of whole documents into id matrices.

Every task tokenises its documents, cuts overlong ones into consecutive pieces
(no id is lost), and packs a block of pieces: longest first, each into the
fullest open row that still holds it. The search runs on a segment tree over
capacities: a node tells whether some open row has that much room, so finding
the tightest room and updating it take log2(capacity) steps.

Blocks hold about block_tokens ids and are packed where they were read: nothing
is shuffled and no block grows with the corpus. A block wastes less than one
row more than packing everything at once would.

A row of the matrix is row_length ids (little-endian, two bytes where the
vocabulary allows, else four), filled up with pad_id; cu_seqlens are the
cumulative lengths of its segments (from 0), position_resets the places where
positions start again at 0 (every segment start and, if there is one, the
start of the padding).

Defined results: null and empty texts are the closing id alone; texts of any
length are cut, never shortened; repeated rows are packed one by one; a null doc_id
stays null in doc_ids; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .text import blocks, buffer_of

SCHEMA = "sequence_id long, n_tokens int, id_bytes int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"


class CapacityTree:
    """Open rows by room left; room 1..capacity are the leaves of a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        if room <= 0:
            return
        self.rows[room].append(row)
        node = self.size + room
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and gives (room, row) of the tightest row with room for `least`."""
        node = self.size + least
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):  # up to the first right neighbour that has a row
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.any[2 * node])
        room = node - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The row of each piece (lengths from 1 to capacity) and the number of rows."""
    tree, rows, out = CapacityTree(capacity), 0, np.empty(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = tree.take(n)
        if found is None:
            room, row, rows = capacity, rows, rows + 1
        else:
            room, row = found
        out[k] = row
        tree.add(room - n, row)
    return out, rows


def packed_rows(docs: DataFrame, tokenizer, end_id: int, row_length: int = 4096, pad_id: int | None = None, block_tokens: int = 4_000_000) -> DataFrame:
    pad_id = end_id if pad_id is None else pad_id

    def flush(held: list[tuple[int, int, int, np.ndarray]], first_id: int):
        lengths = np.array([len(x[3]) for x in held], np.int64)
        row, n = best_fit_decreasing(lengths, row_length)
        order = np.argsort(row, kind="stable")
        edge = np.searchsorted(row[order], np.arange(n + 1))
        for at in range(0, n, 512):
            out: list[list] = [[] for _ in range(9)]
            for r in range(at, min(n, at + 512)):
                segments = [held[k] for k in order[edge[r] : edge[r + 1]].tolist()]
                ids = np.concatenate([s[3] for s in segments])
                ends = np.concatenate(([0], np.cumsum([len(s[3]) for s in segments])))
                full = np.full(row_length, pad_id, ids.dtype)
                full[: len(ids)] = ids
                resets = ends if len(ids) < row_length else ends[:-1]
                for column, value in zip(out, (first_id + r, len(ids), ids.dtype.itemsize, full.tobytes(), ends, resets, [s[0] for s in segments], [s[1] for s in segments], [s[2] for s in segments]), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["sequence_id", "n_tokens", "id_bytes", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"])
        return first_id + n

    def run(batches):
        held, waiting, next_id = [], 0, TaskContext.get().partitionId() << 36
        for b in blocks(batches, max_bytes=1 << 20):
            data, offsets = buffer_of(b.column("text"))
            raw = data.tobytes()
            texts = (raw[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            for doc_id, tokens in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), tokenizer.ids(texts), strict=True):
                whole = np.append(tokens, tokens.dtype.type(end_id))
                for k, at in enumerate(range(0, len(whole), row_length)):
                    held.append((doc_id, k, at, whole[at : at + row_length]))
                waiting += len(whole)
            if waiting >= block_tokens:
                next_id = yield from flush(held, next_id)
                held, waiting = [], 0
        if held:
            yield from flush(held, next_id)

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """Writes the matrices and their segment tables; each file is one block of rows."""
    rows.write.parquet(path)
