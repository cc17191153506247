"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents become pieces of at most `capacity` tokens. A superstep sorts the
waiting pieces and the open gaps by size, lets every piece look for its
successor gap (the smallest that holds it, longest pieces first), gives each
gap to one piece, shrinks the gaps and goes round again. When no gap holds any
waiting piece, the longest waiting pieces open as many new sequences as the
waiting tokens need at least.

Sizes are whole numbers from 1 to capacity and pieces of one size are
interchangeable, so the sweep runs over runs of equal sizes: the state is the
number of pieces of each size and runs (gap, first sequence, number of
sequences). It is bounded by capacity and supersteps, not by documents. What
grows with the data stays in Spark: tokenising, counting sizes, ranking the
pieces of a size, and looking up each piece's sequence by (size, rank).

Ranks need no sort and no shuffle of pieces: each task numbers the pieces of a
size as it writes them, and the tasks' counts are summed up in a table of one row
a task and size, which is joined back. A size that a third of all pieces have is
no group of its own anywhere. Which of several pieces of a size goes where
depends on how the table is cut into tasks; how full the sequences get does not.

Defined results: a null text is empty and becomes the closing id alone; texts of
any length are cut into pieces, never shortened; equal documents are packed one
by one; pieces of a repeated or null doc_id each get a place; an empty table gives
no rows; pack() passes other columns through and refuses names that begin with
_lag_, sequence_id and offset.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, reserved, stored
from .text import blocks, buffer_of

NUMBERS = ("_lag_task", "_lag_nth")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_cutter(tokenizer, capacity: int, end_id: int):
    """A function of record batches with doc_id and text: length and checksum of every piece of every document; whole texts, ids by the tokenizer and then end_id."""

    def cut(batches):
        for b in blocks(batches, max_bytes=1 << 20):
            data, offsets = buffer_of(b.column("text"))
            raw = data.tobytes()
            ids = b.column("doc_id").cast(pa.int64()).to_pylist()
            rows = []
            for doc_id, tokens in zip(ids, tokenizer.ids(raw[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), strict=True):
                whole = np.append(tokens, tokens.dtype.type(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


@dataclass
class Layout:
    """Where the pieces of each size go: the pieces of `size` with ranks from `rank` on go to sequences from `sequence` on, at `offset`."""

    size: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int = 0
    supersteps: int = 0

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.size * (1 << 44) + self.rank, size * (1 << 44) + rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def best_fit_layout(counts: np.ndarray, capacity: int) -> Layout:
    """counts[n]: pieces of n tokens. Runs the supersteps over runs of equal sizes."""
    waiting = {n: int(c) for n, c in enumerate(counts.tolist()) if c and n}
    taken = dict.fromkeys(waiting, 0)  # ranks of a size that have a place
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    rows: list[tuple[int, int, int, int]] = []
    sequences = supersteps = 0

    def seat(n: int, first: int, many: int, gap: int, into: dict[int, list[tuple[int, int]]]) -> None:
        rows.append((n, taken[n], first, capacity - gap))
        taken[n] += many
        waiting[n] -= many
        if not waiting[n]:
            del waiting[n]
        if gap > n:
            into.setdefault(gap - n, []).append((first, many))

    while waiting:
        supersteps += 1
        # sweep from the largest size down: gaps that hold the size are stacked, the smallest on top
        shrunk: dict[int, list[tuple[int, int]]] = {}
        open_sizes, stack = sorted(gaps), []
        for n in sorted(waiting, reverse=True):
            while open_sizes and open_sizes[-1] >= n:
                gap = open_sizes.pop()
                stack.extend((gap, first, many) for first, many in gaps.pop(gap))
            while stack and n in waiting:
                gap, first, many = stack.pop()
                use = min(many, waiting[n])
                seat(n, first, use, gap, shrunk)
                if use < many:
                    stack.append((gap, first + use, many - use))
        for gap, first, many in stack:  # gaps nobody took in this superstep
            gaps.setdefault(gap, []).append((first, many))
        for gap, runs in shrunk.items():
            gaps.setdefault(gap, []).extend(runs)
        widest = max(gaps, default=0)
        stuck = {n: c for n, c in waiting.items() if n > widest}
        if stuck and (len(stuck) == len(waiting) or not shrunk):
            tokens, alone = sum(n * c for n, c in stuck.items()), sum(c for n, c in stuck.items() if 2 * n > capacity)
            more = max(alone, -(-tokens // capacity))
            for n in sorted(stuck, reverse=True):
                use = min(stuck[n], more)
                if use:
                    seat(n, sequences, use, capacity, gaps)
                    sequences, more = sequences + use, more - use
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return Layout(*columns, sequences=sequences, supersteps=supersteps)


def places_in_size(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For every entry, how many entries of its size stand before it; seen holds the counts of earlier batches and is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    held = lengths[order]
    new = np.concatenate(([True], held[1:] != held[:-1]))[: len(held)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(held) else np.zeros(0, np.int64)
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - first + seen[held]
    np.add.at(seen, lengths, 1)
    return out


def numbered(batches, names: list[str], capacity: int):
    """Record batches with the task that writes them, and each piece's place among the task's pieces of its size."""
    seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    for b in batches:
        nth = places_in_size(b.column("length").to_numpy(), seen)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.full(len(nth), task, np.int64)), pa.array(nth)], [*names, *NUMBERS])


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces: length (1 to capacity) and any other columns. Adds sequence_id and offset (long)."""
    reserved(pieces, "sequence_id", "offset", *(c for c in pieces.columns if c.lower().startswith("_lag_")))
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    held = lean(pieces).mapInArrow(lambda batches: numbered(batches, names, capacity), f"{schema}, _lag_task long, _lag_nth long")
    return _laid_out(stored(held, "pieces"), names, schema, capacity)


def pack_documents(docs: DataFrame, tokenizer, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut, names = piece_cutter(tokenizer, capacity, end_id), ["doc_id", "piece", "start", "length", "ids_crc32"]
    texts = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = texts.mapInArrow(lambda batches: numbered(cut(batches), names, capacity), f"{PIECES}, _lag_task long, _lag_nth long")
    return _laid_out(stored(held, "pieces"), names, PIECES, capacity)


def _laid_out(held: DataFrame, names: list[str], schema: str, capacity: int) -> DataFrame:
    tasks = stored(held.groupBy("length", "_lag_task").agg(F.count(F.lit(1)).alias("_lag_n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in tasks.groupBy("length").agg(F.sum("_lag_n")).collect():  # capacity rows at most
        counts[n] = c
    layout = best_fit_layout(counts, capacity)
    before = F.sum("_lag_n").over(Window.partitionBy("length").orderBy("_lag_task").rowsBetween(Window.unboundedPreceding, -1))  # a row a task in each size
    starts = tasks.select("length", "_lag_task", F.coalesce(before, F.lit(0)).alias("_lag_before"))
    ranked = held.join(starts, ["length", "_lag_task"]).select(*names, (F.col("_lag_before") + F.col("_lag_nth")).alias("_lag_rank"))

    def placed(batches):
        for b in batches:
            sequence, offset = layout.place(b.column("length").to_numpy(), b.column("_lag_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")
