"""Substring dedup: removes every word in a window of `window` words that also starts earlier.

The method asked for streams every document past the suffix automaton of every
reference shard. With the corpus as its own reference that is shards times
documents, the square of the input; README.md has the measured figures. For a
reference of bounded size it is what suffix_automaton.py does. Here the shards
are routed instead: a window can only match where its anchor also stands.

Anchor of a window: its `gram`-word sequence with the smallest hash (leftmost
of equals), a function of the window's words alone. Windows with one anchor
place are consecutive, so a document of n windows has about 2 n / (window -
gram + 2) runs (anchor, hash of all words of the run, place).

1. Each row has a key: doc_id, a hash of its values and, only where two rows agree
   in both, a number that is written once to the shared folder. Rows are dealt,
   ordered and cut into blocks by it, the same way in all three passes, and verdicts
   are joined back by it. This exchange serves all three passes. Each block of
   documents settles what it can alone: of equal runs only the first goes on, the
   others are duplicates.
2. First runs meet by anchor, at most one a block and anchor. Of equal runs all
   but the first are duplicates. A run that is the only one of its anchor has no
   duplicate windows. What is left open are first runs of anchors with several
   different runs: the edges of shared passages.
3. Only the windows of open runs meet one by one, by (anchor, window hash); all
   but the first are duplicates.

Two independent 64-bit hashes of the same words decide (anchor and run, anchor
and window). Order is doc_id, then a hash of the row's values, then its number
(only between rows that are equal), then word position. Nothing is capped; a passage
in a third of all documents gives one row a block of 1 MB at most in step 2, and
in step 3 one row a block for each different window.

Defined results: a null text has no words; every row is a document of its own,
also where rows repeat a doc_id or have none, and of equal rows one keeps its
words; a null doc_id comes before all others; texts shorter than a window lose
nothing; texts of any length are whole (one may exceed a block); an empty table
gives an empty table; other columns are passed through (names that begin with
_lag_ are refused).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, numbered, partitions, reserved, row_hash
from .text import Words, _power_tables, covered, mix, ngram_hashes, steady_blocks, words_of

BLOCK = 1 << 20
PARTITION_BYTES = 24 << 20
_PLACE = 26  # bits for a word's position in a block, below the hash that picks anchors
_KEY, _DOC, _HASH = "_lag_id", "_lag_doc", "_lag_hash"


def sliding_min(v: np.ndarray, span: int) -> np.ndarray:
    """min(v[i:i + span]) for every i with a full span."""
    width = 1
    while 2 * width <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (span - width)], v[span - width :]) if span > width else v


@dataclass
class Runs:
    """Windows of a block by anchor place. Arrays end in _w for windows, else for runs."""

    start_w: np.ndarray  # first word of each window, in the block
    hash_w: np.ndarray
    first: np.ndarray  # run r has windows first[r]:first[r + 1]
    anchor: np.ndarray
    run: np.ndarray
    doc: np.ndarray  # row of the block
    start: np.ndarray  # word of the document at which the first window starts
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.anchor)


def anchor_runs(w: Words, window: int, gram: int) -> Runs:
    n = len(w.start)
    none = np.zeros(0, np.int64)
    if n < window:
        return Runs(none, none.astype(np.uint64), np.zeros(1, np.int64), none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    h = w.hashes()
    valid = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
    grams = ngram_hashes(h, gram, seed=77)
    low = np.uint64((1 << _PLACE) - 1)
    picked = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    at = (picked & low).astype(np.int64)[valid]
    power, inverse = _power_tables(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=prefix[1:])
    span = lambda a, b: mix((prefix[b] - prefix[a]) * inverse[a])
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True]))) if len(at) else np.zeros(1, np.int64)
    head = edge[:-1]
    start, count = valid[head], np.diff(edge)
    run = mix(span(start, start + count + window - 1) ^ (count * 64 + at[head] - start).astype(np.uint64))
    return Runs(valid, span(valid, valid + window), edge, grams[at[head]], run, w.doc[start], start - w.first[w.doc[start]], count)


def pack_place(start: np.ndarray, count: np.ndarray, flag: np.ndarray | int) -> np.ndarray:
    return (start.astype(np.int64) << 14) | (count.astype(np.int64) << 1) | flag


@dataclass
class Settled:
    """What a block knows alone."""

    duplicate: np.ndarray  # an equal run stands earlier in the block
    lead: np.ndarray  # the one row that stands for a group of equal runs
    several: np.ndarray  # the block has different runs of this anchor
    face: np.ndarray  # the one row that stands for such an anchor


def settle(r: Runs, ids: np.ndarray) -> Settled:
    """Compares the runs of a block; ids: place of each row of the block in the order of rows."""
    n, doc = len(r), ids[r.doc]
    order = np.lexsort((r.start, doc, r.run, r.anchor))
    a, b = r.anchor[order], r.run[order]
    new_anchor = np.concatenate(([True], a[1:] != a[:-1]))[:n]
    new_run = new_anchor | np.concatenate(([True], b[1:] != b[:-1]))[:n]
    group = np.cumsum(new_run) - 1
    leader = order[np.flatnonzero(new_run)][group] if n else order
    duplicate, lead, several, face = (np.zeros(n, bool) for _ in range(4))
    duplicate[order] = (doc[order] != doc[leader]) | (r.start[order] != r.start[leader])
    lead[order[new_run]] = True
    anchor_group = np.cumsum(new_anchor) - 1
    runs_of = np.bincount(anchor_group, new_run, minlength=int(new_anchor.sum())) if n else np.zeros(0)
    several[order] = runs_of[anchor_group] > 1 if n else False
    face[order[new_anchor]] = True
    return Settled(duplicate, lead, several, face & several)


def expand(first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window indices of the chosen runs, and the run of each."""
    rows = np.flatnonzero(chosen)
    sizes = first[rows + 1] - first[rows]
    run = np.repeat(rows, sizes)
    return first[run] + np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes), run


def verdicts(column: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column of longs as (row, value)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(rows), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def told(r: Runs, row: np.ndarray, place: np.ndarray, kind: int) -> np.ndarray:
    """Marks the runs at (row, place) pairs of this kind."""
    chosen = (place & 1) == kind
    key = row[chosen].astype(np.int64) << 40 | place[chosen] >> 14
    return np.isin(r.doc.astype(np.int64) << 40 | r.start, key)


def open_windows(r: Runs, s: Settled, ids: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows to compare one by one: (window, its run) of the first of equals, and the windows that have an equal earlier in the block."""
    chosen = (s.lead & s.several) | (told(r, row, place, 0) & ~s.duplicate)
    window, run = expand(r.first, chosen)
    start = r.start[run] + window - r.first[run]
    key, doc = mix(r.hash_w[window] ^ mix(r.anchor[run])), ids[r.doc[run]]
    order = np.lexsort((start, doc, key))
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(order)]
    leader = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    later = (doc[order] != doc[leader]) | (start[order] != start[leader])
    keep = order[new]
    return window[keep], run[keep], window[order[later]]


def kept_text(w: Words, removed: np.ndarray, spacing: bool) -> pa.Array:
    """The texts of a block without the removed words, by masks over its bytes.

    Words are joined by one blank; with spacing, a removed word goes with the white space after it and all else stays.
    """
    n, size = len(w.start), len(w.data)
    kept = np.flatnonzero(~removed)
    edge = np.zeros(size + 1, np.int8)
    data = w.data
    if spacing:
        past = np.append(w.start[1:], size)
        last = w.first[1:][w.counts > 0] - 1
        past[last] = w.offsets[1:][w.counts > 0]
        gone = np.flatnonzero(removed)
        edge[w.start[gone]] += 1
        edge[past[gone]] -= 1
        mask = np.cumsum(edge[:size], dtype=np.int8) == 0
    else:
        edge[w.start[kept]] += 1
        edge[w.end[kept]] -= 1
        mask = np.cumsum(edge[:size], dtype=np.int8) > 0
        if len(kept):
            inner = np.flatnonzero(w.doc[kept[1:]] == w.doc[kept[:-1]])  # kept words with another one after them
            blank = w.end[kept[inner]]
            data = data.copy()
            data[blank] = 0x20
            mask[blank] = True
    before = np.zeros(size + 1, np.int32)
    np.cumsum(mask, out=before[1:], dtype=np.int32)
    return pa.StringArray.from_buffers(w.docs, pa.py_buffer(before[w.offsets]), pa.py_buffer(data[mask]))


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """docs with the columns that together are a row's own, and their names; null ids come first. The table is written only if rows repeat."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).min))
    plain = docs.withColumns({_DOC: doc, _HASH: row_hash(docs)})
    if plain.groupBy(_DOC, _HASH).count().where("count > 1").limit(1).isEmpty():
        return plain, (_DOC, _HASH)
    return numbered(docs, _KEY, _HASH, "numbered").withColumn(_DOC, doc), (_DOC, _HASH, _KEY)


def dedup_substrings(docs: DataFrame, window: int = 20, gram: int = 8, spacing: bool = False) -> DataFrame:
    """All columns of docs, with _lag_n_words, _lag_n_removed and _lag_kept (the words that stay, joined by one space; with spacing, the white space between them as it was)."""
    if window - gram + 1 >= 1 << 13:
        raise ValueError("window is too long")
    reserved(docs, *(c for c in docs.columns if c.lower().startswith("_lag_")))
    spark = lean(docs).sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions(spark), -(-int(size) // PARTITION_BYTES))
    keyed, row_columns = keyed_rows(docs)
    row_schema = ", ".join(f"{c} long" for c in row_columns)
    dealt = keyed.repartition(n, *row_columns)

    def prepared(batches):
        for b in steady_blocks(batches, BLOCK):
            w = words_of(b.column("text"))
            ids = np.empty(b.num_rows, np.int64)
            ids[np.lexsort([b.column(c).to_numpy() for c in reversed(row_columns)])] = np.arange(b.num_rows)
            r = anchor_runs(w, window, gram)
            yield b, w, ids, r, settle(r, ids)

    def of_rows(b, rows):
        return [b.column(c).take(pa.array(rows)) for c in row_columns]

    def first_runs(batches):
        for b, _, _, r, s in prepared(batches):
            chosen = np.flatnonzero((s.lead & ~s.several) | s.face)
            place = pack_place(r.start[chosen], r.count[chosen], s.face[chosen].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(r.anchor[chosen].view(np.int64)), pa.array(r.run[chosen].view(np.int64)), *of_rows(b, r.doc[chosen]), pa.array(place)], ["anchor", "run", *row_columns, "place"])

    runs = dealt.sortWithinPartitions(*row_columns).mapInArrow(first_runs, f"anchor long, run long, {row_schema}, place long")
    by_anchor, by_run = Window.partitionBy("anchor"), Window.partitionBy("anchor", "run").orderBy(*row_columns, "place")
    seen = runs.select(
        "*",
        F.first(F.struct(*row_columns)).over(by_run).alias("_row"),
        F.shiftright(F.first("place").over(by_run), 1).alias("_at"),
        ((F.min("run").over(by_anchor) != F.max("run").over(by_anchor)) | (F.max(F.col("place").bitwiseAND(1)).over(by_anchor) == 1)).alias("_several"),
    )
    is_first = (F.struct(*row_columns) == F.col("_row")) & (F.shiftright("place", 1) == F.col("_at"))
    # kind 1: duplicate, kind 0: open
    verdict = seen.where(~is_first | F.col("_several")).select(*row_columns, (F.shiftleft(F.shiftright("place", 1), 1) + F.when(is_first, 0).otherwise(1)).alias("v"))
    run_verdicts = verdict.repartition(n, *row_columns).groupBy(*row_columns).agg(F.collect_list("v").alias("_lag_runs"))
    known = dealt.join(run_verdicts.hint("merge"), list(row_columns), "left")

    def windows(batches):
        for b, _, ids, r, s in prepared(batches):
            at, run, _ = open_windows(r, s, ids, *verdicts(b.column("_lag_runs"), b.num_rows))
            start = r.start[run] + at - r.first[run]
            yield pa.RecordBatch.from_arrays([pa.array(r.anchor[run].view(np.int64)), pa.array(r.hash_w[at].view(np.int64)), *of_rows(b, r.doc[run]), pa.array(start)], ["anchor", "words", *row_columns, "start"])

    by_words = Window.partitionBy("anchor", "words").orderBy(*row_columns, "start")
    compared = known.mapInArrow(windows, f"anchor long, words long, {row_schema}, start long")
    compared = compared.select("*", F.first(F.struct(*row_columns, "start")).over(by_words).alias("_row"))
    later = compared.where(F.struct(*row_columns, "start") != F.col("_row")).select(*row_columns, "start")
    window_verdicts = later.repartition(n, *row_columns).groupBy(*row_columns).agg(F.collect_list("start").alias("_lag_windows"))
    decided = known.join(window_verdicts.hint("merge"), list(row_columns), "left")
    names = docs.columns

    def remove(batches):
        for b, w, ids, r, s in prepared(batches):
            row, place = verdicts(b.column("_lag_runs"), b.num_rows)
            gone = s.duplicate | told(r, row, place, 1)
            _, _, local = open_windows(r, s, ids, row, place)
            alone_row, alone = verdicts(b.column("_lag_windows"), b.num_rows)
            starts = np.concatenate((r.start_w[expand(r.first, gone)[0]], r.start_w[local], w.first[alone_row] + alone))
            removed = covered(starts, window, len(w.start))
            gone_words = np.concatenate(([0], np.cumsum(removed)))[w.first]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(w.counts.astype(np.int64)), pa.array(np.diff(gone_words).astype(np.int64)), kept_text(w, removed, spacing)], [*names, "_lag_n_words", "_lag_n_removed", "_lag_kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return decided.mapInArrow(remove, f"{schema}, _lag_n_words long, _lag_n_removed long, _lag_kept string")
