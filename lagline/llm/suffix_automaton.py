"""Passages of a bounded reference, found by suffix automata.

The reference is cut into shards of about shard_words words. A suffix automaton
of each shard is built once and travels with the tasks; documents are streamed
past every shard for matching statistics (the longest reference match that ends
at each word), and maximal spans of at least `threshold` words are removed.

The work is documents times shards. That is the right price for a reference of
bounded size (an evaluation set); max_words is that bound, at about 1 KB a word in
each worker, and a larger reference is refused. A corpus against itself goes
through substring.py.

Defined results: null texts have no words; texts of any length are streamed whole
(one may exceed a block); reference rows that are null or shorter than the threshold
match nothing; repeated rows each get a result; a null doc_id stays null; an empty
reference removes nothing; an empty table gives an empty table; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .text import blocks, words_of


class SuffixAutomaton:
    """Of several sequences of whole numbers; a match never runs over the end of one."""

    def __init__(self, sequences: Iterable[Iterable[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, symbol: int, to: int) -> int:
        """A copy of state `to` for the shorter contexts that reach it from `at` on."""
        copy = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while at >= 0 and self.next[at].get(symbol) == to:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][symbol]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, symbol, to)
        return new

    def matches(self, symbols: Iterable[int]) -> list[int]:
        """For each symbol, the length of the longest match that ends there."""
        at, n, out = 0, 0, []
        for symbol in symbols:
            while at and symbol not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            to = self.next[at].get(symbol)
            at, n = (0, 0) if to is None else (to, n + 1)
            out.append(n)
        return out


def long_spans(lengths: list[int], threshold: int) -> np.ndarray:
    """Marks the words of all matches of at least threshold words."""
    covered = np.zeros(len(lengths) + 1, np.int64)
    n = np.asarray(lengths, np.int64)
    end = np.flatnonzero(n >= threshold)
    np.add.at(covered, end - n[end] + 1, 1)
    np.add.at(covered, end + 1, -1)
    return np.cumsum(covered[:-1]) > 0


def remove_reference_passages(docs: DataFrame, reference: DataFrame, threshold: int = 20, shard_words: int = 50_000, max_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed and kept text of every document; reference has a column text."""
    size = reference.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))), F.lit(0)).alias("n")).first().n
    if size > max_words:
        raise ValueError(f"the reference has {size} words; at most {max_words} are allowed")
    texts = [r.text for r in reference.where("text is not null").orderBy("text").collect()]  # max_words words at most
    shards: list[list[np.ndarray]] = [[]]
    held = 0
    for text in texts:
        h = words_of(pa.array([text])).hashes()
        if held and held + len(h) > shard_words:
            shards.append([])
            held = 0
        shards[-1].append(h)
        held += len(h)

    def stream(batches):
        automata = [SuffixAutomaton(h.tolist() for h in shard) for shard in shards]
        for b in blocks(batches):
            w = words_of(b.column("text"))
            h, kept, removed = w.hashes().tolist(), [], []
            raw = w.data.tobytes()
            for d in range(w.docs):
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                gone = np.zeros(hi - lo, bool)
                for a in automata:
                    gone |= long_spans(a.matches(h[lo:hi]), threshold)
                kept.append(b" ".join(raw[w.start[k] : w.end[k]] for k in (lo + np.flatnonzero(~gone)).tolist()).decode())
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(w.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stream, "doc_id long, n_words long, n_removed long, kept string")
