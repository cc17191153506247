"""Vectorised text primitives that run inside Arrow tasks.

One Arrow string column becomes one byte buffer plus word boundaries, so that
hashing, counting and n-grams are numpy operations over a whole block of
documents. Words are runs of bytes outside a delimiter set; the delimiters are
ASCII, so UTF-8 sequences are never cut.

Defined results: a null text is an empty text; an empty text has no words;
texts of any length are processed whole (one text may exceed the block size).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release

BLOCK_BYTES = 1 << 20
#: Delimiters of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Delimiters of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_MULT, _MULT_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def for_cut(ids: np.ndarray) -> np.ndarray:
    """Marks the fifth of all ids that thresholds are chosen on; nothing else is learned from them."""
    return mix(ids.astype(np.uint64)) % np.uint64(5) == 0


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every data[start:end]; equal bytes give equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every n consecutive entries of h, in order; has len(h) - n + 1 entries."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, np.uint64(mix(np.array([seed + n], np.uint64))[0]), np.uint64)
    for j in range(n):
        out = (out ^ h[j : j + m]) * _MULT
        out ^= out >> np.uint64(32)
    return mix(out)


@dataclass
class Words:
    """Words of a block of documents; word k is data[start[k]:end[k]] of document doc[k]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first[d]: index of the first word of document d; has a closing entry

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def ngrams(self, h: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams inside one document, and the word at which each starts."""
        g = ngram_hashes(h, n, seed)
        at = np.flatnonzero(self.doc[: len(g)] == self.doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        return g[at], at


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and len + 1 offsets into it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, delimiters: np.ndarray = SPACES, lower: bool = False) -> Words:
    data, offsets = buffer_of(texts)
    return words_in(LOWER[data] if lower else data, offsets, delimiters)


def words_in(data: np.ndarray, offsets: np.ndarray, delimiters: np.ndarray = SPACES) -> Words:
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~delimiters[data]
    starts, ends = inside.copy(), np.zeros(n + 1, bool)
    starts[1:] &= ~inside[:-1]
    ends[1:] = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]  # a word never runs over the end of its document
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts - 1]]
    starts[both] = ends[both] = True
    start, end = np.flatnonzero(starts[:n]), np.flatnonzero(ends)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, doc, first)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of each piece hold about max_bytes at most; one longer text is a piece."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            at = 0
            while at < batch.num_rows:
                past = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + max_bytes, side="right")))
                yield batch.slice(at, past - at)
                at = past
    finally:
        _shrink()


def steady_blocks(batches: Iterable[pa.RecordBatch], max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """blocks() whose cuts depend on the rows and their order only, not on where a record batch ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            total, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                room = max_bytes - size + (int(total[at - 1]) if at else 0)
                past = int(np.searchsorted(total, room, side="right"))
                past = max(past, at if held else at + 1)  # one longer text is a block
                if past > at:
                    held.append(batch.slice(at, past - at))
                    size += int(total[past - 1]) - (int(total[at - 1]) if at else 0)
                at = past
                if at < batch.num_rows:
                    yield pa.concat_batches(held) if len(held) > 1 else held[0]
                    held, size = [], 0
        if held:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
    finally:
        held.clear()
        _shrink()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into pieces of at most so many rows, so that only a piece is held as Python objects."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        _shrink()


def _shrink() -> None:
    """At the end of a task: the power tables of a very long text go, and free memory goes back to the system."""
    if len(_powers[0]) > 4 * BLOCK_BYTES:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    release()


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for every d."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def group_counts(keys: np.ndarray) -> np.ndarray:
    """For every entry, how many entries are equal to it."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1], [True])))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.diff(edge), np.diff(edge))
    return out


def covered(start: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks positions 0..n-1 that lie in some [s, s + length)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, np.minimum(start + length, n), -1)
    return np.cumsum(delta[:n]) > 0
