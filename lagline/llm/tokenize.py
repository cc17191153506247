"""Token ids of whole texts inside Arrow tasks, with a bounded cache of words.

Tokenizers here split a text before they merge, so the ids of a text are those
of its pieces in order, and a piece that occurs again need not be merged again.
The cache lives in the Python worker and is bounded; it changes speed only. The
ids are those of the library on the whole text.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np

from .text import LOWER, Words, words_in

MAX_CACHED_BYTES = 64
_loaded: dict[tuple, object] = {}


class WordCache:
    """Maps pieces of text to packed ids; encode_many gives the ids of a list of pieces as bytes of id_type."""

    def __init__(self, encode_many, id_type: np.dtype, max_entries: int = 500_000):
        self.encode_many, self.id_type, self.max_entries = encode_many, np.dtype(id_type), max_entries
        self.held: dict = {}

    def ids(self, pieces_of_texts: list[list]) -> list[np.ndarray]:
        """The ids of every text, given as a list of pieces."""
        distinct = set(chain.from_iterable(pieces_of_texts))
        held = self.held
        if len(held) + len(distinct) > self.max_entries:
            held.clear()
        missing = [p for p in distinct if p not in held]
        long: list = []
        if missing:
            held.update(zip(missing, self.encode_many(missing), strict=True))
            long = [p for p in missing if len(p) > MAX_CACHED_BYTES]
        get = held.__getitem__
        out = [np.frombuffer(b"".join(map(get, pieces)), self.id_type) for pieces in pieces_of_texts]
        for piece in long:
            del held[piece]
        return out


class WordTable:
    """Packed ids by word, in two generations: words that are met often stay, words that are met once go.

    encode_many gives the ids of a list of words as bytes of id_type.
    """

    def __init__(self, encode_many, id_type: np.dtype, max_entries: int = 600_000):
        self.encode_many, self.id_type, self.max_entries = encode_many, np.dtype(id_type), max_entries
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def look(self, words: list[bytes]) -> list[bytes]:
        out, now, before = list(map(self.now.get, words)), self.now, self.before
        missing = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            ids = before.get(words[k])
            if ids is None:
                missing.append(k)
            else:
                out[k] = now[words[k]] = ids
        if missing:
            for k, ids in zip(missing, self.encode_many([words[k] for k in missing]), strict=True):
                out[k] = ids
                if len(words[k]) <= MAX_CACHED_BYTES:
                    now[words[k]] = ids
        if len(now) > self.max_entries:
            self.before, self.now = now, {}
        return out

    def ids(self, w: Words) -> list[np.ndarray]:
        """The ids of every document of a block: each distinct word is looked up once, the rest is gathered."""
        if not len(w.start):
            return [np.zeros(0, self.id_type)] * w.docs
        _, first, word = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if not alike(w, first[word]):  # two words with one hash: each is its own
            first = word = np.arange(len(w.start))
        raw = w.data.tobytes()
        found = self.look([raw[a:z] for a, z in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.id_type.itemsize
        n = sizes[word]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat((np.cumsum(sizes) - sizes)[word] - ends[:-1], n) + np.arange(ends[-1])
        ids, edges = np.frombuffer(b"".join(found), self.id_type)[at], ends[w.first].tolist()
        return [ids[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]


def alike(w: Words, other: np.ndarray) -> bool:
    """Whether every word has the bytes of the word named beside it."""
    n = w.end - w.start
    if (n != n[other]).any():
        return False
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return bool((w.data[np.repeat(w.start, n) + within] == w.data[np.repeat(w.start[other], n) + within]).all())


class WordEndTokenizer:
    """A `tokenizers` file that lower-cases, and whose pre-tokenizer never looks across white space, drops it, and cuts between letters and marks."""

    def __init__(self, path: str):
        self.path = path

    def _table(self) -> WordTable:
        key = ("word-end", self.path)
        if key not in _loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            small = t.get_vocab_size(with_added_tokens=True) <= 1 << 16
            kind = np.dtype("<u2" if small else "<u4")

            def encode_many(words: list[bytes]) -> list[bytes]:
                """Words are encoded as one text with blanks between them; where a token stands tells whose it is."""
                out: list[bytes] = []
                for k in range(0, len(words), 4096):
                    some = b" ".join(words[k : k + 4096]).decode()
                    sizes = np.fromiter(map(len, some.split(" ")), np.int64)
                    e = t.encode(some, add_special_tokens=False)
                    begin = np.fromiter((o[0] for o in e.offsets), np.int64, len(e))
                    edge = np.append(np.searchsorted(begin, np.cumsum(sizes + 1) - sizes - 1), len(begin)) * kind.itemsize
                    raw, edge = np.array(e.ids).astype(kind).tobytes(), edge.tolist()
                    out += [raw[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
                return out

            _loaded[key] = WordTable(encode_many, kind)
        return _loaded[key]

    def ids(self, texts: Iterable[bytes]) -> list[np.ndarray]:
        # Words end at ASCII white space only, and only A-Z is lowered. Special tokens are found before the library
        # lower-cases, so where one may stand the case is left alone.
        texts = list(texts)
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        lowered = LOWER[data]
        for k in [k for k, t in enumerate(texts) if b"<|" in t]:
            lowered[offsets[k] : offsets[k + 1]] = data[offsets[k] : offsets[k + 1]]
        return self._table().ids(words_in(lowered, offsets))


class BytePairTokenizer:
    """A `tiktoken` rank file, byte-level: decoding gives the text back.

    The pattern puts a blank at the front of the word that follows, so a text can
    be cut before any single blank that stands between two other characters; where
    white space comes in runs, the run stays with the piece before and after it.
    """

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def encoding(self):
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("from-file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def _cache(self) -> WordCache:
        key = ("byte-pair", self.path, self.pattern)
        if key not in _loaded:
            e = self.encoding()
            code = "H" if e.n_vocab <= 1 << 16 else "I"
            _loaded[key] = WordCache(lambda pieces: [array(code, e.encode_ordinary(p)).tobytes() for p in pieces], np.dtype("<u2" if code == "H" else "<u4"))
        return _loaded[key]

    @staticmethod
    def pieces(text: str) -> list[str]:
        parts = text.split(" ")
        out = [parts[0]]
        for part in parts[1:]:
            before = out[-1]
            if not part or part[0].isspace() or not before or before[-1].isspace():
                out[-1] = f"{before} {part}"  # a run of white space: no cut here
            else:
                out.append(f" {part}")
        return out

    def ids(self, texts: Iterable[bytes]) -> list[np.ndarray]:
        return self._cache().ids([self.pieces(t.decode()) for t in texts])
