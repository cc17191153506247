r"""License scans by template-markup matching.

A template is text with markup: `<<optional>> ... <</optional>>` may be absent,
`<<var:N>>` stands for one to N replaceable words, `<<var:0-N>>` for none to N.
Everything else is mandatory wording and must match word for word. A template
is compiled to a token automaton (states are positions between tokens); a text
is accepted at a place when the automaton, started there, reaches its end.

Only places whose word is one of a template's possible first words start an
automaton, and an automaton reads at most its longest path, so a scan is one
pass over a text whatever its length. Nothing is shuffled.

Words are runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
Hashed words find candidate places; the bytes themselves decide.

Score: 1 where a whole licence or a standard notice is accepted, 0.75 where only a
title with its version or another short line is, 0.5 for a phrase alone, else 0.

Defined results: null or empty texts have no words and no labels (empty
strings, null places, score 0); texts of any length are scanned whole (one may
exceed a block); repeated rows each get a row; a null doc_id stays null; an empty
table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .text import NOT_ALNUM, Words, blocks, span_hashes, words_of

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"(<<optional>>|<</optional>>|<<var:(?:\d+-)?\d+>>)")

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: Phrase and the label it gives.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>><<var:1>> <</optional>>redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>><<var:1>> <</optional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
_BSD_WARRANTY = "this software is provided by <<var:20>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:20>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GPL_NOTICE = "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation <<optional>>either <</optional>>version {} of the license <<optional>>or at your option any later version <</optional>><<var:1-6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"

#: Templates in markup; their labels come beside the base ones.
TEMPLATES = {
    "gpl-3.0": "gnu general public license <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>>version 3",
    "gpl-2.0": "gnu general public license <<optional>>as published by the free software foundation <</optional>><<optional>>either <</optional>>version 2",
    "apache-2.0": "apache license <<optional>>version <</optional>>2 0",
    "cc-by-4.0": "cc by <<optional>>international <</optional>>4 0",
    "cc-by-nc-4.0": "cc by nc <<optional>>international <</optional>>4 0",
    "cc-by-sa-4.0": "cc by sa <<optional>>international <</optional>>4 0",
    "mit-notice": "<<optional>>released <</optional>><<optional>>licensed <</optional>>under the <<optional>>terms of the <</optional>>mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of <<var:8>> to deal in <<var:4>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of <<var:4>> and to permit persons to whom <<var:4>> is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph <</optional>>shall be included in all copies or substantial portions of <<var:4>> <<var:4>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var:20>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with <<var:4>> or the use or other dealings in <<var:4>>",
    "bsd-2-clause": _BSD_GRANT + _BSD_WARRANTY,
    "bsd-3-clause": _BSD_GRANT + "<<optional>><<var:1>> <</optional>>neither the <<var:16>> may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_WARRANTY,
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use <<var:4>> except in compliance with the license you may obtain a copy of the license at <<var:10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-2.0-notice": _GPL_NOTICE.format(2),
    "gpl-3.0-notice": _GPL_NOTICE.format(3),
    "cc-by-4.0-title": "creative commons attribution 4 0 international",
    "cc-by-nc-4.0-title": "creative commons attribution noncommercial 4 0 international",
    "cc-by-sa-4.0-title": "creative commons attribution sharealike 4 0 international",
    "copyright-notice": "copyright <<optional>>c <</optional>><<var:1>> <<optional>>by <</optional>><<var:0-6>> all rights reserved",
}

#: Templates of a line: they name a licence, or claim rights, and grant nothing by themselves.
LINES = {"gpl-3.0", "gpl-2.0", "apache-2.0", "cc-by-4.0", "cc-by-nc-4.0", "cc-by-sa-4.0", "mit-notice", "cc-by-4.0-title", "cc-by-nc-4.0-title", "cc-by-sa-4.0-title", "copyright-notice"}

#: Licences whose whole terms are a template, in license_texts/; all of their wording is mandatory.
BODIES = ("apache-2.0-text", "gpl-2.0-text", "gpl-3.0-text")


def body_templates() -> dict[str, str]:
    folder = resources.files(__package__) / "license_texts"
    return {label: (folder / f"{label}.txt").read_text(encoding="utf-8") for label in BODIES}


def tokens(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


@dataclass
class TokenAutomaton:
    """Non-deterministic automaton over words; None on an arc is any word."""

    arcs: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    end: int = 0

    @classmethod
    def compile(cls, template: str) -> "TokenAutomaton":
        a, opened = cls(), []
        for part in _MARK.split(template):
            if part == "<<optional>>":
                opened.append(a.end)
            elif part == "<</optional>>":
                a.skips[opened.pop()].append(a.end)
            elif part.startswith("<<var:"):
                low, _, high = part[6:-2].rpartition("-")
                for k in range(int(high)):
                    a._add(None, optional=k >= int(low or 1))
            else:
                for t in tokens(part):
                    a._add(t)
        if opened:
            raise ValueError(f"an optional region is not closed: {template!r}")
        if a.end in a.closure({0}):
            raise ValueError(f"a template without mandatory wording accepts every text: {template!r}")
        return a

    def _add(self, token: bytes | None, optional: bool = False) -> None:
        self.arcs.append([])
        self.skips.append([])
        self.arcs[self.end].append((token, self.end + 1))
        if optional:
            self.skips[self.end].append(self.end + 1)
        self.end += 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def first_words(self) -> set[bytes]:
        found = {token for s in self.closure({0}) for token, _ in self.arcs[s]}
        if None in found:
            raise ValueError("a template must begin with mandatory or optional wording, not with a replaceable region")
        return found

    def accepts(self, word_at, start: int, stop: int) -> bool:
        """Whether some path from word start ends before word stop; word_at(i) gives the bytes of word i."""
        states = self.closure({0})
        for i in range(start, stop):
            if self.end in states:
                return True
            word = word_at(i)
            states = self.closure({t for s in states for token, t in self.arcs[s] if token is None or token == word})
            if not states:
                return False
        return self.end in states


class LicenseScanner:
    def __init__(self, phrases: dict[str, str] = BASE_PHRASES, templates: dict[str, str] | None = None):
        templates = TEMPLATES | body_templates() if templates is None else templates
        self.phrases = [(tokens(p), label) for p, label in phrases.items()]
        self.automata = [(label, TokenAutomaton.compile(t)) for label, t in templates.items()]
        self.starts = {label: sorted(a.first_words()) for label, a in self.automata}

    @staticmethod
    def _hash(words: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(x) for x in words])
        return span_hashes(data, end - [len(x) for x in words], end)

    def scan(self, w: Words) -> dict[str, list]:
        h, n = w.hashes(), len(w.start)
        raw = w.data.tobytes()
        word_at = lambda i: raw[w.start[i] : w.end[i]]
        places: dict[int, list[int]] = {}
        base: dict[int, set[str]] = {}
        extra: dict[int, set[str]] = {}
        for phrase, label in self.phrases:
            k, keys = len(phrase), self._hash(phrase)
            if n < k:
                continue
            hit = w.doc[: n - k + 1] == w.doc[k - 1 :]
            for j in range(k):
                hit = hit & (h[j : n - k + 1 + j] == keys[j])
            for i in np.flatnonzero(hit).tolist():
                if all(word_at(i + j) == t for j, t in enumerate(phrase)):
                    d = int(w.doc[i])
                    places.setdefault(d, []).append(i - int(w.first[d]))
                    base.setdefault(d, set()).add(label)
        for label, automaton in self.automata:
            first = self._hash(self.starts[label])
            at = np.flatnonzero(np.isin(h, first)) if n else np.zeros(0, np.int64)
            at = self._plausible(automaton, h, at, n)
            for i in at.tolist():
                d = int(w.doc[i])
                if label not in extra.get(d, ()) and automaton.accepts(word_at, i, int(w.first[d + 1])):
                    extra.setdefault(d, set()).add(label)
        out = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for d in range(w.docs):
            at, b = places.get(d, []), base.get(d, set())
            both = b | extra.get(d, set())
            out["n_base"].append(len(at))
            out["first_word"].append(min(at) if at else None)
            out["last_word"].append(max(at) if at else None)
            out["base_labels"].append(",".join(sorted(b)))
            out["labels"].append(",".join(sorted(both)))
            found = extra.get(d, set())
            out["score"].append(1.0 if found - LINES else 0.75 if found else 0.5 if b else 0.0)
        return out

    def _plausible(self, automaton: TokenAutomaton, h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Of the places, those whose second word the automaton could also read; keeps common first words cheap."""
        after = {t for s in automaton.closure({0}) for _, t in automaton.arcs[s]}
        second = [token for s in automaton.closure(set(after)) for token, _ in automaton.arcs[s]]
        if not len(at) or None in second or automaton.end in automaton.closure(set(after)):
            return at
        inner = at[at + 1 < n]
        return inner[np.isin(h[inner + 1], self._hash(sorted(set(second))))]


def license_scan(docs: DataFrame, scanner: LicenseScanner | None = None) -> DataFrame:
    """One row a document: base phrases, template labels and a score."""
    scanner = scanner or LicenseScanner()

    def scan(batches):
        for b in blocks(batches):
            w = words_of(b.column("text"), NOT_ALNUM, lower=True)
            found = scanner.scan(w)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(w.counts.astype(np.int64)), *(pa.array(found[k], pa.int64()) for k in ("n_base", "first_word", "last_word")), *(pa.array(found[k], pa.string()) for k in ("base_labels", "labels")), pa.array(found["score"], pa.float64())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)
