import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lagline.llm.text import NOT_ALNUM, SPACES, blocks, group_counts, span_hashes, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t#中\x1c", max_size=30)), max_size=8)


def found(texts, delimiters, lower):
    w = words_of(pa.array(texts, pa.string()), delimiters, lower)
    raw = w.data.tobytes()
    return [[raw[w.start[k] : w.end[k]] for k in range(w.first[d], w.first[d + 1])] for d in range(len(texts))], w


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    raw = [(t or "").encode() for t in texts]
    assert found(texts, SPACES, False)[0] == [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in raw]
    assert found(texts, NOT_ALNUM, True)[0] == [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for t in raw]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_equal_words_hash_equal_wherever_they_stand(texts):
    words, w = found(texts, SPACES, False)
    flat, h = [x for d in words for x in d], w.hashes().tolist()
    assert len(set(zip(flat, h, strict=True))) == len(set(flat)) == len(set(h))
    grams, at = w.ngrams(w.hashes(), 2)
    pairs = [(flat[k], flat[k + 1]) for k in at]
    assert len(set(pairs)) == len(set(grams.tolist())) and all(w.doc[k] == w.doc[k + 1] for k in at)


def test_blocks_keep_every_row_and_long_texts_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (10, 5000, 3, 0, 900)] + [None])], ["text"])
    out = list(blocks([batch], max_bytes=1000))
    assert [x for b in out for x in b.column(0).to_pylist()] == batch.column(0).to_pylist() and len(out) > 2
    assert list(blocks([batch.slice(0, 0)])) == []


def test_group_counts_and_empty_input():
    assert group_counts(np.array([3, 1, 3, 3])).tolist() == [3, 1, 3, 3]
    empty = np.zeros(0, np.int64)
    assert len(group_counts(empty)) == 0 and len(span_hashes(np.zeros(0, np.uint8), empty, empty)) == 0
