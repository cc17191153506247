"""Jaccard classes, substring dedup, suffix automata and components against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lagline.llm.components import connected_components
from lagline.llm.jaccard import JaccardParams, jaccard_classes
from lagline.llm.substring import dedup_substrings
from lagline.llm.suffix_automaton import SuffixAutomaton, remove_reference_passages

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def plain_classes(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    u = Union(i for i, _ in sets)
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            n = len(a & b)
            if n and den * n >= num * (len(a) + len(b) - n):
                u.join(sets[x][0], sets[y][0])
    return {i: (len(s), u.root(i)) for i, s in sets}


@pytest.mark.parametrize("params", [JaccardParams(shingle=4, num=85), JaccardParams(), JaccardParams(shingle=3, num=60, max_posting=2), JaccardParams(shingle=2, num=50, max_posting=3, bitmap_bits=8)])
def test_classes_equal_all_pairs(docs, rows, params):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs.withColumn("item", F.lit(1)), params).collect()}
    assert got == plain_classes([r[:2] for r in rows], params.shingle, params.num, params.den)


def test_near_copies_far_from_each_other(spark):
    """A large family around a base: most pairs fail the threshold, links run through a few members."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 7])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = JaccardParams(shingle=3, num=80, max_posting=4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df, p).collect()}
    want = plain_classes(rows, 3, 80, 100)
    assert got == want and 1 < len({c for _, c in want.values()}) < 70


def test_classes_of_nothing_and_repeated_rows(spark, nothing):
    assert jaccard_classes(nothing).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (None, "z"), (9, None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, None), (3, 3), (7, 3), (7, 3), (9, 9)]


def plain_dedup(rows, window):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall((t or "").encode())
        gone = set()
        for s in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[s : s + window]), (i, s)) != (i, s):
                gone.update(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "gram"), [(20, 8), (5, 2), (9, 9)])
def test_substring_dedup(docs, rows, window, gram):
    held = dedup_substrings(docs, window, gram)
    assert held.columns[: len(docs.columns)] == docs.columns
    got = {r.doc_id: (r._lag_n_words, r._lag_n_removed, r.h) for r in held.withColumn("h", F.sha2("_lag_kept", 256)).collect()}
    want = plain_dedup([r[:2] for r in rows], window)
    assert got == want and sum(x[1] for x in want.values()) > 100


def test_kept_text_by_masks():
    import numpy as np
    import pyarrow as pa

    from lagline.llm.substring import kept_text
    from lagline.llm.text import words_of

    rng = random.Random(2)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(["a", "é", "bc", " ", "\n", "  "]) for _ in range(rng.randrange(12))) for _ in range(300)]
    w = words_of(pa.array(texts))
    removed = np.array([rng.random() < 0.4 for _ in w.start], bool)
    plain, spaced = (kept_text(w, removed, s).to_pylist() for s in (False, True))
    for d, t in enumerate(texts):
        raw, gone = (t or "").encode(), removed[w.first[d] : w.first[d + 1]]
        found = list(WORD.finditer(raw))
        assert plain[d].encode() == b" ".join(m[0] for m, g in zip(found, gone, strict=True) if not g)
        at = [m.start() for m in found] + [len(raw)]
        assert spaced[d].encode() == raw[: at[0]] + b"".join(raw[at[k] : at[k + 1]] for k in range(len(found)) if not gone[k])


def test_substring_dedup_in_small_blocks(docs, rows, monkeypatch):
    """Many blocks a partition: what one block settles alone must agree with what blocks settle together."""
    from lagline.llm import substring

    window = 6
    monkeypatch.setattr(substring, "BLOCK", 1500)
    got = {r.doc_id: r._lag_n_removed for r in substring.dedup_substrings(docs.coalesce(1), window, 3).collect()}
    assert got == {i: x[1] for i, x in plain_dedup([r[:2] for r in rows], window).items()}


def test_substring_dedup_of_nothing_and_repeated_rows(spark, nothing):
    assert dedup_substrings(nothing).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (6, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r._lag_n_removed) for r in dedup_substrings(df).collect())
    assert got == [(False, 0, 0), (True, 5, 30), (True, 5, 30), (True, 6, 30)]


@pytest.mark.parametrize("block", [700, 3 << 20])
def test_substring_dedup_of_different_texts_without_ids_of_their_own(spark, monkeypatch, block):
    """Rows that repeat a doc_id or have none are documents of their own; nothing that stands once is removed."""
    from lagline.llm import substring

    monkeypatch.setattr(substring, "BLOCK", block)
    rng = random.Random(12)
    words = lambda k: [f"v{rng.randrange(10**9)}" for _ in range(k)]
    shared = [words(12) for _ in range(4)]
    data = []
    for k in range(120):
        w = words(rng.randrange(0, 9)) + (shared[k % 4] if k % 3 else []) + words(rng.choice([0, 3, 40]))
        data.append((None if k % 2 else rng.choice([1, 2, 3]), " ".join(w)))
    data += data[:10]
    rng.shuffle(data)
    window = 6
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.text, r._lag_kept) for r in substring.dedup_substrings(df, window, 3).collect()]
    assert sorted((i is None, i or 0, t) for i, t, _ in got) == sorted((i is None, i or 0, t) for i, t in data)
    before = {tuple(w[s : s + window]) for w in (t.split() for _, t in data) for s in range(len(w) - window + 1)}
    after = [tuple(w[s : s + window]) for w in (k.split() for *_, k in got) for s in range(len(w) - window + 1)]
    after = [x for x in after if x in before]
    assert len(after) == len(set(after))  # no window stands twice
    kept = {x for *_, k in got for x in k.split()}
    assert kept == {x for _, t in data for x in t.split()}  # every word stands somewhere still
    once = Counter(x for _, t in dict.fromkeys(data) for x in t.split())
    for i, t, k in got:
        if data.count((i, t)) == 1:
            assert {x for x in t.split() if once[x] == 1} <= set(k.split())


def test_steady_blocks():
    import pyarrow as pa

    from lagline.llm.text import steady_blocks

    rng = random.Random(3)
    texts = [None if rng.random() < 0.1 else "x" * rng.choice([0, 5, 300, 2000]) for _ in range(200)]
    whole = pa.RecordBatch.from_pydict({"text": texts})

    def cut(rows):
        out = [b.column("text").to_pylist() for b in steady_blocks([whole.slice(k, rows) for k in range(0, 200, rows)], 1000)]
        assert [t for b in out for t in b] == texts and all(len(b) == 1 or sum(len(t or "") + 64 for t in b) <= 1000 for b in out)
        return out

    assert cut(1) == cut(7) == cut(200) and list(steady_blocks([], 10)) == []


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(200):
        refs = [[rng.randrange(3) for _ in range(rng.randrange(10))] for _ in range(3)]
        x = [rng.randrange(3) for _ in range(15)]
        parts = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max(k for k in range(i + 2) if k == 0 or tuple(x[i + 1 - k : i + 1]) in parts) for i in range(len(x))]
        assert SuffixAutomaton(refs).matches(x) == want


def test_reference_passages(spark, docs, rows):
    reference = spark.createDataFrame([(rows[1][1],), (None,), ("",), ("a b c",)], "text string")
    got = {r.doc_id: r.n_removed for r in remove_reference_passages(docs, reference, 20, shard_words=50).collect()}
    w = (rows[1][1] or "").split()
    windows = {tuple(w[k : k + 20]) for k in range(len(w) - 19)}
    for i, t, *_ in rows:
        x = WORD.findall((t or "").encode())
        x = [y.decode() for y in x]
        gone = {q for k in range(len(x) - 19) if tuple(x[k : k + 20]) in windows for q in range(k, k + 20)}
        assert got[i] == len(gone), i
    with pytest.raises(ValueError, match="at most"):
        remove_reference_passages(docs, reference, max_words=10)


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    u = Union({x for e in links for x in e})
    for a, b in links:
        u.join(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(u.root(n) == r for n, r in got.items())
    assert {n for n in u.up if u.root(n) != n} <= set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nodes_that_collide_are_told_apart(docs, rows):
    """Nodes of a few bits: almost all stand for several sets at first."""
    p = JaccardParams(shingle=3, num=60, max_posting=2, node_bits=4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs, p).collect()}
    assert got == plain_classes([r[:2] for r in rows], p.shingle, p.num, p.den)


def test_hot_posting_lists(spark):
    """Lists measured by grouped aggregates, in the first round and in later ones, give the same classes."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i if i % 9 else None, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("a")).repartition(7)
    want = plain_classes([(k, t) for k, (_, t) in enumerate(rows)], 3, 80, 100)  # by row number, as ids repeat
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[want[k][1]] = min(i, least.get(want[k][1], i))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(df, JaccardParams(shingle=3, num=80, max_posting=3, hot_posting=6)).collect())
    assert got == Counter((i, want[k][0], least.get(want[k][1])) for k, (i, _) in enumerate(rows))


def test_classes_of_very_long_near_copies_and_null_ids(spark, monkeypatch):
    from lagline.llm import text

    monkeypatch.setattr(text, "BLOCK_BYTES", 2000)
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, long), (4, long + " end"), (None, "a b c d e f g"), (None, "a b c d e f g"), (2, "")]
    got = Counter((r.doc_id, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, 4), (4, 4), (None, None), (None, None), (2, 2)])
