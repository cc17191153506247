"""Mixing, sharding, packing, token output and top-k search."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline.llm.mixing import mix_sources
from lagline.llm.packing import best_fit_layout, pack, pack_documents, places_in_size
from lagline.llm.sharding import ring, shard_documents, shard_rows, walk
from lagline.llm.token_output import CapacityTree, best_fit_decreasing, packed_rows
from lagline.llm.topk import TopkParams, top_k


def drawn_copies(data, seed="mix"):
    """(doc_id, text, source) rows: how many copies each draws, by inverting the distribution function term by term."""
    size, seen, out = Counter(), Counter(), []
    for _, t, s in data:
        size[s] += len((t or "").encode()) + 1
    weight = {s: math.sqrt(v) for s, v in size.items()}
    for i, t, s in data:
        rate = weight[s] / sum(weight.values()) * sum(size.values()) / size[s]
        key = f"{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}"
        u = int(hashlib.md5(f"{seed}:{key}:{seen[key]}".encode()).hexdigest()[:13], 16) / 2**52
        seen[key] += 1
        n, term, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            term *= rate / n
            total += term
        out.append(n)
    return out


def test_mixing_inverts_the_poisson_distribution(docs, rows):
    got = mix_sources(docs.withColumn("copy", F.lit(5)))
    want = {i: n for (i, *_), n in zip(rows, drawn_copies([(i, t, s) for i, t, _, s, _ in rows]), strict=True) if n}
    copies = got.groupBy("doc_id").agg(F.collect_set("copy").alias("c")).collect()
    assert {r.doc_id: len(r.c) for r in copies} == want
    assert all(sorted(r.c) == list(range(len(r.c))) for r in copies)


def test_mixing_of_repeated_and_missing_ids_and_clashing_columns(spark):
    """Rows without an id of their own draw apart, equal rows too; no column of the input is lost or mistaken for the operator's."""
    data = [(None, f"text {k % 40}", "s") for k in range(300)] + [(7, "x", "s")] * 200 + [(7, "y", "t")] * 20 + [(8, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    extra = {c: F.lit(6) for c in ("_n", "_at", "_cdf", "_source", "row", "rate", "cdf", "least", "at", "id", "hash", "nth")}
    got = mix_sources(df.withColumns(extra).withColumn("MIX_U", F.lit(1)).repartition(5))
    assert got.columns == ["doc_id", "text", "source", *extra, "copy", "mix_rate", "mix_u"]
    held = got.collect()
    assert all(r[c] == 6 for r in held for c in extra)
    want = Counter()
    for (i, t, _), n in zip(data, drawn_copies(data), strict=True):
        want[i, t] += n
    assert Counter((r.doc_id, r.text) for r in held) == +want
    assert len({r.mix_u for r in held if r.text == "x"}) > 50


def test_mixing_of_repeats_does_not_depend_on_row_order(spark):
    """200 rows of one id and text that differ in other columns: as SQL numbers them, in two row orders."""
    import duckdb

    from lagline.llm.registry import OP1_SQL

    data = [(7, "x", "en" if k % 3 else None, "s" if k % 2 else "t", k) for k in range(200)] + [(k, "y", "de", "s", 1) for k in range(20)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", data)
    want = sorted(con.sql(f"SELECT doc_id, n_chars, copy, mix_u FROM ({OP1_SQL})").fetchall())
    for rows in (data, data[::-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        assert sorted(tuple(r) for r in mix_sources(df).select("doc_id", "n_chars", "copy", "mix_u").collect()) == want


def test_mixing_large_rates_missing_weights_and_nothing(spark, nothing):
    df = spark.createDataFrame([(i, "x", "small") for i in range(20)] + [(100 + i, "x" * 2000, "big") for i in range(20)] + [(200, "x", None)], "doc_id long, text string, source string")
    for share, mean in ((1.0, 500), (9.0, 900), (39.0, 975)):  # rates below and above where the array starts at 0
        got = mix_sources(df.union(df.where("source = 'big'")), {"small": share, "big": 1.0}).groupBy("source").count().collect()
        n = {r.source: r["count"] for r in got}
        assert set(n) <= {"small", "big"} and abs(n["small"] / 40 / mean - 1) < 0.2 * (1 + (share == 1.0))
    assert mix_sources(nothing).count() == 0


def test_poisson_distribution_of_large_rates(spark):
    from lagline.llm.mixing import poisson_cdf

    rows = poisson_cdf(spark.createDataFrame([("a", 0.3), ("b", 999.0), ("c", 1000.0), ("d", 40_000.0)], "source string, rate double")).collect()
    for r in rows:
        k = np.arange(r.least, r.least + len(r.cdf))
        log_factorial = np.array([math.lgamma(x + 1) for x in k.tolist()])
        want = np.cumsum(np.exp(k * math.log(r.rate) - r.rate - log_factorial))
        assert np.abs(np.array(r.cdf) - want).max() < 1e-9 and r.cdf[-1] > 1 - 1e-9 and (r.least == 0) == (r.rate < 1000)


def test_ring_walk_is_full_and_gapless(docs, rows):
    got = shard_documents(docs, 24).collect()
    by = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in by.items())
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)


def test_ring_limits_movement_and_serves_heavy_keys(spark, nothing):
    keys = spark.range(3000).select(F.col("id").alias("key"))
    a, b = ({r.key: r.shard for r in shard_rows(keys, n).collect()} for n in (10, 11))
    moved = sum(a[k] != b[k] for k in a) / 3000
    assert moved < 0.15  # hashing modulo the number of shards moves ten elevenths
    heavy = keys.union(spark.range(1500).select(F.lit(7).cast("long").alias("key")))
    slots = Counter(r.shard for r in shard_rows(heavy, 10).collect())
    assert set(slots.values()) == {450}
    assert shard_documents(nothing).count() == 0
    assert len(ring(5, 16, 1 << 10)) == 80


def test_shards_of_rows_without_ids_and_clashing_columns(spark):
    """Rows that share an id, or have none, are spread over cells; no column of the input is mistaken for the operator's."""
    data = [(None, f"text {k}") for k in range(3000)] + [(5, f"other {k}") for k in range(2000)] + [(None, None)] * 500
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = shard_documents(docs, 10).collect()
    assert Counter(r.shard for r in got) == Counter({s: 550 for s in range(10)}) and len(got) == len(data)
    extra = {c: F.lit(6) for c in ("row", "cell", "copies", "begin", "end", "least", "limit", "first_slot", "rank", "_cell", "_copies")}
    clash = shard_rows(docs.withColumns(extra).withColumns({"Shard": F.lit(1), "slot": F.lit(2)}), 10)
    assert clash.columns == ["doc_id", "text", *extra, "shard", "slot"]
    assert all(r[c] == 6 for r in clash.collect() for c in extra) and len(set(r.slot for r in clash.collect())) == 550


def test_walk_takes_the_next_shard_with_room():
    nodes = np.array([(2, 0), (5, 1), (7, 2)])
    counts = np.zeros(8, np.int64)
    counts[1] = 9  # all keys lie before shard 0's node
    assert sorted((s, r) for _, r, s, _ in walk(counts, nodes, 3)) == [(0, 0), (1, 3), (2, 6)]


def letters():
    """A tokenizer for tests: one id a byte. Defined here so that it travels to the tasks by value."""

    class Letters:
        def ids(self, texts):
            return [np.frombuffer(t, np.uint8).astype("<u2") for t in texts]

    return Letters()


def test_packing_places_every_piece_once(docs, rows):
    got = pack_documents(docs, letters(), 256, 1).collect()
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    by = {}
    for r in got:
        ids = np.append(np.frombuffer(texts[r.doc_id], np.uint8), 1).astype("<u4")
        part = ids[r.piece * 256 : (r.piece + 1) * 256]
        assert (r.start, r.length, r.ids_crc32) == (r.piece * 256, len(part), zlib.crc32(part.tobytes()))
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter(r.doc_id for r in got) == {i: -(-(len(t) + 1) // 256) for i, t in texts.items()}
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by) <= 1.03 * -(-sum(r.length for r in got) // 256) + 1


@pytest.mark.parametrize("seed", range(5))
def test_layout_ranks_are_whole_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    np.add.at(counts, rng.integers(1, 101, 2000) if seed % 2 else rng.geometric(0.08, 2000).clip(1, 100), 1)
    layout = best_fit_layout(counts, 100)
    size = np.repeat(np.arange(101), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = layout.place(size, rank)
    used = np.zeros(layout.sequences, np.int64)
    np.add.at(used, sequence, size)
    assert used.max() <= 100 and used.min() > 0
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], size[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    assert (o[new] == 0).all() and (o[~new] == (o + n)[:-1][~new[1:]]).all()
    least = max(-(-size.sum() // 100), (size > 50).sum())
    assert layout.sequences <= 1.05 * least + 1


def test_places_in_size():
    rng, seen, n = np.random.default_rng(2), np.zeros(9, np.int64), Counter()
    for _ in range(5):
        sizes = rng.integers(1, 9, rng.integers(0, 30))
        want = []
        for x in sizes.tolist():
            want.append(n[x])
            n[x] += 1
        assert places_in_size(sizes, seen).tolist() == want


def test_packing_keeps_other_columns_and_one_common_size(spark):
    pieces = spark.range(3000).select((F.col("id") % 3 + 4).alias("length"), F.col("id").alias("_group"), F.lit("x").alias("_rank")).union(spark.range(2000).select(F.lit(10), F.lit(-1), F.lit("x"))).repartition(7)
    got = pack(pieces, 10)
    assert got.columns == ["length", "_group", "_rank", "sequence_id", "offset"]
    used = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("p")).collect()
    assert sum(r.n for r in used) == 35_000 and max(r.n for r in used) <= 10 and len(used) <= 3502
    assert all(p[0] == sum(x[1] for x in r.p[:k]) for r in used for k, p in enumerate(r.p))
    with pytest.raises(ValueError, match="reserved"):
        pack(pieces.withColumn("Offset", F.lit(1)), 10)


def test_packing_of_nothing_and_repeated_rows(spark, nothing):
    assert pack_documents(nothing, letters(), 16, 1).count() == 0
    df = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, None)], "doc_id long, text string")
    assert pack_documents(df, letters(), 16, 1).agg(F.sum("length")).first()[0] == 9


def test_tokenizers_equal_the_libraries(rows):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from lagline.llm.tokenize import BytePairTokenizer, WordEndTokenizer

    texts = [t or "" for _, t, *_ in rows] + ["A<|EndOfText|>b <|startoftext|>, it's. I'LL!' don't'. é, É. 'S … …, x…. １. ½! ͅa. ǅ. Σ. aΣ. İ! ﬁ. á. é, \x85. q\xa0.", "  two  blanks \n x\t\ty ", "क़. Ω."]
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = WordEndTokenizer(P.path("word_bpe_49k.json")).ids([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    pairs = BytePairTokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = pairs.encoding()
    got = pairs.ids([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [library.decode(g.tolist()) for g in got] == texts


def test_word_table_looks_each_word_up_and_forgets_the_rare(monkeypatch):
    from lagline.llm import tokenize
    from lagline.llm.text import words_in

    asked = []

    def encode(words):
        asked.extend(words)
        return [np.frombuffer(w, np.uint8).astype("<u2").tobytes() for w in words]

    table, rng = tokenize.WordTable(encode, np.dtype("<u2"), max_entries=8), np.random.default_rng(3)
    for step in range(40):
        texts = [b" ".join([b"often", *(b"w%d" % k for k in rng.integers(0, 90, rng.integers(0, 6)))]) if rng.random() < 0.9 else b"" for _ in range(3)] + [b"x" * 90]
        if step == 30:
            monkeypatch.setattr(tokenize.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))  # all words share a hash
        w = words_in(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
        assert [g.astype(np.uint8).tobytes() for g in table.ids(w)] == [t.replace(b" ", b"") for t in texts]
        assert len(table.now) <= 8 + 20 and len(table.before) <= 8 + 20
    assert asked.count(b"often") == 1


def test_token_output_round_trip(docs, rows):
    got = packed_rows(docs, letters(), 0, row_length=128, block_tokens=20_000).collect()
    texts, parts = {i: (t or "").encode() for i, t, *_ in rows}, {}
    assert len({r.sequence_id for r in got}) == len(got)
    for r in got:
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == (r.cu_seqlens if r.n_tokens < 128 else r.cu_seqlens[:-1])
        for k, (d, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            parts.setdefault(d, {})[piece] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]
    for i, t in texts.items():
        whole = np.concatenate([parts[i][k] for k in range(len(parts[i]))])
        assert whole[-1] == 0 and bytes(whole[:-1].astype(np.uint8)) == t


def test_segment_tree_finds_the_tightest_row():
    rng = np.random.default_rng(3)
    tree, held = CapacityTree(50), []
    for k in range(2000):
        if rng.random() < 0.5:
            room = int(rng.integers(1, 51))
            tree.add(room, k)
            held.append(room)
        else:
            n = int(rng.integers(1, 51))
            fits = [r for r in held if r >= n]
            got = tree.take(n)
            assert (got is None) == (not fits)
            if got:
                assert got[0] == min(fits)
                held.remove(got[0])
    row, n = best_fit_decreasing(np.array([6, 5, 5, 4]), 10)
    assert n == 2 and row[0] == row[3] and row[1] == row[2]


def plain_top_k(rows, k):
    """Counter of (query_id, rank, vec_id, score) over rows of (vec_id, vector), whole numbers of any size."""
    fine = []
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            fine.append((i, [math.floor(64 * float(np.float64(c))) for c in v]))
    out = Counter()
    for q, v in fine:
        if q % 20 == 0:
            scored = [(min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(v, y, strict=False)))), i) for i, y in fine if i != q]
            out.update((q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k]))
    return out


@pytest.mark.parametrize("params", [TopkParams(k=5, n_pivots=4, n_annuli=3, part_rows=16, query_rows=3), TopkParams(k=200)])
def test_top_k_equals_all_pairs(spark, params):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8)).round(3)
    x[40:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (504, [1.0]), (520, []), (None, [0.0] * 8), (20, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"block": F.lit("a"), "v": F.lit(1), "key": F.lit(2)}).repartition(3)
    got = Counter(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, params).collect())
    assert got == plain_top_k(rows, params.k)


@pytest.mark.parametrize("large", [2e6, 3e14, 1e160])
def test_top_k_of_large_components(spark, large):
    """Components far beyond those of embeddings take part, with exact scores; beyond a long, the largest long."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 5)).round(3)
    x[7, 2], x[8, 2], x[40, 1:3], x[41, 2] = large, -large, (large / 3, large), large * (1 + 2**-40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    p = TopkParams(k=4, n_pivots=5, n_annuli=3, part_rows=20)
    assert Counter(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, p).collect()) == plain_top_k(rows, 4)


def test_top_k_of_nothing(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
