"""The registered queries on the smallest tables: against SQL where there is some, else against plain versions of what the contracts fix."""

import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_dedup import plain_classes
from test_rules import ALNUM, PHRASES, plain_counts

from lagline.llm import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, D).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values([c for c in columns if c not in ("text", "mix_u")]).reset_index(drop=True) for x in (got, want))
    assert not [c for c in columns if not got[c].equals(want[c])] and len(got) == len(want)


def test_whitening(spark, duck):
    """Against numpy's eigenvectors of the exactly summed covariance."""
    held = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.floor(1024 * np.array([v for _, v in held], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    d = n * x - sums
    value, vector = np.linalg.eigh((d.T @ d).astype(float) / n**3)
    value, vector = value[::-1][:8], vector[:, ::-1][:, :8]
    got = registry.op11_lobpcg_whitening(spark, D).toPandas().sort_values(["vec_id", "component"])
    assert got["vec_id"].tolist() == [i for i, _ in held for _ in range(8)] and got["component"].tolist() == list(range(1, 9)) * n
    assert (got["n"] == n).all() and got["deviation"].tolist() == [s for s in (d * d).sum(1).tolist() for _ in range(8)]
    w, want = got["whitened"].to_numpy().reshape(n, 8), d / n @ vector / np.sqrt(value)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy().reshape(n, 8), value / (np.square(d / n).sum() / n), rtol=1e-10, atol=0)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


def test_toxic_scores(spark, texts):
    got = registry.op2_toxic_segments(spark, D).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_jaccard_classes(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op3_jaccard_classes(spark, D).collect()}
    assert got == plain_classes(list(texts.items()), 4, 85, 100)


def test_quality_counts(spark, texts):
    for r in registry.op5_quality_llr(spark, D).collect():
        n, *rest, repeat = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)


def test_license_places(spark, texts):
    for r in registry.op7_license_templates(spark, D).collect():
        words = ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        at = [k for p in PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        base = {v for p, v in PHRASES.items() if any(words[k : k + len(p.split())] == p.split() for k in range(len(words)))}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_shards(spark, texts):
    got = registry.op9_bounded_ring(spark, D).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode())) and r.law == "rows" and r.grown_shard is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_packed_sequences(spark, texts):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    whole, by, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), defaultdict(list), Counter()
    ids = {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    for r in registry.op10_best_fit(spark, D).collect():
        part = ids[r.doc_id][4096 * r.piece : 4096 * (r.piece + 1)]
        assert (r.start, r.length, r.ids_crc32) == (4096 * r.piece, len(part), zlib.crc32(part.tobytes()))
        by[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += 1
    assert pieces == {i: -(-len(x) // 4096) for i, x in ids.items()}
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) <= 1.03 * -(-sum(map(len, ids.values())) // 4096) + 1


def test_packed_rows(spark, texts):
    """Every document's ids, cut over rows, and back to its text."""
    pytest.importorskip("public_tokenizers")
    library, parts = registry.byte_tokenizer().encoding(), defaultdict(dict)
    for r in registry.op6_packed_ids(spark, D).collect():
        ids = np.frombuffer(r.input_ids, "<u2" if r.id_bytes == 2 else "<u4")
        assert len(ids) == 4096 and r.cu_seqlens[-1] == r.n_tokens
        for k, (d, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            parts[d][piece] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]
    assert set(parts) == set(texts)
    for i, t in texts.items():
        held = np.concatenate([parts[i][k] for k in range(len(parts[i]))])
        assert held[-1] == registry.BYTE_END and library.decode(held[:-1].tolist()) == t


def test_models_take_one_row_of_a_labelled_id(spark, docs, labels):
    """A labelled id that a third of the rows repeat."""
    from lagline.llm.quality import fit_quality
    from lagline.llm.toxicity import fit_toxicity

    hot = docs.where("doc_id = 0").crossJoin(spark.range(40)).drop("id")  # one row by forty
    more = docs.union(hot)
    assert np.isfinite(fit_quality(more, labels).threshold) == np.isfinite(fit_quality(docs, labels).threshold)
    assert fit_toxicity(more, labels).cut > 0


def test_operators_take_null_ids_and_empty_tables(spark, nothing):
    """What the contracts leave open: rows without an id, and no rows at all."""
    from lagline.llm.sharding import shard_documents
    from lagline.llm.suffix_automaton import remove_reference_passages
    from lagline.llm.token_output import packed_rows
    from lagline.llm.toxicity import fit_toxicity, score_toxicity

    rows = [(None, "a b c", "s"), (None, None, None), (None, "a b c", "s"), (4, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r.slot for r in shard_documents(df, 2).collect()) == [0, 0, 1, 1]
    assert score_toxicity(df, fit_toxicity(df, labels)).count() == 4
    reference = spark.createDataFrame([("a b",)], "text string")
    assert Counter(r.n_removed for r in remove_reference_passages(df, reference, 2).collect()) == {2: 2, 0: 2}
    assert remove_reference_passages(nothing, reference, 2).count() == 0
    P = pytest.importorskip("public_tokenizers")
    assert P and packed_rows(nothing, registry.byte_tokenizer(), 0).count() == 0
    assert Counter(d for r in packed_rows(df, registry.byte_tokenizer(), 0).collect() for d in r.doc_ids) == {None: 3, 4: 1}
