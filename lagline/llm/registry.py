"""The driver's queries over the operators of this subpackage.

Each query applies its operator to its whole table and shapes the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .jaccard import JaccardParams, jaccard_classes
from .licenses import license_scan
from .main_text import fit_pages, main_text
from .merkle import audit_documents
from .mixing import mix_sources
from .packing import pack_documents
from .quality import fit_quality, quality_rules
from .sharding import shard_documents
from .substring import dedup_substrings
from .suffix_automaton import remove_reference_passages
from .token_output import packed_rows
from .topk import top_k
from .tokenize import BytePairTokenizer, WordEndTokenizer
from .toxicity import fit_toxicity, score_toxicity
from .whitening import fit_whitening, whiten

#: Ids of the closing token: the contract's, and the free id of the byte-level vocabulary.
PACK_END, BYTE_END = 1, 50256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_tokenizer() -> WordEndTokenizer:
    return WordEndTokenizer(tokenizer_path("word_bpe_49k.json"))


def byte_tokenizer() -> BytePairTokenizer:
    import public_tokenizers

    return BytePairTokenizer(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).withColumn("mix_rate", F.round("mix_rate", 9))


OP1_SQL = """
WITH d AS (SELECT *, strlen(coalesce(text, '')) + 1 AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size FROM d GROUP BY source),
r AS (SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM s),
k AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT)) AS k FROM r),
t AS (SELECT source, rate, k, k * ln(rate) - rate - sum(CASE WHEN k > 0 THEN ln(greatest(k, 1)) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS log_term FROM k),
c AS (SELECT source, rate, k, sum(exp(log_term)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY md5(concat_ws(':', coalesce(lang, 'null'), coalesce(n_chars::VARCHAR, 'null'), coalesce(source, 'null')))) - 1 AS nth FROM d),
u AS (SELECT n.*, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || nth), 1, 13))::BIGINT / 4503599627370496.0 AS mix_u FROM n)
SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, c.k::INTEGER AS copy, round(c.rate, 9) AS mix_rate, u.mix_u
FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.mix_u
"""


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op5_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), JaccardParams(shingle=4, num=85, den=100))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_lag_n_words").alias("n_words"), F.col("_lag_n_removed").alias("n_removed"), F.sha2("_lag_kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) AS k FROM w WHERE len(ws) >= 20),
d AS (SELECT doc_id, s FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM d),
a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
k AS (SELECT a.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM a ANTI JOIN c USING (doc_id, pos) GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


#: Words in a row that a document must share with an evaluation item before they are removed.
REFERENCE_WORDS = 13


def op4_reference_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix automata at work: documents against the benchmark, a reference of bounded size."""
    found = remove_reference_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), REFERENCE_WORDS)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


REFERENCE_SQL = rf"""
WITH b AS (SELECT regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT unnest(list_transform(range(1, len(ws) - {REFERENCE_WORDS - 2}), lambda i: array_to_string(ws[i:i + {REFERENCE_WORDS - 1}], ' '))) AS k FROM b WHERE len(ws) >= {REFERENCE_WORDS}),
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - {REFERENCE_WORDS - 2})) AS s, unnest(list_transform(range(1, len(ws) - {REFERENCE_WORDS - 2}), lambda i: array_to_string(ws[i:i + {REFERENCE_WORDS - 1}], ' '))) AS k FROM w WHERE len(ws) >= {REFERENCE_WORDS}),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + {REFERENCE_WORDS})) AS pos FROM p SEMI JOIN g USING (k)),
a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
k AS (SELECT a.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM a ANTI JOIN c USING (doc_id, pos) GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"), byte_tokenizer(), BYTE_END)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer(), 4096, PACK_END)


def op11_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit_whitening(vectors))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, audited after n_chars has grown by one where 7 divides the id's checksum."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return audit_documents(table(spark, sf_dir, "documents"), F.col("n_chars") + F.when(hit, 1).otherwise(0))


OP12_SQL = """
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
  list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(strlen(t::VARCHAR) || ':' || t, '-') || tail) AS now
  FROM (SELECT *, n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS t FROM f)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS hs FROM p GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(hs), 2), lambda k: sha256(hs[k + 1] || coalesce(hs[k + 2], ''))) FROM t WHERE len(hs) > 1),
s AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE len(hs) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS hs FROM s
  UNION ALL SELECT level + 1, list_transform(range(0, len(hs), 2), lambda k: sha256(hs[k + 1] || coalesce(hs[k + 2], ''))) FROM u WHERE len(hs) > 1),
steps AS (SELECT doc_id, leaf, t.level AS level, (p.pos >> t.level) & 1 AS side, coalesce(t.hs[xor(p.pos >> t.level, 1) + 1], '') AS h FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang AND len(t.hs) > 1
  UNION ALL SELECT doc_id, leaf, 1000 + u.level, (s.pos >> u.level) & 1, coalesce(u.hs[xor(s.pos >> u.level, 1) + 1], '') FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN u ON len(u.hs) > 1),
w AS (SELECT doc_id, leaf, list({'side': side, 'h': h} ORDER BY level) AS path FROM steps GROUP BY doc_id, leaf),
v AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT hs[1] FROM u WHERE len(hs) = 1) AS root, sha256(array_to_string(list_transform(coalesce(w.path, []), lambda x: x.h), '')) AS proof_sha256,
  list_reduce(list_prepend({'side': 0, 'h': p.now}, coalesce(w.path, [])), lambda a, x: {'side': 0, 'h': CASE WHEN x.side = 1 THEN sha256(x.h || a.h) ELSE sha256(a.h || x.h) END}).h AS folded_root
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN w ON p.doc_id IS NOT DISTINCT FROM w.doc_id AND p.leaf = w.leaf)
SELECT *, folded_root = root AS verified FROM v
"""


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit_pages(pages))


#: For pages as the test tables have them: one article of headings and paragraphs.
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g')) AS blocks FROM a),
d AS (SELECT page_id, url, list_transform(blocks, lambda x: regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS blocks FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_poisson_mixing": op1_poisson_mixing,
        "op2_toxic_segments": op2_toxic_segments,
        "op3_jaccard_classes": op3_jaccard_classes,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_quality_llr": op5_quality_llr,
        "op6_packed_ids": op6_packed_ids,
        "op7_license_templates": op7_license_templates,
        "op8_pivot_topk": op8_pivot_topk,
        "op9_bounded_ring": op9_bounded_ring,
        "op10_best_fit": op10_best_fit,
        "op4_reference_passages": op4_reference_passages,
        "op11_lobpcg_whitening": op11_lobpcg_whitening,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_main_text": op13_main_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_poisson_mixing": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op4_reference_passages": REFERENCE_SQL, "op8_pivot_topk": OP8_SQL, "op12_merkle_manifest": OP12_SQL, "op13_main_text": OP13_SQL}
