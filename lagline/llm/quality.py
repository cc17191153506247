"""Quality rules: a hashed n-gram log-likelihood ratio beside plain counting rules.

Words and word pairs are hashed to a fixed number of buckets. Two multinomials
over the buckets are estimated: the raw corpus (every document) and the trusted
target (every document labelled good). A document's score is the mean over its
n-grams of log p_target - log p_raw; it is kept when that reaches a threshold
which is fixed once, on all labelled documents of the fifth that the target was
not estimated from (of several rows of one id the best score counts). There is
no random draw: the same document always gets the same verdict.

All labels count, and none passes through the driver: they are joined by id, to the
texts for the target (moved once, at any size, as labels grow with them) and to narrow rows of scores for the threshold, which comes from running counts over the
order of scores. Only bucket counts (bounded by n_buckets) and one row leave the executors.

Defined results: null and empty texts have zero counts and fail the base rules;
texts of any length are counted whole (one may exceed a block); repeated rows
each get a row; a null doc_id stays null; without labels of both kinds in that
fifth the threshold is minus infinity and only the base rules decide; an empty
table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running
from .common import id_array, lean
from .text import Words, blocks, covered, for_cut, group_counts, mix, per_doc, span_hashes, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


@dataclass(frozen=True)
class QualityParams:
    n_buckets: int = 1 << 16
    min_words: int = 50
    max_repeat_percent: int = 50
    prior: float = 0.5


def gram_buckets(w: Words, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word and word pair."""
    h = w.hashes()
    pairs, at = w.ngrams(h, 2)
    grams = np.concatenate((mix(h), pairs))
    return (grams % np.uint64(n_buckets)).astype(np.int64), np.concatenate((w.doc, w.doc[at]))


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """The counting rules' figures of every document of a block."""
    in_word = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(in_word, w.start, 1)
    np.add.at(in_word, w.end, -1)
    code_point = ((w.data & 0xC0) != 0x80) & (np.cumsum(in_word[:-1]) > 0)
    line_break = np.flatnonzero(w.data == 10)
    inner = w.offsets[1:-1]
    starts = np.unique(np.concatenate(([0], line_break + 1, inner)))
    starts = starts[starts < len(w.data)]
    doc = np.searchsorted(w.offsets, starts, side="right") - 1
    next_start = np.append(starts[1:], len(w.data))
    ends = np.where(w.data[next_start - 1] == 10, next_start - 1, next_start) if len(starts) else next_start[:0]
    has_word = np.searchsorted(w.start, next_start[: len(starts)]) > np.searchsorted(w.start, starts)
    starts, ends, doc = starts[has_word], ends[has_word], doc[has_word]
    key = mix(span_hashes(w.data, starts, ends) ^ mix(doc.astype(np.uint64)))
    seen_first = np.zeros(len(key), bool)
    seen_first[np.unique(key, return_index=True)[1]] = True
    grams, at = w.ngrams(w.hashes(), 3)
    often = group_counts(mix(grams ^ mix(w.doc[at].astype(np.uint64)))) > 1
    repeated = covered(at[often], 3, len(w.start)) if len(w.start) else np.zeros(0, bool)
    return {
        "n_words": w.counts,
        "word_chars": per_doc(code_point.astype(np.int64), w.offsets),
        "n_symbols": per_doc(SYMBOLS[w.data].astype(np.int64), w.offsets),
        "n_dup_lines": np.bincount(doc[~seen_first], minlength=w.docs),
        "n_repeat_words": per_doc(repeated.astype(np.int64), w.first),
    }


class QualityModel:
    """Bucket log-ratios and a threshold; fixed size."""

    def __init__(self, llr: np.ndarray, threshold: float, params: QualityParams):
        self.llr, self.threshold, self.params = llr, threshold, params

    def scores(self, w: Words) -> np.ndarray:
        bucket, doc = gram_buckets(w, self.params.n_buckets)
        n = np.bincount(doc, minlength=w.docs)
        return np.bincount(doc, self.llr[bucket], minlength=w.docs) / np.maximum(n, 1)


def best_cut(scored: DataFrame) -> float:
    """The cut c that makes "score >= c" separate y best (sensitivity + specificity): the middle of the gap there, the lowest of equally good ones; minus infinity where none is better than none.

    scored: score, y (0 or 1). Equal scores are counted into one row, and running counts tell what lies below each.
    """
    points = scored.groupBy("score").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    below = running(points, [], ["score"], {"good_below": "good", "bad_below": "bad"})
    whole = below.agg(F.sum("good").cast("double").alias("goods"), F.sum("bad").cast("double").alias("bads"))
    gain = F.col("bad_below") / F.nullif("bads", F.lit(0.0)) - F.col("good_below") / F.nullif("goods", F.lit(0.0))
    best = below.join(F.broadcast(whole), F.lit(True)).withColumn("gain", gain).where("gain > 0").orderBy(F.desc("gain"), "score").select("score").first()  # one row
    if best is None:
        return -np.inf
    under = points.where(F.col("score") < F.lit(best.score)).agg(F.max("score")).first()[0]
    return (under + best.score) / 2


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    size = params.n_buckets
    docs = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("y")).where("_id is not null and y is not null").groupBy("_id").agg(F.max("y").alias("y"))

    def count(cut: bool):
        """Counts grams; with cut, not those of the fifth that the threshold is chosen on."""

        def grams(batches):
            n = np.zeros(size, np.int64)
            for b in blocks(batches):
                if cut:
                    b = b.filter(pa.array(~for_cut(id_array(b)[0])))
                n += np.bincount(gram_buckets(words_of(b.column("text")), size)[0], minlength=size)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

        return grams

    trusted = docs.join(known.where("y = 1").hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi")
    counts = np.zeros((2, size))
    for k, (rows, cut) in enumerate(((docs, False), (trusted, True))):
        for bucket, n in rows.mapInArrow(count(cut), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # n_buckets rows at most
            counts[k, bucket] = n
    prior = params.prior
    share = (counts + prior) / (counts.sum(1, keepdims=True) + prior * size)
    model = QualityModel(np.log(share[1]) - np.log(share[0]), -np.inf, params)
    if not counts[1].any():
        model.llr[:] = 0
        return model

    def score(batches):
        for b in blocks(batches):
            ids, null = id_array(b)
            rows = np.flatnonzero(~null & for_cut(ids))
            if len(rows):
                w = words_of(b.column("text").take(pa.array(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(model.scores(w)), pa.array(w.counts)], ["id", "score", "n"])

    scored = docs.mapInArrow(score, "id long, score double, n long").where(f"n >= {params.min_words}").groupBy("id").agg(F.max("score").alias("score"))
    model.threshold = best_cut(scored.join(known, F.col("id") == F.col("_id")).select("score", "y"))
    return model


def quality_rules(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row a document: the counts, the score and the verdict."""
    p = model.params

    def judge(batches):
        for b in blocks(batches):
            w = words_of(b.column("text"))
            base, score = base_counts(w), model.scores(w)
            failed = (base["n_words"] < p.min_words) | (100 * base["n_repeat_words"] > p.max_repeat_percent * base["n_words"])
            kept = ~failed & (score >= model.threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *(pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(score), pa.array(kept)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"],
            )

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, SCHEMA)


def keep_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents, all columns as they are, that the rules keep; text need not be shuffled."""
    p = model.params

    def keep(batches):
        for b in blocks(batches):
            w = words_of(b.column("text"))
            base = base_counts(w)
            failed = (base["n_words"] < p.min_words) | (100 * base["n_repeat_words"] > p.max_repeat_percent * base["n_words"])
            yield b.filter(pa.array(~failed & (model.scores(w) >= model.threshold)))

    return lean(docs).mapInArrow(keep, docs.schema)
