"""Toxicity by maximum-scoring segments over token log-odds.

Features of a token are the hashed word and its hashed stem (its first bytes, up
to the end of a character).
Fitting counts the documents that have a feature, three ways: over all documents
(the informative Dirichlet prior) and over the toxic and the clean rows of a
bounded labelled sample; a word that one document repeats counts once. A
feature's log-odds and its z-score follow from the three counts, and a token
takes those of its more significant feature. Features without a significant
difference score only the drift, a small negative constant, so that the
expected score of clean text is negative.

Scoring walks every whole text once: all maximal scoring segments (the
linear-time stack algorithm for "all maximal scoring subsequences") are found
over its runs of positive tokens, each gets an extreme-value P-value
1 - exp(-n exp(-lambda S)) with lambda from the score distribution of clean
text that no feature was learned from, and the significant ones are the passages. A word repeated over and over is
a passage, but not ever more evidence: a segment's weight is that of its best part
in which each feature counts max_repeats times at most, so it depends on the
segment alone and not on what stands elsewhere in the text. The weights are
aggregated by the sum statistic of several segments. The document's evidence t = -log P becomes t / (t + c), so 0.5 is the decision.
The cut c, and how significant a feature must be, are those with the best F1 on
a fifth of the sample from which no feature was learned; of several rows of one
labelled id the one with the most evidence counts there.

Bounds: n_buckets counts and max_labels labelled rows leave the executors; no
text is shuffled. Only text enters a score.

Defined results: null and empty texts have no tokens and score 0; texts of any
length are scanned whole (one may exceed a block); repeated rows each get a row,
and of several labels of an id the largest counts; a null doc_id stays null;
without both kinds of labels every score is 0; an empty table gives an empty
table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LabelledSample, best_f1_threshold, id_array, lean
from .text import NOT_ALNUM, Words, blocks, for_cut, mix, span_hashes, words_of

SEGMENTS = "array<struct<first:int,last:int,score:double,p_value:double>>"


@dataclass(frozen=True)
class ToxicityParams:
    n_buckets: int = 1 << 17
    max_labels: int = 40_000
    prior_strength: float = 2_000.0
    min_z: tuple[float, ...] = (2.5, 4.0, 6.0)
    min_log_odds: float = 1.5
    stem_bytes: int = 5
    max_repeats: int = 2
    drift: float = 0.1
    alpha: float = 0.01


def token_buckets(w: Words, p: ToxicityParams) -> np.ndarray:
    """Buckets of each token's features, as two rows: the word, and its stem (a word no longer than a stem is its own)."""
    end = np.minimum(w.end, w.start + p.stem_bytes)
    for _ in range(3):  # a character has at most three bytes after its first
        inside = end < w.end
        inside[inside] = w.data[end[inside]] & 0xC0 == 0x80
        end = end + inside
    stem = span_hashes(w.data, w.start, end)
    return np.stack([(h % np.uint64(p.n_buckets)).astype(np.int64) for h in (w.hashes(), mix(stem + np.uint64(1)))])


def document_counts(bucket: np.ndarray, doc: np.ndarray, n_buckets: int) -> np.ndarray:
    """How many documents have each bucket."""
    return np.bincount(np.unique(doc.astype(np.int64) * n_buckets + bucket) % n_buckets, minlength=n_buckets)


def log_odds(toxic: np.ndarray, clean: np.ndarray, background: np.ndarray, p: ToxicityParams, min_z: float) -> tuple[np.ndarray, np.ndarray]:
    """Feature scores and z-scores from bucket counts with a Dirichlet prior in proportion to the background."""
    prior = p.prior_strength * (background + 0.5) / (background.sum() + 0.5 * len(background))
    a, b = toxic + prior, clean + prior
    total_a, total_b = a.sum(), b.sum()
    delta = np.log(a / (total_a - a)) - np.log(b / (total_b - b))
    z = delta / np.sqrt(1 / a + 1 / b)
    return np.where((np.abs(z) >= min_z) & (np.abs(delta) >= p.min_log_odds), delta, 0.0) - p.drift, z


def decay_rate(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1; the scale of the extreme-value law."""
    live = share > 0
    score, share = score[live], share[live] / share[live].sum()
    if not (score > 0).any() or (share * score).sum() >= 0:
        return 1.0
    excess = lambda x: float((share * np.exp(np.minimum(x * score, 700))).sum()) - 1
    high = 1e-3
    while excess(high) < 0 and high < 1e3:
        high *= 2
    low = 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score), left to right; linear time."""
    positive = score > 0
    if not positive.any():
        return []
    total = np.concatenate(([0.0], np.cumsum(score)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    held: list[list] = []  # [first, end, total before, total after, link to the nearest held segment with a lower start]
    for first, end in runs:
        item = [first, end, float(total[first]), float(total[end]), -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= item[2]:
                j = held[j][4]
            item[4] = j
            if j < 0 or held[j][3] >= item[3]:
                held.append(item)
                break
            item = [held[j][0], item[1], held[j][2], item[3], -1]
            del held[j:]
    return [(a, b - 1, hi - lo) for a, b, lo, hi, _ in held]


def damped(value: np.ndarray, feature: np.ndarray, most: int, drift: float) -> float:
    """The best sum over consecutive entries in which a feature counts most times at most; further positive entries of it score -drift.

    Entries with a negative feature always count. The first entry of the part moves from right to left; each step gives
    one entry its value back and takes that of the entry most places on in its feature. A tree holds (sum, best prefix).
    """
    hot = np.flatnonzero(feature >= 0)
    if not len(hot):
        return max(0.0, float(value.max(initial=0.0)))
    total = np.concatenate(([0.0], np.cumsum(value)))
    gap = (total[hot[1:]] - total[hot[:-1] + 1]).tolist() + [0.0]  # what stands between an entry and the next; none is positive
    own, seen = value[hot].tolist(), {}
    size = 1 << max(0, len(hot) - 1).bit_length()
    sums, best = [0.0] * (2 * size), [0.0] * (2 * size)

    def put(k: int, x: float) -> None:
        k_gap, k = gap[k], k + size
        sums[k], best[k] = x + k_gap, max(0.0, x)
        k >>= 1
        while k:
            sums[k] = sums[2 * k] + sums[2 * k + 1]
            best[k] = max(best[2 * k], sums[2 * k] + best[2 * k + 1])
            k >>= 1

    found = 0.0
    for k in range(len(hot) - 1, -1, -1):
        places = seen.setdefault(int(feature[hot[k]]), [])
        places.append(k)
        if len(places) > most:
            put(places[-1 - most], -drift)
        put(k, own[k])
        found = max(found, best[1])
    return found


class ToxicityModel:
    """Scores and z-scores of the buckets of words and stems, and constants; fixed size."""

    def __init__(self, score: np.ndarray, z: np.ndarray, params: ToxicityParams, decay: float = 1.0):
        self.score, self.z, self.decay, self.params = score.astype(np.float32), np.abs(z).astype(np.float32), decay, params
        self.cut = -math.log(params.alpha)

    def scored(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Score of every token, and the feature it comes from where it is positive, else -1."""
        word, stem = token_buckets(w, self.params)
        by_word = self.z[0][word] >= self.z[1][stem]
        s = np.where(by_word, self.score[0][word], self.score[1][stem]).astype(float)
        return s, np.where(s > 0, np.where(by_word, word, stem + self.params.n_buckets), -1)

    def tokens(self, w: Words) -> np.ndarray:
        return self.scored(w)[0]

    def weight(self, s: np.ndarray, feature: np.ndarray, total: float) -> float:
        """What a segment's score of total counts for as evidence: the same, unless it repeats a feature more than max_repeats times."""
        hot = feature[feature >= 0]
        if len(hot) <= self.params.max_repeats or np.unique(hot, return_counts=True)[1].max() <= self.params.max_repeats:
            return total
        return damped(s, feature, self.params.max_repeats, self.params.drift)

    def passages(self, s: np.ndarray, feature: np.ndarray) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Evidence of a text from its token scores, and its significant passages (first word, last word, score, P-value)."""
        n, found, strong, best = len(s), [], [], -math.inf
        p_value = lambda x: -math.expm1(-math.exp(min(-x, 700)))
        for first, last, total in maximal_segments(s):
            p = p_value(self.decay * total - math.log(n))
            if p <= self.params.alpha:
                found.append((first, last, total, p))
            x = self.decay * self.weight(s[first : last + 1], feature[first : last + 1], total) - math.log(n)
            best = max(best, x)
            if p_value(x) <= self.params.alpha:
                strong.append(x)
        if best == -math.inf:
            return 0.0, found
        alone = best if best > 30 else -math.log(-math.expm1(-math.exp(-best))) if best > -6 else math.exp(-math.exp(min(-best, 6.5)))
        if len(strong) < 2:
            return alone, found
        x, r = sum(strong), len(strong)
        log_p = -x + (r - 1) * math.log(max(x, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r)
        return max(alone, -log_p), found

    def evidence(self, w: Words) -> tuple[np.ndarray, list[list[tuple[int, int, float, float]]]]:
        (s, feature), out, spans = self.scored(w), np.zeros(w.docs), [[] for _ in range(w.docs)]
        for d in np.unique(w.doc[s > 0]).tolist():
            at = slice(w.first[d], w.first[d + 1])
            out[d], spans[d] = self.passages(s[at], feature[at])
        return out, spans


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), held_out_of: int = 5) -> ToxicityModel:
    """Learns from labelled rows whose crc32(doc_id as text) mod held_out_of is not 0."""
    sample = LabelledSample(labels, "toxic", params.max_labels, F.crc32(F.col("doc_id").cast("string")) % held_out_of != 0)
    size = params.n_buckets
    docs = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batches):
        found = np.zeros((2, 3, size), np.int64)
        for b in blocks(batches):
            w = words_of(b.column("text"), NOT_ALNUM, lower=True)
            ids = id_array(b)[0]
            y = np.where(for_cut(ids), -1, sample.lookup(ids))[w.doc]
            for into, bucket in zip(found, token_buckets(w, params), strict=True):
                for row, chosen in zip(into, (slice(None), y == 1, y == 0), strict=True):
                    row += document_counts(bucket[chosen], w.doc[chosen], size)
        for k in range(2):
            at = np.flatnonzero(found[k, 0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at + k * size, *found[k][:, at])], ["bucket", *names])

    names = ("background", "toxic", "clean")
    totals = docs.mapInArrow(count, "bucket long, background long, toxic long, clean long").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names))
    counts = np.zeros((3, 2, size))
    for bucket, *row in totals.collect():  # 2 * n_buckets rows at most
        counts[:, bucket // size, bucket % size] = row
    if not counts[1].any() or not counts[2].any():
        return ToxicityModel(np.full((2, size), -params.drift), np.zeros((2, size)), params)
    models = []
    for min_z in params.min_z:
        fitted = [log_odds(counts[1, k], counts[2, k], counts[0, k], params, min_z) for k in range(2)]
        models.append(ToxicityModel(np.stack([f[0] for f in fitted]), np.stack([f[1] for f in fitted]), params))

    def labelled(batches, wanted):
        for b in blocks(batches):
            ids = id_array(b)[0]
            y = sample.lookup(ids)
            rows = np.flatnonzero((y >= 0) & wanted(ids, y))
            if len(rows):
                yield ids[rows], y[rows], words_of(b.column("text").take(pa.array(rows)), NOT_ALNUM, lower=True)

    high, step = 16.0, 0.02
    bins = int(2 * high / step) + 1

    def spread(batches):
        found = np.zeros((len(models), bins), np.int64)
        for _, _, w in labelled(batches, lambda ids, y: (y == 0) & for_cut(ids)):
            for row, m in zip(found, models, strict=True):
                row += np.bincount(np.clip(np.round((m.tokens(w) + high) / step), 0, bins - 1).astype(np.int64), minlength=bins)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found.ravel()[at])], ["bin", "n"])

    share = np.zeros(len(models) * bins)
    for at, n in docs.mapInArrow(spread, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a constant number of bins
        share[at] = n
    for m, row in zip(models, share.reshape(-1, bins), strict=True):
        m.decay = decay_rate(np.arange(bins) * step - high, row)

    def weigh(batches):
        for ids, y, w in labelled(batches, lambda ids, y: for_cut(ids)):
            for k, m in enumerate(models):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k)), pa.array(ids), pa.array(m.evidence(w)[0]), pa.array(y.astype(np.int32))], ["k", "id", "t", "y"])

    weighed = docs.mapInArrow(weigh, "k long, id long, t double, y int")
    seen = weighed.groupBy("k", "id", "y").agg(F.max("t").alias("t")).toPandas()  # a row a labelled id and model: max_labels bounds it, also where ids repeat
    best, chosen = -1.0, models[0]
    for k, m in enumerate(models):
        t, y = (seen.loc[seen["k"] == k, c].to_numpy() for c in ("t", "y"))
        cut = best_f1_threshold(t, y)
        if np.isfinite(cut) and cut > 0:
            m.cut, hit = cut, t >= cut
            f1 = 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + y.sum())
            if f1 > best:
                best, chosen = f1, m
    return chosen


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted and the significant passages of every document."""

    def judge(batches):
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
        for b in blocks(batches):
            t, spans = model.evidence(words_of(b.column("text"), NOT_ALNUM, lower=True))
            score = t / (t + model.cut)
            passages = pa.array([[dict(zip(("first", "last", "score", "p_value"), s, strict=True)) for s in found] for found in spans], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), passages], ["doc_id", "score", "predicted", "passages"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, f"doc_id long, score double, predicted int, passages {SEGMENTS}")
