"""The quality model learns from every label, and its cut is that of plain code over all of them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lagline.llm.common import youden_threshold
from lagline.llm.quality import QualityParams, best_cut, fit_quality, gram_buckets
from lagline.llm.text import for_cut, words_of


@pytest.mark.parametrize("kind", ["mixed", "equal", "reversed", "one"])
def test_cut_equals_plain_code(spark, kind):
    rng = random.Random(3)
    rows = {
        "mixed": [(rng.randrange(12) / 8 + y / 2, y) for y in (0, 1) for _ in range(60)],
        "equal": [(0.5, k % 2) for k in range(8)],
        "reversed": [(1.0 - k % 2, k % 2) for k in range(8)],
        "one": [(k / 8, 1) for k in range(8)],
    }[kind]
    held = sorted(rows)
    want = youden_threshold(np.array([s for s, _ in held]), np.array([y for _, y in held]))
    assert best_cut(spark.createDataFrame(rows, "score double, y int").repartition(3)) == want


def test_every_label_is_learned_from(spark):
    """More labels than the 20,000 that a sample once kept: of a word in all good documents, none is missed."""
    n = 26_000
    docs = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'fine words' ELSE 'poor stuff' END AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(1 - id % 2 AS int) AS quality")
    p = QualityParams()
    model = fit_quality(docs, labels, p)
    good = int((~for_cut(np.arange(0, n, 2))).sum())
    bucket = gram_buckets(words_of(pa.array(["fine"])), p.n_buckets)[0][0]
    want = np.log((good + p.prior) / (3 * good + p.prior * p.n_buckets)) - np.log((n / 2 + p.prior) / (3 * n + p.prior * p.n_buckets))
    assert good > 10_000 and model.llr[bucket] == pytest.approx(want, rel=1e-9)
