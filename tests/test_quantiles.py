"""Exact quantiles and time-local percentiles against numpy and plain loops."""

import random

import numpy as np
import pytest

from lagline.functions.scalar import DAY
from lagline.operators.drift import local_percentile
from lagline.operators.metrics import univariate
from lagline.operators.ordered import quantile_values, quantiles, running

SHARES = [0, 0.02, 0.25, 0.5, 0.501, 0.98, 1]


def test_quantiles_equal_numpy(spark):
    """A group of most rows, one value that most of them have, null and tiny groups, infinities and nulls."""
    rng = random.Random(1)
    rows = [("hot" if i % 4 else rng.choice(["a", "b", None]), 7.25 if rng.random() < 0.6 else rng.gauss(0, 1e6)) for i in range(4000)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None), ("a", None), ("wide", -1e300), ("wide", 1e300), ("wide", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles(df, ["g"], "v", SHARES).collect()}
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert set(got) == set(by)
    for g, held in by.items():
        assert got[g].n == len(held) and got[g].quantiles == pytest.approx(np.quantile(held, SHARES).tolist(), rel=1e-12)
    assert quantile_values(df, "v", [0.5]) == pytest.approx([np.median([v for _, v in rows if v is not None])])
    assert quantile_values(df.where("v > 1e301"), "v", [0.5, 1]) == [None, None]


def test_running_sums_in_both_directions(spark):
    rows = [(i % 3, i, i * 7 % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, v long, n long").repartition(4)
    for descending in (False, True):
        got = {(r.g, r.v): r.s for r in running(df, ["g"], ["v"], {"s": "n"}, descending).collect()}
        assert got == {(g, v): sum(n for h, w, n in rows if h == g and (w > v if descending else w < v)) for g, v, _ in rows}


@pytest.mark.parametrize("days", [1, 3, 14])
def test_local_percentiles_equal_loops(spark, days):
    """Days with gaps, one of them with a third of the rows; equal values over days; nulls."""
    rng = random.Random(days)
    rows = [(i, (rng.choice([0, 1, 2, 5, 5, 5, 9, 30, 31]) * 24 + rng.randrange(24)) * DAY // 24, None if i % 11 == 0 else float(rng.choice([5, rng.randrange(1000)]))) for i in range(600)]
    df = spark.createDataFrame(rows, "transaction_id long, us long, x double").repartition(5)
    got = {r.transaction_id: r.p for r in local_percentile(df, "x", "p", days).collect()}
    number = {d: k for k, d in enumerate(sorted({us // DAY for _, us, _ in rows}))}
    for i, us, x in rows:
        d = number[us // DAY]
        refs = [v for _, t, v in rows if v is not None and d - days <= number[t // DAY] < d]
        assert got[i] == (None if x is None or not refs else pytest.approx(sum(v < x for v in refs) / len(refs)))
    assert local_percentile(df.where("us < 0"), "x", "p").count() == 0


def test_medians_fill_what_is_missing(spark):
    rows = [(k % 2, k % 5 == 0, None if k % 3 == 0 else float(k), None) for k in range(60)]
    df = spark.createDataFrame([(a, int(b), c, d) for a, b, c, d in rows], "period int, label int, x double, empty double")
    median = float(np.median([c for *_, c, _ in rows if c is not None]))
    filled = df.fillna({"x": median})
    got, want = ({(r.period, r.sign): r.ap for r in univariate(d, ["x"], "period").collect()} for d in (df, filled))
    assert got == want and len(got) == 4
    assert univariate(df, ["x", "empty"], "period").where("feature = 'x'").count() == 4
