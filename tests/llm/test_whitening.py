"""LOBPCG whitening against numpy's eigenvectors."""

import numpy as np
import pytest

from lagline.llm.whitening import CERTIFIED, fit_whitening, lobpcg, whiten

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("width", [3, 12, 64, 150])
@pytest.mark.parametrize("spread", ["even", "steep", "equal"])
def test_eigenpairs(width, spread):
    rng = np.random.default_rng(width)
    q = np.linalg.qr(rng.standard_normal((width, width)))[0]
    value = {"even": np.linspace(2, 1, width), "steep": 10.0 ** -np.linspace(0, 9, width), "equal": np.where(np.arange(width) < width // 2, 2.0, 1.0)}[spread]
    m = (q * value) @ q.T
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return m @ block

    e, x, residual, steps = lobpcg(product, width, min(8, width))
    assert np.allclose(e, value[: len(e)], rtol=0, atol=1e-13 * 10) and residual <= CERTIFIED and steps == len(passes) < 120
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-13 and np.abs(m @ x - x * e).max() < 1e-11


def test_whitened_rows(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((400, 20)) * np.linspace(0.5, 0.05, 20) + rng.standard_normal(20)).astype(np.float32)
    rows = [(i if i % 7 else None, x.tolist()) for i, x in enumerate(v)] + [(2, v[2].tolist())] * 3
    rows += [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, [1.0] * 3), (905, [])]
    df = frame(spark, rows)
    model = fit_whitening(df)
    x = np.floor(1024 * np.array([r for i, r in rows if r and len(r) == 20 and None not in r and np.isfinite(r).all()])).astype(np.int64) + 100_000
    n = len(x)
    d = n * x - x.sum(0)
    value, vector = np.linalg.eigh((d.T @ d).astype(float) / n**3)
    value, vector = value[::-1][:8], vector[:, ::-1][:, :8]
    out = whiten(df, model).toPandas()
    assert n == 403 and len(out) == 8 * n and set(out["n"]) == {n} and not set(out["vec_id"].dropna()) & set(range(900, 906))
    want = d / n @ vector / np.sqrt(value)
    sign = np.sign((model.vectors * vector).sum(0))
    assert np.abs(model.whitened(x) * sign - want).max() < 1e-9
    for c in range(8):
        assert np.allclose(np.sort(out.loc[out["component"] == c + 1, "whitened"]), np.sort(want[:, c] * sign[c]), atol=1e-9)
    assert sorted(out.loc[out["component"] == 1, "deviation"]) == sorted((d * d).sum(1).tolist())
    assert 0 < model.identity_error < 1e-9 and abs(model.trace - np.square(d / n).sum() / n) < 1e-9 * model.trace


def test_few_vectors(spark):
    """Fewer independent directions than components; none at all."""
    assert whiten(frame(spark, []), fit_whitening(frame(spark, []))).count() == 0
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, None), (2, [])]):
        df = frame(spark, rows)
        assert whiten(df, fit_whitening(df)).count() == 0
    df = frame(spark, [(1, [0.0, 1.0, 0.5]), (2, [1.0, 1.0, 0.5]), (3, [2.0, 1.0, 0.5])])
    out = whiten(df, fit_whitening(df)).collect()
    assert sorted(r.vec_id for r in out) == [1, 2, 3] and all(r.component == 1 and abs(r.explained - 1) < 1e-12 for r in out)


def test_a_deviation_beyond_a_long_is_refused(spark):
    df = frame(spark, [(1, [1e12]), (2, [0.0])])
    with pytest.raises(Exception, match="beyond a long"):
        whiten(df, fit_whitening(df)).collect()
