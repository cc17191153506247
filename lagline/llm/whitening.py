"""Whitening of embeddings by the leading eigenvectors of their covariance, found by LOBPCG.

The covariance V is never formed. Each step is one pass over the vectors: centred
rows C are multiplied with a block of directions Q, and C'(CQ)/n, a matrix of
width x block numbers, is summed over tasks by dimension. A Rayleigh-Ritz problem
on the iterate, its residuals and the previous directions, a dense matrix of three
blocks at most, gives the next iterate. The basis is orthonormalised anew before
every pass and all of it is multiplied, so rounding errors don't add up over
steps. When the residuals ||Vv - ev|| are small, one more pass over the iterate
alone certifies them; then the whitened rows' covariance is measured in a pass of
its own, and only then rows are whitened.

Entries are whole numbers, x = floor(SCALE * c) + OFFSET, so sums are exact, and a
centred entry is (n * x - S) / n, rounded once. What a task holds is a batch of
rows and a matrix of width x block; the driver gets one row a dimension. The table
is read once a pass and not copied: give one that is cheap to read.

Defined results: vectors that are null or hold null or non-finite entries take no
part, and neither do vectors of another length than the commonest (of equally
common ones the smallest); null ids are kept; repeated rows count each time;
components are left out whose eigenvalue is zero but for rounding (a table of one
vector, or of equal ones, has none), so an empty table has no rows; components of
equal eigenvalues are any basis of their space; a deviation beyond a long is
refused with an error, not wrapped; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SCALE, OFFSET = 1024, 100_000
#: Residuals, relative to the largest eigenvalue: where steps end, and what is accepted if they get no smaller.
SMALL, CERTIFIED = 2e-14, 1e-10
#: Columns of the block beyond those asked for, and most steps.
SPARE, MAX_STEPS = 8, 200
#: Eigenvalues of at most this share of the largest are zero.
NOTHING = 1e-12


def entries(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that take part, and their whole numbers."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    value = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: not a number
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(value))))
    end = np.cumsum(length)
    rows = np.flatnonzero((length == width) & (bad[end] == bad[end - length]))
    at = (end - length)[rows][:, None] + np.arange(width)
    return rows, np.floor(SCALE * value[at]).astype(np.int64) + OFFSET


@dataclass
class Whitening:
    """What whitens a row: the number of vectors, their sums, components by column, eigenvalues."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float = 0.0
    residual: float = 0.0
    identity_error: float = 0.0
    steps: int = 0

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if self.n and len(x) and np.abs(self.n * x.astype(float) - self.sums).max() >= 2.0**62:
            raise OverflowError("n * x - S is beyond a long")
        return self.n * x - self.sums

    def deviation(self, x: np.ndarray) -> np.ndarray:
        d = self.differences(x)
        if len(d) and np.square(d.astype(float)).sum(1).max() >= 2.0**63 * (1 - 1e-9):
            raise OverflowError("a deviation is beyond a long")
        return (d * d).sum(1)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.differences(x) / float(self.n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def width_of(vectors: DataFrame, column: str) -> int:
    """The commonest length of the vectors that take part; 0 if there are none."""
    whole = F.col(column).isNotNull() & ~F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    found = vectors.where(whole).groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), "width").first()
    return found.width if found else 0


def _summed(vectors: DataFrame, column: str, width: int, rows: int, columns: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of of(x), a matrix of rows x columns, over the vectors' batches: summed inside a task, then by row over tasks."""
    names = [f"c{k}" for k in range(columns)]
    dtype, arrow = (np.float64, pa.float64()) if kind == "double" else (np.int64, pa.int64())

    def partial(batches):
        total = np.zeros((rows, columns), dtype)
        for b in batches:
            total += of(entries(b.column(0), width)[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *(pa.array(total[:, k], arrow) for k in range(columns))], ["row", *names])

    schema = "row long, " + ", ".join(f"{c} {kind}" for c in names)
    out = np.zeros((rows, columns), dtype)
    for row, *held in map_arrow(vectors.select(column), partial, schema).groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).collect():  # a row a dimension
        out[row] = held
    return out


def basis(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, those of the first as they are but for rounding; directions that add nothing are left out."""
    held = np.linalg.qr(blocks[0])[0]
    for b in blocks[1:]:
        size = np.linalg.norm(b, axis=0)
        b = b[:, size > 0] / size[size > 0]
        for _ in range(2):
            b = b - held @ (held.T @ b)
        if b.size and held.shape[1] < held.shape[0]:
            u, s, _ = np.linalg.svd(b, full_matrices=False)
            u = u[:, s > 1e-10 * max(1.0, s[0])][:, : held.shape[0] - held.shape[1]]
            u = u - held @ (held.T @ u)
            held = np.concatenate([held, np.linalg.qr(u)[0]], axis=1) if u.shape[1] else held
    return held


def lobpcg(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, spare: int = SPARE, small: float = SMALL, certified: float = CERTIFIED, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The leading eigenvalues and unit eigenvectors of the symmetric operator product(block), the largest residual relative to the largest eigenvalue, and the passes it took."""
    block = min(width, wanted + spare)
    s, of_x = np.linalg.qr(np.random.default_rng(0).standard_normal((width, block)))[0], block
    best, stalled = np.inf, 0
    for step in range(1, max_steps + 1):
        vs = product(s)
        small_problem = s.T @ vs
        value, c = np.linalg.eigh((small_problem + small_problem.T) / 2)
        value, c = value[::-1][:block], c[:, ::-1][:, :block]
        x = s @ c
        residuals = vs @ c - x * value
        top = max(value[0], 0.0)
        if top == 0.0:
            return value[:0], x[:, :0], 0.0, step
        found = float(np.linalg.norm(residuals[:, :wanted], axis=0).max() / top)
        if s.shape[1] == of_x and (found <= small or stalled >= 3) and found <= certified:  # measured on the iterate itself
            return value[:wanted], x[:, :wanted], found, step
        stalled = stalled + 1 if found > 0.5 * best and found <= certified else 0
        best = min(best, found)
        if found <= small or stalled >= 3:
            s, of_x = np.linalg.qr(x)[0], block
            continue
        directions = s[:, of_x:] @ c[of_x:]
        s, of_x = basis(x, residuals, directions), block
    raise RuntimeError(f"residuals did not settle: {best:.1e}")


def fit_whitening(vectors: DataFrame, components: int = 8, column: str = "embedding") -> Whitening:
    width = width_of(vectors, column)
    none = Whitening(0, np.zeros(width, np.int64), np.zeros((width, 0)), np.zeros(0))
    if not width:
        return none
    firsts = _summed(vectors, column, width, width, 2, lambda x: np.stack([np.full(width, len(x)), x.sum(0)], axis=1), "long")
    model = Whitening(int(firsts[0, 0]), firsts[:, 1], none.vectors, none.values)

    def times(q: np.ndarray) -> np.ndarray:
        def block(x: np.ndarray) -> np.ndarray:
            c = model.centred(x)
            return np.concatenate([c.T @ (c @ q), np.square(c).sum(0)[:, None]], axis=1)

        total = _summed(vectors, column, width, width, q.shape[1] + 1, block) / model.n
        model.trace = float(total[:, -1].sum())
        return total[:, :-1]

    value, vector, model.residual, model.steps = lobpcg(times, width, min(components, width))
    real = value > NOTHING * model.trace
    model.values, model.vectors = value[real], vector[:, real]
    k = len(model.values)
    if k:
        def spread(x: np.ndarray) -> np.ndarray:
            w = model.whitened(x)
            return np.concatenate([w.T @ w, w.sum(0)[:, None]], axis=1)

        held = _summed(vectors, column, width, k, k + 1, spread) / model.n
        model.identity_error = float(np.abs(held[:, :k] - np.outer(held[:, k], held[:, k]) - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row a vector and component."""
    k, width = len(model.values), len(model.sums)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    share = model.values / model.trace if k else model.values

    def apply(batches):
        for b in batches:
            rows, x = entries(b.column(1), width)
            if k and len(rows):
                n = len(rows) * k
                ids = b.column(0).take(pa.array(np.repeat(rows, k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(n, model.n)), pa.array(np.repeat(model.deviation(x), k)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(share, len(rows))), pa.array(np.full(n, model.identity_error))], names)

    return map_arrow(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), column), apply, schema)
