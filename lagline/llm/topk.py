"""Exact top-k by inner product with a pivot-distance index.

Components become whole numbers floor(scale * x), so scores are exact. With M at
least the greatest squared norm, a vector x is lifted to (x, sqrt(M - |x|^2)) and
a query q to (q, 0); then |q' - x'|^2 = |q|^2 + M - 2 q.x, and the nearest lifted
vectors are those of the largest inner product.

Index: every vector is keyed by its nearest pivot and its distance r to it; the
distances of a pivot are cut into annuli. A block is (pivot, annulus); blocks
with many rows are split into parts, so no task holds an unbounded block. Pivots
are a bounded sample; every vector is indexed.

Search: the distance from a query to a block is at least its gap to the annulus
[r_min, r_max] around the pivot (triangle inequality). A query first visits its
blocks in the order of that bound until they hold k vectors besides its own;
their k-th best score is a floor. It then visits just the blocks whose bound
still allows that floor, ties included, and stops there: no block left out can
hold a better or equal score. The directory of blocks and the pivots are of
fixed size (n_pivots * n_annuli) and travel with the tasks.

Shuffle: the visits of each block are counted first. A block's queries are dealt
to groups of about query_rows, and a part of the index is sent once to each group
that visits its block, to none if nobody does. What is moved is in proportion to
the visits, not to vectors times queries.

Exactness: products are of doubles where the norms prove every sum below 2 ** 52,
else of whole numbers of any size.

Defined results: vectors that are null, or hold a null or non-finite component (or
one that overflows a double when scaled), take no part as query or candidate; a
null vec_id takes no part; rows that repeat a vec_id are candidates one by one, but
none for a query of that id, and each such query row gets its own answer; a vector
shorter than another counts as followed by zeros; a score that a long can't hold
becomes the largest or smallest long; with fewer than k candidates all are
returned; an empty table gives no rows; other columns are not read, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, stored

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Queries whose bounds are worked out at once: about ten matrices of this by the number of blocks.
BOUND_ROWS = 256


@dataclass(frozen=True)
class TopkParams:
    k: int = 20
    scale: float = 64.0
    n_pivots: int = 64
    n_annuli: int = 16
    part_rows: int = 4096
    query_rows: int = 2048


def matrix(vectors) -> np.ndarray:
    """Vectors as rows; shorter ones are followed by zeros."""
    vectors = [np.asarray(v, np.float64) for v in vectors]
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices without the columns that only one has: they add nothing to a product."""
    n = min(a.shape[1], b.shape[1])
    return a[:, :n], b[:, :n]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as longs; what a long can't hold becomes the one next to it."""
    q, x = alike(q, x)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None]
        out = q @ x.T
    fine = norms < 2.0**52
    if fine.all():
        return np.rint(out).astype(np.int64)
    exact = np.where(fine, out, 0).round().astype(np.int64)
    for i in np.flatnonzero(~fine.all(axis=1)).tolist():
        own = [int(c) for c in q[i]]
        for j in np.flatnonzero(~fine[i]).tolist():
            exact[i, j] = min(MOST, max(LEAST, sum(a * int(b) for a, b in zip(own, x[j].tolist(), strict=True) if a)))
    return exact


class PivotDirectory:
    """Pivots and the blocks around them; fixed size. Works on vectors divided by unit, whose squared norms are top at most."""

    def __init__(self, pivots: np.ndarray, unit: float, top: float, p: TopkParams):
        self.pivots, self.unit, self.top, self.p = pivots / unit, unit, top, p
        self.square = (self.pivots**2).sum(1)
        self.lift = np.sqrt(np.maximum(0, top - self.square))
        self.width = max(1e-9, np.sqrt(top) / p.n_annuli)
        self.pivot = self.count = self.low = self.high = self.block = np.zeros(0, np.int64)

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances of rows to all pivots; queries have lift 0."""
        norm = (x**2).sum(1)
        own = np.sqrt(np.maximum(0, self.top - norm)) if lifted else np.zeros(len(x))
        a, b = alike(x, self.pivots)
        square = (norm + own**2)[:, None] + (self.square + self.lift**2)[None] - 2 * (a @ b.T + own[:, None] * self.lift[None])
        return np.sqrt(np.maximum(0, square))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x / self.unit, True)
        pivot = d.argmin(1)
        r = d[np.arange(len(x)), pivot]
        return pivot * self.p.n_annuli + np.minimum(r / self.width, self.p.n_annuli - 1).astype(np.int64), r

    def load(self, rows) -> None:
        rows = sorted(tuple(r) for r in rows)
        self.block, self.count = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.low, self.high = (np.array([r[i] for r in rows]) for i in (2, 3))
        self.pivot = self.block // self.p.n_annuli

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest score that each block can hold for each query, rounded up; in units squared."""
        q = q / self.unit
        square = (q**2).sum(1)[:, None]
        d = self.distances(q, False)[:, self.pivot]
        gap = np.maximum(0, np.maximum(self.low[None] - d, d - self.high[None]) - 1e-6 * (1 + d))
        return (square + self.top - gap**2) / 2 + 1e-6 * (1 + self.top + square)

    def floors(self, floor: np.ndarray) -> np.ndarray:
        """Scores as the bounds have them, rounded down."""
        f = floor.astype(np.float64)
        return np.where(floor == LEAST, -np.inf, (f - 1e-9 * np.abs(f)) / self.unit / self.unit)

    def visits(self, q: np.ndarray, floor: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, place of the block in the directory) pairs: the first blocks that hold k vectors besides the query's own; else all others that can reach the floor."""
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        enough = np.concatenate((np.ones((len(q), 1), bool), held[:, :-1] < self.p.k + 1), axis=1)
        at_first = np.zeros_like(enough)
        np.put_along_axis(at_first, order, enough, axis=1)
        return np.nonzero(at_first if first else ~at_first & (bound >= self.floors(floor)[:, None]))


def whole_vectors(vectors: DataFrame, p: TopkParams) -> DataFrame:
    """vec_id, v (whole numbers, as doubles): the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double") * F.lit(p.scale))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(F.forall("x", finite))
    floor = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)  # noqa: E731  larger doubles are whole
    return fine.select("vec_id", F.transform("x", floor).alias("v"))


def top_k(vectors: DataFrame, is_query, params: TopkParams = TopkParams()) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every query row; is_query is a condition on vec_id."""
    p = params
    spark = lean(vectors).sparkSession
    whole = whole_vectors(vectors, p)
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    size = whole.agg(F.max(norm).alias("norm"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(F.size("v")).alias("length")).first()
    if size.norm is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    unit, top = (1.0, size.norm * (1 + 1e-9)) if size.norm < 1e200 else (size.most, float(size.length))
    chosen = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.n_pivots).collect()
    directory = PivotDirectory(matrix(r.v for r in chosen), unit, top, p)

    def index(frames):
        for f in frames:
            if len(f):
                block, r = directory.keys(matrix(f["v"]))
                yield f.assign(block=block, r=r)

    indexed = whole.mapInPandas(index, "vec_id long, v array<double>, block long, r double")
    directory.load(indexed.groupBy("block").agg(F.count(F.lit(1)), F.min("r"), F.max("r")).collect())  # n_pivots * n_annuli rows at most
    n_blocks = p.n_pivots * p.n_annuli
    parts = np.zeros(n_blocks, np.int64)
    parts[directory.block] = -(-directory.count // p.part_rows)

    def with_counts(rows: DataFrame, counts: np.ndarray, name: str) -> DataFrame:
        """rows with their block's count; rows of blocks without one go. The table has n_blocks rows at most."""
        few = spark.createDataFrame([(b, int(n)) for b, n in enumerate(counts.tolist()) if n], f"block long, {name} long")
        return rows.join(F.broadcast(few), "block")

    numbered = with_counts(indexed, parts, "parts").withColumn("part", F.pmod(F.monotonically_increasing_id(), "parts"))
    placed = stored(numbered.select("vec_id", "v", "block", "part"), "index")
    queries = stored(whole.where(is_query).withColumn("key", F.monotonically_increasing_id()), "queries")

    def in_slices(frames):
        for f in frames:
            for at in range(0, len(f), BOUND_ROWS):
                yield f.iloc[at : at + BOUND_ROWS]

    def met(asked: DataFrame, first: bool) -> DataFrame:
        """asked: key, vec_id, v, floor. The best rows of every part that a query visits."""

        def counted(frames):
            n = np.zeros(n_blocks, np.int64)
            for f in in_slices(frames):
                _, at = directory.visits(matrix(f["v"]), f["floor"].to_numpy(), first)
                np.add.at(n, directory.block[at], 1)
            block = np.flatnonzero(n)
            yield pd.DataFrame({"block": block, "n": n[block]})

        def visiting(frames):
            for f in in_slices(frames):
                row, at = directory.visits(matrix(f["v"]), f["floor"].to_numpy(), first)
                for k in range(0, len(row), 4 * BOUND_ROWS):
                    some, block = row[k : k + 4 * BOUND_ROWS], directory.block[at[k : k + 4 * BOUND_ROWS]]
                    yield pd.DataFrame({"key": f["key"].to_numpy()[some], "query_id": f["vec_id"].to_numpy()[some], "q": f["v"].to_numpy()[some], "floor": f["floor"].to_numpy()[some], "block": block, "parts": parts[block], "groups": groups[block]})

        n = np.zeros(n_blocks, np.int64)
        for block, visits in asked.mapInPandas(counted, "block long, n long").groupBy("block").agg(F.sum("n")).collect():  # n_blocks rows at most
            n[block] = visits
        groups = -(-n // p.query_rows)
        seen = asked.mapInPandas(visiting, "key long, query_id long, q array<double>, floor long, block long, parts long, groups long")
        up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        seen = seen.withColumn("part", up_to("parts")).withColumn("g", F.pmod(F.xxhash64("key"), "groups"))
        sent = with_counts(placed, groups, "groups").withColumn("g", up_to("groups"))
        keys = ("block", "part", "g")
        return seen.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(best_of, "key long, query_id long, vec_id long, score long")

    def best_of(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, x = matrix(asked["q"]), matrix(held["v"])
        held_ids, out = held["vec_id"].to_numpy(), []
        for at in range(0, len(q), BOUND_ROWS):
            some = asked.iloc[at : at + BOUND_ROWS]
            scores = products(q[at : at + BOUND_ROWS], x)
            for key, query_id, floor, row in zip(some["key"], some["query_id"], some["floor"], scores, strict=True):
                fit = np.flatnonzero((held_ids != query_id) & (row >= floor))
                best = fit[np.lexsort((held_ids[fit], ~row[fit]))[: p.k]]  # ~ reverses the order of all longs
                out.append((np.full(len(best), key), np.full(len(best), query_id), held_ids[best], row[best]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("key", "query_id", "vec_id", "score"))})

    first = stored(met(queries.withColumn("floor", F.lit(LEAST).cast("long")), True), "first")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == p.k).select("key", F.col("score").alias("floor"))
    rest = met(queries.join(floors, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST).cast("long"))), False)
    ranked = first.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
