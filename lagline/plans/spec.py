"""Feature specifications: a name, the time direction and the expression.

The direction takes the place of a guard on names: a plan refuses whatever reads
the future unless it is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column, DataFrame


class Direction(str, Enum):
    PRIOR = "prior"
    ROW = "row"
    SYMMETRIC = "symmetric"
    FORWARD = "forward"


class FutureFeatureError(ValueError):
    pass


@dataclass(frozen=True)
class Feature:
    name: str
    expr: Column
    direction: Direction = Direction.PRIOR
    stage: int = 0


def guard(features: Iterable[Feature]) -> None:
    ahead = sorted(f.name for f in features if f.direction in (Direction.SYMMETRIC, Direction.FORWARD))
    if ahead:
        raise FutureFeatureError(f"features that read the future: {', '.join(ahead)}")


def later(features: Iterable[Feature], by: int) -> list[Feature]:
    """The same features some stages later; helpers of rows alone stay first."""
    return [f if f.stage < 0 else replace(f, stage=f.stage + by) for f in features]


def plan(df: DataFrame, features: Iterable[Feature], allow_future: bool = False) -> DataFrame:
    """Adds the features, one projection a stage.

    Inside a stage the frames ordered by (us, id) come first, so that their sort
    also serves the frames ordered by us; features of a later stage may use
    columns of an earlier one. Spark puts windows of one partitioning behind one exchange.
    """
    features = list(features)
    if not allow_future:
        guard(features)
    shared = {f.name: f for f in features if f.name.startswith("_")}  # helpers that several families bring along are the same
    features = [f for f in features if not f.name.startswith("_") or shared[f.name] is f]
    names = [f.name for f in features]
    if len(set(names)) != len(names):
        raise ValueError("feature names repeat")
    for stage in sorted({f.stage for f in features}):
        now = [f for f in features if f.stage == stage]
        taken = {f.name for f in now}
        df = df.select(*[c for c in df.columns if c not in taken], *[f.expr.alias(f.name) for f in now])
    return df
