"""The only place where window frames are defined.

Three tie rules exist and are never mixed:

* prior: rows before this one by (us, transaction_id), so earlier rows at the same time count;
* trailing: times in [t - w, t), so no row at the same time counts;
* backward and its mirror forward: trailing (or (t, t + w]) plus the rows at the
  same time that stand before (after) this one by transaction_id. RANGE accepts
  one order key, so these are sums of two frames.

`us` is epoch microseconds as a long; frame bounds are whole microseconds, both ends inclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

US, ID = "us", "transaction_id"


def ordered(*entity: str) -> WindowSpec:
    return Window.partitionBy(*entity).orderBy(US, ID)


def prior(*entity: str) -> WindowSpec:
    return ordered(*entity).rowsBetween(Window.unboundedPreceding, -1)


def trailing(entity: str, width: int) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(US).rangeBetween(-width, -1)


def around(entity: str, half: int) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(US).rangeBetween(-half, half)


def tied_before(entity: str) -> WindowSpec:
    return Window.partitionBy(entity, US).orderBy(ID).rowsBetween(Window.unboundedPreceding, -1)


def tied_after(entity: str) -> WindowSpec:
    return Window.partitionBy(entity, US).orderBy(ID).rowsBetween(1, Window.unboundedFollowing)


def rank_before(*entity: str) -> Column:
    """Number of prior rows of the entity."""
    return F.row_number().over(ordered(*entity)) - 1


def up_to(entity: str, us: int) -> WindowSpec:
    """All times up to t + us."""
    return Window.partitionBy(entity).orderBy(US).rangeBetween(Window.unboundedPreceding, us)


def total(f: Callable[[], Column], entity: str, low: int, high: int) -> Column:
    """f, a count or a sum of whole numbers, over times in [t + low, t + high]; 0 where there are none.

    It is the difference of two running values, so what a row costs does not grow with the window or the entity.
    """
    return F.coalesce(f().over(up_to(entity, high)), F.lit(0)) - F.coalesce(f().over(up_to(entity, low - 1)), F.lit(0))


def before(f: Callable[[], Column], entity: str) -> Column:
    """f (a count or a sum of whole numbers) over all earlier rows by (us, transaction_id)."""
    return F.coalesce(f().over(prior(entity)), F.lit(0))


def backward_sum(f: Callable[[], Column], entity: str, width: int, past: Column | None = None) -> Column:
    """f (a count or a sum of whole numbers) over [t - w, t) plus earlier rows at t: all earlier rows but for those older than t - w.

    past: before(f, entity), from a stage of its own. Its order by (us, transaction_id) then serves this frame too; together, each would sort the rows.
    """
    older = F.when(F.col(US).isNotNull(), f().over(up_to(entity, -width - 1)))  # rows without a time see those before them only
    return (before(f, entity) if past is None else past) - F.coalesce(older, F.lit(0))


def forward_sum(f: Callable[[], Column], entity: str, width: int) -> Column:
    """f (a count or a sum of whole numbers) over (t, t + w] plus later rows at t."""
    return total(f, entity, 1, width) + F.coalesce(f().over(tied_after(entity)), F.lit(0))
