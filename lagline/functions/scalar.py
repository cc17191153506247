"""Scalar expressions shared by the feature families."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND


def dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def over_eps(x: Column | str, y: Column) -> Column:
    """x / (y + EPS); null where y is null. Never a division by zero for y >= 0."""
    return dbl(x) / (dbl(y) + F.lit(EPS))


def over_count(x: Column, n: Column) -> Column:
    """x / n, null for n = 0."""
    return dbl(x) / F.nullif(dbl(n), F.lit(0.0))


def or_zero(c: Column) -> Column:
    return F.coalesce(dbl(c), F.lit(0.0))


def cents(amount: Column | str) -> Column:
    """An amount with two digits after the point as a whole number: sums of longs are exact and cheap."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.when(F.abs(c) < 10**13, F.rint(dbl(c) * 100.0).cast("long")).otherwise((c * 100).cast("long"))


def money(c: Column) -> Column:
    return dbl(c) / F.lit(100.0)


def seconds(us: Column) -> Column:
    return dbl(us) / F.lit(1e6)


def text_or(c: str, sentinel: str) -> Column:
    """A nullable attribute as text, with an explicit value for missing."""
    return F.coalesce(F.col(c).cast("string"), F.lit(sentinel))


def calendar(us: str = "us") -> dict[str, Column]:
    """hour, day of week (Monday 0), night flag (hours 0 to 5) and cyclic forms of an epoch-microsecond column."""
    ts = F.timestamp_micros(F.col(us))
    hour, dow = F.hour(ts), F.weekday(ts)
    cyc = lambda c, n, f: F.round(f(dbl(c) * F.lit(2 * math.pi / n)), 9)  # noqa: E731  last digits differ between maths libraries
    return {
        "hour_of_day": hour,
        "day_of_week": dow,
        "is_night": (hour < 6).cast("int"),
        "hour_sin": cyc(hour, 24, F.sin),
        "hour_cos": cyc(hour, 24, F.cos),
        "dow_sin": cyc(dow, 7, F.sin),
        "dow_cos": cyc(dow, 7, F.cos),
    }


def recency_weight(us: str, end_us: int, half_life_days: float) -> Column:
    """exp(-ln 2 * days before the end / half-life): a sample weight."""
    return F.exp(-F.lit(math.log(2) / half_life_days) * (F.lit(end_us) - F.col(us)) / F.lit(float(DAY)))
