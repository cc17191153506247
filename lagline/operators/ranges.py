"""Time-range features: trailing, recent, freshness, context, backward, forward and symmetric windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAY, HOUR, MINUTE, dbl, money, over_eps, seconds, text_or
from ..plans.frames import US, backward_sum, before, forward_sum, ordered, prior, total, trailing
from ..plans.spec import Direction, Feature, plan
from .history import whole
from .scan import prior_by_keys


def span_name(us: int) -> str:
    return f"{us // DAY}d" if us % DAY == 0 and us > 7 * DAY else f"{us // HOUR}h" if us % HOUR == 0 else f"{us // MINUTE}m"


def count() -> Column:
    return F.count(F.lit(1))


def amounts() -> Column:
    return F.sum("_cents")


def trailing_ladder(entity: str, p: str, widths: list[int], amount: str = "amount") -> list[Feature]:
    """Counts and sums over [t - w, t) for each width (empty: 0), amount per sum, and the burst of the first against the last width."""
    names = [span_name(w) for w in widths]
    out = [whole(amount)]
    for w, s in zip(widths, names, strict=True):
        out += [Feature(f"{p}_cnt_{s}", total(count, entity, -w, -1).cast("long")), Feature(f"{p}_amtsum_{s}", money(total(amounts, entity, -w, -1)))]
        out += [Feature(f"{p}_amt_share_{s}", over_eps(amount, F.col(f"{p}_amtsum_{s}")), stage=1)]
    burst = lambda m: (dbl(f"{p}_{m}_{names[0]}") + 1) / (dbl(f"{p}_{m}_{names[-1]}") + 1)
    return [*out, Feature(f"{p}_burst_cnt_ratio", burst("cnt"), stage=1), Feature(f"{p}_burst_amt_ratio", burst("amtsum"), stage=1)]


def recent_tops(p: str, widths: list[int]) -> dict[str, int]:
    """The columns that recent() takes the windows' maxima from, in hundredths: name -> width."""
    return {f"_{p}_most_{span_name(w)}": w for w in widths}


def recent(entity: str, p: str, widths: list[int], amount: str = "amount", held_tops: bool = False) -> list[Feature]:
    """Short windows: count and sum (empty: 0), amount against the window's mean and maximum (empty: null).

    held_tops: maxima come from the columns of recent_tops(), which cost the same whatever the width; else from window functions.
    """
    out = [whole(amount)]
    for w in widths:
        s = span_name(w)
        n, held = F.col(f"{p}_cnt_{s}"), F.col(f"{p}_amtsum_{s}")
        out += [
            Feature(f"{p}_cnt_{s}", total(count, entity, -w, -1).cast("long")),
            Feature(f"{p}_amtsum_{s}", money(total(amounts, entity, -w, -1))),
            Feature(f"_{p}_top_{s}", money(F.col(f"_{p}_most_{s}") if held_tops else F.max("_cents").over(trailing(entity, w)))),
            Feature(f"{p}_amt_vs_recent_mean_{s}", over_eps(amount, held / dbl(F.nullif(n, F.lit(0)))), stage=1),
            Feature(f"{p}_amt_vs_recent_max_{s}", over_eps(amount, F.col(f"_{p}_top_{s}")), stage=1),
        ]
    return out


def freshness(entity: str, other: str, p: str, widths: list[int]) -> list[Feature]:
    """How many rows of [t - w, t) met a value of `other` that the entity had not seen for w; and their share."""
    key = f"_{p}_{other}"
    gap = F.col(US) - F.lag(US).over(ordered(entity, key))
    out = [Feature(key, text_or(other, "nan"), Direction.ROW), Feature(f"{key}_gap", gap, stage=1)]
    for w in widths:
        s = span_name(w)
        fresh = F.when(F.col(f"{key}_gap").isNull() | (F.col(f"{key}_gap") > w), 1).otherwise(0)
        n, met = F.col(f"_{p}_rows_{s}"), f"{p}_fresh_{other}_{s}"
        out += [
            Feature(met, total(lambda x=fresh: F.sum(x), entity, -w, -1).cast("long"), stage=2),
            Feature(f"_{p}_rows_{s}", total(count, entity, -w, -1), stage=2),
            Feature(f"{p}_fresh_{other}_share_{s}", F.when(n > 0, dbl(met) / (dbl(n) + 1)), stage=3),
        ]
    return out


def place_windows(place: str, amount: str = "amount") -> list[Feature]:
    """Place activity of the last hour and day."""
    at = "_place"
    out = [whole(amount), Feature(at, text_or(place, "__unknown__"), Direction.ROW)]
    for h in (1, 24):
        out += [Feature(f"loc_cnt_{h}h", total(count, at, -h * HOUR, -1).cast("long"), stage=1), Feature(f"loc_amtsum_{h}h", money(total(amounts, at, -h * HOUR, -1)), stage=1)]
    return out


def context(place: str, category: str, amount: str = "amount") -> list[Feature]:
    """Place activity of the last hour and day, and amounts against the prior means of category and place."""
    kind, at = "_category", "_place"
    mean = lambda k: money(F.sum("_cents").over(prior(k))) / dbl(F.nullif(F.count(F.lit(1)).over(prior(k)), F.lit(0)))
    out = [*place_windows(place, amount), Feature(kind, text_or(category, "__unknown__"), Direction.ROW)]
    return [*out, Feature("amt_vs_cat_mean_prior", over_eps(amount, mean(kind)), stage=2), Feature("loc_amt_ratio", over_eps(amount, mean(at)), stage=3)]


def context_by_blocks(df: DataFrame, place: str, category: str, amount: str = "amount", block_rows: int | None = None) -> DataFrame:
    """What context() gives, for places and categories that hold many rows each: windows inside blocks, and what earlier blocks add up to."""
    keys = {"_loc": (place, "__unknown__"), "_cat": (category, "__unknown__")}
    held = prior_by_keys(plan(df, [whole(amount)]), keys, block_rows=block_rows)
    mean = lambda k: money(F.col(f"{k}_s")) / dbl(F.nullif(F.col(f"{k}_n"), F.lit(0)))
    held = held.select(*df.columns, over_eps(amount, mean("_cat")).alias("amt_vs_cat_mean_prior"), over_eps(amount, mean("_loc")).alias("loc_amt_ratio"), text_or(place, "__unknown__").alias("_place"))
    widths = {1: HOUR, 24: DAY}
    near = {f"_{m}_{n}": ((lambda m=m: F.sum(f"_{m}")), w) for n, w in widths.items() for m in "cs"}
    # rows of one place and time see the same windows: these are over a row for all of them
    times = plan(df, [whole(amount)]).groupBy(text_or(place, "__unknown__").alias("_at"), US).agg(count().alias("_c"), amounts().alias("_s"))
    times = trailing_with_halo(times, "_at", DAY, near).select("_at", F.col(US).alias("_then"), *near)
    held = held.join(times, (F.col("_place") == F.col("_at")) & F.col(US).eqNullSafe(F.col("_then")))
    out = [c.alias(k) for n in widths for k, c in ((f"loc_cnt_{n}h", F.coalesce(f"_c_{n}", F.lit(0)).cast("long")), (f"loc_amtsum_{n}h", money(F.coalesce(f"_s_{n}", F.lit(0)))))]
    return held.select(*df.columns, *out, "amt_vs_cat_mean_prior", "loc_amt_ratio")


def intensity(p: str, amount: str = "amount") -> list[Feature]:
    """From cnt and amtsum of 1 h and 24 h: amount against the day's mean, acceleration, many small amounts."""
    c1, c24, s1, s24 = (dbl(f"{p}_{m}") for m in ("cnt_1h", "cnt_24h", "amtsum_1h", "amtsum_24h"))
    return [
        Feature(f"{p}_amt_vs_24h_mean", over_eps(amount, s24 / (c24 + F.lit(1e-6)))),
        Feature(f"{p}_burst_accel", c1 * 24 / (c24 + 1)),
        Feature(f"{p}_smurf_ratio_1h", (c1 + 1) / (s1 + 10)),
    ]


def cross(a: str, b: str, name: str) -> list[Feature]:
    return [Feature(name, F.concat_ws("_", text_or(a, "__missing__"), text_or(b, "__missing__")), Direction.ROW)]


def backward(entity: str, p: str, widths: list[int], amount: str = "amount", rates: list[tuple[int, int]] = ()) -> list[Feature]:
    """Windows [t - w, t) with the earlier rows of the same time: count, sum, amount against their mean, and ratios of rates."""
    rows, held_before = f"_{p}_rows_before", f"_{p}_cents_before"
    out = [whole(amount), Feature(rows, before(count, entity)), Feature(held_before, before(amounts, entity))]
    for w in widths:
        s = span_name(w)
        cnt, held = F.col(f"{p}_bwd_cnt_{s}"), F.col(f"{p}_bwd_amtsum_{s}")
        out += [
            Feature(f"{p}_bwd_cnt_{s}", backward_sum(count, entity, w, F.col(rows)).cast("long"), stage=1),
            Feature(f"{p}_bwd_amtsum_{s}", money(backward_sum(amounts, entity, w, F.col(held_before))), stage=1),
            Feature(f"{p}_amt_vs_bwd_{s}", over_eps(amount, held / F.greatest(dbl(cnt), F.lit(1.0))), stage=2),
        ]
    for short, long in rates:
        rate = lambda w: dbl(f"{p}_bwd_cnt_{span_name(w)}") / F.lit(w / MINUTE) + F.lit(1e-9)
        out.append(Feature(f"{p}_rate_ratio_{span_name(short)}_{span_name(long)}", rate(short) / rate(long), stage=2))
    return out


def ahead(entity: str, p: str, widths: list[int], amount: str = "amount") -> list[Feature]:
    """Forward and symmetric windows and what compares them with the past. Reads the future: plan(..., allow_future=True)."""
    out, o = [whole(amount)], ordered(entity)
    for w in widths:
        s = span_name(w)
        f = lambda n: dbl(f"{p}_{n}_{s}")
        out += [
            Feature(f"{p}_fwd_cnt_{s}", forward_sum(count, entity, w).cast("long"), Direction.FORWARD),
            Feature(f"{p}_fwd_amtsum_{s}", money(forward_sum(amounts, entity, w)), Direction.FORWARD),
            Feature(f"{p}_sym_cnt_{s}", (total(count, entity, -w, w) - 1).cast("long"), Direction.SYMMETRIC),
            Feature(f"{p}_sym_amtsum_{s}", money(total(amounts, entity, -w, w) - F.col("_cents")), Direction.SYMMETRIC),
            Feature(f"_{p}_bwd_{s}", backward_sum(count, entity, w)),
            Feature(f"{p}_accel_{s}", (f("fwd_cnt") + 1) / (dbl(f"_{p}_bwd_{s}") + 1), Direction.FORWARD, 1),
            Feature(f"{p}_amt_vs_sym_{s}", over_eps(amount, f("sym_amtsum") / F.greatest(f("sym_cnt"), F.lit(1.0))), Direction.SYMMETRIC, 1),
        ]
    one, two = seconds(F.lead(US, 1).over(o) - F.col(US)), seconds(F.lead(US, 2).over(o) - F.col(US))
    back = seconds(F.col(US) - F.lag(US, 1).over(o))
    return [
        *out,
        Feature(f"{p}_seconds_to_next", one, Direction.FORWARD),
        Feature(f"{p}_seconds_to_next2", two, Direction.FORWARD),
        Feature(f"{p}_gap_fwd_vs_bwd", (one + 1) / (back + 1), Direction.FORWARD),
    ]


def trailing_with_halo(df: DataFrame, entity: str, width: int, aggregates: dict[str, Callable[[], Column] | tuple[Callable[[], Column], int]]) -> DataFrame:
    """Aggregates over [t - w, t) for entities too large for one window partition; an aggregate can bring a shorter w of its own.

    Time is cut into buckets of w; each row also visits the next bucket, where it
    is seen but gets no result. A window partition then holds two buckets of an
    entity, and every range is whole inside it.
    """
    frame = lambda w: Window.partitionBy(entity, "_bucket").orderBy(US).rangeBetween(-w, -1)
    over = {n: f[0]().over(frame(f[1])) if isinstance(f, tuple) else f().over(frame(width)) for n, f in aggregates.items()}
    b = F.floor(F.col(US) / F.lit(width))
    seen = df.withColumn("_visit", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_bucket", b + F.col("_visit"))
    done = seen.select("*", *(c.alias(n) for n, c in over.items())).where("_visit = 0")
    return done.select(*df.columns, *aggregates)


