"""Strictly-prior features of an entity: levels, spread, gaps, novelty, own norms.

Each function returns features for lagline.plans.spec.plan; none looks at the
row's own future. Empty histories give 0 for counts and sums and null for
everything that would divide by them.

Families ask a Prior what came before: window functions by entity, or Scanned,
columns that a scan over blocks has made, for entities that are too large for one
window partition. The formulas are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cents, dbl, money, over_count, over_eps, seconds, text_or
from ..plans.frames import ID, US, prior
from ..plans.spec import Direction, Feature, plan
from ..sources.scratch import stored
from .robust import SPREAD_ROWS
from .scan import LAST, N, Prior, Scanned, State, large_keys, prior_states, text_key


def whole(amount: str = "amount") -> Feature:
    """The amount in hundredths, for exact sums."""
    return Feature("_cents", cents(amount), Direction.ROW, stage=-1)


def exact_double(c: Column) -> Column:
    """A sum of squares of hundredths (a whole decimal) as a double, in the amount's units squared."""
    return dbl(c) / F.lit(10_000.0)


def expanding(entity: str, p: str, amount: str = "amount", past: Prior | None = None) -> list[Feature]:
    """History count, sum, mean, population std, z-score and ratio to the mean of the amounts before this one."""
    past = past or Prior(entity)
    n, wide = past.count(), cents(amount).cast("decimal(19,0)")
    total, square = past.sum("_cents"), past.sum("_square")
    name = lambda s: F.col(f"{p}_{s}")
    mean, std = name("amt_mean_prior"), name("amt_std_prior")
    variance = over_count(F.col(f"_{p}_square"), name("history_count")) - mean * mean
    return [
        whole(amount),
        Feature("_square", (wide * wide).cast("decimal(38,0)"), Direction.ROW, stage=-1),
        Feature(f"{p}_history_count", n.cast("long")),
        Feature(f"{p}_amt_sum_prior", money(F.coalesce(total, F.lit(0)))),
        Feature(f"_{p}_square", exact_double(square)),
        Feature(f"{p}_amt_mean_prior", over_count(name("amt_sum_prior"), name("history_count")), stage=1),
        Feature(f"{p}_amt_std_prior", F.when(n > 0, F.sqrt(F.greatest(variance, F.lit(0.0)))), stage=2),
        Feature(f"{p}_amt_zscore", (dbl(amount) - mean) / (std + F.lit(1e-6)), stage=3),
        Feature(f"{p}_amt_ratio", over_eps(amount, mean), stage=3),
    ]


def robust(entity: str, p: str, amount: str = "amount") -> list[Feature]:
    """Prior median, prior median absolute deviation from the running median, and the robust z-score: the definition, for small tables; robust.py has it for large ones.

    The deviation of an entity's first row is unknown (null), so no entity's values reach another's.
    """
    past = prior(entity)
    return [
        Feature(f"{p}_amt_median_prior", F.percentile(dbl(amount), F.lit(0.5)).over(past)),
        Feature(f"_{p}_dev", F.abs(dbl(amount) - F.col(f"{p}_amt_median_prior")), stage=1),
        Feature(f"{p}_amt_mad_prior", F.percentile(F.col(f"_{p}_dev"), F.lit(0.5)).over(past), stage=2),
        Feature(f"{p}_amt_robust_z", (dbl(amount) - F.col(f"{p}_amt_median_prior")) / (F.col(f"{p}_amt_mad_prior") + F.lit(1e-6)), stage=3),
    ]


def log_zscore(entity: str, p: str, amount: str = "amount", past: Prior | None = None) -> list[Feature]:
    """Z-score on log1p(amount); logs are whole numbers of 1e-8, so that their sums are exact and don't depend on order."""
    past, n = past or Prior(entity), F.col(f"_{p}_log_n")
    square = F.col("_log") * F.col("_log")  # below 2 ** 63 for amounts below 1e13; summed in two parts, as the sum is not
    high, low = F.shiftright(square, 30), square.bitwiseAND((1 << 30) - 1)
    mean = over_count(F.col(f"_{p}_log_sum") / F.lit(1e8), n)
    variance = over_count((dbl(f"_{p}_log_high") * float(1 << 30) + dbl(f"_{p}_log_low")) / F.lit(1e16), n) - mean * mean
    return [
        Feature("_log", F.rint(F.log1p(dbl(amount)) * 1e8).cast("long"), Direction.ROW, stage=-2),
        Feature("_log_high", high, Direction.ROW, stage=-1),
        Feature("_log_low", low, Direction.ROW, stage=-1),
        Feature(f"_{p}_log_n", past.count()),
        Feature(f"_{p}_log_sum", dbl(past.sum("_log"))),
        Feature(f"_{p}_log_high", past.sum("_log_high")),
        Feature(f"_{p}_log_low", past.sum("_log_low")),
        Feature(f"{p}_log_amt_zscore", (dbl("_log") / F.lit(1e8) - mean) / (F.sqrt(F.greatest(variance, F.lit(0.0))) + F.lit(1e-6)), stage=1),
    ]


def gaps(entity: str, p: str, past: Prior | None = None) -> list[Feature]:
    """Seconds since the last and the one before, and how much the gap tightens."""
    past = past or Prior(entity)
    one, two = (seconds(F.col(US) - past.last(k)) for k in (1, 2))
    g1, g2 = F.col(f"{p}_seconds_since_last"), F.col(f"{p}_seconds_since_last2")
    return [Feature(f"{p}_seconds_since_last", one), Feature(f"{p}_seconds_since_last2", two), Feature(f"{p}_seconds_since_last2_gap", g2 - g1, stage=1), Feature(f"{p}_gap_tightening", (g1 + 1) / (g2 - g1 + 1), stage=1)]


def self_relative(entity: str, p: str, amount: str = "amount", rates: tuple[int, ...] = (1, 24), past: Prior | None = None) -> list[Feature]:
    """Against the entity's own norm: gap acceleration, velocity ratios, prior maximum, records. Needs history_count, seconds_since_last and cnt_{h}h."""
    past = past or Prior(entity)
    top, n = past.max("_cents"), dbl(f"{p}_history_count")
    age = seconds(F.col(US) - past.min(US))
    held = F.col(f"_{p}_age")
    usual = n / F.greatest(held, F.lit(1.0))
    return [
        whole(amount),
        Feature(f"_{p}_age", F.coalesce(age, F.lit(0.0))),
        Feature(f"_{p}_top", money(top)),
        Feature(f"{p}_gap_accel", (held / F.greatest(n, F.lit(1.0))) / (F.col(f"{p}_seconds_since_last") + 1), stage=2),
        *(Feature(f"{p}_velocity_ratio_{h}h", dbl(f"{p}_cnt_{h}h") / (usual * F.lit(h * 3600.0) + F.lit(1e-6)), stage=2) for h in rates),
        Feature(f"{p}_amt_vs_prior_max", over_eps(amount, F.col(f"_{p}_top")), stage=2),
        Feature(f"{p}_is_record_amt", F.when(F.col(f"_{p}_top").isNotNull(), (dbl(amount) > F.col(f"_{p}_top")).cast("double")), stage=2),
    ]


def hour_bucket() -> Column:
    return F.floor(F.hour(F.timestamp_micros(US)) / 4)


def hour_profile(entity: str, p: str, past: Prior | None = None, same: Prior | None = None) -> list[Feature]:
    """Share of prior rows in the same four-hour bucket, and whether the bucket is new."""
    bucket, seen = f"_{p}_bucket", F.col(f"_{p}_seen")
    return [
        Feature(bucket, hour_bucket(), Direction.ROW),
        Feature(f"_{p}_seen", (same or Prior(entity, bucket)).count(), stage=1),
        Feature(f"{p}_hour_bucket_share", dbl(seen) / F.greatest(dbl((past or Prior(entity)).count()), F.lit(1.0)), stage=2),
        Feature(f"{p}_new_hour_bucket", (seen == 0).cast("int"), stage=2),
    ]


def pair_novelty(a: str, b: str, name: str, past: Prior | None = None, pair: Prior | None = None) -> list[Feature]:
    """Whether the pair (a, b) is new, how many b's a has had before, and that per prior row. A null b is a value."""
    key, past = f"_{name}_b", past or Prior(a)
    return [
        Feature(key, text_or(b, "\0null"), Direction.ROW),
        Feature(f"is_new_{name}", ((pair or Prior(a, key)).count() == 0).cast("int"), stage=1),
        Feature(f"{a}_nunique_{name}_prior", F.coalesce(past.sum(f"is_new_{name}"), F.lit(0)).cast("long"), stage=2),
        Feature(f"{a}_nunique_{name}_share_prior", dbl(f"{a}_nunique_{name}_prior") / F.greatest(dbl(past.count()), F.lit(1.0)), stage=3),
    ]


def target_encoding(entity: str, tag: str, label: str = "label", alpha: float = 20.0, rate: Column | None = None) -> list[Feature]:
    """Smoothed prior label rate; rows without a label add nothing. An experiment: not part of the default set."""
    past = prior(entity)
    n, pos = F.count(label).over(past), F.coalesce(F.sum(label).over(past), F.lit(0))
    g = F.lit(0.0) if rate is None else rate
    return [
        Feature(f"te_{tag}_n", n.cast("long")),
        Feature(f"te_{tag}_pos", pos.cast("long")),
        Feature(f"te_{tag}", (dbl(f"te_{tag}_pos") + F.lit(alpha) * g) / (dbl(f"te_{tag}_n") + F.lit(alpha)), stage=1),
    ]


def frequency_share(df: DataFrame, column: str, block_rows: int | None = None) -> DataFrame:
    """Share of all earlier rows that have this row's category."""
    held = prior_states(df, {"same": (text_or(column, "__missing__"), [N]), "all": (F.lit(""), [N])}, block_rows)
    return held.select(*df.columns, (dbl("_same_n") / F.greatest(dbl("_all_n"), F.lit(1.0))).alias(f"{column}_freq_share_prior"))


#: Row values that the levels' states are over.
SUMS = ["_cents", "_square", "_log", "_log_high", "_log_low"]


def scanned(df: DataFrame, entity: str, p: str, amount: str = "amount", pairs: dict[str, str] | None = None, profile: bool = False, block_rows: int | None = None) -> DataFrame:
    """What expanding, log_zscore, gaps, self_relative, pair_novelty (pairs: name -> other column) and hour_profile ask Scanned(p), Scanned(name) and Scanned(f"{p}_hour") for.

    Pairs and hour buckets come first, since the entity's state sums up which pairs were new.
    """
    helpers = [f for f in (*expanding(entity, p, amount), *log_zscore(entity, p, amount)) if f.stage < 0]
    held, pairs = plan(df, helpers), pairs or {}
    inner = {name: (text_key(entity, b), [N]) for name, b in pairs.items()}
    if profile:
        held = held.withColumn("_hour", hour_bucket())
        inner[f"{p}_hour"] = (text_key(entity, "_hour"), [N])
    if inner:
        held = prior_states(held, inner, block_rows).withColumns({f"_new_{name}": (F.col(f"_{name}_n") == 0).cast("int") for name in pairs})
    states = [N, LAST, State("max", "_cents"), State("min", US), *(State("sum", c) for c in SUMS), *(State("sum", f"_new_{name}") for name in pairs)]
    held = prior_states(held, {p: (text_key(entity), states)}, block_rows)
    return held.withColumns({f"_{p}_sum_is_new_{name}": F.col(f"_{p}_sum_new_{name}") for name in pairs})


def expanding_in_blocks(df: DataFrame, entity: str, p: str, amount: str = "amount", block_rows: int | None = None, spread_rows: int = SPREAD_ROWS) -> DataFrame:
    """Levels, log z-score and gaps of entities of any size: scans for those of more than spread_rows rows, windows for the rest.

    A scan carries an entity's state from block to block, so that small entities with a row here and there would cost more
    than their rows do. block_rows: scans for all.
    """

    def features(past: Prior) -> list[Feature]:
        return [*expanding(entity, p, amount, past), *log_zscore(entity, p, amount, past), *gaps(entity, p, past)]

    by_scan = lambda d: plan(scanned(d, entity, p, amount, block_rows=block_rows), features(Scanned(p)))
    if block_rows is not None:
        return by_scan(df)
    held = stored(df, "rows")
    large = stored(large_keys(held, entity, spread_rows), "large")
    if large.isEmpty():
        return plan(held, features(Prior(entity)))
    same = F.col(entity).eqNullSafe(F.col("_large"))
    few = plan(held.join(F.broadcast(large), same, "left_anti"), features(Prior(entity)))  # a row a large entity
    many = by_scan(held.join(F.broadcast(large), same, "left_semi"))
    return few.unionByName(many.select(*few.columns))


def running_max_ratio(df: DataFrame, value: str, name: str, block_rows: int | None = None) -> DataFrame:
    """value over the largest earlier value of the table; the first row takes the second row's maximum, its own value."""
    top = State("max", value)
    held = prior_states(df, {"_table": (text_key(), [top])}, block_rows)
    return held.select(*df.columns, (dbl(value) / F.nullif(dbl(F.coalesce(f"__table_{top.name}", value)), F.lit(0.0))).alias(name))


def add(df: DataFrame, *families: list[Feature]) -> DataFrame:
    """Plans families one after the other and drops helper columns (leading underscore)."""
    keep = set(df.columns)
    for features in families:
        df = plan(df, features)
    return df.select(*[c for c in df.columns if c in keep or not c.startswith("_")])
