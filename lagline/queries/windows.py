"""W20-W38 and X1-X7: time-range windows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions.scalar import DAY, HOUR, MINUTE
from ..operators import history as h
from ..operators import ranges as r
from ..plans.spec import plan
from .base import EVENTS, LINES, events_fact, lineitem_fact, register

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)


def R(e: str, w: int) -> str:
    return f"(PARTITION BY {e} ORDER BY us RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def ladder_sql(fact: str, e: str, p: str, widths: list[int]) -> str:
    names = [r.span_name(w) for w in widths]
    raw = ", ".join(f"count(*) OVER {R(e, w)} AS c_{s}, coalesce((sum(amount) OVER {R(e, w)})::DOUBLE, 0) AS s_{s}" for w, s in zip(widths, names, strict=True))
    out = ", ".join(f"c_{s} AS {p}_cnt_{s}, s_{s} AS {p}_amtsum_{s}, round(amount / (s_{s} + 1e-6), 4) AS {p}_amt_share_{s}" for s in names)
    a, z = names[0], names[-1]
    return f"""WITH {fact}, a AS (SELECT transaction_id, amount::DOUBLE AS amount, {raw} FROM fact)
SELECT transaction_id, {out}, round((c_{a} + 1)::DOUBLE / (c_{z} + 1)::DOUBLE, 9) AS {p}_burst_cnt_ratio, round((s_{a} + 1) / (s_{z} + 1), 9) AS {p}_burst_amt_ratio FROM a"""


def ladder(fact, e, p, widths):
    df = h.add(fact.select("transaction_id", "us", e, "amount"), r.trailing_ladder(e, p, widths))
    names = [r.span_name(w) for w in widths]
    cols = [c for s in names for c in (F.col(f"{p}_cnt_{s}"), F.col(f"{p}_amtsum_{s}"), F.round(f"{p}_amt_share_{s}", 4).alias(f"{p}_amt_share_{s}"))]
    return df.select("transaction_id", *cols, *[F.round(f"{p}_burst_{k}_ratio", 9).alias(f"{p}_burst_{k}_ratio") for k in ("cnt", "amt")])


HOURS = [h_ * HOUR for h_ in (1, 6, 24, 72, 168)]
DAYS = [7 * DAY, 30 * DAY, 90 * DAY]


@query("w20_w22_trailing_customer", ladder_sql(EVENTS, "customer_id", "cust", HOURS))
def w20c(spark, d):
    return ladder(events_fact(spark, d), "customer_id", "cust", HOURS)


@query("w20_w22_trailing_device", ladder_sql(EVENTS, "device_id", "dev", HOURS))
def w20d(spark, d):
    return ladder(events_fact(spark, d), "device_id", "dev", HOURS)


@query("w20_w22_trailing_merchant_ties", ladder_sql(LINES, "merchant_id", "merch", DAYS))
def w20m(spark, d):
    return ladder(lineitem_fact(spark, d), "merchant_id", "merch", DAYS)


@query("w20_trailing_halo", f"""WITH {LINES} SELECT transaction_id, count(*) OVER {R("merchant_id", 30 * DAY)} AS n, coalesce((sum(amount) OVER {R("merchant_id", 30 * DAY)})::DOUBLE, 0) AS total FROM fact""")
def w20h(spark, d):
    fact = lineitem_fact(spark, d).select("transaction_id", "us", "merchant_id", "amount")
    held = r.trailing_with_halo(fact, "merchant_id", 30 * DAY, {"n": r.count, "total": lambda: F.sum("amount")})
    return held.select("transaction_id", "n", F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"))


MINUTES = [5 * MINUTE, 15 * MINUTE, 30 * MINUTE, 3 * HOUR, 12 * HOUR]


def recent_sql(e: str, p: str) -> str:
    names = [(w, r.span_name(w)) for w in MINUTES]
    raw = ", ".join(f"count(*) OVER {R(e, w)} AS c_{s}, (sum(amount) OVER {R(e, w)})::DOUBLE AS s_{s}, (max(amount) OVER {R(e, w)})::DOUBLE AS m_{s}" for w, s in names)
    out = ", ".join(f"c_{s} AS {p}_cnt_{s}, coalesce(s_{s}, 0) AS {p}_amtsum_{s}, round(amount / (s_{s} / nullif(c_{s}, 0)::DOUBLE + 1e-6), 6) AS {p}_amt_vs_recent_mean_{s}, round(amount / (m_{s} + 1e-6), 6) AS {p}_amt_vs_recent_max_{s}" for _, s in names)
    return f"WITH {EVENTS}, a AS (SELECT transaction_id, amount::DOUBLE AS amount, {raw} FROM fact) SELECT transaction_id, {out} FROM a"


@query("w23_w24_recent_device", recent_sql("device_id", "dev"))
def w23(spark, d):
    df = h.add(events_fact(spark, d).select("transaction_id", "us", "device_id", "amount"), r.recent("device_id", "dev", MINUTES))
    return df.select("transaction_id", *[F.round(c, 6).alias(c) if "_vs_" in c else F.col(c) for c in df.columns if c.startswith("dev_")])


FRESH = [HOUR, 24 * HOUR, 7 * DAY]


def fresh_sql() -> str:
    flags = ", ".join(f"CASE WHEN gap IS NULL OR gap > {w} THEN 1 ELSE 0 END AS f{i}" for i, w in enumerate(FRESH))
    raw = ", ".join(f"sum(f{i}) OVER {R('customer_id', w)} AS t{i}, count(*) OVER {R('customer_id', w)} AS c{i}" for i, w in enumerate(FRESH))
    out = ", ".join(f"coalesce(t{i}, 0)::BIGINT AS cust_fresh_device_id_{r.span_name(w)}, round(t{i}::DOUBLE / (c{i} + 1)::DOUBLE, 9) AS cust_fresh_device_id_share_{r.span_name(w)}" for i, w in enumerate(FRESH))
    return f"WITH {EVENTS}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY customer_id, device_id ORDER BY us, transaction_id) AS gap FROM fact), f AS (SELECT *, {flags} FROM g), a AS (SELECT transaction_id, {raw} FROM f) SELECT transaction_id, {out} FROM a"


@query("w25_w26_freshness", fresh_sql())
def w25(spark, d):
    df = h.add(events_fact(spark, d).select("transaction_id", "us", "customer_id", "device_id"), r.freshness("customer_id", "device_id", "cust", FRESH))
    return df.select("transaction_id", *[F.round(c, 9).alias(c) if "share" in c else F.col(c) for c in df.columns if c.startswith("cust_fresh")])


@query("w28_w29_context", f"""WITH {LINES}, f AS (SELECT *, coalesce(location, '__unknown__') AS place, coalesce(merchant_category, '__unknown__') AS cat FROM fact),
a AS (SELECT transaction_id, amount::DOUBLE AS amount, count(*) OVER {R("place", HOUR)} AS c1, coalesce((sum(amount) OVER {R("place", HOUR)})::DOUBLE, 0) AS s1,
  count(*) OVER {R("place", 24 * HOUR)} AS c24, coalesce((sum(amount) OVER {R("place", 24 * HOUR)})::DOUBLE, 0) AS s24,
  (sum(amount) OVER c)::DOUBLE / nullif(count(*) OVER c, 0)::DOUBLE AS mc, (sum(amount) OVER p)::DOUBLE / nullif(count(*) OVER p, 0)::DOUBLE AS mp FROM f
  WINDOW c AS (PARTITION BY cat ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY place ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT transaction_id, c1 AS loc_cnt_1h, s1 AS loc_amtsum_1h, c24 AS loc_cnt_24h, s24 AS loc_amtsum_24h, round(amount / (mc + 1e-6), 6) AS amt_vs_cat_mean_prior, round(amount / (mp + 1e-6), 6) AS loc_amt_ratio FROM a""")
def w28(spark, d):
    df = r.context_by_blocks(lineitem_fact(spark, d).select("transaction_id", "us", "location", "merchant_category", "amount"), "location", "merchant_category")
    return df.select("transaction_id", "loc_cnt_1h", "loc_amtsum_1h", "loc_cnt_24h", "loc_amtsum_24h", *[F.round(c, 6).alias(c) for c in ("amt_vs_cat_mean_prior", "loc_amt_ratio")])


@query("w30_w32_intensity", f"""WITH {EVENTS}, a AS (SELECT transaction_id, amount::DOUBLE AS amount, (count(*) OVER {R("device_id", HOUR)})::DOUBLE AS c1, coalesce((sum(amount) OVER {R("device_id", HOUR)})::DOUBLE, 0) AS s1,
  (count(*) OVER {R("device_id", 24 * HOUR)})::DOUBLE AS c24, coalesce((sum(amount) OVER {R("device_id", 24 * HOUR)})::DOUBLE, 0) AS s24 FROM fact)
SELECT transaction_id, round(amount / (s24 / (c24 + 1e-6) + 1e-6), 4) AS dev_amt_vs_24h_mean, round(c1 * 24 / (c24 + 1), 6) AS dev_burst_accel, round((c1 + 1) / (s1 + 10), 9) AS dev_smurf_ratio_1h FROM a""")
def w30(spark, d):
    df = h.add(events_fact(spark, d).select("transaction_id", "us", "device_id", "amount"), r.trailing_ladder("device_id", "dev", [HOUR, 24 * HOUR]), r.intensity("dev"))
    return df.select("transaction_id", F.round("dev_amt_vs_24h_mean", 4).alias("dev_amt_vs_24h_mean"), F.round("dev_burst_accel", 6).alias("dev_burst_accel"), F.round("dev_smurf_ratio_1h", 9).alias("dev_smurf_ratio_1h"))


def backward_sql(fact: str, e: str, p: str, widths: list[int], rates: list[tuple[int, int]]) -> str:
    tie = f"(PARTITION BY {e}, us ORDER BY transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    raw = ", ".join(f"(count(*) OVER {R(e, w)} + count(*) OVER {tie}) AS c_{r.span_name(w)}, (coalesce(sum(amount) OVER {R(e, w)}, 0) + coalesce(sum(amount) OVER {tie}, 0))::DOUBLE AS s_{r.span_name(w)}" for w in widths)
    out = [f"c_{s} AS {p}_bwd_cnt_{s}, s_{s} AS {p}_bwd_amtsum_{s}, round(amount / (s_{s} / greatest(c_{s}::DOUBLE, 1.0) + 1e-6), 4) AS {p}_amt_vs_bwd_{s}" for s in map(r.span_name, widths)]
    out += [f"round((c_{r.span_name(a)}::DOUBLE / {a / MINUTE!r} + 1e-9) / (c_{r.span_name(b)}::DOUBLE / {b / MINUTE!r} + 1e-9), 6) AS {p}_rate_ratio_{r.span_name(a)}_{r.span_name(b)}" for a, b in rates]
    return f"WITH {fact}, a AS (SELECT transaction_id, amount::DOUBLE AS amount, {raw} FROM fact) SELECT transaction_id, {', '.join(out)} FROM a"


def backward(fact, e, p, widths, rates):
    df = h.add(fact.select("transaction_id", "us", e, "amount"), r.backward(e, p, widths, rates=rates))
    digits = lambda c: 4 if "_vs_" in c else 6
    return df.select("transaction_id", *[F.round(c, digits(c)).alias(c) if "_vs_" in c or "ratio" in c else F.col(c) for c in df.columns if c.startswith(f"{p}_")])


BACK = [5 * MINUTE, 15 * MINUTE, HOUR, 3 * HOUR, 12 * HOUR, 24 * HOUR]
BACK_RATES = [(5 * MINUTE, HOUR), (15 * MINUTE, 3 * HOUR), (HOUR, 24 * HOUR)]


@query("w34_w36_backward_device", backward_sql(EVENTS, "device_id", "dev", BACK, BACK_RATES))
def w34(spark, d):
    return backward(events_fact(spark, d), "device_id", "dev", BACK, BACK_RATES)


@query("w34_w36_backward_merchant_ties", backward_sql(LINES, "merchant_id", "merch", DAYS, [(7 * DAY, 30 * DAY)]))
def w34m(spark, d):
    return backward(lineitem_fact(spark, d), "merchant_id", "merch", DAYS, [(7 * DAY, 30 * DAY)])


def ahead_sql(fact: str, e: str, p: str, widths: list[int]) -> str:
    before = f"(PARTITION BY {e}, us ORDER BY transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = f"(PARTITION BY {e}, us ORDER BY transaction_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    o = f"(PARTITION BY {e} ORDER BY us, transaction_id)"
    raw, out = [], []
    for w in widths:
        s, f, b = r.span_name(w), f"(PARTITION BY {e} ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {w} FOLLOWING)", f"(PARTITION BY {e} ORDER BY us RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING)"
        raw.append(f"(count(*) OVER {f} + count(*) OVER {after}) AS f_{s}, (coalesce(sum(amount) OVER {f}, 0) + coalesce(sum(amount) OVER {after}, 0))::DOUBLE AS fs_{s}, (count(*) OVER {b}) - 1 AS y_{s}, ((sum(amount) OVER {b}) - amount)::DOUBLE AS ys_{s}, (count(*) OVER {R(e, w)} + count(*) OVER {before}) AS b_{s}")
        out.append(f"f_{s} AS {p}_fwd_cnt_{s}, fs_{s} AS {p}_fwd_amtsum_{s}, y_{s} AS {p}_sym_cnt_{s}, ys_{s} AS {p}_sym_amtsum_{s}, round((f_{s} + 1)::DOUBLE / (b_{s} + 1)::DOUBLE, 9) AS {p}_accel_{s}, round(amt / (ys_{s} / greatest(y_{s}::DOUBLE, 1.0) + 1e-6), 4) AS {p}_amt_vs_sym_{s}")
    raw.append(f"(lead(us, 1) OVER {o} - us)::DOUBLE / 1e6 AS n1, (lead(us, 2) OVER {o} - us)::DOUBLE / 1e6 AS n2, (us - lag(us, 1) OVER {o})::DOUBLE / 1e6 AS l1")
    return f"WITH {fact}, a AS (SELECT transaction_id, amount::DOUBLE AS amt, {', '.join(raw)} FROM fact) SELECT transaction_id, {', '.join(out)}, n1 AS {p}_seconds_to_next, n2 AS {p}_seconds_to_next2, round((n1 + 1) / (l1 + 1), 6) AS {p}_gap_fwd_vs_bwd FROM a"


def ahead(fact, e, p, widths):
    df = plan(fact.select("transaction_id", "us", e, "amount"), r.ahead(e, p, widths), allow_future=True)
    digits = {"accel": 9, "amt_vs_sym": 4, "gap_fwd": 6}
    cols = []
    for c in df.columns:
        if c.startswith(f"{p}_"):
            n = next((v for k, v in digits.items() if k in c), None)
            cols.append(F.col(c) if n is None else F.round(c, n).alias(c))
    return df.select("transaction_id", *cols)


@query("x1_x7_forward_customer", ahead_sql(EVENTS, "customer_id", "cust", [HOUR, 24 * HOUR]))
def x1(spark, d):
    return ahead(events_fact(spark, d), "customer_id", "cust", [HOUR, 24 * HOUR])


@query("x1_x7_forward_merchant_ties", ahead_sql(LINES, "merchant_id", "merch", [7 * DAY]))
def x1m(spark, d):
    return ahead(lineitem_fact(spark, d), "merchant_id", "merch", [7 * DAY])
