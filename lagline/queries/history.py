"""W family: strictly-prior features."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions.scalar import HOUR, calendar
from ..operators import history as h
from ..operators.ranges import cross, trailing_ladder
from ..operators.robust import with_robust_z
from .base import EVENTS, LINES, events_fact, lineitem_fact, register

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

P = "(PARTITION BY {e} ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("w0_calendar", f"""WITH {EVENTS}, t AS (SELECT *, make_timestamp(us) AS ts FROM fact)
SELECT transaction_id, hour(ts)::INTEGER AS hour_of_day, (isodow(ts) - 1)::INTEGER AS day_of_week, (hour(ts) < 6)::INTEGER AS is_night,
  round(sin(hour(ts)::DOUBLE * (2 * pi() / 24)), 9) AS hour_sin, round(cos(hour(ts)::DOUBLE * (2 * pi() / 24)), 9) AS hour_cos,
  round(sin((isodow(ts) - 1)::DOUBLE * (2 * pi() / 7)), 9) AS dow_sin, round(cos((isodow(ts) - 1)::DOUBLE * (2 * pi() / 7)), 9) AS dow_cos FROM t""")
def w0(spark, d):
    return events_fact(spark, d).select("transaction_id", *[c.alias(n) for n, c in calendar().items()])


CENTS = "c AS (SELECT *, amount::DOUBLE AS a, round(amount::DOUBLE * 100.0)::BIGINT AS cents FROM fact)"


def expanding_sql(fact: str, e: str, p: str) -> str:
    """Nothing is rounded: both sides add whole hundredths, so spreads and z-scores of equal amounts are compared as they are."""
    return f"""WITH {fact}, {CENTS}, a AS (SELECT transaction_id, a, count(*) OVER w AS n, coalesce(sum(cents) OVER w, 0)::DOUBLE / 100.0 AS s, (sum(cents * cents) OVER w)::DOUBLE / 10000.0 AS sq FROM c WINDOW w AS {P.format(e=e)}),
b AS (SELECT *, s / nullif(n::DOUBLE, 0) AS mean FROM a), d AS (SELECT *, CASE WHEN n > 0 THEN sqrt(greatest(sq / n::DOUBLE - mean * mean, 0.0)) END AS std FROM b)
SELECT transaction_id, n AS {p}_history_count, s AS {p}_amt_sum_prior, mean AS {p}_amt_mean_prior, std AS {p}_amt_std_prior, (a - mean) / (std + 1e-6) AS {p}_amt_zscore, a / (mean + 1e-6) AS {p}_amt_ratio FROM d"""


def expanding(fact, e, p):
    df = h.add(fact.select("transaction_id", "us", e, "amount"), h.expanding(e, p))
    return df.select("transaction_id", *[f"{p}_{c}" for c in ("history_count", "amt_sum_prior", "amt_mean_prior", "amt_std_prior", "amt_zscore", "amt_ratio")])


@query("w1_w8_expanding_customer", expanding_sql(EVENTS, "customer_id", "cust"))
def w1c(spark, d):
    return expanding(events_fact(spark, d), "customer_id", "cust")


@query("w1_w8_expanding_device", expanding_sql(EVENTS, "device_id", "dev"))
def w1d(spark, d):
    return expanding(events_fact(spark, d), "device_id", "dev")


@query("w1_w8_expanding_merchant", expanding_sql(LINES, "merchant_id", "merch"))
def w1m(spark, d):
    return expanding(lineitem_fact(spark, d), "merchant_id", "merch")


@query("w2_w3_expanding_buckets", f"""WITH {LINES} SELECT transaction_id, count(*) OVER w AS cust_history_count, coalesce((sum(amount) OVER w)::DOUBLE, 0) AS cust_amt_sum_prior, (us - lag(us, 2) OVER (PARTITION BY customer_id ORDER BY us, transaction_id))::DOUBLE / 1e6 AS cust_seconds_since_last2
FROM fact WINDOW w AS {P.format(e="customer_id")}""")
def w23(spark, d):
    """By segmented scans where an entity is too large for one window partition."""
    df = h.expanding_in_blocks(lineitem_fact(spark, d).select("transaction_id", "us", "customer_id", "amount"), "customer_id", "cust")
    return df.select("transaction_id", "cust_history_count", "cust_amt_sum_prior", "cust_seconds_since_last2")


@query("w7_robust_z", f"""WITH {EVENTS}, {CENTS}, m AS (SELECT *, (2 * quantile_cont(cents, 0.5) OVER {P.format(e="customer_id")})::BIGINT AS med FROM c),
g AS (SELECT *, (2 * quantile_cont(abs(2 * cents - med), 0.5) OVER {P.format(e="customer_id")})::BIGINT AS mad FROM m)
SELECT transaction_id, med::DOUBLE / 200.0 AS cust_amt_median_prior, mad::DOUBLE / 400.0 AS cust_amt_mad_prior, (a - med::DOUBLE / 200.0) / (mad::DOUBLE / 400.0 + 1e-6) AS cust_amt_robust_z FROM g""")
def w7(spark, d):
    df = with_robust_z(events_fact(spark, d).select("transaction_id", "us", "customer_id", "amount"), "customer_id", "cust")
    return df.select("transaction_id", "cust_amt_median_prior", "cust_amt_mad_prior", "cust_amt_robust_z")


@query("w9_log_zscore", f"""WITH {EVENTS}, a AS (SELECT transaction_id, us, customer_id, round(ln(1 + amount::DOUBLE) * 1e8)::BIGINT AS l FROM fact),
b AS (SELECT transaction_id, l, count(*) OVER w AS n, sum(l) OVER w AS s, sum((l * l) >> 30) OVER w AS hi, sum((l * l) & 1073741823) OVER w AS lo FROM a WINDOW w AS {P.format(e="customer_id")}),
c AS (SELECT *, (s::DOUBLE / 1e8) / nullif(n::DOUBLE, 0) AS mean FROM b)
SELECT transaction_id, (l::DOUBLE / 1e8 - mean) / (sqrt(greatest(((hi::DOUBLE * 1073741824.0 + lo::DOUBLE) / 1e16) / nullif(n::DOUBLE, 0) - mean * mean, 0.0)) + 1e-6) AS cust_log_amt_zscore FROM c""")
def w9(spark, d):
    return h.add(events_fact(spark, d).select("transaction_id", "us", "customer_id", "amount"), h.log_zscore("customer_id", "cust")).select("transaction_id", "cust_log_amt_zscore")


O = "(PARTITION BY {e} ORDER BY us, transaction_id)"


@query("w10_w37_w38_gaps", f"""WITH {EVENTS}, a AS (SELECT transaction_id, (us - lag(us, 1) OVER w)::DOUBLE / 1e6 AS g1, (us - lag(us, 2) OVER w)::DOUBLE / 1e6 AS g2 FROM fact WINDOW w AS {O.format(e="customer_id")})
SELECT transaction_id, g1 AS cust_seconds_since_last, g2 AS cust_seconds_since_last2, round(g2 - g1, 6) AS cust_seconds_since_last2_gap, round((g1 + 1) / (g2 - g1 + 1), 6) AS cust_gap_tightening FROM a""")
def w10(spark, d):
    df = h.add(events_fact(spark, d).select("transaction_id", "us", "customer_id"), h.gaps("customer_id", "cust"))
    return df.select("transaction_id", "cust_seconds_since_last", "cust_seconds_since_last2", *[F.round(c, 6).alias(c) for c in ("cust_seconds_since_last2_gap", "cust_gap_tightening")])


@query("w11_w14_self_relative", f"""WITH {EVENTS}, a AS (SELECT transaction_id, amount::DOUBLE AS amount, us, customer_id, count(*) OVER p AS n, coalesce((us - min(us) OVER p)::DOUBLE / 1e6, 0) AS age,
  (max(amount) OVER p)::DOUBLE AS top, (us - lag(us) OVER {O.format(e="customer_id")})::DOUBLE / 1e6 AS gap,
  count(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS c1,
  count(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS c24 FROM fact WINDOW p AS {P.format(e="customer_id")})
SELECT transaction_id, round((age / greatest(n::DOUBLE, 1.0)) / (gap + 1), 6) AS cust_gap_accel,
  c1::DOUBLE / (n::DOUBLE / greatest(age, 1.0) * (1 * 3600.0) + 1e-6) AS cust_velocity_ratio_1h, c24::DOUBLE / (n::DOUBLE / greatest(age, 1.0) * (24 * 3600.0) + 1e-6) AS cust_velocity_ratio_24h,
  round(amount / (top + 1e-6), 6) AS cust_amt_vs_prior_max, CASE WHEN top IS NOT NULL THEN (amount > top)::INTEGER::DOUBLE END AS cust_is_record_amt FROM a""")
def w11(spark, d):
    df = h.add(events_fact(spark, d).select("transaction_id", "us", "customer_id", "amount"), h.expanding("customer_id", "cust"), h.gaps("customer_id", "cust"), trailing_ladder("customer_id", "cust", [HOUR, 24 * HOUR]), h.self_relative("customer_id", "cust"))
    return df.select("transaction_id", F.round("cust_gap_accel", 6).alias("cust_gap_accel"), "cust_velocity_ratio_1h", "cust_velocity_ratio_24h", F.round("cust_amt_vs_prior_max", 6).alias("cust_amt_vs_prior_max"), "cust_is_record_amt")


@query("w15_w16_hour_profile", f"""WITH {EVENTS}, b AS (SELECT *, hour(make_timestamp(us)) // 4 AS bucket FROM fact),
c AS (SELECT transaction_id, row_number() OVER (PARTITION BY customer_id, bucket ORDER BY us, transaction_id) - 1 AS same, row_number() OVER (PARTITION BY customer_id ORDER BY us, transaction_id) - 1 AS n FROM b)
SELECT transaction_id, round(same::DOUBLE / greatest(n::DOUBLE, 1.0), 9) AS cust_hour_bucket_share, (same = 0)::INTEGER AS cust_new_hour_bucket FROM c""")
def w15(spark, d):
    df = h.add(events_fact(spark, d).select("transaction_id", "us", "customer_id"), h.hour_profile("customer_id", "cust"))
    return df.select("transaction_id", F.round("cust_hour_bucket_share", 9).alias("cust_hour_bucket_share"), "cust_new_hour_bucket")


@query("w17_w19_pair_novelty", f"""WITH {EVENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY customer_id, device_id ORDER BY us, transaction_id) = 1)::INTEGER AS fresh FROM fact),
c AS (SELECT transaction_id, fresh, coalesce(sum(fresh) OVER {P.format(e="customer_id")}, 0)::BIGINT AS seen, count(*) OVER {P.format(e="customer_id")} AS n FROM n)
SELECT transaction_id, fresh AS is_new_device, seen AS customer_id_nunique_device_prior, round(seen::DOUBLE / greatest(n::DOUBLE, 1.0), 9) AS customer_id_nunique_device_share_prior FROM c""")
def w17(spark, d):
    df = h.add(events_fact(spark, d).select("transaction_id", "us", "customer_id", "device_id"), h.pair_novelty("customer_id", "device_id", "device"))
    return df.select("transaction_id", "is_new_device", "customer_id_nunique_device_prior", F.round("customer_id_nunique_device_share_prior", 9).alias("customer_id_nunique_device_share_prior"))


@query("w27_frequency_share", f"""WITH {EVENTS}, c AS (SELECT transaction_id, row_number() OVER (PARTITION BY transaction_type ORDER BY us, transaction_id) - 1 AS same, row_number() OVER (ORDER BY us, transaction_id) - 1 AS n FROM fact)
SELECT transaction_id, round(same::DOUBLE / greatest(n::DOUBLE, 1.0), 9) AS transaction_type_freq_share_prior FROM c""")
def w27(spark, d):
    df = h.frequency_share(events_fact(spark, d).select("transaction_id", "us", "transaction_type"), "transaction_type")
    return df.select("transaction_id", F.round("transaction_type_freq_share_prior", 9).alias("transaction_type_freq_share_prior"))


@query("w33_cross_frequency", f"""WITH {LINES}, x AS (SELECT transaction_id, us, concat_ws('_', coalesce(payment_method, '__missing__'), coalesce(transaction_type, '__missing__')) AS pay_x_type FROM fact),
c AS (SELECT transaction_id, pay_x_type, row_number() OVER (PARTITION BY pay_x_type ORDER BY us, transaction_id) - 1 AS same, row_number() OVER (ORDER BY us, transaction_id) - 1 AS n FROM x)
SELECT transaction_id, pay_x_type, round(same::DOUBLE / greatest(n::DOUBLE, 1.0), 9) AS pay_x_type_freq_share_prior FROM c""")
def w33(spark, d):
    df = h.add(lineitem_fact(spark, d).select("transaction_id", "us", "payment_method", "transaction_type"), cross("payment_method", "transaction_type", "pay_x_type"))
    df = h.frequency_share(df.select("transaction_id", "us", "pay_x_type"), "pay_x_type")
    return df.select("transaction_id", "pay_x_type", F.round("pay_x_type_freq_share_prior", 9).alias("pay_x_type_freq_share_prior"))


@query("w39_target_encoding", f"""WITH {EVENTS}, c AS (SELECT transaction_id, count(label) OVER w AS n, coalesce(sum(label) OVER w, 0)::BIGINT AS pos FROM fact WINDOW w AS {P.format(e="device_id")})
SELECT transaction_id, n AS te_dev_n, pos AS te_dev_pos, round((pos::DOUBLE + 20.0 * 0.1) / (n::DOUBLE + 20.0), 9) AS te_dev FROM c""")
def w39(spark, d):
    df = h.add(events_fact(spark, d).select("transaction_id", "us", "device_id", "label"), h.target_encoding("device_id", "dev", rate=F.lit(0.1)))
    return df.select("transaction_id", "te_dev_n", "te_dev_pos", F.round("te_dev", 9).alias("te_dev"))


@query("w40_running_max", f"""WITH {EVENTS}, c AS (SELECT transaction_id, us, amount::DOUBLE AS amount, (max(amount) OVER (ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE AS top FROM fact)
SELECT transaction_id, round(amount / nullif(coalesce(top, first_value(amount) OVER (ORDER BY us, transaction_id)), 0), 9) AS amount_vs_running_max FROM c""")
def w40(spark, d):
    df = h.running_max_ratio(events_fact(spark, d).select("transaction_id", "us", "amount"), "amount", "amount_vs_running_max")
    return df.select("transaction_id", F.round("amount_vs_running_max", 9).alias("amount_vs_running_max"))
