"""PCT, PSI, ranks, metrics, audits, folds and guards."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions.scalar import DAY, dbl
from ..operators import audit as a
from ..operators import drift, guards
from ..operators import evaluate as ev
from ..operators import metrics as m
from ..operators.history import add, expanding, pair_novelty
from .base import EVENTS, LINES, events_fact, lineitem_fact, register

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

JAN = 1_704_067_200_000_000  # 2024-01-01 UTC in microseconds
YEAR98 = 883_612_800_000_000  # 1998-01-01
#: A score that both engines compute alike, and a label.
SCORED = EVENTS + ", s AS (SELECT *, floor(amount::DOUBLE) / 500.0 AS score FROM fact)"


def scored(spark, d):
    return events_fact(spark, d).withColumn("score", F.floor(F.col("amount").cast("double")).cast("double") / F.lit(500.0))


def AP(by: str = "") -> str:
    """CTE text: average precision of table s by the given columns, ties of a score together."""
    lead, part = (f"{by}, " if by else ""), (f"PARTITION BY {by} " if by else "")
    return f"""st AS (SELECT {lead}score, count(*) AS n, sum(label)::BIGINT AS p FROM s GROUP BY {lead}score),
cv AS (SELECT {lead}n, p, sum(p) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS seen, sum(p) OVER ({part.strip()}) AS whole FROM st),
ap AS (SELECT {lead}sum(round(p::DOUBLE / nullif(whole::DOUBLE, 0) * tp::DOUBLE / seen::DOUBLE, 12)::DECIMAL(30,12))::DOUBLE AS ap, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives FROM cv {f"GROUP BY {by}" if by else ""})"""


@query("pct_time_local", f"""WITH {EVENTS}, d AS (SELECT transaction_id, amount::DOUBLE AS v, dense_rank() OVER (ORDER BY us // {DAY}) AS day FROM fact),
c AS (SELECT x.transaction_id, count(y.v) AS refs, count(*) FILTER (WHERE y.v < x.v) AS below FROM d x LEFT JOIN d y ON y.day BETWEEN x.day - 14 AND x.day - 1 GROUP BY 1)
SELECT transaction_id, round(below::DOUBLE / nullif(refs, 0)::DOUBLE, 9) AS amount_pct FROM c""")
def pct(spark, d):
    df = drift.local_percentile(events_fact(spark, d).select("transaction_id", "us", "amount"), "amount", "amount_pct", days=14)
    return df.select("transaction_id", F.round("amount_pct", 9).alias("amount_pct"))


HALF = JAN + 15 * DAY


def psi_sql(open_ends: bool, least: int, other: str) -> str:
    outside = "" if open_ends else "AND l.v BETWEEN list_extract(e, 1) AND list_extract(e, len(e))"
    return f"""WITH {EVENTS}, r AS (SELECT 'amount' AS feature, us, amount::DOUBLE AS v FROM fact UNION ALL SELECT 'device_id', us, device_id::DOUBLE FROM fact),
e AS (SELECT feature, list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS u FROM r WHERE us < {HALF} GROUP BY 1), e2 AS (SELECT feature, list_sort(u) AS e FROM e),
b AS (SELECT feature, unnest(range(0, greatest(len(e) - 1, 1))) AS bin FROM e2),
l AS (SELECT l.feature, us < {HALF} AS early, len(list_filter(e[2:len(e) - 1], lambda q: q <= l.v)) AS bin FROM r l JOIN e2 USING (feature) WHERE true {outside}),
c AS (SELECT b.feature, b.bin, count(l.early) FILTER (WHERE l.early) AS p, count(l.early) FILTER (WHERE NOT l.early) AS q FROM b LEFT JOIN l ON b.feature = l.feature AND b.bin = l.bin GROUP BY 1, 2),
n AS (SELECT *, sum(p) OVER (PARTITION BY feature) AS np, sum(q) OVER (PARTITION BY feature) AS nq FROM c),
s AS (SELECT feature, np, nq, greatest(p::DOUBLE / nullif(np::DOUBLE, 0), 1e-6) AS p, greatest(q::DOUBLE / nullif(nq::DOUBLE, 0), 1e-6) AS q FROM n)
SELECT feature, max(np)::BIGINT AS n_early, max(nq)::BIGINT AS n_late, CASE WHEN max(np) >= {least} AND max(nq) >= {least} THEN round(sum(round((q - p) * ln(q / p), 12)::DECIMAL(30,12))::DOUBLE, 9) ELSE {other} END AS psi FROM s GROUP BY feature"""


def psi(spark, d, open_ends):
    fact = events_fact(spark, d)
    out = drift.stability_index(fact.where(F.col("us") < HALF), fact.where(F.col("us") >= HALF), ["amount", "device_id"], open_ends=open_ends)
    return out.select("feature", "n_early", "n_late", F.round("psi", 9).alias("psi"))


@query("psi1_open_ends", psi_sql(True, 100, "0.0"))
def psi1(spark, d):
    return psi(spark, d, True)


@query("psi2_closed_ends", psi_sql(False, 10, "NULL"))
def psi2(spark, d):
    return psi(spark, d, False)


RANK = "(rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) + 1)::DOUBLE / 2) / (count(*) OVER ())::DOUBLE"


@query("rnk1_average_rank", f"WITH {SCORED} SELECT transaction_id, round({RANK.format(c='score')}, 9) AS score_rank FROM s")
def rnk1(spark, d):
    return drift.average_rank(scored(spark, d), "score", "score_rank").select("transaction_id", F.round("score_rank", 9).alias("score_rank"))


@query("rnk2_spearman", f"WITH {SCORED}, r AS (SELECT {RANK.format(c='score')} AS ra, {RANK.format(c='device_id')} AS rb FROM s) SELECT round(corr(ra, rb), 9) AS spearman, count(*) AS n FROM r")
def rnk2(spark, d):
    return drift.spearman(scored(spark, d), "score", "device_id")


@query("m1_average_precision", f"WITH {SCORED}, {AP()} SELECT round(ap, 9) AS ap, n, positives FROM ap")
def m1(spark, d):
    return m.average_precision(scored(spark, d)).select(F.round("ap", 9).alias("ap"), "n", "positives")


@query("m2_tk3_at_fractions", f"""WITH {SCORED}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, transaction_id) AS k, count(*) OVER () AS n, sum(label) OVER () AS pos FROM s),
f AS (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS fraction), g AS (SELECT fraction, greatest(1, round_even(n * fraction, 0)::BIGINT) AS top, k, label, pos FROM r, f)
SELECT fraction, top AS k, sum(label)::BIGINT AS hits, round(sum(label)::DOUBLE / top::DOUBLE, 9) AS precision, round(sum(label)::DOUBLE / max(pos)::DOUBLE, 9) AS recall FROM g WHERE k <= top GROUP BY fraction, top""")
def m2(spark, d):
    out = m.at_fractions(scored(spark, d), [0.01, 0.05, 0.1])
    return out.select("fraction", "k", "hits", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("m3_cold_split", f"WITH {SCORED.replace('FROM fact)', ', CASE WHEN row_number() OVER (PARTITION BY customer_id ORDER BY us, transaction_id) > 20 THEN 1 ELSE 0 END AS part FROM fact)')}, {AP('part')} SELECT part, round(ap, 9) AS ap, n, positives FROM ap")
def m3(spark, d):
    df = add(scored(spark, d), expanding("customer_id", "cust"))
    return m.split_precision(df, (F.col("cust_history_count") >= 20).cast("int")).select("part", F.round("ap", 9).alias("ap"), "n", "positives")


GAPS = {"amount": "CASE WHEN transaction_id % 7 = 0 THEN NULL ELSE amount::DOUBLE END", "device_id": "CASE WHEN transaction_id % 5 < 2 THEN NULL ELSE device_id::DOUBLE END"}


def univariate_sql(median: bool) -> str:
    """A seventh and two fifths of the values are missing."""
    fill = lambda c: f"(SELECT quantile_cont({GAPS[c]}, 0.5) FROM fact)" if median else "0"
    rows = " UNION ALL ".join(f"SELECT (us >= {HALF})::INTEGER AS period, label, '{c}' AS feature, coalesce({v}, {fill(c)}) AS v FROM fact" for c, v in GAPS.items())
    return f"""WITH {EVENTS}, l AS ({rows}),
s AS (SELECT period, feature, sign::INTEGER AS sign, label, v * sign AS score FROM l, (SELECT unnest([1, -1]) AS sign)), {AP('period, feature, sign')}, w AS (SELECT period, feature, min(v) < max(v) AS varies FROM l GROUP BY 1, 2)
SELECT period, feature, sign, CASE WHEN varies THEN round(ap, 9) END AS ap, positives FROM ap JOIN w USING (period, feature)"""


def univariate(spark, d, missing):
    df = events_fact(spark, d).withColumn("period", (F.col("us") >= HALF).cast("int"))
    df = df.withColumn("amount", F.when(F.col("transaction_id") % 7 != 0, F.col("amount").cast("double"))).withColumn("device_id", F.when(F.col("transaction_id") % 5 >= 2, F.col("device_id")))
    return m.univariate(df, ["amount", "device_id"], "period", missing=missing).withColumn("ap", F.round("ap", 9))


@query("m4_univariate_median", univariate_sql(True))
def m4(spark, d):
    return univariate(spark, d, "median")


@query("m4b_univariate_zero", univariate_sql(False))
def m4b(spark, d):
    return univariate(spark, d, "zero")


@query("m5_roc_auc", f"""WITH {SCORED}, st AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY 1), c AS (SELECT n, p, coalesce(sum(n - p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM st)
SELECT round(sum(p * (2 * below + n - p))::DOUBLE / nullif(2.0 * sum(p)::DOUBLE * sum(n - p)::DOUBLE, 0), 9) AS auc, sum(p)::BIGINT AS positives, sum(n - p)::BIGINT AS negatives FROM c""")
def m5(spark, d):
    return m.roc_auc(scored(spark, d)).select(F.round("auc", 9).alias("auc"), "positives", "negatives")


WEEKS = [(f"fold{k}", JAN + (14 + 4 * k) * DAY, JAN + (18 + 4 * k) * DAY) for k in range(4)]


@query("m6_fold_decay", f"""WITH {SCORED.replace('FROM fact)', f', (us - {WEEKS[0][1]}) // {4 * DAY} AS fold FROM fact WHERE us >= {WEEKS[0][1]} AND us < {WEEKS[-1][2]})')}, {AP('fold')}
SELECT round(max(ap) FILTER (WHERE fold = 0), 9) AS first_ap, round(max(ap) FILTER (WHERE fold = 3), 9) AS last_ap, max(ap) FILTER (WHERE fold = 3) < max(ap) FILTER (WHERE fold = 0) - 0.02 AS decays FROM ap""")
def m6(spark, d):
    fold = F.floor((F.col("us") - WEEKS[0][1]) / F.lit(4 * DAY))
    inside = scored(spark, d).where((F.col("us") >= WEEKS[0][1]) & (F.col("us") < WEEKS[-1][2])).withColumn("fold", fold)
    ap = m.average_precision(inside, by=["fold"])
    at = lambda k: F.max(F.when(F.col("fold") == k, F.col("ap")))
    return ap.agg(at(0).alias("first_ap"), at(3).alias("last_ap")).select(F.round("first_ap", 9).alias("first_ap"), F.round("last_ap", 9).alias("last_ap"), m.decays(F.col("first_ap"), F.col("last_ap")).alias("decays"))


@query("ag2_flt4_rule_decay", f"""WITH {EVENTS}, l AS (SELECT strftime(make_timestamp(us), '%Y-%m') AS month, label AS y, rule, hit::BIGINT AS hit FROM (
  SELECT us, label, 'high_amount' AS rule, amount > 200 AS hit FROM fact UNION ALL SELECT us, label, 'night', hour(make_timestamp(us)) < 5 FROM fact UNION ALL SELECT us, label, 'low_device', device_id < 20 FROM fact)),
g AS (SELECT month, rule, count(*) AS n, sum(y)::DOUBLE AS pos, sum(hit)::BIGINT AS hits, sum(hit * y)::DOUBLE AS hit_pos FROM l GROUP BY 1, 2)
SELECT month, rule, n, hits, round(hit_pos / nullif(hits::DOUBLE, 0), 9) AS rate, round(hit_pos / nullif(hits::DOUBLE, 0) / nullif(pos / n::DOUBLE, 0), 9) AS lift, round(hits::DOUBLE / n::DOUBLE, 9) AS coverage, round(hit_pos / nullif(pos, 0), 9) AS recall FROM g""")
def ag2(spark, d):
    rules = {"high_amount": F.col("amount") > 200, "night": F.hour(F.timestamp_micros("us")) < 5, "low_device": F.col("device_id") < 20}
    out = a.rule_decay(events_fact(spark, d), rules)
    return out.select("month", "rule", "n", "hits", *[F.round(c, 9).alias(c) for c in ("rate", "lift", "coverage", "recall")])


@query("ag3_flt6_category_shift", f"""WITH {LINES}, g AS (SELECT payment_method AS value, count(*) FILTER (WHERE us < {YEAR98}) AS n_early, count(*) FILTER (WHERE us >= {YEAR98}) AS n_late,
  coalesce(sum(label) FILTER (WHERE us < {YEAR98}), 0)::BIGINT AS p_early, coalesce(sum(label) FILTER (WHERE us >= {YEAR98}), 0)::BIGINT AS p_late FROM fact GROUP BY 1)
SELECT value, n_early, n_late, round(p_early::DOUBLE / nullif(n_early::DOUBLE, 0), 9) AS rate_early, round(p_late::DOUBLE / nullif(n_late::DOUBLE, 0), 9) AS rate_late,
  round(p_late::DOUBLE / nullif(n_late::DOUBLE, 0) - p_early::DOUBLE / nullif(n_early::DOUBLE, 0), 9) AS delta, p_late >= 15 AS trusted FROM g WHERE n_early >= 200 AND n_late >= 200""")
def ag3(spark, d):
    out = a.category_shift(lineitem_fact(spark, d), "payment_method", F.col("us") < YEAR98, F.col("us") >= YEAR98)
    return out.select("value", "n_early", "n_late", *[F.round(c, 9).alias(c) for c in ("rate_early", "rate_late", "delta")], "trusted")


@query("ag4_label_clustering", f"""WITH {EVENTS}, g AS (SELECT device_id, count(*) AS n, sum(label) AS k FROM fact GROUP BY 1 HAVING count(*) > 1),
t AS (SELECT sum(k * (k - 1))::DOUBLE / nullif(sum(k * (n - 1))::DOUBLE, 0) AS c, sum(k * (k - 1))::DOUBLE / nullif(sum(n * (n - 1))::DOUBLE, 0) AS j, (SELECT sum(label)::DOUBLE / count(*)::DOUBLE FROM fact) AS b FROM g)
SELECT 'device_id' AS entity, round(j, 9) AS p_joint, round(c, 9) AS p_given, round(b, 9) AS p_base, round(c / nullif(b, 0), 9) AS lift FROM t""")
def ag4(spark, d):
    out = a.label_clustering(events_fact(spark, d), "device_id")
    return out.select("entity", *[F.round(c, 9).alias(c) for c in ("p_joint", "p_given", "p_base", "lift")])


@query("ag5_group_sizes", f"""WITH {EVENTS}, g AS (SELECT customer_id, device_id, count(*) AS n FROM fact GROUP BY 1, 2)
SELECT count(*) AS groups, round(sum(n)::DOUBLE / count(*)::DOUBLE, 9) AS mean_rows, round((count(*) FILTER (WHERE n = 1))::DOUBLE / count(*)::DOUBLE, 9) AS single_share FROM g""")
def ag5(spark, d):
    return a.group_sizes(events_fact(spark, d), ["customer_id", "device_id"]).select("groups", F.round("mean_rows", 9).alias("mean_rows"), F.round("single_share", 9).alias("single_share"))


@query("ag6_sibling_coverage", f"""WITH {EVENTS}, g AS (SELECT device_id, us // {DAY} AS b, count(*) AS n FROM fact GROUP BY 1, 2)
SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE, 9) AS coverage FROM g""")
def ag6(spark, d):
    return a.sibling_coverage(events_fact(spark, d), "device_id", DAY).select(F.round("coverage", 9).alias("coverage"))


@query("ag7_ag9_quantiles", f"""WITH {EVENTS} SELECT round(quantile_cont(amount::DOUBLE, 0.1), 9) AS q10, round(quantile_cont(amount::DOUBLE, 0.5), 9) AS q50, round(quantile_cont(amount::DOUBLE, 0.98), 9) AS q98,
  (SELECT count(*) FROM fact WHERE amount::DOUBLE >= (SELECT quantile_cont(amount::DOUBLE, 0.98) FROM fact)) AS top_rows FROM fact""")
def ag7(spark, d):
    fact = events_fact(spark, d).select(F.col("amount").cast("double").alias("v"))
    cut = drift.quantile_cut(fact, "v", 0.98)
    values = drift.quantile_values(fact, "v", [0.1, 0.5, 0.98])
    return fact.agg(*[F.round(F.lit(v), 9).alias(n) for v, n in zip(values, ("q10", "q50", "q98"), strict=True)], F.count_if(F.col("v") >= cut).alias("top_rows"))


@query("ag10_fold_summary", f"""WITH {EVENTS}, f AS (SELECT transaction_type AS arm, us // {7 * DAY} AS week, sum(label)::DOUBLE / count(*)::DOUBLE AS rate FROM fact GROUP BY 1, 2)
SELECT arm, round(avg(rate), 9) AS mean, round(stddev_pop(rate), 9) AS std, round(min(rate), 9) AS least, round(max(rate), 9) AS greatest FROM f GROUP BY arm""")
def ag10(spark, d):
    rates = events_fact(spark, d).groupBy(F.col("transaction_type").alias("arm"), F.floor(F.col("us") / F.lit(7 * DAY)).alias("week")).agg((dbl(F.sum("label")) / dbl(F.count(F.lit(1)))).alias("rate"))
    out = a.fold_summary(rates, ["arm"], "rate")
    return out.select("arm", "mean", "std", F.round("least", 9).alias("least"), F.round("greatest", 9).alias("greatest"))


@query("ag13_acceptance", f"""WITH {EVENTS}, r AS (SELECT transaction_type AS arm, (us // {7 * DAY})::VARCHAR AS "window", round(avg(amount)::DOUBLE / 1000.0, 6) AS metric FROM fact GROUP BY 1, 2),
b AS (SELECT "window", metric FROM r WHERE arm = 'click'), x AS (SELECT arm, round(r.metric - b.metric, 9)::DECIMAL(20,9) AS delta FROM r JOIN b USING ("window") WHERE arm <> 'click'),
g AS (SELECT arm, round(sum(delta)::DOUBLE / count(*), 9) AS mean_delta, count(*) FILTER (WHERE delta > 0) AS windows_up, min(delta)::DOUBLE AS worst FROM x GROUP BY 1)
SELECT *, mean_delta >= 0.004 AND windows_up >= 2 AND worst >= -0.003 AS accepted FROM g""")
def ag13(spark, d):
    rows = events_fact(spark, d).groupBy(F.col("transaction_type").alias("arm"), F.floor(F.col("us") / F.lit(7 * DAY)).cast("string").alias("window"))
    return a.acceptance(rows.agg(F.round(dbl(F.sum("amount")) / dbl(F.count(F.lit(1))) / 1000.0, 6).alias("metric")), "click")


FOLDS = [(f"fold{k}", JAN + (10 + 5 * k) * DAY, JAN + (15 + 5 * k) * DAY, None) for k in range(4)] + [("recent", JAN + 25 * DAY, JAN + 30 * DAY, 7)]


@query("sp1_sp3_flt2_folds", " UNION ALL ".join(
    f"SELECT '{n}' AS fold, (SELECT count(*) FROM fact WHERE us < {s} {f'AND us >= {s - t * DAY}' if t else ''}) AS train_rows, (SELECT coalesce(sum(label), 0)::BIGINT FROM fact WHERE us < {s} {f'AND us >= {s - t * DAY}' if t else ''}) AS train_pos, "
    f"(SELECT count(*) FROM fact WHERE us >= {s} AND us < {e}) AS valid_rows, (SELECT coalesce(sum(label), 0)::BIGINT FROM fact WHERE us >= {s} AND us < {e}) AS valid_pos" for n, s, e, t in FOLDS).join([f"WITH {EVENTS} SELECT * FROM (", ")"]))
def sp1(spark, d):
    return ev.fold_rows(events_fact(spark, d), [ev.Fold(n, s, e, t) for n, s, e, t in FOLDS])


@query("exp7_frame_checks", f"""WITH {LINES}, k AS (SELECT us, transaction_id, count(*) AS n, count(*) FILTER (WHERE amount <= 0) AS low FROM fact GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(CASE WHEN us IS NULL OR transaction_id IS NULL THEN n END), 0)::BIGINT AS null_keys, sum(low)::BIGINT AS low_amounts, count(*) FILTER (WHERE n > 1) AS repeated_keys FROM k""")
def exp7(spark, d):
    return guards.frame_violations(lineitem_fact(spark, d))


@query("g1_first_rows", f"WITH {EVENTS} SELECT count(DISTINCT customer_id) AS first_rows, 0::BIGINT AS not_empty, 0::BIGINT AS not_new FROM fact")
def g1(spark, d):
    df = add(events_fact(spark, d), expanding("customer_id", "cust"), pair_novelty("customer_id", "device_id", "device"))
    return guards.first_row_violations(df, "customer_id", "cust_amt_mean_prior", "is_new_device")


@query("g4_jn1_submission_checks", f"""WITH {EVENTS} SELECT 0::BIGINT AS missing, count(*) FILTER (WHERE transaction_id % 7 = 0) AS extra, 0::BIGINT AS empty, count(*) FILTER (WHERE amount::DOUBLE / 500.0 > 1) AS outside, false AS hard FROM fact""")
def g4(spark, d):
    rows = events_fact(spark, d).select("transaction_id", (F.col("amount").cast("double") / 500.0).alias("score"))
    return guards.score_violations(rows, rows.where("transaction_id % 7 != 0"))


@query("se1_set_operations", f"""WITH {EVENTS}, early AS (SELECT DISTINCT device_id FROM fact WHERE us < {HALF}), late AS (SELECT DISTINCT device_id FROM fact WHERE us >= {HALF} AND amount > 300)
SELECT (SELECT count(*) FROM early) AS early, (SELECT count(*) FROM late) AS late, (SELECT count(*) FROM (SELECT * FROM early UNION SELECT * FROM late)) AS either, (SELECT count(*) FROM (SELECT * FROM late EXCEPT SELECT * FROM early)) AS only_late""")
def se1(spark, d):
    fact = events_fact(spark, d)
    early, late = fact.where(F.col("us") < HALF).select("device_id").distinct(), fact.where((F.col("us") >= HALF) & (F.col("amount") > 300)).select("device_id").distinct()
    tagged = early.withColumn("t", F.lit(1)).union(late.withColumn("t", F.lit(2))).groupBy("device_id").agg(F.sum("t").alias("t"))
    has = lambda *v: F.count_if(F.col("t").isin(*v))
    return tagged.agg(has(1, 3).alias("early"), has(2, 3).alias("late"), F.count(F.lit(1)).alias("either"), has(2).alias("only_late"))


@query("gr3_so2_edges", f"""WITH {LINES}, e AS (SELECT customer_id, merchant_id, count(*) AS n, min(us) AS first_us FROM fact GROUP BY 1, 2)
SELECT customer_id, count(*) AS degree, sum(n)::BIGINT AS n_rows, min(first_us) AS first_us FROM e GROUP BY 1 ORDER BY degree DESC, customer_id""")
def gr3(spark, d):
    edges = lineitem_fact(spark, d).groupBy("customer_id", "merchant_id").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"))
    return edges.groupBy("customer_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("n").alias("n_rows"), F.min("first_us").alias("first_us")).orderBy(F.desc("degree"), "customer_id")


@query("jn3_recency_weights", f"""WITH {EVENTS} SELECT transaction_id, round(exp(-(ln(2) / 14.0) * ({JAN + 31 * DAY} - us) / {float(DAY)!r}), 9) AS weight, count(*) OVER (PARTITION BY device_id) AS device_rows,
  sum(amount) OVER (PARTITION BY device_id)::DOUBLE AS device_total FROM fact""".replace("sum(amount) OVER (PARTITION BY device_id)::DOUBLE", "(sum(amount) OVER (PARTITION BY device_id))::DOUBLE"))
def jn3(spark, d):
    from pyspark.sql import Window

    from ..functions.scalar import recency_weight

    w = Window.partitionBy("device_id")
    return events_fact(spark, d).select("transaction_id", F.round(recency_weight("us", JAN + 31 * DAY, 14.0), 9).alias("weight"), F.count(F.lit(1)).over(w).alias("device_rows"), dbl(F.sum("amount").over(w)).alias("device_total"))
