"""Blends, drift, metrics, graph, models and streams."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lagline.functions.scalar import DAY, HOUR, MINUTE
from lagline.operators import audit, drift, evaluate, graph, metrics
from lagline.operators import propagate as p

T0 = 1_767_225_600_000_000


def values(df, key="transaction_id", column="blend"):
    return {x[key]: x[column] for x in df.collect()}


@pytest.fixture(scope="module")
def blocked(spark):
    hours = [("0", "c1", 1, 0.1), ("1", "c1", 9, 0.2), ("2", "c1", 20, 0.6), ("3", "c1", 99, 0.9), ("4", "c1", 106, 0.5), ("5", "c2", 5, 0.4)]
    return spark.createDataFrame([(i, e, "x", T0 + h * HOUR, s) for i, e, h, s in hours], "transaction_id string, entity string, all_same string, us long, score double")


def test_blocked_blend(blocked):
    got = values(p.blocked_blend(blocked, ["entity"], weight=0.1))
    assert [got[str(i)] for i in range(6)] == pytest.approx([0.13, 0.215, 0.555, 0.86, 0.54, 0.4])
    assert values(p.blocked_blend(blocked, ["entity"], weight=0.0)) == values(blocked, column="score")
    assert values(p.blocked_blend(blocked, ["entity"], weight=0.1, block_us=4 * HOUR))["0"] == pytest.approx(0.1)
    assert values(p.blocked_blend(blocked, ["entity", "all_same"])) != got


def test_sliding_blend(spark):
    rows = [("0", "c1", 0, 0.1), ("1", "c1", 20, 0.5), ("2", "c1", 90, 0.9), ("3", "c2", 10, 0.4)]
    make = lambda rs: spark.createDataFrame([(i, e, T0 + m * MINUTE, s) for i, e, m, s in rs], "transaction_id string, entity string, us long, score double")
    df = make(rows)
    got = values(p.sliding_blend(df, ["entity"], weight=0.5, half_us=30 * MINUTE))
    assert [got[str(i)] for i in range(4)] == pytest.approx([0.3, 0.3, 0.9, 0.4])
    assert values(p.sliding_blend(df, ["entity"], half_us=15 * MINUTE)) == pytest.approx(values(df, column="score"))
    assert values(p.sliding_blend(df, ["entity"], half_us=5000 * MINUTE))["0"] == pytest.approx(0.4)
    assert values(p.sliding_blend(make(rows[::-1]), ["entity"], half_us=30 * MINUTE)) == got
    edge = make([("0", "c", 0, 0.0), ("1", "c", 30, 1.0)])
    assert values(p.sliding_blend(edge, ["entity"], half_us=30 * MINUTE)) == {"0": 0.5, "1": 0.5}


def test_pairs_equal_window_counts(spark):
    rng = random.Random(3)
    rows = [(f"T{i}", f"c{rng.randrange(5)}", T0 + rng.randrange(300) * MINUTE, rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "transaction_id string, entity string, us long, score double")
    got = defaultdict(int, {x.src: x["count"] for x in p.neighbour_pairs(df, "entity", 25 * MINUTE, ["score"]).groupBy("src").count().collect()})
    for t, e, us, _ in rows:
        assert got[t] == sum(x[1] == e and abs(x[2] - us) <= 25 * MINUTE and x[0] != t for x in rows)


def test_local_percentile(spark):
    days = [[0, 1, 2, 3, 4], [0, 1, 2, 3, 4], [10] * 5, [-5, 2.5, 100, None, 0]]
    make = lambda ds: spark.createDataFrame([(f"{d}{k}", T0 + d * DAY + k, None if v is None else float(v)) for d, vs in enumerate(ds) for k, v in enumerate(vs)], "transaction_id string, us long, x double")
    got = values(drift.local_percentile(make(days), "x", "pct"), column="pct")
    assert [got[f"0{k}"] for k in range(5)] == [None] * 5
    assert [got[f"1{k}"] for k in range(5)] == pytest.approx([0, 0.2, 0.4, 0.6, 0.8]) and got["20"] == 1.0
    assert [got[f"3{k}"] for k in range(5)] == [0, pytest.approx(6 / 15), 1, None, 0]
    short = values(drift.local_percentile(make(days), "x", "pct", days=1), column="pct")
    assert (short["32"], short["31"]) == (1.0, 0.0)
    later = values(drift.local_percentile(make([*days[:2], [1e9] * 5, days[3]]), "x", "pct"), column="pct")
    assert all(later[f"{d}{k}"] == got[f"{d}{k}"] for d in (0, 1) for k in range(5))


def test_stability_index(spark):
    a = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    few = a.limit(50)
    assert drift.stability_index(a, a, ["x"]).first().psi == pytest.approx(0, abs=1e-9)
    assert drift.stability_index(few, a, ["x"]).first().psi == 0.0
    assert drift.stability_index(a.limit(5), a, ["x"], open_ends=False).first().psi is None
    assert drift.stability_index(a, a.select((F.col("x") + 500).alias("x")), ["x"]).first().psi > 1


def scored(spark, scores, labels):
    return spark.createDataFrame([(str(i), float(s), y) for i, (s, y) in enumerate(zip(scores, labels, strict=True))], "transaction_id string, score double, label int")


def test_average_precision_and_auc(spark):
    df = scored(spark, [0.9, 0.5, 0.5, 0.1], [1, 0, 1, 0])
    assert metrics.average_precision(df).first().ap == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert metrics.roc_auc(df).first().auc == pytest.approx(0.875)
    assert metrics.average_precision(df.where("label = 0")).first().ap is None
    assert metrics.at_fractions(scored(spark, [5, 4, 3, 2, 1], [1, 0, 0, 0, 1]), [0.5]).first().k == 2


def test_average_rank_and_spearman(spark):
    rng = random.Random(9)
    data = [(str(i), float(rng.randrange(20)), float(rng.randrange(9))) for i in range(300)]
    df = spark.createDataFrame(data, "transaction_id string, a double, b double")
    got = values(drift.average_rank(df, "a", "r"), column="r")
    for t, a, _ in data:
        below, same = sum(x[1] < a for x in data), sum(x[1] == a for x in data)
        assert got[t] == pytest.approx((below + (same + 1) / 2) / 300)
    import pandas as pd

    frame = pd.DataFrame(data, columns=["t", "a", "b"])
    assert drift.spearman(df, "a", "b").first().spearman == pytest.approx(frame["a"].rank().corr(frame["b"].rank()), abs=1e-8)


def test_acceptance(spark):
    rows = [("base", "1", 0.5), ("base", "2", 0.5), ("base", "3", 0.5), ("good", "1", 0.51), ("good", "2", 0.51), ("good", "3", 0.499), ("bad", "1", 0.6), ("bad", "2", 0.6), ("bad", "3", 0.49)]
    got = values(audit.acceptance(spark.createDataFrame(rows, "arm string, window string, metric double"), "base"), "arm", "accepted")
    assert got == {"good": True, "bad": False}


def brute_components(rows):
    out, edges = {}, []
    for t, us, a, b in sorted(rows, key=lambda x: (x[1], x[0])):
        near = defaultdict(set)
        for x, y in edges:
            near[x].add(y)
            near[y].add(x)

        def size(n, near=near):
            seen, todo = {n}, [n]
            while todo:
                for m in near[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            return len(seen)

        out[t] = (size(("a", a)), size(("b", b)))
        edges.append((("a", a), ("b", b)))
    return out


def test_component_sizes_before_each_row(spark):
    rng = random.Random(11)
    rows = [(f"T{i:03d}", rng.randrange(40), f"a{rng.randrange(18)}", f"b{rng.randrange(18)}") for i in range(70)]
    rows += [("U0", 100, "x1", "y1"), ("U1", 101, "x2", "y2"), ("U2", 102, "x1", "y2"), ("U3", 103, "x1", "y1")]
    df = spark.createDataFrame(rows, "transaction_id string, us long, a string, b string")
    got = {x.transaction_id: (x.g_a_size, x.g_b_size) for x in graph.component_sizes(df, "a", "b", "g").collect()}
    assert got == brute_components(rows)
    cut = {x.transaction_id: (x.g_a_size, x.g_b_size) for x in graph.component_sizes(df, "a", "b", "g", slice_edges=12, bucket=7).collect()}
    assert cut == got  # several slices of time, lookups in buckets
    assert [got[f"U{i}"] for i in range(4)] == [(1, 1), (1, 1), (2, 2), (4, 4)]


def test_folds(spark):
    rng = random.Random(2)
    rows = [(i, i * HOUR, rng.random(), rng.choice(["a", "b", None]), int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame([(i, us, None if i % 17 == 0 else x + y, k, y) for i, us, x, k, y in rows], "transaction_id long, us long, x double, kind string, label int")
    fold = evaluate.Fold("f", 300 * HOUR, 400 * HOUR)
    counts = evaluate.fold_rows(df, [fold]).first()
    assert (counts.train_rows, counts.valid_rows) == (300, 100)


def test_stream_equals_batch(spark, tmp_path):
    from lagline.streaming.prior import prior_stream

    rows = [(i, i % 3, i * 1_000_000, float(i)) for i in range(30)] + [(99, 1, 5, 1.0)]
    schema = "transaction_id long, customer_id long, us long, amount double"
    for k, part in enumerate((rows[:15], rows[15:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = prior_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {x.transaction_id: x for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[99].late and got[99].history_count is None
    for i, c, _, _ in rows[:-1]:
        before = [x for x in rows[:-1] if x[1] == c and x[0] < i]
        assert (got[i].history_count, got[i].amt_sum_prior) == (len(before), sum(x[3] for x in before))
