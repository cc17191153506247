"""The stream profile against plain loops over several micro-batches, with late rows, ties and a customer that a timer visits."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from lagline.streaming.profile import Profile, profile_stream, sessions, split, with_rocks

SCHEMA = "transaction_id long, customer_id long, device_id long, us long, amount double"
MINUTE = 60_000_000
WIDTH = 90 * MINUTE


def loops(batches):
    """transaction_id -> features, None for late rows."""
    held, out = {}, {}
    for rows in batches:
        for i, c, d, us, x in sorted(rows, key=lambda r: (r[3], r[0])):
            mine = held.setdefault(c, [])
            if mine and any((us, i) < (r[3], r[0]) for r in mine if r[5] != id(rows)):
                out[i] = None
                continue
            near = [r for r in mine if us - WIDTH <= r[3] < us]
            top = max((r[4] for r in mine), default=None)
            out[i] = (len(mine), sum(round(r[4] * 100) for r in mine) / 100, (us - mine[-1][3]) / 1e6 if mine else None, top, float(x > top) if mine else None, int(d not in {r[2] for r in mine}), len({r[2] for r in mine}), len(near), sum(round(r[4] * 100) for r in near) / 100)
            mine.append((i, c, d, us, x, id(rows)))
    return out


def batches():
    rng, out, i = random.Random(8), [], 0
    for k in range(4):
        rows = []
        for _ in range(60):
            i += 1
            us = (k * 300 + rng.randrange(-40, 300)) * MINUTE if k else rng.randrange(300) * MINUTE
            rows.append((i, rng.randrange(4), rng.choice([1, 2, 3, None]), us, rng.randrange(1, 2000) / 100))
        out.append(rows)
    out[0].append((1000, 9, 1, 5 * MINUTE, 1.0))  # quiet until the last batch, long after a timer
    out[3].append((1001, 9, 1, 1150 * MINUTE, 2.0))
    out[3].append((1002, 9, 2, 1150 * MINUTE, 3.0))
    return out


def run(spark, tmp_path, name, make, delay):
    for k, rows in enumerate(batches()):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in/*")
    start = lambda: make(stream, delay).writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start().awaitTermination()
    with_rocks(spark, start)
    return spark.read.parquet(f"{tmp_path}/{name}/out")


def test_profile_equals_loops(spark, tmp_path):
    got = run(spark, tmp_path, "profile", lambda s, delay: profile_stream(s, WIDTH, delay), "1 hour")
    on_time, late = split(got)
    want = loops(batches())
    names = ["history_count", "amt_sum_prior", "seconds_since_last", "amt_max_prior", "is_record_amt", "is_new_device", "devices_prior", "cnt_recent", "amtsum_recent"]
    held = {r.transaction_id: tuple(r[c] for c in names) for r in on_time.collect()}
    gone = {r.transaction_id for r in late.collect()}
    assert gone and all(want[i] is None for i in gone)
    bad = {i: (v, want[i]) for i, v in held.items() if v != want[i]}
    assert not bad, [(i, v[0][-3:], v[1][-3:]) for i, v in bad.items()][:3]
    dropped = set(want) - set(held) - gone  # older than the watermark: Spark's own rule
    assert all(want[i] is None for i in dropped)
    assert held[1001] == (1, 1.0, 1145 * 60.0, 1.0, 1.0, 0, 1, 0, 0.0) and held[1002][-2:] == (0, 0.0)


def test_sessions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    put = lambda d: d.withColumn("_cents", F.rint(F.col("amount") * 100).cast("long"))
    rows = [r for b in batches() for r in b]
    want = {(r.customer_id, r.start, r.end, r.n, r.total) for r in sessions(put(spark.createDataFrame(rows, SCHEMA)), "20 minutes").collect()}
    got = {(r.customer_id, r.start, r.end, r.n, r.total) for r in run(spark, tmp_path, "sessions", lambda s, delay: sessions(put(s), "20 minutes", delay), "1 hour").collect()}
    assert got <= want and len(got) > len(want) // 2  # the last ones wait for the watermark
    assert sum(n for *_, n, _ in want) == len(rows)


class Counted:
    """Value, map and list state in memory that counts the messages a processor would send."""

    def __init__(self):
        self.level, self.pages, self.rows, self.sent = None, {}, [], 0

    def getValueState(self, *_):
        return _Held(self, get=lambda: self.level, exists=lambda: self.level is not None, update=lambda v: setattr(self, "level", v))

    def getMapState(self, *_):
        return _Held(self, getValue=lambda k: self.pages.get(k), containsKey=lambda k: k in self.pages, updateValue=lambda k, v: self.pages.__setitem__(k, v))

    def getListState(self, *_):
        return _Held(self, get=lambda: iter(self.rows), exists=lambda: bool(self.rows), put=lambda v: setattr(self, "rows", v))

    def registerTimer(self, _):
        self.sent += 1


class _Held:
    def __init__(self, owner, **calls):
        for name, f in calls.items():
            setattr(self, name, lambda *a, f=f: setattr(owner, "sent", owner.sent + 1) or f(*a))


def test_messages_to_the_state_don_t_follow_the_devices():
    """Three batches of 400 rows with up to 1,200 devices of their own: pages fill, double, and tell new devices from known ones."""
    handle, seen, rng = Counted(), set(), random.Random(3)
    profile = Profile(WIDTH)
    profile.init(handle)
    for k in range(3):
        devices = [str(rng.randrange(1200)) for _ in range(400)]
        rows = [Row(transaction_id=k * 400 + i, customer_id=1, device_id=d, us=k * 400 + i, amount=1.0) for i, d in enumerate(devices)]
        got = list(profile.handleInputRows((1,), iter(rows), None))
        want = [int(d not in seen and not seen.add(d)) for d in devices]
        assert [r.is_new_device for r in got] == want and got[-1].devices_prior == len(seen) - want[-1]
    assert sorted(d for (held,) in handle.pages.values() for d in held) == sorted(seen) and len(handle.pages) == 4
    assert handle.sent < 50  # 1,200 and more with a question for each device
