"""A customer's profile as stream state: levels, records, novelty and trailing activity, equal to the batch features.

State by customer, in the state store: a value (count, sum, greatest amount, last
row), a map of what the customer has met, and a list of the rows of the last
`width`, from which older ones go as new ones come. Rows of a micro-batch are taken
in order of (us, transaction_id) and answered in arrays.

Each question to the state is a message to the JVM and back, which costs more than
the arithmetic of a whole batch. So what was met stands in pages by hash, twice as
many whenever they are full: a batch asks for the pages of its devices, not for each
device, and neither messages nor bytes grow faster than the batch's own devices.
Rows come and go as rows: a data frame a customer and batch costs more than a few rows.

A row that stands before the customer's last one would break the strictly-prior
rule: it comes out with late = true and no features, and does not enter the state;
split() parts the two outputs. Rows older than the watermark are what Spark drops,
so the delay is how late a row may come at all. When the watermark passes the last
row by `width`, a timer empties the list of a customer that has gone quiet; the
list could not have counted again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "transaction_id long, customer_id long, us long, late boolean, history_count long, amt_sum_prior double, seconds_since_last double, amt_max_prior double, is_record_amt double, is_new_device int, devices_prior long, cnt_recent long, amtsum_recent double"
NAMES = [c.split()[0] for c in OUT.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Devices of a page, when the customer's pages are about full.
PAGE = 256


def pages(met: int) -> int:
    """How many pages hold so many devices: a power of two."""
    n = 1
    while n * PAGE < met:
        n *= 2
    return n


def page_of(device: str, n: int) -> int:
    return zlib.crc32(device.encode()) & (n - 1)  # the same in every worker


class Profile(StatefulProcessor):
    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "n long, cents long, top long, last_us long, last_id long, met long")
        self.met = handle.getMapState("met", "page int", "devices array<string>")
        self.recent = handle.getListState("recent", "us long, cents long")

    def page(self, k: int) -> list[str]:
        held = self.met.getValue((k,))
        return list(held[0]) if held is not None else []

    def meet(self, devices: list[str], met: int) -> list[str]:
        """Those of the batch's different devices that the customer, who has met so many, had not; they are met from here on."""
        n = pages(met)
        asked: dict[int, list[str]] = {}
        for d in devices:
            asked.setdefault(page_of(d, n), []).append(d)
        held = {k: self.page(k) if met else [] for k in asked}
        known = {d for page in held.values() for d in page}
        new = [d for d in devices if d not in known]
        more = pages(met + len(new))
        if more == n:
            for k, mine in asked.items():
                added = [d for d in mine if d not in known]
                if added:
                    self.met.updateValue((k,), (held[k] + added,))
        else:  # twice as many pages or more: all are dealt anew, which a device pays for a few times in its life
            dealt: dict[int, list[str]] = {}
            for d in [d for k in range(n) for d in (held[k] if k in held else self.page(k) if met else [])] + new:
                dealt.setdefault(page_of(d, more), []).append(d)
            for k, mine in dealt.items():
                self.met.updateValue((k,), (mine,))
        return new

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)  # one customer's rows of one micro-batch
        column = dict(zip(rows[0].__fields__, zip(*rows, strict=True), strict=True))
        us, ids = np.array(column["us"], np.int64), np.array(column["transaction_id"], np.int64)
        order = np.lexsort((ids, us))
        us, ids = us[order], ids[order]
        device_id, amount = (np.array(column[c], kind)[order] for c, kind in (("device_id", object), ("amount", float)))
        held = self.level.get()
        n, total, top, last_us, last_id, met = (0, 0, None, None, None, 0) if held is None else held
        late = (us < last_us) | ((us == last_us) & (ids < last_id)) if last_us is not None else np.zeros(len(us), bool)
        values = [(None, None)] * (len(NAMES) - 4)
        some = ~late
        if some.any():
            t, x = us[some], np.rint(amount[some] * 100).astype(np.int64)
            device = ["\0null" if d is None else d for d in device_id[some].tolist()]
            first = {d: k for k, d in reversed(list(enumerate(device)))}
            fresh = self.meet(list(dict.fromkeys(device)), met)
            new = np.zeros(len(t), bool)
            new[[first[d] for d in fresh]] = True
            near = last_us is not None and last_us >= t[0] - self.width and self.recent.exists()  # else no row of the list counts again
            old = [r for r in self.recent.get() if r[0] >= t[0] - self.width] if near else []
            times = np.concatenate((np.array([u for u, _ in old], np.int64), t))
            sums = np.concatenate(([0], np.cumsum(np.concatenate((np.array([c for _, c in old], np.int64), x)))))
            low, high = np.searchsorted(times, t - self.width), np.searchsorted(times, t)
            before = np.concatenate(([0], np.cumsum(x)))
            least = np.iinfo(np.int64).min
            tops = np.maximum.accumulate(np.concatenate(([least if top is None else top], x)))
            known = tops[:-1] > least
            gap = np.diff(t, prepend=t[0] if last_us is None else last_us) / 1e6
            count = n + np.arange(len(t))
            values = [(count, None), ((total + before[:-1]) / 100.0, None), (gap, count > 0), (tops[:-1] / 100.0, known), ((x > tops[:-1]).astype(float), known), (new.astype(np.int64), None), (met + np.concatenate(([0], np.cumsum(new)))[:-1], None), (high - low, None), ((sums[high] - sums[low]) / 100.0, None)]
            self.level.update((n + len(t), total + int(before[-1]), int(tops[-1]), int(t[-1]), int(ids[some][-1]), met + len(fresh)))
            stay = times >= t[-1] - self.width
            self.recent.put(list(zip(times[stay].tolist(), np.diff(sums)[stay].tolist(), strict=True)))
            self.handle.registerTimer((int(t[-1]) + self.width) // 1000 + 1)
        done = [ids.tolist(), column["customer_id"], us.tolist(), late.tolist()]
        for value, real in values:
            told = [None] * len(us)
            if value is not None:
                there = some.nonzero()[0] if real is None else some.nonzero()[0][real]
                for k, v in zip(there.tolist(), (value if real is None else value[real]).tolist(), strict=True):
                    told[k] = v
            done.append(told)
        yield from map(Row(*NAMES), *done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.level.get()[3]
        if (last + self.width) // 1000 < timerValues.getCurrentWatermarkInMs():  # an earlier row's timer comes too early
            self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def profile_stream(stream: DataFrame, width: int, delay: str = "30 days") -> DataFrame:
    """stream: transaction_id, customer_id, device_id, us (epoch microseconds), amount (double). Append output; needs the RocksDB state store, see with_rocks()."""
    # as text, so that numbers look the same whether or not a batch has nulls
    timed = stream.withColumns({"_ts": F.timestamp_micros("us"), "device_id": F.col("device_id").cast("string")}).withWatermark("_ts", delay)
    return timed.groupBy("customer_id").transformWithState(Profile(width), OUT, "Append", "EventTime")


def with_rocks(spark, run):
    """Runs a function that starts stream queries with the state store that Profile needs; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with features, and rows that came late."""
    features = [c for c in rows.columns if c != "late"]
    return rows.where("not late").select(*features), rows.where("late").select("transaction_id", "customer_id", "us")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """A customer's sessions: rows with less than gap between them. customer_id, start and end (the last row's us), n, total of _cents.

    For streams give the delay: a session comes out when the watermark has passed its end.
    """
    timed = stream.withColumn("_ts", F.timestamp_micros("us"))
    timed = timed.withWatermark("_ts", delay) if delay else timed
    held = timed.groupBy(F.session_window("_ts", gap), "customer_id").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("_cents").alias("total"))
    return held.select("customer_id", "start", "end", "n", "total")
