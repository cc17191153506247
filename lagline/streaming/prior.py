"""Prior features of a live stream, kept as state by entity.

Each entity's state is three numbers: count, sum (in hundredths, so that it is exact)
and last time. A row older than the entity's last one would break the strictly-prior
rule; it is sent out marked late, without features, and does not enter the state.
Rows of one micro-batch are taken in order of (us, transaction_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "transaction_id long, customer_id long, us long, amount double, history_count long, amt_sum_prior double, seconds_since_last double, late boolean"
STATE = "n long, cents long, last_us long"


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total, last = state.get if state.exists else (0, 0, None)
    rows = pd.concat(list(frames)).sort_values(["us", "transaction_id"])  # one entity's rows of one micro-batch
    us = rows["us"].to_numpy()
    late = us < last if last is not None else np.zeros(len(us), bool)
    fresh, cents = us[~late], np.rint(rows["amount"].to_numpy()[~late] * 100).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(cents)))
    out = rows[["transaction_id", "customer_id", "us", "amount"]].assign(late=late)
    features = np.full((3, len(us)), np.nan)
    features[0, ~late] = n + np.arange(len(fresh))
    features[1, ~late] = (total + before[:-1]) / 100.0
    features[2, ~late] = np.diff(fresh, prepend=np.int64(last if last is not None else 0)) / 1e6
    if last is None and len(fresh):
        features[2, np.flatnonzero(~late)[0]] = np.nan
    if len(fresh):
        state.update((n + len(fresh), total + int(before[-1]), int(fresh[-1])))
    out["history_count"] = pd.array(np.where(late, 0, features[0]), "Int64")
    out.loc[late, "history_count"] = pd.NA
    for name, values in (("amt_sum_prior", features[1]), ("seconds_since_last", features[2])):
        out[name] = pd.array(np.nan_to_num(values), "Float64")
        out.loc[np.isnan(values), name] = pd.NA
    yield out[["transaction_id", "customer_id", "us", "amount", "history_count", "amt_sum_prior", "seconds_since_last", "late"]]


def prior_stream(stream: DataFrame) -> DataFrame:
    """stream: transaction_id, customer_id, us, amount (double). Use it with append output."""
    return stream.groupBy("customer_id").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_activity(stream: DataFrame, ts: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum by customer and event-time window; rows later than the watermark are dropped by Spark."""
    from pyspark.sql import functions as F

    held = stream.withWatermark(ts, late).groupBy(F.window(ts, width), "customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    return held.select(F.col("window.start").alias("start"), "customer_id", "n", "total")
