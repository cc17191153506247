"""The two test beds, as DataFrames and as SQL."""

from __future__ import annotations

from ..sources.adapters import events_fact, lineitem_fact

__all__ = ["EVENTS", "LINES", "events_fact", "lineitem_fact", "register"]

EVENTS = """fact AS (
  SELECT event_id AS transaction_id, epoch_us(ts) AS us, user_id AS customer_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS device_id, event_type AS transaction_type,
         CAST(value AS DECIMAL(18,2)) AS amount, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
  FROM events)"""

LINES = """fact AS (
  SELECT concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), lpad(l_linenumber::VARCHAR, 12, '0'), lpad(l_partkey::VARCHAR, 12, '0'), lpad(l_suppkey::VARCHAR, 12, '0'),
                   (epoch_us(l_shipdate) // 1000000)::VARCHAR, lpad(CAST(l_extendedprice AS DECIMAL(18,2))::VARCHAR, 14, '0')) AS transaction_id,
         epoch_us(l_shipdate) AS us, o_custkey AS customer_id, l_suppkey AS merchant_id, l_partkey AS device_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, p_type AS merchant_category, o_orderstatus AS device_type, n_name AS location,
         o_orderpriority AS payment_method, l_linestatus AS transaction_type, l_quantity::INTEGER AS account_age_days, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
       LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def register(queries: dict, oracles: dict, name: str, sql: str | None = None):
    """Decorator: files a query and its SQL under a name."""

    def put(f):
        queries[name] = f
        if sql is not None:
            oracles[name] = sql
        return f

    return put
