"""Shared pieces of the registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cutledger.operators import discovery as dc
from cutledger.operators import leaves as lv
from cutledger.plans import shape as sh
from cutledger.sources.views import table as T  # noqa: F401

ORDER_ROWS = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)"
ORDER_PAYLOAD = "concat(o_custkey, '/', pos // 30)"
ORD = (
    f"ord AS (SELECT *, {ORDER_PAYLOAD} AS payload_id, pos % 30 AS rec_idx, "
    "concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS login, "
    "concat('Order ', o_orderkey, ' ', o_orderpriority) AS title, "
    f"CASE WHEN o_orderstatus = 'F' THEN concat('agent', o_orderkey % 7) END AS assignee FROM {ORDER_ROWS})"
)
CONV = (
    "conv AS (SELECT *, concat(conv_id, '/', pos // 64) AS payload_id, pos % 64 AS rec_idx "
    "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations))"
)
DOCS = "docs AS (SELECT *, concat(source, '/', (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16) AS payload_id FROM documents)"
EVT = (
    "evt AS (SELECT *, concat(user_id, '/', (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 100) AS payload_id, "
    "CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"
)


def tok(text: str) -> str:
    """Token count in the checking SQL."""
    return rf"CAST(len(regexp_extract_all({text}, '\p{{L}}{{1,6}}|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]')) AS BIGINT)"


def cost(text: str) -> str:
    return f"({tok(text)} + length({text}) - length(replace({text}, chr(10), '')))"


def found(payloads: DataFrame) -> DataFrame:
    return sh.discover(payloads)


def records(payloads: DataFrame, *keep: str) -> DataFrame:
    return dc.explode_records(found(payloads), "payload_id", *keep)


def leaves(payloads: DataFrame) -> DataFrame:
    return lv.leaf_values(records(payloads), "payload_id", "rec_idx")


def profile(payloads: DataFrame) -> DataFrame:
    return lv.path_profile(lv.record_paths(leaves(payloads)))


def totals(payloads: DataFrame) -> DataFrame:
    return found(payloads).select("payload_id", F.size("record_list").cast("long").alias("n_total"))
