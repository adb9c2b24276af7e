"""Registered queries over calls from result to view, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.plans import calls as cl
from cutledger.plans.catalog.common import ORD, T, cost
from cutledger.sources import views

BLOCK = views.BLOCKS["orders"]


def _policies(spark):
    rows = [("quiet", None, None, None, None, True), ("tight", ["number", "state"], None, 256, None, None),
            ("wide", ["number", "state"], None, 100_000, None, None)]
    return spark.createDataFrame(rows, "tool string, fields array<string>, counts array<string>, budget_tokens bigint, long_text_chars int, skip boolean")


def _calls(spark, sf):
    """Every customer's orders as call results of a tool: failed, skipped, with a copy to keep, not JSON, tight or wide."""
    record = F.struct(F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("state"),
                      F.concat_ws(" ", F.lit("Order"), "o_orderkey", "o_orderpriority").alias("title"))
    p = views.pack(T(spark, sf, "orders"), "o_custkey", "o_orderkey", BLOCK, record)
    cust, part = (F.split("payload_id", "/")[i].cast("long") for i in (0, 1))
    kind = cust % 8
    return p.select(
        "payload_id", (cust % 7).cast("string").alias("session_id"), (cust * 1000 + part).alias("arrival"),
        F.when(kind == 1, "quiet").when(kind == 4, "tight").otherwise("wide").alias("tool"),
        F.when(kind == 3, F.concat(F.lit("plain "), "payload_id")).otherwise(F.col("text")).alias("text"),
        F.when(kind.isin(2, 4), F.col("text")).alias("structured"), F.when(kind == 4, F.lit(False)).alias("has_schema"), (kind == 0).alias("is_error"))


def call_results(spark, sf):
    r = cl.call_results(_calls(spark, sf), _policies(spark))
    return r.select("payload_id", "outcome", "handle", "text", F.col("structured").isNotNull().alias("has_copy"), "shown", "next_offset",
                    F.col("tokens_after").cast("long").alias("tokens_after"))


def recover_views(spark, sf):
    e = T(spark, sf, "events")
    requests = e.select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 7).cast("string").alias("session_id"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("r"), F.col("event_id") % 150 + 1)).alias("handle"),
        F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.col("event_id") % 5).cast("long").alias("offset"),
        F.when(F.col("event_type") == "view", F.array(F.lit("title"), F.lit(""))).when(F.col("event_type") == "click", F.array(F.lit("title"))).alias("fields"),
        F.when(F.col("event_id") % 11 == 0, 100).cast("long").alias("budget_tokens"))
    archive = cl.call_archive(_calls(spark, sf), _policies(spark), keep=1_000_000_000)
    return cl.recover_views(requests, archive, _policies(spark)).select(
        "request_id", "error", "text", F.col("records").cast("long").alias("records"), F.col("shown").cast("long").alias("shown"), "start", "next_offset")


_CALLS = f"""{ORD}, p AS (SELECT payload_id, any_value(o_custkey) AS cust, CAST(split_part(payload_id, '/', 2) AS BIGINT) AS part, count(*) AS n,
    concat('{{"total_count":', count(*), ',"items":[', string_agg(concat('{{"number":', o_orderkey, ',"state":"', o_orderstatus, '","title":"', title, '"}}'), ',' ORDER BY rec_idx), ']}}') AS js
    FROM ord GROUP BY payload_id),
  k AS (SELECT *, cust % 8 AS kind, cust % 7 AS session_id, CASE cust % 8 WHEN 4 THEN 'tight' ELSE 'wide' END AS tool, CASE cust % 8 WHEN 4 THEN 256 ELSE 100000 END AS b FROM p),
  named AS (SELECT *, concat('r', row_number() OVER (PARTITION BY session_id ORDER BY cust, part)) AS h FROM k WHERE kind >= 4)"""


def _fitted(v: str) -> str:
    """Text of the most rows within the budget for each row of ``v`` (view, payload_id, tool, h, n, start, b, choice)."""
    return f"""lines AS (SELECT v.*, o.rec_idx - v.start + 1 AS s, string_agg(CASE v.choice WHEN 'title' THEN concat('{{"title":"', o.title, '"}}')
      ELSE concat('{{"number":', o.o_orderkey, ',"state":"', o.o_orderstatus, '"}}') END, chr(10)) OVER (PARTITION BY v.view ORDER BY o.rec_idx) AS body
      FROM {v} v JOIN ord o ON o.payload_id = v.payload_id AND o.rec_idx >= v.start),
    tried AS (SELECT * FROM lines UNION ALL SELECT *, 0 AS s, NULL AS body FROM {v} WHERE start = n),
    texts AS (SELECT *, concat('# handle="', h, '" keeps the whole response · recover(handle, offset, fields) gives cut records and left-out fields', chr(10),
      '# ', tool, ': showing ', s, ' of ', n, CASE WHEN start > 0 AND s > 0 THEN concat(' (records ', start + 1, '–', start + s, ')') ELSE '' END, ' · total_count=', n, chr(10),
      '# left out fields: ', CASE choice WHEN 'title' THEN 'number, state' ELSE 'title' END,
      CASE WHEN start + s < n THEN concat(chr(10), '# ', n - start - s, ' records not shown · recover with handle="', h, '" and offset=', start + s) ELSE '' END,
      CASE WHEN s > 0 THEN concat(chr(10), body) ELSE '' END) AS text FROM tried),
    fitted AS (SELECT view, CAST(max(s) AS BIGINT) AS shown, arg_max(text, s) AS text FROM texts WHERE {cost('text')} <= b GROUP BY view)"""


QUERIES = {
    "call_results": (call_results, f"""WITH {_CALLS}, v AS (SELECT payload_id AS view, payload_id, tool, h, n, 0 AS start, b, 'rows' AS choice FROM named), {_fitted('v')},
        j AS (SELECT k.payload_id, kind, js, n, h, f.text, f.shown, CASE WHEN kind < 4 THEN NULL WHEN {cost('f.text')} >= {cost('js')} THEN 'no_gain' ELSE 'shaped' END AS fit
          FROM k LEFT JOIN named USING (payload_id, kind, js, n) LEFT JOIN fitted f ON f.view = k.payload_id)
        SELECT payload_id, CASE kind WHEN 0 THEN 'error' WHEN 1 THEN 'skip' WHEN 2 THEN 'structured' WHEN 3 THEN 'not_json' ELSE fit END AS outcome, h AS handle,
          CASE WHEN fit = 'shaped' THEN text WHEN kind = 3 THEN concat('plain ', payload_id) ELSE js END AS text,
          kind = 2 OR (kind = 4 AND fit = 'no_gain') AS has_copy, CASE WHEN fit = 'shaped' THEN shown END AS shown,
          CASE WHEN fit = 'shaped' AND shown < n THEN shown END AS next_offset,
          CASE WHEN fit = 'shaped' THEN {cost('text')} WHEN kind >= 4 THEN {cost('js')} WHEN kind = 3 THEN {cost("concat('plain ', payload_id)")} END AS tokens_after FROM j"""),
    "recover_views": (recover_views, f"""WITH {_CALLS}, req AS (SELECT event_id AS request_id, user_id % 7 AS session_id, CASE WHEN event_type <> 'signup' THEN concat('r', event_id % 150 + 1) END AS handle,
          event_id % 5 AS off, CASE event_type WHEN 'click' THEN 'title' ELSE 'rows' END AS choice,
          event_type IN ('signup', 'error', 'view') OR event_id % 11 = 0 AS bad FROM events),
        hit AS (SELECT r.*, a.payload_id, a.tool, a.h, a.n, a.b, least(off, a.n) AS start, concat_ws('|', a.payload_id, off, choice) AS view
          FROM req r LEFT JOIN named a ON a.session_id = r.session_id AND a.h = r.handle AND NOT r.bad),
        v AS (SELECT DISTINCT view, payload_id, tool, h, n, start, b, choice FROM hit WHERE payload_id IS NOT NULL), {_fitted('v')}
        SELECT request_id, CASE WHEN bad THEN 'invalid arguments' WHEN payload_id IS NULL THEN 'unknown or expired handle' END AS error, f.text, n AS records, f.shown, CASE WHEN payload_id IS NOT NULL THEN start END AS start,
          CASE WHEN start + f.shown < n THEN start + f.shown END AS next_offset FROM hit LEFT JOIN fitted f ON f.view = hit.view"""),
}
