"""Registered queries over recovery, dictionaries, traces and savings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.functions.tokens import token_count
from cutledger.operators import ids
from cutledger.operators import recover as rc
from cutledger.plans import shape as sh
from cutledger.plans.catalog.common import CONV, T, found, tok
from cutledger.sources import views
from cutledger.sources.payloads import archive
from cutledger.streaming import streams

DAY = 24 * 3600


def _archive(spark, sf):
    p = views.conversation_payloads(spark, sf)
    conv = F.split("payload_id", "/")[0].cast("long")
    return archive(p.withColumns({"session_id": conv % 7, "arrival": F.expr("cast(split(payload_id, '/')[0] AS bigint) * 1000 + cast(split(payload_id, '/')[1] AS bigint)")}), keep=10)


def _requests(spark, sf):
    e = T(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 7).alias("session_id"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("r"), F.col("event_id") % 20 + 1)).alias("handle"),
        F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.col("event_id") % 5).alias("offset"),
        F.when(F.col("event_type") == "view", F.array(F.lit("turn"), F.lit(""))).when(F.col("event_type") == "click", F.array(F.lit("*"))).alias("fields"),
        F.when(F.col("event_id") % 11 == 0, 100).alias("budget_tokens"))


def recover_pages(spark, sf):
    arch = _archive(spark, sf)
    sizes = found(arch.select("session_id", "handle", "payload_id", "text")).select(
        "session_id", "handle", F.col("payload_id").alias("conv"), F.size("record_list").cast("long").alias("records"))
    good = rc.bind_requests(_requests(spark, sf), arch).where("error IS NULL").select("request_id", "session_id", "handle", "o_mode", "o_offset")
    return good.join(sizes, ["session_id", "handle"]).select(
        "request_id", "conv", "o_mode", F.least("o_offset", "records").alias("start"), F.greatest(F.lit(0), F.col("records") - F.col("o_offset")).alias("remaining"))


def recover_errors(spark, sf):
    bound = rc.bind_requests(_requests(spark, sf), _archive(spark, sf))
    return bound.groupBy("error").agg(F.count(F.lit(1)).alias("requests"))


def validate_recovery(spark, sf):
    e = T(spark, sf, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    scope = lambda n: F.create_map(F.lit("owner"), F.lit("acme"), F.lit("repo"), F.concat(F.lit("r"), F.col("k") % n))
    regs = e.where("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("session_id"), "ts", F.when(F.col("k") % 4 == 0, "jira").otherwise("github").alias("adapter"),
        scope(2).alias("scope"), F.array(F.lit("title"), F.lit("body")).alias("allowed"),
        F.when(F.col("k") % 3 == 0, F.array(F.lit("body"))).otherwise(F.array().cast("array<string>")).alias("redacted"))
    reqs = e.where("event_type = 'click'").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("session_id"), "ts", F.lit("github").alias("adapter"),
        scope(2).alias("scope"), F.when(F.col("k") % 5 == 0, F.array(F.lit("title"), F.lit("secret"))).otherwise(F.array(F.lit("title"), F.lit("body"))).alias("fields"))
    return rc.validate_recovery(reqs, regs, ttl_seconds=DAY).select(F.col("request_id").cast("long").alias("request_id"), "reason")


def _values(spark, sf):
    value = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("cus_"), F.left(F.md5(F.col("o_custkey").cast("string")), F.lit(14))))
        .when(F.col("o_orderkey") % 3 == 1, F.format_string("Customer#%09d", "o_custkey"))
        .otherwise(F.md5(F.col("o_orderkey").cast("string"))))
    return T(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).cast("string").alias("session_id"), F.col("o_orderkey").alias("seen"), value.alias("value"))


def alias_candidates(spark, sf):
    return ids.alias_candidates(_values(spark, sf))


def _dictionary(spark, sf):
    return ids.assign_aliases(ids.alias_candidates(_values(spark, sf)), block=1_000)


def assign_aliases(spark, sf):
    return _dictionary(spark, sf)


def assign_aliases_incremental(spark, sf):
    v = _values(spark, sf)
    half = ids.assign_aliases(ids.alias_candidates(v.where("seen < 5000")), block=1_000)
    return ids.assign_aliases(ids.alias_candidates(v), half, block=1_000)


def apply_aliases(spark, sf):
    return ids.apply_aliases(_values(spark, sf), _dictionary(spark, sf)).select("session_id", "seen", "shown")


def restore_aliases(spark, sf):
    args = T(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).cast("string").alias("session_id"), "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("see @"), F.col("o_orderkey") % 900))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("@0"), F.col("o_orderkey") % 900))
        .otherwise(F.concat(F.lit("@"), F.col("o_orderkey") % 2000)).alias("argument"))
    return ids.restore_aliases(args, _dictionary(spark, sf)).select("o_orderkey", "restored")


def trace_events(spark, sf):
    s = sh.shape_payloads(views.conversation_payloads(spark, sf), fields="auto", max_tokens=100_000)
    t = streams.trace_events(s, "search", "conversations")
    return t.select("payload_id", "outcome", "shown_rows", "omitted_rows", "budget_cut_rows", "withheld_fields", "recovery_kind")


def savings_by_tool(spark, sf):
    c = T(spark, sf, "conversations").select(
        F.col("role").alias("tool"), token_count("text").cast("long").alias("before"), F.least(token_count("text"), F.lit(60)).cast("long").alias("after"))
    return streams.savings(c, "tool")


def savings_by_hour(spark, sf):
    e = T(spark, sf, "events").select(F.window(F.col("ts").cast("timestamp"), "6 hours").alias("window"), F.col("event_type").alias("tool"),
                                      token_count("props").cast("long").alias("before"), F.least(token_count("props"), F.lit(5)).cast("long").alias("after"))
    return streams.savings(e, "window", "tool").select(F.col("window.start").cast("string").alias("start"), "tool", "calls", "before", "after", "saved_permille")


_ARCHIVE = f"""{CONV}, p AS (SELECT payload_id, max(conv_id) AS conv_id, max(turn // 64) AS b, count(*) AS records FROM conv GROUP BY 1),
  n AS (SELECT *, conv_id % 7 AS session_id, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, b) AS n,
    row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id DESC, b DESC) AS back FROM p),
  arch AS (SELECT *, concat('r', n) AS handle FROM n WHERE back <= 10),
  req AS (SELECT event_id AS request_id, user_id % 7 AS session_id, CASE WHEN event_type <> 'signup' THEN concat('r', event_id % 20 + 1) END AS handle,
    CASE WHEN event_type = 'error' THEN -1 ELSE event_id % 5 END AS off, event_type, event_id FROM events),
  bound AS (SELECT r.*, a.payload_id, a.records, CASE WHEN r.handle IS NULL OR off < 0 OR event_id % 11 = 0 OR event_type = 'view' THEN 'invalid arguments'
    WHEN a.payload_id IS NULL THEN 'unknown or expired handle' END AS error FROM req r LEFT JOIN arch a ON a.session_id = r.session_id AND a.handle = r.handle)"""
_VALUES = """v AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS session_id, o_orderkey AS seen, CASE o_orderkey % 3 WHEN 0 THEN concat('cus_', left(md5(CAST(o_custkey AS VARCHAR)), 14))
    WHEN 1 THEN concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) ELSE md5(CAST(o_orderkey AS VARCHAR)) END AS value FROM orders),
  b AS (SELECT *, CASE WHEN starts_with(value, 'cus_') THEN substr(value, 5) ELSE value END AS body FROM v),
  c AS (SELECT session_id, value, min(seen) AS first_seen FROM b WHERE NOT starts_with(value, 'Customer') AND NOT regexp_matches(body, '^[a-f]+$')
    AND len(regexp_extract_all(body, '[0-9]+|[a-z]+|[A-Z]+')) >= 5 GROUP BY 1, 2),
  d AS (SELECT session_id, value, row_number() OVER (PARTITION BY session_id ORDER BY first_seen) AS alias_no FROM c)"""

QUERIES = {
    "recover_pages": (recover_pages, f"""WITH {_ARCHIVE} SELECT request_id, payload_id AS conv, CASE WHEN event_type = 'click' THEN 'all' ELSE 'auto' END AS o_mode,
        least(off, records) AS start, greatest(0, records - off) AS remaining FROM bound WHERE error IS NULL"""),
    "recover_errors": (recover_errors, f"WITH {_ARCHIVE} SELECT error, count(*) AS requests FROM bound GROUP BY 1"),
    "validate_recovery": (validate_recovery, """WITH e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
        r AS (SELECT user_id, ts, k FROM e WHERE event_type = 'signup'), q AS (SELECT event_id, user_id, ts, k FROM e WHERE event_type = 'click'),
        j AS (SELECT q.event_id, q.k, CASE WHEN r.ts > q.ts - INTERVAL 1 DAY THEN r.k END AS rk FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.ts >= r.ts)
        SELECT event_id AS request_id, CASE WHEN rk IS NULL THEN 'session not found or expired'
          WHEN rk % 4 = 0 THEN 'recovery adapter mismatch: expected jira, got github'
          WHEN rk % 2 <> k % 2 THEN concat('scope mismatch for repo: expected r', rk % 2, ', got r', k % 2)
          WHEN k % 5 = 0 THEN 'field ''secret'' is not in the allowed recovery field list'
          WHEN rk % 3 = 0 THEN 'field ''body'' is permanently redacted by policy and cannot be recovered' END AS reason FROM j"""),
    "alias_candidates": (alias_candidates, f"WITH {_VALUES} SELECT session_id, value, first_seen FROM c"),
    "assign_aliases": (assign_aliases, f"WITH {_VALUES} SELECT session_id, value, alias_no FROM d"),
    "assign_aliases_incremental": (assign_aliases_incremental, f"WITH {_VALUES} SELECT session_id, value, alias_no FROM d"),
    "apply_aliases": (apply_aliases, f"WITH {_VALUES} SELECT v.session_id, v.seen, coalesce('@' || alias_no, v.value) AS shown FROM v LEFT JOIN d ON d.session_id = v.session_id AND d.value = v.value"),
    "restore_aliases": (restore_aliases, f"""WITH {_VALUES}, a AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS session_id, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('see @', o_orderkey % 900)
          WHEN 1 THEN concat('@0', o_orderkey % 900) ELSE concat('@', o_orderkey % 2000) END AS argument FROM orders)
        SELECT o_orderkey, coalesce(d.value, argument) AS restored FROM a LEFT JOIN d ON d.session_id = a.session_id AND argument = concat('@', d.alias_no)"""),
    "trace_events": (trace_events, f"""WITH {CONV} SELECT payload_id, 'shaped' AS outcome, count(*) AS shown_rows, 0 AS omitted_rows, 0 AS budget_cut_rows,
        CASE WHEN sum(length(text)) > 200 * count(*) THEN 1 ELSE 0 END AS withheld_fields, CAST(NULL AS VARCHAR) AS recovery_kind FROM conv GROUP BY 1"""),
    "savings_by_tool": (savings_by_tool, f"""WITH c AS (SELECT role AS tool, {tok('text')} AS t FROM conversations), s AS (SELECT tool, count(*) AS calls, CAST(sum(t) AS BIGINT) AS before, CAST(sum(least(t, 60)) AS BIGINT) AS after FROM c GROUP BY 1)
        SELECT *, CAST(floor(1000.0 * (before - after) / before + 0.5) AS BIGINT) AS saved_permille FROM s"""),
    "savings_by_hour": (savings_by_hour, f"""WITH c AS (SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS tool, {tok('props')} AS t FROM events),
        s AS (SELECT start, tool, count(*) AS calls, CAST(sum(t) AS BIGINT) AS before, CAST(sum(least(t, 5)) AS BIGINT) AS after FROM c GROUP BY 1, 2)
        SELECT *, CAST(floor(1000.0 * (before - after) / before + 0.5) AS BIGINT) AS saved_permille FROM s"""),
}
