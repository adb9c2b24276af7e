"""Registered queries over parsing, discovery and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.operators import discovery as dc
from cutledger.operators import policies as po
from cutledger.functions.tokens import token_count
from cutledger.operators.positions import group_positions
from cutledger.plans.catalog.common import ORDER_PAYLOAD, ORDER_ROWS, CONV, ORD, T, found, leaves, records, tok
from cutledger.sources import views


def passthrough_reasons(spark, sf):
    docs = T(spark, sf, "documents").select(F.lit("documents").alias("origin"), "text")
    props = T(spark, sf, "events").select(F.lit("events").alias("origin"), F.col("props").alias("text"))
    reasons = dc.passthrough_reason(dc.find_records(dc.parse_payloads(docs.unionByName(props))))
    return reasons.groupBy("origin", "passthrough").agg(F.count(F.lit(1)).alias("payloads"))


def find_records_pick(spark, sf):
    o = group_positions(T(spark, sf, "orders"), ["o_custkey"], "o_orderkey")
    rec = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    urgent = lambda x: x["p"].isin("1-URGENT", "2-HIGH")
    packed = o.groupBy("o_custkey", F.expr("pos div 30").alias("b")).agg(F.array_sort(F.collect_list(rec)).alias("all"))
    body = F.struct(
        F.struct(F.filter("all", urgent).alias("urgent")).alias("a"),
        F.struct(F.struct(F.filter("all", lambda x: ~urgent(x)).alias("rest")).alias("c")).alias("b"),
        F.array(F.lit(1), F.lit(2)).alias("numbers"),
    )
    payloads = packed.select(F.concat_ws("/", "o_custkey", "b").alias("payload_id"), F.to_json(body).alias("text"))
    return found(payloads).select(
        "payload_id", F.array_join("record_path", ".").alias("record_path"), F.size("record_list").cast("long").alias("records"))


def records_exploded(spark, sf):
    r = records(views.order_payloads(spark, sf))
    return r.groupBy("payload_id").agg(F.count(F.lit(1)).alias("records"), F.max("rec_idx").alias("last_idx"))


def _with_siblings(spark, sf):
    o = group_positions(T(spark, sf, "orders"), ["o_custkey"], "o_orderkey")
    packed = o.groupBy("o_custkey", F.expr("pos div 30").alias("b")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("number")))).alias("items"))
    body = F.struct(
        F.struct("items", F.size("items").alias("count"), F.lit("").alias("note")).alias("data"),
        F.lit(None).cast("string").alias("cursor"),
        F.transform("items", lambda x: x["number"]).alias("keys"),
        F.struct(F.struct(F.col("o_custkey").alias("id")).alias("user")).alias("owner"),
    )
    return packed.select(F.concat_ws("/", "o_custkey", "b").alias("payload_id"),
                         F.to_json(body, {"ignoreNullFields": "false"}).alias("text"))


_SIBLINGS = f"""s AS (SELECT {ORDER_PAYLOAD} AS payload_id, max(o_custkey) AS c, count(*) AS n,
    concat('[', string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), ']') AS keys FROM {ORDER_ROWS} GROUP BY 1),
  m AS (SELECT payload_id, 'data.count' AS path, CAST(n AS VARCHAR) AS js, n FROM s
    UNION ALL SELECT payload_id, 'keys', keys, n FROM s
    UNION ALL SELECT payload_id, 'owner', concat('{{"user":{{"id":', c, '}}}}'), n FROM s)"""


def meta_siblings(spark, sf):
    return dc.envelope_meta(found(_with_siblings(spark, sf))).select("payload_id", "path", "js")


def meta_abbrev(spark, sf):
    m = dc.envelope_meta(found(_with_siblings(spark, sf)))
    return m.select("payload_id", "path", F.expr(dc.meta_display()).alias("shown"))


def clean_nonempty_counts(spark, sf):
    o = T(spark, sf, "orders")
    rec = F.struct(
        F.col("o_orderkey").alias("number"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("state"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
        F.struct(F.when(F.col("o_orderstatus") == "P", F.struct(F.col("o_custkey").alias("id"))).alias("who")).alias("owner"),
        F.array(F.lit(None).cast("string"), F.when(F.col("o_orderstatus") == "O", "x")).alias("tags"),
    )
    v = leaves(views.pack(o, "o_custkey", "o_orderkey", views.BLOCKS["orders"], rec))
    return v.where("js IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("filled"))


def json_equality(spark, sf):
    e = T(spark, sf, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long") + F.col("event_id") % 2
    compact = F.concat(F.lit('{"k":'), k, F.lit("}"))
    return e.select(po.same_json(F.col("props"), compact).alias("same")).groupBy("same").agg(F.count(F.lit(1)).alias("events"))


def structured_dedupe(spark, sf):
    p = views.conversation_payloads(spark, sf).withColumn("c", F.split("payload_id", "/")[0].cast("long"))
    structured = F.when(F.col("c") % 4 == 1, F.lit('{"other":1}')).when(F.col("c") % 4 != 0, F.concat(F.lit(" "), "text"))
    has_schema = F.when(F.col("c") % 3 == 0, F.lit(True)).when(F.col("c") % 3 == 1, F.lit(False))
    action = po.structured_action(structured, has_schema, po.same_json(F.col("text"), structured))
    return p.select("payload_id", action.alias("action"))


def routing_counts(spark, sf):
    e = T(spark, sf, "events")
    way = po.route(F.col("event_type") == "error", F.col("event_type") == "view")
    return e.groupBy(way.alias("route")).agg(F.count(F.lit(1)).alias("calls"))


def gain_gate(spark, sf):
    c = T(spark, sf, "conversations").withColumn("t", token_count("text"))
    sums = c.groupBy("conv_id").agg(
        F.sum("t").alias("before"), (F.sum(F.when(F.col("role") == "assistant", F.col("t")).otherwise(0)) + 60).alias("after"))
    return sums.select("conv_id", "before", "after", po.keeps_original(F.col("before"), F.col("after"), F.lit(False)).alias("original"))


QUERIES = {
    "passthrough_reasons": (passthrough_reasons, """SELECT origin, CASE WHEN json_valid(t) THEN 'no_records' ELSE 'not_json' END AS passthrough, count(*) AS payloads
        FROM (SELECT 'documents' AS origin, text AS t FROM documents UNION ALL SELECT 'events', props FROM events) GROUP BY ALL"""),
    "find_records_pick": (find_records_pick, f"""WITH s AS (SELECT {ORDER_PAYLOAD} AS payload_id,
          count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS u, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS r FROM {ORDER_ROWS} GROUP BY 1)
        SELECT payload_id, CASE WHEN u >= r THEN 'a.urgent' ELSE 'b.c.rest' END AS record_path, greatest(u, r) AS records FROM s"""),
    "records_exploded": (records_exploded, f"WITH {ORD} SELECT payload_id, count(*) AS records, max(rec_idx) AS last_idx FROM ord GROUP BY 1"),
    "meta_siblings": (meta_siblings, f"WITH {_SIBLINGS} SELECT payload_id, path, js FROM m"),
    "meta_abbrev": (meta_abbrev, f"""WITH {_SIBLINGS} SELECT payload_id, path,
        CASE WHEN length(js) > 120 THEN concat('[', n, ' items]') ELSE js END AS shown FROM m"""),
    "clean_nonempty_counts": (clean_nonempty_counts, """SELECT * FROM (
        SELECT 'number' AS path, count(*) AS filled FROM orders UNION ALL SELECT 'state', count(*) FILTER (o_orderstatus <> 'F') FROM orders
        UNION ALL SELECT 'priority', count(*) FILTER (o_orderpriority <> '5-LOW') FROM orders
        UNION ALL SELECT 'owner.who.id', count(*) FILTER (o_orderstatus = 'P') FROM orders
        UNION ALL SELECT 'tags', count(*) FILTER (o_orderstatus = 'O') FROM orders) WHERE filled > 0"""),
    "json_equality": (json_equality, "SELECT event_id % 2 = 0 AS same, count(*) AS events FROM events GROUP BY ALL"),
    "structured_dedupe": (structured_dedupe, f"""WITH {CONV} SELECT DISTINCT payload_id, CASE WHEN conv_id % 4 = 0 THEN 'shape'
        WHEN conv_id % 3 = 1 AND conv_id % 4 <> 1 THEN 'drop_copy_and_shape' ELSE 'keep' END AS action FROM conv"""),
    "routing_counts": (routing_counts, """SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skip' ELSE 'shape' END AS route, count(*) AS calls
        FROM events GROUP BY ALL"""),
    "gain_gate": (gain_gate, f"""WITH s AS (SELECT conv_id, CAST(sum({tok('text')}) AS BIGINT) AS before,
        CAST(sum(CASE WHEN role = 'assistant' THEN {tok('text')} ELSE 0 END) + 60 AS BIGINT) AS after FROM conversations GROUP BY 1)
        SELECT conv_id, before, after, after >= before AS original FROM s"""),
}
