"""Registered queries over budgets and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.functions.tokens import token_count
from cutledger.operators import budget as bd
from cutledger.operators import frame
from cutledger.plans import shape as sh
from cutledger.plans.catalog.common import CONV, DOCS, ORD, T, cost, tok, totals
from cutledger.sources import views

HEADER, BUDGET = 20, 500


def token_counts(spark, sf):
    return T(spark, sf, "documents").select("doc_id", token_count("text").cast("long").alias("tokens"))


def _turns(spark, sf):
    """Turns with a dense position in their conversation."""
    from cutledger.operators.positions import group_positions

    c = T(spark, sf, "conversations").withColumn("cost", token_count("text").cast("long"))
    return group_positions(c, ["conv_id"], "turn", block=1_000).select("conv_id", "role", "pos", "cost", F.col("group_rows").alias("total"))


def budget_pack(spark, sf):
    p = bd.budget_pack(_turns(spark, sf), "conv_id", "pos", "cost", BUDGET, HEADER)
    return p.groupBy("conv_id").agg(F.count(F.lit(1)).alias("shown"), F.max("used").alias("used"))


def page_offset(spark, sf):
    t = totals(views.order_payloads(spark, sf))
    start = bd.page_start(F.lit(2), F.col("n_total"))
    shown = F.col("n_total") - start
    return t.select("payload_id", start.cast("long").alias("start"), shown.cast("long").alias("shown"), bd.page_label(start, shown).alias("label"))


def next_offset(spark, sf):
    r = _turns(spark, sf)
    p = bd.budget_pack(r, "conv_id", "pos", "cost", BUDGET, HEADER, offset=1)
    shown = p.groupBy("conv_id").agg(F.count(F.lit(1)).alias("shown"))
    all_ = r.groupBy("conv_id").agg(F.max("total").alias("total"))
    n = F.coalesce("shown", F.lit(0))
    return all_.join(shown, "conv_id", "left").select("conv_id", n.alias("shown"), bd.next_offset(F.lit(1), n, F.col("total")).alias("next"))


def budget_hint(spark, sf):
    c = T(spark, sf, "conversations").groupBy("conv_id").agg((F.sum(token_count("text")) * 3).alias("full"), F.count(F.lit(1)).alias("n"))
    return c.select("conv_id", bd.needed_budget(F.col("full")).alias("need"), bd.budget_hint(F.col("full"), F.col("n"), "search").alias("hint"))


def receipt_fit(spark, sf):
    r = _turns(spark, sf)
    receipt = F.concat(F.lit("# receipt: conversation "), "conv_id", F.lit(" · turns="), "total")
    room = bd.receipt_room(F.lit(BUDGET), token_count(receipt))
    roomy = r.withColumn("room", room)
    packed = bd.budget_pack(roomy, "conv_id", "pos", "cost", F.col("room"))
    shown = packed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("shown"))
    every = roomy.groupBy("conv_id").agg(F.max("room").cast("long").alias("room"), F.max("total").alias("total"), F.sum(F.col("cost") + 1).alias("full"))
    n = F.coalesce("shown", F.lit(0))
    status = F.when(F.col("room") < bd.MIN_ROOM, "error").when(n == F.col("total"), "full").otherwise("cut")
    return every.join(shown, "conv_id", "left").select("conv_id", "room", n.alias("shown"), status.alias("status"))


ROW_BUDGET, TINY_BUDGET, SQUEEZE_BUDGET = 60, 20, 44


def render_rows(spark, sf):
    s = sh.shape_payloads(views.conversation_payloads(spark, sf), fields=["turn", "role"], max_tokens=ROW_BUDGET)
    return s.select("payload_id", "shown", "text", "output_tokens")


def fallback_lines(spark, sf):
    s = sh.shape_payloads(views.conversation_payloads(spark, sf), fields=["turn", "role"], max_tokens=TINY_BUDGET)
    return s.select("payload_id", "fallback", "text")


def squeeze_level(spark, sf):
    s = sh.shape_payloads(views.order_payloads(spark, sf), fields=["number"], max_tokens=SQUEEZE_BUDGET)
    return s.select("payload_id", F.col("level").cast("long").alias("level"), "shown", "text")


def header_numbers(spark, sf):
    s = sh.shape_payloads(views.conversation_payloads(spark, sf), fields="auto", counts=["role"])
    pick = lambda p: F.regexp_extract("text", p, 1).cast("long")
    return s.select(
        "payload_id", pick(r"^# items: showing (\d+) of").alias("shown"), pick(r" of (\d+) · total_count=").alias("total"),
        pick(r"# count by role \(all (\d+) records").alias("counted"), F.regexp_extract("text", r"# count by role[^:]*: (.*)", 1).alias("counts"),
        F.col("text").contains("# left out fields: text").alias("text_left_out"))


def oversized_fit(spark, sf):
    s = sh.shape_payloads(views.document_payloads(spark, sf), fields=["doc_id", "text"], max_tokens=300)
    return s.agg(
        F.count(F.lit(1)).alias("payloads"),
        F.count_if(F.col("output_tokens") > 300).alias("over_budget"),
        F.count_if((F.col("shown") == 0) & ~F.col("fallback")).alias("no_progress"),
        F.count_if(F.col("cut_cap") >= F.col("longest")).alias("cap_not_smaller"))


def render_tsv_cells(spark, sf):
    p = T(spark, sf, "part")
    rows = p.select(
        F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("#"), "p_brand")).otherwise(F.col("p_brand")).alias("brand"),
        F.struct(F.col("p_partkey").alias("key"), F.concat_ws("\t", "p_name", "p_type").alias("name")).alias("part"),
        F.when(F.col("p_size") > 5, F.concat(F.lit("a\\b\n"), "p_size")).alias("note"))
    return rows.select(F.col("part.key").alias("p_partkey"), frame.tsv_line(rows).alias("line"))


def manifest_kinds(spark, sf):
    s = sh.shape_payloads(views.order_payloads(spark, sf), fields="auto")
    m = sh.manifest(s)
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("cuts"), F.countDistinct("payload_id").alias("payloads"))


def frame_budget(spark, sf):
    o = T(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus")
    p = frame.shape_frame(o, ["o_orderpriority"], "o_orderkey", 2000, fields=["o_orderkey", "o_orderstatus"])
    return p.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("shown"), F.sum(F.col("cost") + 1).alias("used"), F.max("pos").alias("last"))


def frame_text(spark, sf):
    o = T(spark, sf, "orders").select(
        "o_orderkey", F.struct(F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("s")).alias("state"),
        F.array(F.lit(None).cast("string"), F.when(F.col("o_orderstatus") == "O", "x"), F.lit("")).alias("tags"))
    return o.select("o_orderkey", frame.row_text(o).alias("line"))


NL = "chr(10)"
_PACKED = f"""t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, {tok('text')} AS cost,
    count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)"""
# The whole rendering of two fields per turn, for every possible number of rows shown.
_RENDER = f"""{CONV}, l AS (SELECT payload_id, rec_idx, concat('{{"role":"', role, '","turn":', turn, '}}') AS line, count(*) OVER (PARTITION BY payload_id) AS total FROM conv),
  b AS (SELECT payload_id, total, rec_idx + 1 AS n, string_agg(line, {NL}) OVER (PARTITION BY payload_id ORDER BY rec_idx) AS body FROM l
    UNION ALL SELECT DISTINCT payload_id, total, 0, NULL FROM l),
  r AS (SELECT payload_id, total, n, concat('# items: showing ', n, ' of ', total, ' · total_count=', total, {NL}, '# left out fields: text',
    CASE WHEN n < total THEN concat({NL}, '# ', total - n, ' records not shown') ELSE '' END, CASE WHEN n > 0 THEN concat({NL}, body) ELSE '' END) AS text FROM b)"""
_LEFT = """concat(CASE WHEN a > 0 AND first THEN 'assignee, ' ELSE '' END, 'labels, state, title, total, updated_at, user', CASE WHEN a > 0 AND NOT first THEN ', assignee' ELSE '' END, ', +2 URL/ID fields')"""
_NOTES = """concat('# items: showing ', n, ' of ', total, ' · total_count=', total, chr(10), '# left out fields: ', {left}, CASE WHEN n < total THEN concat(chr(10), '# ', total - n, ' records not shown') ELSE '' END)"""

QUERIES = {
    "token_counts": (token_counts, f"SELECT doc_id, {tok('text')} AS tokens FROM documents"),
    "budget_pack": (budget_pack, f"""WITH {_PACKED}, u AS (SELECT conv_id, sum(cost + 1) OVER (PARTITION BY conv_id ORDER BY pos) + {HEADER} AS used FROM t)
        SELECT conv_id, count(*) AS shown, CAST(max(used) AS BIGINT) AS used FROM u WHERE used <= {BUDGET} GROUP BY 1"""),
    "page_offset": (page_offset, f"""WITH {ORD}, t AS (SELECT payload_id, count(*) AS n FROM ord GROUP BY 1), s AS (SELECT payload_id, n, least(2, n) AS start FROM t)
        SELECT payload_id, start, n - start AS shown, CASE WHEN n > start THEN concat('(records ', start + 1, '–', n, ')') END AS label FROM s"""),
    "next_offset": (next_offset, f"""WITH {_PACKED}, u AS (SELECT conv_id, sum(cost + 1) OVER (PARTITION BY conv_id ORDER BY pos) + {HEADER} AS used FROM t WHERE pos >= 1),
        s AS (SELECT conv_id, count(*) AS shown FROM u WHERE used <= {BUDGET} GROUP BY 1), a AS (SELECT conv_id, max(total) AS total FROM t GROUP BY 1)
        SELECT conv_id, coalesce(shown, 0) AS shown, CASE WHEN 1 + coalesce(shown, 0) < total THEN 1 + coalesce(shown, 0) END AS next FROM a LEFT JOIN s USING (conv_id)"""),
    "budget_hint": (budget_hint, f"""WITH c AS (SELECT conv_id, CAST(ceil(sum({tok('text')}) * 3 / 100.0) * 100 AS BIGINT) AS need, count(*) AS n FROM conversations GROUP BY 1)
        SELECT conv_id, need, CASE WHEN need <= 8192 THEN concat('call search again with budget_tokens=', need, ' to see all ', n)
          ELSE concat('narrow the query to see them; all ', n, ' need over 8192 tokens') END AS hint FROM c"""),
    "receipt_fit": (receipt_fit, f"""WITH {_PACKED}, m AS (SELECT *, {BUDGET} - {tok("concat('# receipt: conversation ', conv_id, ' · turns=', total)")} - 1 AS room FROM t),
        u AS (SELECT conv_id, room, total, sum(cost + 1) OVER (PARTITION BY conv_id ORDER BY pos) AS used FROM m),
        s AS (SELECT conv_id, max(room) AS room, max(total) AS total, count(*) FILTER (used <= room) AS shown FROM u GROUP BY 1)
        SELECT conv_id, room, shown, CASE WHEN room < 64 THEN 'error' WHEN shown = total THEN 'full' ELSE 'cut' END AS status FROM s"""),
    "render_rows": (render_rows, f"""WITH {_RENDER} SELECT payload_id, n AS shown, text, {cost('text')} AS output_tokens FROM r
        WHERE {cost('text')} <= {ROW_BUDGET} QUALIFY row_number() OVER (PARTITION BY payload_id ORDER BY n DESC) = 1"""),
    "fallback_lines": (fallback_lines, f"""WITH {_RENDER} SELECT payload_id, true AS fallback, concat('# items: showing 0 of ', total, '; budget too small, raise maxTokens') AS text
        FROM r WHERE n = 0"""),
    "squeeze_level": (squeeze_level, f"""WITH {ORD}, p AS (SELECT *, count(*) OVER (PARTITION BY payload_id) AS total, count(assignee) OVER (PARTITION BY payload_id) AS a,
            max(CASE WHEN rec_idx = 0 THEN assignee END) OVER (PARTITION BY payload_id) IS NOT NULL AS first FROM ord),
        b AS (SELECT payload_id, total, a, first, rec_idx + 1 AS n, string_agg(concat('{{"number":', o_orderkey, '}}'), {NL}) OVER (PARTITION BY payload_id ORDER BY rec_idx) AS body FROM p
            UNION ALL SELECT DISTINCT payload_id, total, a, first, 0, NULL FROM p),
        h AS (SELECT *, {_NOTES.format(left=_LEFT)} AS head0, {_NOTES.format(left="concat(7 + CASE WHEN a > 0 THEN 2 ELSE 1 END, ' (list too long for budget)')")} AS head1 FROM b),
        f AS (SELECT payload_id, max(n) FILTER ({cost("concat(head0, CASE WHEN n > 0 THEN concat(chr(10), body) ELSE '' END)")} <= {SQUEEZE_BUDGET}) AS fit,
            max(n) FILTER (n = 1 AND {cost("concat(head1, chr(10), body)")} <= {SQUEEZE_BUDGET}) AS whole FROM h GROUP BY 1),
        z AS (SELECT h.*, fit, whole, CASE WHEN fit IS NOT NULL THEN 0 WHEN {cost('head1')} <= {SQUEEZE_BUDGET} THEN 1 ELSE 2 END AS level FROM h JOIN f USING (payload_id) WHERE n = 0),
        x AS (SELECT payload_id, n, CASE WHEN n > 0 THEN concat(head0, chr(10), body) ELSE head0 END AS t0, concat(head1, chr(10), body) AS t1 FROM h)
        SELECT z.payload_id, z.level, CASE WHEN fit > 0 THEN fit WHEN whole = 1 THEN 1 ELSE 0 END AS shown,
          CASE WHEN fit > 0 THEN (SELECT t0 FROM x WHERE x.payload_id = z.payload_id AND x.n = z.fit)
               WHEN whole = 1 THEN (SELECT t1 FROM x WHERE x.payload_id = z.payload_id AND x.n = 1)
               WHEN fit = 0 THEN head0 WHEN level = 1 THEN head1
               ELSE concat('# items: showing 0 of ', total, '; budget too small, raise maxTokens') END AS text FROM z"""),
    "header_numbers": (header_numbers, f"""WITH {CONV}, c AS (SELECT payload_id, role, count(*) AS n FROM conv GROUP BY 1, 2),
        s AS (SELECT payload_id, string_agg(concat(role, ' ', n), ' · ' ORDER BY n DESC, role) AS counts FROM c GROUP BY 1),
        g AS (SELECT payload_id, count(*) AS n, sum(length(text)) > 200 * count(*) AS long FROM conv GROUP BY 1)
        SELECT payload_id, n AS shown, n AS total, n AS counted, counts, long AS text_left_out FROM g JOIN s USING (payload_id)"""),
    "oversized_fit": (oversized_fit, f"WITH {DOCS} SELECT count(DISTINCT payload_id) AS payloads, 0 AS over_budget, 0 AS no_progress, 0 AS cap_not_smaller FROM docs"),
    "render_tsv_cells": (render_tsv_cells, """SELECT p_partkey, concat(CASE WHEN p_size % 10 = 0 THEN concat('\\#', p_brand) ELSE p_brand END, chr(9), p_partkey, chr(9), p_name, '\\t', p_type, chr(9),
        CASE WHEN p_size > 5 THEN concat('a\\\\b\\n', p_size) ELSE '' END) AS line FROM part"""),
    "manifest_kinds": (manifest_kinds, f"""WITH {ORD}, g AS (SELECT payload_id, count(assignee) AS a, count(*) AS n, count(DISTINCT assignee) AS da, count(DISTINCT o_orderstatus) AS s,
          count(DISTINCT o_orderpriority) AS p, count(DISTINCT CAST(o_orderdate AS DATE)) AS d, count(DISTINCT round(o_totalprice)) AS t FROM ord GROUP BY 1),
        k AS (SELECT payload_id, 'left_out' AS kind, 3 AS c FROM g UNION ALL SELECT payload_id, 'empty', CASE WHEN a = 0 THEN 2 ELSE 1 END FROM g
          UNION ALL SELECT payload_id, 'hoisted', 1 + CAST(a = n AND da = 1 AS INT) + CAST(s = 1 AND p = 1 AS INT) + CAST(s = 1 AS INT) + CAST(t = 1 AS INT) + CAST(d = 1 AS INT) FROM g WHERE n >= 3)
        SELECT kind, CAST(sum(c) AS BIGINT) AS cuts, count(*) AS payloads FROM k GROUP BY 1"""),
    "frame_budget": (frame_budget, f"""WITH l AS (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos,
          {tok("concat('{\"o_orderkey\":', o_orderkey, ',\"o_orderstatus\":\"', o_orderstatus, '\"}')")} AS cost FROM orders),
        u AS (SELECT *, sum(cost + 1) OVER (PARTITION BY o_orderpriority ORDER BY pos) AS used FROM l)
        SELECT o_orderpriority, count(*) AS shown, CAST(sum(cost + 1) AS BIGINT) AS used, max(pos) AS last FROM u WHERE used <= 2000 GROUP BY 1"""),
    "frame_text": (frame_text, """SELECT o_orderkey, concat('{"o_orderkey":', o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN concat(',"state":{"s":"', o_orderstatus, '"}') ELSE '' END,
        CASE WHEN o_orderstatus = 'O' THEN ',"tags":[null,"x",null]' ELSE '' END, '}') AS line FROM orders"""),
}
