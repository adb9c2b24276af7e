"""Registered queries over profiles and declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.operators import counts as ct
from cutledger.operators import fields as fl
from cutledger.operators import frame
from cutledger.plans import shape as sh
from cutledger.plans.catalog.common import CONV, DOCS, EVT, ORD, T, leaves, profile, totals
from cutledger.sources import views


def leaf_counts(spark, sf):
    v = leaves(views.event_payloads(spark, sf)).where("js IS NOT NULL")
    return v.groupBy("payload_id", "path").agg(F.count(F.lit(1)).alias("n"), F.count("str").alias("strings"))


def constant_fields(spark, sf):
    p = views.order_payloads(spark, sf)
    c = profile(p).join(totals(p), "payload_id").where(fl.is_constant(F.col("n_total")))
    return c.select("payload_id", "path", fl.constant_value().alias("value"))


def _decided(spark, sf, **options):
    return sh.field_decisions(views.order_payloads(spark, sf), **options)


def empty_everywhere(spark, sf):
    return _decided(spark, sf, fields="auto").select("payload_id", F.explode("empty").alias("path"))


def ragged_rows(spark, sf):
    return _decided(spark, sf, fields="auto").select("payload_id", "ragged")


def left_out_collapsed(spark, sf):
    return _decided(spark, sf, fields=["number", "labels.name", "milestone"]).select("payload_id", F.explode("left_out").alias("path"))


def not_in_data(spark, sf):
    d = _decided(spark, sf, fields=["number", "user", "assignee.login", "nope.x", "milestone", "user.login.x"])
    return d.select("payload_id", F.explode("not_in_data").alias("path"))


def named_vs_noise(spark, sf):
    left = _decided(spark, sf, fields=["number"]).select("payload_id", F.explode("left_out").alias("path"))
    return fl.named_and_noise(left, "payload_id")


def _counts(spark, sf, path):
    v = leaves(views.order_payloads(spark, sf)).where(F.col("path") == path)
    return ct.value_counts(ct.record_values(v, "payload_id").drop("path"), "payload_id")


def value_counts_priority(spark, sf):
    return _counts(spark, sf, "labels.name").select("payload_id", "value", "n", "more_values")


def value_counts_top20(spark, sf):
    d = T(spark, sf, "documents")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))
    return ct.value_counts(d.select("source", F.explode(words).alias("value")), "source").select("source", "value", "n", "more_values")


def shape_stats(spark, sf):
    d = sh.field_decisions(views.conversation_payloads(spark, sf), fields="auto")
    return d.select("payload_id", F.col("n_total").alias("records"), F.array_join(F.array_sort("left_out"), ",").alias("left_out"),
                    F.array_join(F.array_sort(F.transform("constants", lambda c: c["path"])), ",").alias("hoisted"), "ragged")


def longest_string(spark, sf):
    v = leaves(views.document_payloads(spark, sf))
    return v.groupBy("payload_id").agg(F.max(F.length("str")).cast("long").alias("longest"))


def _flags(spark, sf):
    li = T(spark, sf, "lineitem")
    empty = F.when(F.col("l_quantity") < 0, "x")
    return li.select("l_returnflag", "l_orderkey", F.struct("l_suppkey", F.col("l_linestatus").alias("status")).alias("line"),
                     F.concat(F.lit("https://api.example.com/"), "l_partkey").alias("url"),
                     F.array(F.struct(F.col("l_linenumber").alias("n")), F.struct(F.col("l_linenumber").alias("n"))).alias("tags"),
                     empty.alias("note"), F.when(F.col("l_tax") > 0.04, "taxed").alias("tax"), F.lit("fixed").alias("kind"))


def frame_profile(spark, sf):
    p = frame.profile_frame(_flags(spark, sf), ["l_returnflag"])
    return p.select("l_returnflag", "path", "n_values", "n_strings", "string_chars", "n_links", "n_records", "n_total")


def frame_auto_fields(spark, sf):
    return frame.frame_auto_fields(frame.profile_frame(_flags(spark, sf), ["l_returnflag"])).select("l_returnflag", "path")


def frame_declarations(spark, sf):
    p = frame.profile_frame(_flags(spark, sf), ["l_returnflag"])
    kinds = {"constant": frame.frame_constants(p), "empty": frame.frame_empty(p), "ragged": frame.frame_ragged(p)}
    rows = [df.select("l_returnflag", "path", F.lit(k).alias("kind")) for k, df in kinds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_CONST = {
    "assignee.login": ("count(assignee) = count(*) AND min(assignee) = max(assignee)", "concat('\"', min(assignee), '\"')"),
    "labels.id": ("true", "'[1,2]'"),
    "labels.name": ("min(o_orderstatus) = max(o_orderstatus) AND min(o_orderpriority) = max(o_orderpriority)", "concat('[\"', min(o_orderstatus), '\",\"', min(o_orderpriority), '\"]')"),
    "state": ("min(o_orderstatus) = max(o_orderstatus)", "concat('\"', min(o_orderstatus), '\"')"),
    "total": ("min(round(o_totalprice)) = max(round(o_totalprice))", "CAST(CAST(min(round(o_totalprice)) AS BIGINT) AS VARCHAR)"),
    "updated_at": ("min(CAST(o_orderdate AS DATE)) = max(CAST(o_orderdate AS DATE))", "concat('\"', strftime(min(o_orderdate), '%Y-%m-%d'), '\"')"),
    "user.id": ("true", "CAST(min(o_custkey) AS VARCHAR)"),
    "user.login": ("true", "concat('\"', min(login), '\"')"),
}

QUERIES = {
    "leaf_counts": (leaf_counts, f"""WITH {EVT}, c AS (SELECT payload_id, count(*) AS n FROM evt GROUP BY 1)
        SELECT payload_id, path, n, CASE WHEN path = 'kind' THEN n ELSE 0 END AS strings FROM c CROSS JOIN (VALUES ('event_id'), ('kind'), ('props.k')) t(path)"""),
    "constant_fields": (constant_fields, f"WITH {ORD} " + " UNION ALL ".join(
        f"SELECT payload_id, '{k}' AS path, {v} AS value FROM ord GROUP BY 1 HAVING count(*) >= 3 AND {c}" for k, (c, v) in _CONST.items())),
    "empty_everywhere": (empty_everywhere, f"""WITH {ORD} SELECT DISTINCT payload_id, 'milestone' AS path FROM ord
        UNION ALL SELECT payload_id, 'assignee' FROM ord GROUP BY 1 HAVING count(assignee) = 0"""),
    "ragged_rows": (ragged_rows, f"WITH {ORD} SELECT payload_id, count(assignee) > 0 AND count(assignee) < count(*) AS ragged FROM ord GROUP BY 1"),
    "left_out_collapsed": (left_out_collapsed, f"""WITH {ORD}, p AS (SELECT payload_id, count(assignee) AS a FROM ord GROUP BY 1)
        SELECT payload_id, path FROM p CROSS JOIN (VALUES ('labels.id'), ('title'), ('state'), ('user'), ('url'), ('html_url'), ('updated_at'), ('total')) t(path)
        UNION ALL SELECT payload_id, 'assignee' FROM p WHERE a > 0"""),
    "not_in_data": (not_in_data, f"""WITH {ORD}, p AS (SELECT payload_id, count(assignee) AS a FROM ord GROUP BY 1)
        SELECT payload_id, path FROM p CROSS JOIN (VALUES ('nope.x'), ('milestone'), ('user.login.x')) t(path)
        UNION ALL SELECT payload_id, 'assignee.login' FROM p WHERE a = 0"""),
    "named_vs_noise": (named_vs_noise, f"WITH {ORD} SELECT payload_id, 6 + CASE WHEN count(assignee) > 0 THEN 1 ELSE 0 END AS named, 2 AS noise FROM ord GROUP BY 1"),
    "value_counts_priority": (value_counts_priority, f"""WITH {ORD}, v AS (SELECT payload_id, unnest([o_orderstatus, o_orderpriority]) AS value FROM ord)
        SELECT payload_id, value, count(*) AS n, 0 AS more_values FROM v GROUP BY 1, 2"""),
    "value_counts_top20": (value_counts_top20, r"""WITH w AS (SELECT source, unnest(list_distinct(regexp_extract_all(text, '\p{L}+'))) AS value FROM documents),
        c AS (SELECT source, value, count(*) AS n FROM w GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY source) AS total FROM c)
        SELECT source, value, n, greatest(total - 20, 0) AS more_values FROM r WHERE rank <= 20"""),
    "shape_stats": (shape_stats, f"""WITH {CONV}, g AS (SELECT payload_id, count(*) AS n, sum(length(text)) > 200 * count(*) AS long,
          count(*) >= 3 AND min(role) = max(role) AS r, count(*) >= 3 AND min(turn) = max(turn) AS t, count(*) >= 3 AND min(text) = max(text) AS x FROM conv GROUP BY 1)
        SELECT payload_id, n AS records, CASE WHEN long THEN 'text' ELSE '' END AS left_out,
          concat_ws(',', CASE WHEN r THEN 'role' END, CASE WHEN x AND NOT long THEN 'text' END, CASE WHEN t THEN 'turn' END) AS hoisted, false AS ragged FROM g"""),
    "longest_string": (longest_string, f"WITH {DOCS} SELECT payload_id, max(greatest(length(text), length(lang))) AS longest FROM docs GROUP BY 1"),
    "frame_profile": (frame_profile, """WITH g AS (SELECT l_returnflag, count(*) AS n, sum(length(CAST(l_partkey AS VARCHAR)) + 24) AS u, count(*) FILTER (l_tax > 0.04) AS t FROM lineitem GROUP BY 1)
        SELECT l_returnflag, path, v AS n_values, s AS n_strings, CAST(c AS BIGINT) AS string_chars, k AS n_links, r AS n_records, n AS n_total FROM g,
        LATERAL (VALUES ('l_orderkey', n, 0, 0, 0, n), ('line.l_suppkey', n, 0, 0, 0, n), ('line.status', n, n, n, 0, n), ('url', n, n, u, n, n),
          ('tags.n', 2 * n, 0, 0, 0, n), ('note', 0, 0, 0, 0, 0), ('tax', t, t, 5 * t, 0, t), ('kind', n, n, 5 * n, 0, n)) x(path, v, s, c, k, r)"""),
    "frame_auto_fields": (frame_auto_fields, """SELECT DISTINCT l_returnflag, unnest(['l_orderkey', 'line.l_suppkey', 'line.status', 'tags.n', 'tax', 'kind']) AS path FROM lineitem"""),
    "frame_declarations": (frame_declarations, """SELECT l_returnflag, 'kind' AS path, 'constant' AS kind FROM lineitem GROUP BY 1 HAVING count(*) >= 3
        UNION ALL SELECT l_returnflag, 'line.status', 'constant' FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND min(l_linestatus) = max(l_linestatus)
        UNION ALL SELECT DISTINCT l_returnflag, 'note', 'empty' FROM lineitem
        UNION ALL SELECT l_returnflag, 'tax', 'ragged' FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_tax > 0.04) BETWEEN 1 AND count(*) - 1"""),
}
