"""Registered queries over declared frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.plans import declared as dl
from cutledger.plans import shape as sh
from cutledger.plans.catalog.common import T, cost, tok

BUDGET, OFFSET, PAGE_BUDGET = 700, 40, 400
# Order and line number repeat in the table; with part, supplier and day they name a row.
LINE_NO = "(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 40 + day(l_shipdate)"


def _lines(spark, sf):
    """Line items with a nested part, a constant, an empty column, a long text, and a column that some rows lack."""
    return T(spark, sf, "lineitem").select(
        "l_returnflag", F.expr(LINE_NO).alias("line_no"),
        F.struct(F.col("l_suppkey").alias("number"), F.col("l_partkey").alias("part_id"), F.col("l_linestatus").alias("status")).alias("supplier"),
        F.when(F.col("l_linenumber") < 3, F.col("l_linenumber")).alias("early"), F.lit("line").alias("kind"),
        F.lit("").alias("note"), F.repeat(F.lit("many words "), F.lit(20)).alias("remark"))


def frame_shape(spark, sf):
    s = dl.declare(_lines(spark, sf), ["l_returnflag"], "line_no", BUDGET, label="lines", hint="offset={next}")
    return s.select("payload_id", "text", "records", "shown", "output_tokens")


def frame_page(spark, sf):
    s = dl.declare(_lines(spark, sf), ["l_returnflag"], "line_no", PAGE_BUDGET, fields=["line_no", "supplier.status", "absent"], offset=OFFSET, label="lines")
    return s.select("payload_id", "text", "start", "shown")


def frame_manifest(spark, sf):
    return sh.manifest(dl.declare(_lines(spark, sf), ["l_returnflag"], "line_no", BUDGET, label="lines"))


def frame_oversized(spark, sf):
    """Every source has a row, also where the first document alone is over the budget."""
    s = dl.declare(T(spark, sf, "documents").select("source", "doc_id", "text"), ["source"], "doc_id", 300, fields=["doc_id", "text"], hint="offset={next}")
    return s.select("payload_id", "records", "shown", F.coalesce("longest", F.lit(0)).alias("longest"),
                    F.col("cut_cap").isNotNull().alias("is_cut"), (F.col("output_tokens") <= 300).alias("within"))


LINES = f"""li AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY line_no) AS pos, count(*) OVER (PARTITION BY g) AS n_total
  FROM (SELECT l_returnflag AS g, {LINE_NO} AS line_no, l_suppkey, l_linestatus, l_linenumber FROM lineitem))"""
# A group shares its line status when all its items have the same one; it then stands in the note, not in the rows.
SHARED = """sh AS (
  SELECT g, count(*) AS n_total, min(l_linestatus) = max(l_linestatus) AS one, min(l_linestatus) AS status FROM li GROUP BY g)"""
SAME = """concat('# same in every record: ', CASE WHEN one THEN concat('supplier.status="', status, '" · ') ELSE '' END, 'kind="line"')"""
HEAD = f"""concat('# lines: showing ', n, ' of ', n_total, chr(10), {SAME}, chr(10), '# empty (null) in every record: note', chr(10),
    '# a field missing from a row is empty (null) in that record', chr(10), '# left out fields: remark, +1 URL/ID fields',
    CASE WHEN n < n_total THEN concat(chr(10), '# ', n_total - n, ' records not shown · offset=', n) ELSE '' END)"""
ROW = """concat('{"line_no":', line_no, ',"supplier":{"number":', l_suppkey, CASE WHEN one THEN '' ELSE concat(',"status":"', l_linestatus, '"') END, '}',
    CASE WHEN l_linenumber < 3 THEN concat(',"early":', l_linenumber) ELSE '' END, '}')"""
TEXTS = f"""
WITH {LINES}, {SHARED},
r AS (SELECT li.g, pos, sh.n_total, one, status, {ROW} AS line FROM li JOIN sh ON sh.g = li.g WHERE pos <= {BUDGET}),
u AS (SELECT *, pos AS n, sum({tok("line")} + 1) OVER (PARTITION BY g ORDER BY pos) AS used FROM r),
h AS (SELECT *, {HEAD} AS head FROM u),
f AS (SELECT g, max(pos) AS shown FROM h WHERE {cost("head")} + used <= {BUDGET} GROUP BY g),
t AS (
  SELECT h.g, any_value(n_total) AS records, any_value(shown) AS shown, max(CASE WHEN pos = shown THEN head END) AS head, string_agg(line, chr(10) ORDER BY pos) AS body
  FROM h JOIN f ON f.g = h.g AND pos <= shown GROUP BY h.g),
o AS (SELECT g AS payload_id, concat(head, chr(10), body) AS text, records, shown FROM t)"""
FRAME_SHAPE = f"{TEXTS} SELECT payload_id, text, records, shown, {cost('text')} AS output_tokens FROM o"
PAGE_HEAD = f"""concat('# lines: showing ', n, ' of ', n_total, ' (records {OFFSET + 1}–', {OFFSET} + n, ')', chr(10),
    '# left out fields: supplier.number, early, kind, remark, +1 URL/ID fields', chr(10), '# not in data (null or missing in every record): absent',
    CASE WHEN {OFFSET} + n < n_total THEN concat(chr(10), '# ', n_total - {OFFSET} - n, ' records not shown') ELSE '' END)"""
FRAME_PAGE = f"""
WITH {LINES},
r AS (SELECT g, pos - {OFFSET} AS n, n_total, concat('{{"line_no":', line_no, ',"supplier":{{"status":"', l_linestatus, '"}}}}') AS line FROM li WHERE pos > {OFFSET} AND pos <= {OFFSET + PAGE_BUDGET}),
u AS (SELECT *, sum({tok("line")} + 1) OVER (PARTITION BY g ORDER BY n) AS used, {PAGE_HEAD} AS head FROM r),
f AS (SELECT g, max(n) AS shown FROM u WHERE {cost("head")} + used <= {PAGE_BUDGET} GROUP BY g)
SELECT u.g AS payload_id, concat(max(CASE WHEN n = shown THEN head END), chr(10), string_agg(line, chr(10) ORDER BY n)) AS text,
  CAST({OFFSET} AS BIGINT) AS start, any_value(shown) AS shown
FROM u JOIN f ON f.g = u.g AND n <= shown GROUP BY u.g"""
NO_HINT = HEAD.replace(" · offset=', n)", "')")
FRAME_MANIFEST = f"""
{TEXTS.replace(HEAD, NO_HINT)}
SELECT payload_id, 'rows_cut' AS kind, CAST(NULL AS VARCHAR) AS path, records - shown AS n FROM o WHERE records > shown
UNION ALL SELECT g, kind, path, CAST(1 AS BIGINT) FROM sh, (VALUES ('hoisted', 'kind'), ('empty', 'note'), ('left_out', 'remark'), ('left_out', 'supplier.part_id')) AS c(kind, path)
UNION ALL SELECT g, 'hoisted', 'supplier.status', CAST(1 AS BIGINT) FROM sh WHERE one"""
DOC_LINE = "to_json({'doc_id': doc_id, 'text': text})"
DOC_HEAD = """concat('# records: showing ', n, ' of ', n_total, CASE WHEN n < n_total THEN concat(chr(10), '# ', n_total - n, ' records not shown · offset=', n) ELSE '' END)"""
FRAME_OVERSIZED = f"""
WITH d AS (
  SELECT source AS g, text, {DOC_LINE} AS line, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS n_total FROM documents),
u AS (SELECT *, sum({tok("line")} + 1) OVER (PARTITION BY g ORDER BY n) AS used, {DOC_HEAD} AS head FROM d),
f AS (SELECT g, max(n_total) AS n_total, coalesce(max(CASE WHEN {cost("head")} + used <= 300 THEN n END), 0) AS fit, max(CASE WHEN n = 1 THEN length(text) END) AS longest FROM u GROUP BY g)
SELECT g AS payload_id, n_total AS records, greatest(fit, 1) AS shown, CASE WHEN fit = 0 THEN longest ELSE 0 END AS longest, fit = 0 AS is_cut, true AS within FROM f"""

QUERIES = {
    "frame_shape": (frame_shape, FRAME_SHAPE),
    "frame_page": (frame_page, FRAME_PAGE),
    "frame_manifest": (frame_manifest, FRAME_MANIFEST),
    "frame_oversized": (frame_oversized, FRAME_OVERSIZED),
}
