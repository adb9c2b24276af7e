"""Registered queries over sources, pages and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutledger.operators.positions import group_positions
from cutledger.plans.catalog.common import T
from cutledger.sources import pages as pg
from cutledger.sources import views
from cutledger.sources.payloads import archive

PROJECTS = 60
PAGES_SQL = f"""
pos AS (SELECT o_custkey % {PROJECTS} AS project, row_number() OVER (PARTITION BY o_custkey % {PROJECTS} ORDER BY o_orderkey) - 1 AS pos,
  count(*) OVER (PARTITION BY o_custkey % {PROJECTS}) AS total FROM orders),
landed AS (SELECT project, pos // 30 + 1 AS page, max(total) AS total, count(*) AS page_rows,
  CASE project % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'jira' ELSE 'hubspot' END AS source FROM pos GROUP BY ALL),
pages_n AS (SELECT concat(project, '/', page) AS page_id, *, source = 'github' AND project % 10 = 0 AS incomplete,
  CASE WHEN source = 'github' THEN CASE WHEN page_rows = 30 AND page * 30 < least(total, 1000) THEN CAST(page + 1 AS VARCHAR) END
       WHEN page * 30 < total THEN concat('t', page + 1) END AS next_cursor FROM landed)"""


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as landed search pages of 30, in the three source layouts."""
    orders = T(spark, sf_dir, "orders").withColumn("project", F.col("o_custkey") % PROJECTS)
    numbered = group_positions(orders, ["project"], "o_orderkey", block=10_000)
    rows = numbered.select("project", "pos", "group_rows", (F.expr(f"pos div {pg.PAGE_SIZE}") + 1).alias("page"),
                           views.order_record().alias("r"))
    packed = rows.groupBy("project", "page").agg(
        F.max("group_rows").alias("total"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: x["r"]).alias("list"))
    more = F.col("page") * pg.PAGE_SIZE < F.col("total")
    token = F.when(more, F.concat(F.lit("t"), F.col("page") + 1))
    source = F.get(F.array(*map(F.lit, ["github", "jira", "hubspot"])), (F.col("project") % 3).cast("int"))
    body = (
        F.when(source == "github", F.to_json(F.struct(
            F.col("total").alias("total_count"), (F.col("project") % 10 == 0).alias("incomplete_results"), F.col("list").alias("items"))))
        .when(source == "jira", F.to_json(F.struct("total", token.alias("nextPageToken"), F.col("list").alias("issues"))))
        .otherwise(F.to_json(F.struct("total", F.when(more, F.struct(F.struct(token.alias("after")).alias("next"))).alias("paging"), F.col("list").alias("results"))))
    )
    return packed.select(F.concat_ws("/", "project", "page").alias("page_id"), source.alias("source"), "page", body.alias("text"))


def payload_count(spark, sf):
    parsed = F.try_variant_get(F.try_parse_json("text"), F.lit("$.total_count"), "long")
    return views.conversation_payloads(spark, sf).agg(F.count(F.lit(1)).alias("payloads"), F.sum(parsed).alias("records"))


def pages_normalized(spark, sf):
    return pg.normalize_pages(landed_pages(spark, sf)).select(
        "page_id", "source", "record_path", "page_rows", "upstream_total", "next_cursor", "next_argument")


def next_page_plan(spark, sf):
    n = pg.normalize_pages(landed_pages(spark, sf))
    return n.select("page_id", pg.next_page(F.col("page"), F.col("page_rows"), F.col("upstream_total")).alias("next_page"))


def page_completeness(spark, sf):
    return pg.completeness(pg.normalize_pages(landed_pages(spark, sf))).select("page_id", "incomplete", "omitted_rows")


def source_receipts(spark, sf):
    return pg.source_receipt(pg.normalize_pages(landed_pages(spark, sf))).select("page_id", "receipt")


def conversation_archive(spark: SparkSession, sf_dir: str, keep: int = 10) -> DataFrame:
    calls = T(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return archive(calls.withColumn("session_id", F.col("conv_id") % 7), arrival="conv_id", keep=keep)


def archive_retention(spark, sf):
    return conversation_archive(spark, sf).select("session_id", "handle", "conv_id", "turns")


def trace_append(spark, sf):
    e = T(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("outcome"))
    return e.groupBy("day", "outcome").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("day").cast("string").alias("day"), "outcome", "events")


QUERIES = {
    "src_payload_count": (payload_count, "SELECT count(DISTINCT concat(conv_id, '/', turn // 64)) AS payloads, count(*) AS records FROM conversations"),
    "pages_normalized": (pages_normalized, f"""WITH {PAGES_SQL} SELECT page_id, source,
        CASE source WHEN 'github' THEN 'items' WHEN 'jira' THEN 'issues' ELSE 'results' END AS record_path, page_rows, total AS upstream_total, next_cursor,
        CASE WHEN next_cursor IS NOT NULL THEN CASE source WHEN 'github' THEN 'page' WHEN 'jira' THEN 'cursor' ELSE 'after' END END AS next_argument FROM pages_n"""),
    "next_page_plan": (next_page_plan, f"""WITH {PAGES_SQL} SELECT page_id,
        CASE WHEN page_rows = 30 AND page * 30 < least(total, 1000) THEN page + 1 END AS next_page FROM pages_n"""),
    "page_completeness": (page_completeness, f"WITH {PAGES_SQL} SELECT page_id, incomplete, greatest(0, total - page_rows) AS omitted_rows FROM pages_n"),
    "source_receipts": (source_receipts, f"""WITH {PAGES_SQL},
        d AS (SELECT *, CASE source WHEN 'github' THEN 'github_search_issues' WHEN 'jira' THEN 'jira_search_issues' ELSE 'hubspot_search' END AS tool,
          CASE source WHEN 'github' THEN 'github_get_issue(owner, repo, issue_number, fields)' WHEN 'jira' THEN 'jira_get_issue(issue_key, fields)' ELSE 'hubspot_get_record(object_type, id, properties)' END AS detail,
          CASE source WHEN 'github' THEN 'full comments, timeline events' WHEN 'jira' THEN 'issue attachments, audit logs' ELSE 'engagement history, associated deals/tickets' END AS never,
          CASE source WHEN 'github' THEN concat('page=', next_cursor) WHEN 'jira' THEN concat('cursor="', next_cursor, '"') ELSE concat('after="', next_cursor, '"') END AS arg FROM pages_n)
        SELECT page_id, concat('# page of ', tool, ' · rows=', page_rows, ' · total=', total, chr(10),
          '# rows hold chosen fields only · the others: ', detail, chr(10),
          '# outside this search: ', never, ' · ask elsewhere about them',
          CASE WHEN next_cursor IS NOT NULL THEN concat(chr(10), '# more rows: ', tool, ' with ', arg) ELSE '' END,
          CASE WHEN incomplete THEN concat(chr(10), '# the source gave up early, so total is a lower bound') ELSE '' END) AS receipt FROM d"""),
    "archive_retention": (archive_retention, """WITH c AS (SELECT conv_id, conv_id % 7 AS session_id, count(*) AS turns FROM conversations GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY conv_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY conv_id DESC) AS back FROM c)
        SELECT session_id, concat('r', n) AS handle, conv_id, turns FROM r WHERE back <= 10"""),
    "trace_append": (trace_append, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS outcome, count(*) AS events FROM events GROUP BY ALL"),
}
