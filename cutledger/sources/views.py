"""JSON payload tables built from relational tables.

A payload never holds a whole group: rows of one group are numbered densely and cut into
blocks of ``block`` positions, so a payload has at most ``block`` records however hot its group
is, its size doesn't depend on the size of the table, and the grouping key of the shuffle is
``(group, block)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cutledger.operators.positions import group_positions

BLOCKS = {"orders": 30, "conversations": 64, "documents": 16, "pages": 25, "events": 100}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(df: DataFrame, group: str, row_key: str, block: int, record: Column, tool: Column | None = None) -> DataFrame:
    """``(payload_id, tool, text)``: records of a group packed by blocks of positions in the order of ``row_key``.

    Records repeat the values of their row, so rows are dealt as they come and records are made where their payload lies.
    """
    held = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(F.col(group).cast("string").alias("_g"), F.col(row_key).alias("_k"), *(F.col(f"`{c}`").alias(h) for c, h in held.items()))
    dealt = group_positions(rows, ["_g"], "_k").withColumn("_b", F.expr(f"pos div {block}")).repartition("_g", "_b")
    packed = (
        dealt.select("_g", "_b", "_k", *(F.col(h).alias(c) for c, h in held.items()))
        .select(F.col("_g").alias("g"), F.col("_b").alias("b"), F.struct(F.col("_k").alias("k"), record.alias("r")).alias("kr"))
        .groupBy("g", "b")
        .agg(F.array_sort(F.collect_list("kr")).alias("items"))
    )
    body = F.struct(
        F.size("items").cast("long").alias("total_count"), F.transform("items", lambda x: x["r"]).alias("items")
    )
    return packed.select(
        F.concat_ws("/", "g", "b").alias("payload_id"),
        (F.lit("search") if tool is None else tool).alias("tool"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("text"),
    )


def conversation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations")
    return pack(df, "conv_id", "turn", BLOCKS["conversations"], F.struct("turn", "role", "text"), F.lit("conversations"))


def order_record() -> Column:
    """An order as a tracker issue: nested user and labels, links, an always-empty field."""
    key = F.col("o_orderkey")
    login = F.format_string("Customer#%09d", "o_custkey")
    assignee = F.when(F.col("o_orderstatus") == "F", F.struct(F.concat(F.lit("agent"), (key % 7).cast("string")).alias("login")))
    return F.struct(
        key.alias("number"),
        F.concat_ws(" ", F.lit("Order"), key, "o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("state"),
        F.struct(login.alias("login"), F.col("o_custkey").alias("id")).alias("user"),
        F.array(
            F.struct(F.lit(1).alias("id"), F.col("o_orderstatus").alias("name")),
            F.struct(F.lit(2).alias("id"), F.col("o_orderpriority").alias("name")),
        ).alias("labels"),
        assignee.alias("assignee"),
        F.lit("").alias("milestone"),
        F.concat(F.lit("https://api.example.com/orders/"), key).alias("url"),
        F.concat(F.lit("https://example.com/orders/"), key).alias("html_url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
        F.round("o_totalprice").cast("long").alias("total"),
    )


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return pack(df, "o_custkey", "o_orderkey", BLOCKS["orders"], order_record(), F.lit("orders"))


def document_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return pack(df, "source", "doc_id", BLOCKS["documents"], F.struct("doc_id", "lang", "n_chars", "text"), F.lit("documents"))


def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").withColumn("site", F.lit("pages"))
    return pack(df, "site", "page_id", BLOCKS["pages"], F.struct("page_id", "url", "html"), F.lit("pages"))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k BIGINT"))
    record = F.struct("event_id", F.col("event_type").alias("kind"), F.col("p").alias("props"))
    return pack(df, "user_id", "event_id", BLOCKS["events"], record, F.lit("events"))
