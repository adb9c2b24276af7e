import json

from pyspark.sql import functions as F

from cutledger.operators.ids import alias_candidates, assign_aliases
from cutledger.plans.shape import shape_payloads
from cutledger.streaming import streams


def test_shape_stream_equals_batch(spark, tmp_path):
    rows = [(f"p{i}", json.dumps([{"n": j, "t": "x" * 300, "k": "same"} for j in range(4)])) for i in range(3)]
    df = spark.createDataFrame(rows, "payload_id string, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.shape_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), fields="auto", max_tokens=100).awaitTermination()
    out = {r.payload_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {r.payload_id: r.text for r in shape_payloads(df, fields="auto", max_tokens=100).collect()}


def test_alias_stream_over_two_batches_equals_one(spark, tmp_path):
    schema = "session_id string, value string, seen bigint"
    one = [("s", "ch_3NxQ8kLm2pZ9", 1), ("s", "cus_AbCdEf123456", 2), ("t", "cus_AbCdEf123456", 3)]
    two = [("s", "pi_9ZyXw8Vu7Ts6", 4), ("s", "ch_3NxQ8kLm2pZ9", 5)]
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.alias_stream(stream, str(tmp_path / "dict"), str(tmp_path / "check")).awaitTermination()
    grown = {(r.session_id, r.value): r.alias_no for r in spark.read.parquet(str(tmp_path / "dict")).collect()}
    whole = assign_aliases(alias_candidates(spark.createDataFrame(one + two, schema)))
    assert grown == {(r.session_id, r.value): r.alias_no for r in whole.collect()}


def test_session_stream_answers_requests(spark, tmp_path):
    schema = "session_id string, minute bigint, is_request boolean, request_id string, adapter string, allowed array<string>, fields array<string>"
    first = [("s", 0, False, None, "github", ["title"], []), ("s", 1, True, "a", "github", [], ["title"])]
    second = [
        ("s", 2, True, "b", "github", [], ["body"]), ("s", 3, True, "c", "jira", [], ["title"]),
        ("s", 11, True, "d", "github", [], ["title"]), ("t", 0, True, "e", "github", [], ["title"])]
    for rows in (first, second):
        df = spark.createDataFrame(rows, schema).selectExpr(
            "session_id", "timestamp_seconds(1767225600 + minute * 60) AS ts", "is_request", "request_id", "adapter",
            "map('repo', 'api') AS scope", "allowed", "cast(array() AS array<string>) AS redacted", "fields")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        streams.session_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = {r.request_id: r.reason for r in spark.read.parquet(str(tmp_path / "out/answers")).collect()}
    assert got == {"a": None, "b": "field 'body' is not in the allowed recovery field list", "c": "recovery adapter mismatch: expected github, got jira",
                   "d": "session not found or expired", "e": "session not found or expired"}


def test_savings_stream(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, 'a' AS tool, 100L AS before, 40L AS after UNION ALL SELECT timestamp'2026-01-01 00:20:00', 'a', 100L, 60L")
    df.write.parquet(str(tmp_path / "in"))
    out = streams.savings_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("saved").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.calls, r.before, r.after, r.saved_permille) for r in spark.table("saved").select("calls", "before", "after", "saved_permille").collect()] == [(2, 200, 100, 500)]
