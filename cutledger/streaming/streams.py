"""Streaming forms: shaping arriving payloads, session dictionaries, registrations and savings."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F, types as T

from cutledger.operators.ids import alias_candidates, assign_aliases
from cutledger.operators.recover import validate_recovery
from cutledger.plans.shape import shape_payloads

SESSION_TTL_SECONDS = 10 * 60  # fixed value


def shape_stream(payloads: DataFrame, path: str, checkpoint: str, **options):
    """Shape every arriving payload; the output of one depends on that one alone.

    Each batch goes to its own folder, overwritten when the batch is run again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        shape_payloads(batch, **options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alias_stream(values: DataFrame, path: str, checkpoint: str):
    """Grow the session dictionary batch by batch; known ids keep their numbers.

    A batch writes only its new entries, to its own folder, and reads those of earlier batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "session_id string, value string, alias_no bigint"
        known = None
        if batch_id:
            known = spark.read.schema(schema + ", batch bigint").option("basePath", path).parquet(path).where(
                F.col("batch") < batch_id).select("session_id", "value", "alias_no")
        grown = assign_aliases(alias_candidates(batch), known)
        fresh = grown if known is None else grown.join(known, ["session_id", "value"], "left_anti")
        fresh.select("session_id", "value", "alias_no").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return values.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(events: DataFrame, path: str, checkpoint: str, ttl_seconds: int = SESSION_TTL_SECONDS):
    """Answer recovery requests against the registrations of the same stream, batch by batch.

    Input: ``session_id, ts, is_request, request_id, adapter, scope, allowed, redacted, fields``.
    Registrations are kept as a table with one folder per batch; a batch reads only those that
    can still be alive for its requests, and uses the batch operator for the answers.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = ["session_id", "ts", "adapter", "scope", "allowed", "redacted"]
        fresh = batch.where("NOT is_request").select(*columns)
        fresh.write.mode("overwrite").parquet(f"{path}/registrations/batch={batch_id}")
        known = spark.read.schema(fresh.schema.add("batch", T.LongType())).parquet(f"{path}/registrations")
        requests = batch.where("is_request").select("request_id", "session_id", "ts", "adapter", "scope", "fields")
        oldest = requests.agg(F.min("ts")).first()[0]
        alive = known.where(F.col("batch") <= batch_id)
        if oldest is not None:
            alive = alive.where(F.col("ts") > F.lit(oldest - timedelta(seconds=ttl_seconds)))
        answers = validate_recovery(requests, alive.select(*columns), ttl_seconds)
        answers.write.mode("overwrite").parquet(f"{path}/answers/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_events(shaped: DataFrame, tool: str, adapter: str, upstream_total: str = "records") -> DataFrame:
    """Trace rows from shaped payloads: numbers and outcomes, never payload content."""
    budget_cut = F.col("records") - F.col("start") - F.col("shown")
    omitted = F.greatest(F.lit(0), F.col(upstream_total) - F.col("records"))
    return shaped.select(
        "payload_id", F.lit(adapter).alias("adapter"), F.lit(tool).alias("tool"),
        F.when(F.col("passthrough").isNull(), "shaped").otherwise("passthrough").alias("outcome"),
        F.col("input_tokens"), F.col("output_tokens"),
        F.col("shown").alias("shown_rows"), omitted.alias("omitted_rows"), budget_cut.alias("budget_cut_rows"),
        F.size("left_out").cast("long").alias("withheld_fields"),
        F.when(budget_cut > 0, "budget").when(omitted > 0, "next_page").alias("recovery_kind"),
    )


def savings(calls: DataFrame, *keys: str) -> DataFrame:
    """Tokens before and after per group, and the saving in tenths of a percent."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("before").alias("before"), F.sum("after").alias("after")
    ).withColumn("saved_permille", F.floor(1000 * (F.col("before") - F.col("after")) / F.col("before") + 0.5).cast("long"))


def savings_stream(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Savings per tool and time window; late calls are taken until the watermark passes."""
    return savings(calls.withWatermark("ts", late).withColumn("window", F.window("ts", window)), "window", "tool")
