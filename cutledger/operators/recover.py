"""Getting back what was cut: views of archived payloads, and who may ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cutledger.functions.rules import MIN_BUDGET
from cutledger.operators.policies import DEFAULT_BUDGET

# Request problems (fixed values).
INVALID = "invalid arguments"
UNKNOWN = "unknown or expired handle"


def bad_request() -> Column:
    """A request without a handle, or with an offset, a budget or a field name out of its range."""
    return (
        F.col("handle").isNull()
        | (F.coalesce("offset", F.lit(0)) < 0)
        | (F.coalesce("budget_tokens", F.lit(MIN_BUDGET)) < MIN_BUDGET)
        | F.coalesce(F.exists("fields", lambda f: f.isNull() | (f == "")), F.lit(False))
    )


def bind_requests(requests: DataFrame, archive: DataFrame) -> DataFrame:
    """Join requests ``(request_id, session_id, handle, offset, fields, budget_tokens)`` to the archive.

    Bad arguments and unknown handles become rows with ``error``; the others carry the archived
    text and the options of the view: ``["*"]`` means every field. Requests come in by the
    number of calls, and each reads one archived document, so the join is keyed on one handle.
    """
    stored = archive.select("session_id", "handle", "text", "tool")
    every = F.array_contains("fields", "*") | (F.size("fields") == 0)
    return requests.join(stored, ["session_id", "handle"], "left").withColumns({
        "error": F.when(bad_request(), INVALID).when(F.col("text").isNull(), UNKNOWN),
        "o_mode": F.when(F.col("fields").isNull(), "auto").when(every, "all").otherwise("list"),
        "o_fields": F.when(~every, F.col("fields")),
        "o_offset": F.coalesce("offset", F.lit(0)).cast("long"),
        "o_budget": F.coalesce("budget_tokens", F.lit(DEFAULT_BUDGET)).cast("long"),
    })


def recover(requests: DataFrame, archive: DataFrame) -> DataFrame:
    """``(request_id, error, text, records, shown, start, next_offset)`` for every request; ``plans.calls.recover_views`` also minds policies."""
    from cutledger.plans.shape import shape_payloads

    bound = bind_requests(requests, archive)
    good = bound.where("error IS NULL").select(
        F.col("request_id").alias("payload_id"), "text", "o_mode", "o_fields", "o_offset", "o_budget",
        F.col("tool").alias("o_label"),
        F.concat(F.lit('recover with handle="'), "handle", F.lit('" and offset={next}')).alias("o_hint"),
    )
    shaped = shape_payloads(good).select(
        F.col("payload_id").alias("request_id"), F.lit(None).cast("string").alias("error"), "text", "records", "shown", "start",
        F.when(F.col("start") + F.col("shown") < F.col("records"), F.col("start") + F.col("shown")).alias("next_offset"))
    failed = bound.where("error IS NOT NULL").select("request_id", "error")
    return shaped.unionByName(failed, allowMissingColumns=True)


def latest_registrations(requests: DataFrame, registrations: DataFrame, ttl_seconds: int, columns: list[str],
                         session: str = "session_id", slice_seconds: int = 60) -> DataFrame:
    """For each request, ``columns`` of the session's latest registration that is still alive.

    An as-of join without pairing every request with every registration: time is cut into
    slices, the last registration of each slice is carried forward over the small table of
    slices, and inside a slice one sorted pass finds the latest registration so far. A busy
    session is spread over as many tasks as it has slices.
    """
    cut = F.floor(F.unix_micros("ts") / (slice_seconds * 1_000_000)).cast("long")
    regs = registrations.withColumn("ts", F.col("ts").cast("timestamp")).select(
        session, "ts", F.lit(None).cast("string").alias("request_id"), F.struct("ts", *columns).alias("reg"))
    reqs = requests.withColumn("ts", F.col("ts").cast("timestamp")).select(
        session, "ts", F.col("request_id").cast("string").alias("request_id"),
        F.lit(None).cast(regs.schema["reg"].dataType).alias("reg"))
    both = regs.unionByName(reqs).withColumn("slice", cut)
    earlier = W.partitionBy(session).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        both.groupBy(session, "slice")
        .agg(F.max_by("reg", F.when(F.col("reg").isNotNull(), F.col("ts"))).alias("last_reg"))
        .withColumn("carried", F.last("last_reg", ignorenulls=True).over(earlier))
        .drop("last_reg")
    )
    order = W.partitionBy(session, "slice").orderBy("ts", F.col("request_id").asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    found = both.withColumn("found", F.last("reg", ignorenulls=True).over(order)).where("request_id IS NOT NULL")
    last = found.join(carried, [session, "slice"]).withColumn("last", F.coalesce("found", "carried"))
    alive = F.unix_micros(F.col("last.ts")) > F.unix_micros("ts") - ttl_seconds * 1_000_000
    return last.select("request_id", F.when(alive, F.col("last")).alias("registration"))


def recovery_reason() -> str:
    """SQL for the first reason against a request, NULL when it may go ahead.

    Needs ``registration`` (adapter, scope, allowed, redacted), ``adapter``, ``scope`` and ``fields``.
    """
    scope = (
        "get(filter(array_sort(map_entries(registration.scope)), e -> NOT (e.value <=> element_at(scope, e.key))), 0)"
    )
    bad_field = (
        "get(filter(fields, f -> array_contains(registration.redacted, f) OR NOT array_contains(registration.allowed, f)), 0)"
    )
    return (
        "CASE WHEN registration IS NULL THEN 'session not found or expired' "
        "WHEN registration.adapter <> adapter THEN concat('recovery adapter mismatch: expected ', registration.adapter, ', got ', adapter) "
        f"WHEN {scope} IS NOT NULL THEN concat('scope mismatch for ', {scope}.key, ': expected ', {scope}.value, ', got ', "
        f"coalesce(element_at(scope, {scope}.key), 'undefined')) "
        f"WHEN array_contains(registration.redacted, {bad_field}) THEN "
        f"concat('field \\'', {bad_field}, '\\' is permanently redacted by policy and cannot be recovered') "
        f"WHEN {bad_field} IS NOT NULL THEN concat('field \\'', {bad_field}, '\\' is not in the allowed recovery field list') END"
    )


def validate_recovery(requests: DataFrame, registrations: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """``(request_id, reason)``: NULL reason means allowed.

    Requests: ``request_id, session_id, ts, adapter, scope, fields``. Registrations:
    ``session_id, ts, adapter, scope, allowed, redacted``.
    """
    latest = latest_registrations(requests, registrations, ttl_seconds, ["adapter", "scope", "allowed", "redacted"])
    asked = requests.select(F.col("request_id").cast("string").alias("request_id"), "adapter", "scope", "fields")
    return asked.join(latest, "request_id").select("request_id", F.expr(recovery_reason()).alias("reason"))
