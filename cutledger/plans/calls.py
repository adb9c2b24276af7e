"""Tool calls from result to view, and back: route, policy, handle, shape, receipt, gain.

``call_results`` takes one text per call. Errors, results whose structured copy must stay, and skipped tools go past the shaping
branch; only calls with records get a handle, numbered by arrival in their session. A view that leaves anything out carries a receipt
line with its handle, and is fitted with room for that line. A result that is no smaller than its original is given back as it was.

``recover_views`` shapes each distinct view of an archived text once, under the policy of the tool the text came from, and joins it to
all requests for it, so a view that many ask for costs one shaping.

Sessions, arrivals (integers, unique in a session) and ids must not be null. Empty inputs give empty results. A null text is not JSON
and comes back null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cutledger.functions.tokens import token_count
from cutledger.operators import discovery as dc, policies as po, recover as rc
from cutledger.operators.positions import group_positions
from cutledger.plans import shape as sh
from cutledger.plans.shape import KEY
from cutledger.sources.payloads import KEEP_RESPONSES

HINT = 'recover with handle="{handle}" and offset={next}'
RECEIPT = '# handle="{handle}" keeps the whole response · recover(handle, offset, fields) gives cut records and left-out fields'
OPTIONS = ["o_mode", "o_fields", "o_counts", "o_budget", "o_long_text", "o_offset"]


def _named(line: str) -> Column:
    before, after = line.split("{handle}")
    return F.concat(F.lit(before), F.col("handle"), F.lit(after))


def routed(calls: DataFrame, policies: DataFrame, budget: int | None = None, long_text: int | None = None) -> DataFrame:
    """Add the options of the tool's policy and ``route``: error, structured, skip or shape."""
    ruled = po.resolve_policy(calls, policies, budget, long_text)
    copy = po.structured_action(F.col("structured"), F.col("has_schema"), po.same_json(F.col("text"), F.col("structured")))
    way = po.route(F.coalesce("is_error", F.lit(False)), F.col("o_skip"))
    return ruled.withColumn("route", F.when(way == "error", way).when(copy == "keep", "structured").otherwise(way))


def fit_with_receipt(plan: DataFrame, *keep: str) -> DataFrame:
    """Fit decided views that have a ``handle``; those that leave something out get the receipt line within their budget.

    Left-out fields are known before the fit, so such views are fitted once, with room for the receipt. Of the others only the fit
    tells whether rows are cut: they are fitted with both budgets from the same rendered rows, and one of the two is kept.
    """
    room = F.coalesce(token_count("o_receipt") + 1, F.lit(0))
    full, less = F.col("o_budget"), F.col("o_budget") - room
    tries = F.when(F.col("passthrough").isNotNull(), F.array(full)).when(F.size("left_out") > 0, F.array(less)).otherwise(F.array(full, less))
    ready = plan.withColumns({"hint": _named(HINT), "o_receipt": _named(RECEIPT)})
    tried = sh._rows(ready).withColumn("o_asked", full).withColumn("_tries", tries)
    fitted = sh.fit_lines(tried.withColumn("o_budget", F.explode("_tries")).drop("_tries"), "handle", "o_receipt", "o_asked", *keep)
    cut = (F.size("left_out") > 0) | (F.col("start") + F.col("shown") < F.col("records"))
    whole = F.col("budget") == F.col("o_asked")
    view = W.partitionBy(KEY)
    # The first fit decides, where there is one; a receipt of no cost can't be told from it and needs no second.
    chosen = fitted.withColumn("_cut", F.coalesce(F.max(F.when(whole, cut)).over(view), F.lit(True))).where(
        F.col("passthrough").isNotNull() | (whole != F.col("_cut")) | F.col("o_receipt").isNull())
    shown = F.when(F.col("passthrough").isNull() & F.col("_cut"), F.concat_ws("\n", "o_receipt", "text")).otherwise(F.col("text"))
    after = F.when(F.col("passthrough").isNull() & F.col("_cut"), F.col("output_tokens") + room).otherwise(F.col("output_tokens"))
    return chosen.withColumns({"text": shown, "output_tokens": after}).drop("_cut", "o_receipt", "o_asked")


def handles(views: DataFrame) -> DataFrame:
    """``(payload_id, session_id, pos, group_rows, handle)`` of results with records, numbered by arrival.

    Whether there are records is told where a text lies, so no text is shuffled.
    """
    found = dc.find_records(dc.parse_payloads(views.select(KEY, "session_id", "arrival", "text")))
    held = found.where("record_list IS NOT NULL").select(KEY, "session_id", "arrival")
    return group_positions(held, ["session_id"], "arrival").withColumn("handle", F.concat(F.lit("r"), F.col("pos") + 1))


def call_results(calls: DataFrame, policies: DataFrame, budget: int | None = None, long_text: int | None = None,
                 use_counts: bool = False) -> DataFrame:
    """``(payload_id, outcome, handle, text, structured, records, shown, next_offset, tokens_before, tokens_after)`` for each call.

    Calls: ``payload_id, session_id, arrival, tool, text, structured, has_schema, is_error``. Outcomes: error, structured, skip,
    not_json, no_records and no_gain leave the result as it was; shaped replaces the text and drops the structured copy.
    """
    ways = routed(calls, policies, budget, long_text)
    views = ways.where("route = 'shape'").select(
        KEY, "session_id", "arrival", "text", *OPTIONS, F.col("tool").alias("o_label"), F.col("structured").alias("o_structured"))
    numbered = handles(views).groupBy(KEY).agg(F.collect_list("handle").alias("o_handles"))
    plan = sh.decided(views.drop("session_id", "arrival"), use_counts, numbered).withColumn("handle", F.explode_outer("o_handles"))
    shaped = fit_with_receipt(plan.drop("o_handles").withColumn("o_original", F.col("text")), "o_structured", "o_original")
    kept = F.col("passthrough").isNull() & po.keeps_original(F.col("input_tokens"), F.col("output_tokens"), F.lit(False))
    outcome = F.coalesce("passthrough", F.when(kept, "no_gain"), F.lit("shaped"))
    done = shaped.withColumn("outcome", outcome)
    new = F.col("outcome") == "shaped"
    end = F.col("start") + F.col("shown")
    done = done.select(
        KEY, "outcome", "handle", F.when(new, F.col("text")).otherwise(F.col("o_original")).alias("text"),
        F.when(~new, F.col("o_structured")).alias("structured"), "records", F.when(new, F.col("shown")).alias("shown"),
        F.when(new & (end < F.col("records")), end).alias("next_offset"), F.col("input_tokens").alias("tokens_before"),
        F.when(new, F.col("output_tokens")).otherwise(F.col("input_tokens")).alias("tokens_after"))
    past = ways.where("route <> 'shape'").select(KEY, F.col("route").alias("outcome"), "text", "structured")
    return done.unionByName(past, allowMissingColumns=True)


def call_archive(calls: DataFrame, policies: DataFrame, keep: int = KEEP_RESPONSES) -> DataFrame:
    """``(session_id, handle, tool, text)``: the originals that ``call_results`` named, the latest ``keep`` of each session."""
    views = routed(calls, policies).where("route = 'shape'")
    latest = handles(views).where(F.col("pos") >= F.col("group_rows") - keep)
    return latest.select(KEY, "handle").join(views.select(KEY, "session_id", "tool", "text"), KEY).select("session_id", "handle", "tool", "text")


def recover_views(requests: DataFrame, archive: DataFrame, policies: DataFrame, budget: int | None = None, long_text: int | None = None,
                  use_counts: bool = False) -> DataFrame:
    """``(request_id, error, text, records, shown, start, next_offset)`` for each request.

    Requests: ``request_id, session_id, handle, offset, fields, budget_tokens``. What a request leaves open comes from the policy of
    the archived text's tool, then from the global settings. The view is given even where the original is smaller; a text of a
    skipped tool, or without records, comes back whole.
    """
    asked = requests.withColumns({
        "bad": rc.bad_request(),
        "view": F.sha2(F.to_json(F.struct("session_id", "handle", F.coalesce("offset", F.lit(0)).alias("o"), "fields", "budget_tokens"),
                                 {"ignoreNullFields": "false"}), 256)})
    views = asked.where("NOT bad").select("view", "session_id", "handle", "offset", "fields", "budget_tokens").dropDuplicates(["view"])
    bound = views.join(archive.select("session_id", "handle", "tool", "text"), ["session_id", "handle"]).withColumns({
        "view_fields": F.when(F.array_contains("fields", "*"), F.array().cast("array<string>")).otherwise(F.col("fields")),
        "view_budget": F.col("budget_tokens").cast("long"), "view_offset": F.col("offset").cast("long")})
    ruled = po.resolve_policy(bound, policies, budget, long_text).withColumnRenamed("view", KEY)
    plan = sh.decided(ruled.where("NOT o_skip").select(
        KEY, "text", *OPTIONS, F.col("tool").alias("o_label"), F.col("handle").alias("o_handle")), use_counts)
    shaped = fit_with_receipt(plan.withColumnRenamed("o_handle", "handle"))
    end = F.col("start") + F.col("shown")
    made = shaped.select(KEY, "text", "records", "shown", "start", F.when(end < F.col("records"), end).alias("next_offset"))
    whole = ruled.where("o_skip").select(KEY, "text")
    results = made.unionByName(whole, allowMissingColumns=True).withColumn("known", F.lit(True)).withColumnRenamed(KEY, "view")
    error = F.when(F.col("bad"), rc.INVALID).when(F.col("known").isNull(), rc.UNKNOWN)
    return asked.select("request_id", "bad", "view").join(results, "view", "left").select(
        "request_id", error.alias("error"), "text", "records", "shown", "start", "next_offset")
