"""Per-tool policies, routing, and when an original passes through unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_BUDGET = 8000  # fixed value
MIN_BUDGET = 256  # fixed value
POLICY_KEYS = ("tool", "fields", "counts", "budget_tokens", "long_text_chars", "skip")


def same_json(a: Column, b: Column) -> Column:
    """Both are JSON and hold the same document, whatever the spacing or key order."""
    return F.coalesce(F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b)), F.lit(False))


def structured_action(structured: Column, has_schema: Column, text_matches: Column) -> Column:
    """What to do with a structured copy: none, keep the result as is, or drop the copy and shape.

    Only a tool known to have no output schema gives the copy up; unknown is not "none".
    """
    duplicate = (~F.coalesce(has_schema, F.lit(True))) & text_matches
    return F.when(structured.isNull(), "shape").when(duplicate, "drop_copy_and_shape").otherwise("keep")


def route(is_error: Column, skip: Column) -> Column:
    """Error results and skipped tools are never altered."""
    return F.when(is_error, "error").when(F.coalesce(skip, F.lit(False)), "skip").otherwise("shape")


def keeps_original(tokens_before: Column, tokens_after: Column, is_recovery: Column) -> Column:
    """Call rule: the shaped text is no smaller, and the caller did not ask for this view."""
    return ~is_recovery & (tokens_after >= tokens_before)


def resolve_policy(calls: DataFrame, policies: DataFrame, budget: int | None = None, long_text: int | None = None,
                   default_long_text: int = 200) -> DataFrame:
    """View over tool policy over global setting over default.

    ``calls`` may carry ``view_fields``, ``view_budget`` and ``view_offset``. The policy table has
    one row per tool; Spark broadcasts it only while it is under its own size limit.
    """
    view = lambda c, t: F.col(c) if c in calls.columns else F.lit(None).cast(t)
    joined = calls.join(policies.select(*[F.col(k).alias(f"p_{k}") for k in POLICY_KEYS]), F.col("tool") == F.col("p_tool"), "left")
    fields = F.coalesce(view("view_fields", "array<string>"), F.col("p_fields"))
    mode = F.when(fields.isNull(), "auto").when(F.size(fields) == 0, "all").otherwise("list")
    return joined.withColumns({
        "o_mode": mode,
        "o_fields": F.when(F.size(fields) > 0, fields),
        "o_counts": F.col("p_counts"),
        "o_budget": F.coalesce(view("view_budget", "long"), F.col("p_budget_tokens"), F.lit(budget), F.lit(DEFAULT_BUDGET)).cast("long"),
        "o_long_text": F.coalesce(F.col("p_long_text_chars"), F.lit(long_text), F.lit(default_long_text)).cast("int"),
        "o_offset": F.coalesce(view("view_offset", "long"), F.lit(0)).cast("long"),
        "o_skip": F.coalesce(F.col("p_skip"), F.lit(False)),
    }).drop(*[f"p_{k}" for k in POLICY_KEYS])


def policy_problem(policy: str = "policy") -> Column:
    """First problem of a policy given as JSON text, NULL when it is valid."""
    v = F.try_parse_json(policy)
    known = F.array(*map(F.lit, POLICY_KEYS))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    number = lambda k: F.try_variant_get(v, f"$.{k}", "double")
    is_integer = lambda k: (number(k).isNotNull() & (number(k) == F.floor(number(k))))
    present = lambda k: F.array_contains(keys, k)
    bad_paths = lambda k: present(k) & F.coalesce(
        F.exists(F.try_variant_get(v, f"$.{k}", "array<string>"), lambda p: p.isNull() | (p == "")), F.lit(True))
    auto = F.coalesce(F.try_variant_get(v, "$.fields", "string") == "auto", F.lit(False))
    return (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown key")
        .when(present("budget_tokens") & ~F.coalesce(is_integer("budget_tokens") & (number("budget_tokens") >= MIN_BUDGET), F.lit(False)), "budget_tokens")
        .when(present("long_text_chars") & ~F.coalesce(is_integer("long_text_chars") & (number("long_text_chars") >= 1), F.lit(False)), "long_text_chars")
        .when(~auto & bad_paths("fields"), "fields")
        .when(bad_paths("counts"), "counts")
        .when(present("skip") & F.try_variant_get(v, "$.skip", "boolean").isNull(), "skip")
    )


def validate_policies(policies: DataFrame, column: str = "policy") -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected rows, the latter with a ``reason``."""
    checked = policies.withColumn("reason", policy_problem(column))
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")
