"""Choosing fields and declaring what the choice leaves out, per payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cutledger.functions.rules import ID_NAME, URL_OR_ID_NAME, is_noise_name, nested_id

LONG_TEXT = 200  # fixed value: longer average strings are left out
MIN_CONSTANT_RECORDS = 3  # fixed value


def keeps_auto(long_text: Column) -> Column:
    """Short values stay; long text, mostly-link fields and nested ids go."""
    average = F.col("string_chars") / F.greatest(F.col("n_strings"), F.lit(1))
    return (
        (F.col("n_values") > 0)
        & (average <= long_text)
        & ~nested_id(F.col("path"))
        & ~(F.col("n_links") * 2 > F.col("n_strings"))
    )


def auto_fields(profile: DataFrame, long_text: int = LONG_TEXT) -> DataFrame:
    """Rows of the profile whose path is kept by the automatic rule."""
    return profile.where(keeps_auto(F.lit(long_text)))


def is_constant(n_total: Column) -> Column:
    """Same ordered list of values in every one of at least three records."""
    return (
        (n_total >= MIN_CONSTANT_RECORDS)
        & (F.col("n_records") == n_total)
        & (F.col("min_vals") == F.col("max_vals"))
    )


def constant_value() -> Column:
    """JSON text of a constant: the value, or the list of values."""
    return F.when(F.col("vals_per_record") == 1, F.col("min_vals")).otherwise(
        F.concat(F.lit("["), F.col("min_vals"), F.lit("]"))
    )


NO_PATHS = "cast(array() AS array<string>)"
# A path is covered when a field is the path itself or one of its prefixes.
_COVERED = "arrays_overlap(l.prefixes, {fields})"
_PREFIXES_OF = "array_distinct(flatten(transform(filter(leaf, l -> l.n_values > 0{also}), l -> l.prefixes)))"
# A left-out path collapses to its shortest prefix that no kept path shares.
LEFT_OUT = (
    f"CASE WHEN fields IS NULL OR leaf IS NULL THEN {NO_PATHS} ELSE "
    f"array_distinct(transform(filter(leaf, l -> l.n_values > 0 AND NOT {_COVERED.format(fields='fields')}), "
    "l -> get(array_except(l.prefixes, kept_prefixes), 0))) END"
)
NOT_IN_DATA = (
    f"CASE WHEN o_mode = 'list' THEN array_except(fields, coalesce(filled_prefixes, {NO_PATHS})) ELSE {NO_PATHS} END"
)
EMPTY_EVERYWHERE = (
    f"CASE WHEN o_mode = 'list' OR tops IS NULL THEN {NO_PATHS} ELSE array_except(tops, filled_prefixes) END"
)
# Per record shape, the picked paths with arrays as one leaf; ragged when one shape lacks some.
_PICKED = "array_distinct(transform(filter(s, x -> row_paths IS NULL OR array_contains(row_paths, x.path)), x -> x.apath))"
RAGGED = (
    "CASE WHEN o_mode = 'list' OR shapes IS NULL OR size(shapes) < 2 THEN false ELSE "
    f"array_min(transform(shapes, s -> size({_PICKED}))) < "
    f"size(array_distinct(flatten(transform(shapes, s -> {_PICKED})))) END"
)


_AUTO = (
    "l.n_values > 0 AND l.string_chars / greatest(l.n_strings, 1) <= o_long_text "
    f"AND NOT (contains(l.path, '.') AND substring_index(l.path, '.', -1) RLIKE r'{ID_NAME}') "
    "AND NOT (l.n_links * 2 > l.n_strings)"
)
_CONSTANT = (
    f"n_total >= {MIN_CONSTANT_RECORDS} AND l.n_records = n_total AND l.min_vals = l.max_vals "
    "AND array_contains(fields, l.path)"
)
_CONSTANT_VALUE = "CASE WHEN l.vals_per_record = 1 THEN l.min_vals ELSE concat('[', l.min_vals, ']') END"


def decide_fields(plan: DataFrame) -> DataFrame:
    """Add fields, constants and every field-level cut to one row per payload.

    Needs the columns of ``jsontasks.profile``, ``n_total`` and the options ``o_mode``
    (``auto``, ``list`` or ``all``), ``o_fields``, ``o_long_text`` and ``o_hoist``.
    """
    row_paths = f"transform(filter(leaf, l -> l.n_values > 0 AND {_COVERED.format(fields='row_fields')}), l -> l.path)"
    return (
        plan
        .withColumns({
            "filled_prefixes": F.expr(_PREFIXES_OF.format(also="")),
            "fields": F.expr(
                f"CASE o_mode WHEN 'auto' THEN coalesce(transform(filter(leaf, l -> {_AUTO}), l -> l.path), array()) "
                "WHEN 'list' THEN o_fields END"),
        })
        .withColumns({
            "kept_prefixes": F.expr(_PREFIXES_OF.format(also=f" AND {_COVERED.format(fields='fields')}")),
            "constants": F.expr(
                f"CASE WHEN o_hoist AND fields IS NOT NULL THEN transform(filter(leaf, l -> {_CONSTANT}), "
                f"l -> named_struct('path', l.path, 'value', {_CONSTANT_VALUE})) END"),
        })
        .withColumn("row_fields", F.expr(
            "CASE WHEN size(constants) > 0 THEN array_except(fields, transform(constants, c -> c.path)) ELSE fields END"))
        .withColumn("row_paths", F.expr(f"CASE WHEN size(shapes) > 1 AND row_fields IS NOT NULL THEN {row_paths} END"))
        .withColumns({
            "left_out": F.expr(LEFT_OUT),
            "not_in_data": F.expr(NOT_IN_DATA),
            "empty": F.expr(EMPTY_EVERYWHERE),
            "ragged": F.expr(RAGGED),
        })
        .drop("leaf", "tops", "shapes", "filled_prefixes", "kept_prefixes", "row_paths")
    )


def name_fields_sql(paths: str) -> str:
    """SQL: list the names, but only count URL and ID fields."""
    noise = f"(substring_index(p, '.', -1) RLIKE r'{URL_OR_ID_NAME}')"
    return (
        f"array_join(concat(filter({paths}, p -> NOT {noise}), CASE WHEN exists({paths}, p -> {noise}) THEN "
        f"array(concat('+', size(filter({paths}, p -> {noise})), ' URL/ID fields')) ELSE array() END), ', ')"
    )


def named_and_noise(paths: DataFrame, *keys: str, path: str = "path") -> DataFrame:
    """Per group: how many paths are named and how many are only counted."""
    noise = is_noise_name(F.col(path))
    return paths.groupBy(*keys).agg(F.count_if(~noise).alias("named"), F.count_if(noise).alias("noise"))


def filter_fields(filters: DataFrame, *keys: str, column: str = "filters", rename: DataFrame | None = None,
                  base: list[str] | None = None) -> DataFrame:
    """Every string ``field`` anywhere in a filter document, renamed, in document order.

    ``base`` fields come first. ``rename`` has columns ``request`` and ``response``.
    """
    from cutledger.operators.leaves import leaf_values

    found = leaf_values(filters, *keys, column=column).where(
        F.col("str").isNotNull() & ((F.col("path") == "field") | F.endswith("path", F.lit(".field")))
    ).select(*keys, F.col("str").alias("field"), "ord")
    if rename is not None:
        found = found.join(rename, found["field"] == rename["request"], "left").select(
            *keys, F.coalesce("response", "field").alias("field"), "ord")
    first = found.groupBy(*keys, "field").agg(F.min("ord").alias("ord"))
    if base:
        given = filters.select(*keys, F.posexplode(F.array(*map(F.lit, base))).alias("pos", "field")).select(
            *keys, "field", F.array(F.lit(-1), F.col("pos")).alias("ord"))
        first = given.unionByName(first).groupBy(*keys, "field").agg(F.min("ord").alias("ord"))
    return first


def property_union(defaults: Column, asked: Column) -> Column:
    """Defaults first, then the caller's own, each once."""
    return F.array_union(defaults, F.coalesce(asked, F.array().cast("array<string>")))
