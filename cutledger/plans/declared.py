"""Declared frame mode: every group of a typed DataFrame as one budgeted view that names all its cuts.

The schema gives the paths, so one generated aggregate profiles all groups (hash aggregates only; the value of a constant is
taken from the group's first row). Rows are numbered and costed by segments, so a group may hold any share of the table, and only rows that
the budget can hold are rendered. The fit is that of payload mode: longest prefix of rows, shorter notes, a row cut to fit, one line
as the last resort; ``manifest`` of ``plans.shape`` lists the cuts.

A group always has a result, also when its first row alone is over the budget. A null group key is a group of its own. An empty
frame has no groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cutledger.functions.rules import machine_url, nested_id
from cutledger.functions.tokens import token_count
from cutledger.operators import prefix, render as rd
from cutledger.operators.fields import LONG_TEXT, MIN_CONSTANT_RECORDS
from cutledger.operators.frame import clean_value, leaf_paths, path_values
from cutledger.plans.shape import KEY, MIN_ROW_COST, fit_lines

Fields = str | list[str] | None


def group_key(by: list[str]) -> Column:
    """The group as text: its values joined by a slash."""
    return F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in by])


def prefixes(path: str) -> list[str]:
    parts = path.split(".")
    return [".".join(parts[: i + 1]) for i in range(len(parts))]


def value_texts(records: DataFrame, paths: list[str]) -> list[Column]:
    """JSON text of a row's filled values at each path, several as a list; NULL when there are none."""
    out = []
    for p in paths:
        values = path_values(records, p)
        js = F.to_json(values)
        out.append(F.when(F.size(values) == 1, js.substr(F.lit(2), F.length(js) - 2)).when(F.size(values) > 1, js))
    return out


# Types whose equal values are those of equal JSON text, so a value is compared as it is.
_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _plain_sums(i: int, path: str, text: bool) -> list[Column]:
    """The sums of ``profile`` for a path outside arrays, without a list of values or their JSON."""
    value = F.col(".".join(f"`{p}`" for p in path.split(".")))
    value = F.nullif(value, F.lit("")) if text else value
    h = F.when(value.isNotNull(), F.xxhash64(value))
    link = value.startswith("http") & machine_url(value)
    return [
        F.count(value).alias(f"v{i}"), F.count(value).alias(f"r{i}"), F.min(h).alias(f"lo{i}"), F.max(h).alias(f"hi{i}"),
        (F.coalesce(F.sum(F.length(value)), F.lit(0)).cast("long") if text else F.lit(0)).alias(f"c{i}"),
        (F.count_if(link) if text else F.lit(0)).alias(f"l{i}")]


def profile(df: DataFrame, by: list[str], fields: Fields, long_text: int) -> DataFrame:
    """``(*by, n_total, leaf)``: for each path whether it is filled, kept, constant, and missing from some rows only."""
    records = df.drop(*by)
    leaves = leaf_paths(records.schema)
    paths = [p for p, _, _ in leaves]
    if len(set(paths)) < len(paths):
        raise ValueError("two columns share a path")
    sums, made = [], []
    for i, ((path, dtype, inside), js) in enumerate(zip(leaves, value_texts(records, paths), strict=True)):
        text = isinstance(dtype, T.StringType)
        values = path_values(records, path)
        h = F.xxhash64(js)
        sums += _plain_sums(i, path, text) if isinstance(dtype, _PLAIN) and not inside else [
            F.sum(F.size(values)).alias(f"v{i}"), F.count_if(F.size(values) > 0).alias(f"r{i}"),
            F.min(F.when(js.isNotNull(), h)).alias(f"lo{i}"), F.max(F.when(js.isNotNull(), h)).alias(f"hi{i}"),
            (F.sum(F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.length(x))) if text else F.lit(0)).alias(f"c{i}"),
            (F.sum(F.size(F.filter(values, lambda x: x.startswith("http") & machine_url(x)))) if text else F.lit(0)).alias(f"l{i}")]
        n, r = F.col(f"v{i}"), F.col(f"r{i}")
        if fields == "auto":
            strings = n if text else F.lit(0)
            kept = (F.col(f"c{i}") <= long_text * F.greatest(strings, F.lit(1))) & ~nested_id(F.lit(path)) & ~(F.col(f"l{i}") * 2 > strings)
        else:
            kept = F.lit(fields is None or any(path == f or path.startswith(f + ".") for f in fields))
        same = (F.col("n_total") >= MIN_CONSTANT_RECORDS) & (r == F.col("n_total")) & (F.col(f"lo{i}") == F.col(f"hi{i}"))
        kept = kept & (n > 0)
        made.append(F.struct(
            F.lit(i).alias("ord"), F.lit(path).alias("path"), F.array(*map(F.lit, prefixes(path))).alias("prefixes"), (n > 0).alias("filled"), kept.alias("kept"),
            (kept & same if fields == "auto" else F.lit(False)).alias("same"), ((r > 0) & (r < F.col("n_total"))).alias("some")))
    grouped = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), *[s for s in sums])
    return grouped.select(*by, "n_total", F.array(*made).alias("leaf"))


def decide(profiled: DataFrame, fields: Fields) -> DataFrame:
    """Add the fields and the field-level cuts of each group; constants still lack their values."""
    paths = lambda test: f"transform(filter(leaf, l -> {test}), l -> l.path)"
    above = lambda test: f"array_distinct(flatten(transform(filter(leaf, l -> {test}), l -> l.prefixes)))"
    none = "cast(array() AS array<string>)"
    # The highest prefix of a path that no filled, or no kept, path shares.
    highest = lambda test, over: f"array_distinct(transform(filter(leaf, l -> {test}), l -> get(array_except(l.prefixes, {over}), 0)))"
    listed = isinstance(fields, list)
    asked = F.array(*map(F.lit, fields)) if listed else F.expr(paths("l.kept") if fields == "auto" else "cast(NULL AS array<string>)")
    return profiled.withColumns({"filled_above": F.expr(above("l.filled")), "kept_above": F.expr(above("l.kept"))}).withColumns({
        "fields": asked, "row_fields": F.expr(paths("l.kept AND NOT l.same")),
        "left_out": F.expr(none if fields is None else highest("l.filled AND NOT l.kept", "kept_above")),
        "empty": F.expr(none if listed else highest("NOT l.filled", "filled_above")),
        "not_in_data": F.array_except("fields", "filled_above") if listed else F.expr(none),
        "ragged": F.lit(False) if listed else F.expr("exists(leaf, l -> l.kept AND NOT l.same AND l.some)"),
    }).drop("filled_above", "kept_above")


def row_json(records: DataFrame) -> Column:
    """A row's cleaned JSON with the paths of its group's ``row_fields`` only."""
    def masked(value: Column, dtype: T.DataType, path: str) -> Column:
        if isinstance(dtype, T.StructType):
            return F.struct(*[masked(value[f.name], f.dataType, f"{path}.{f.name}").alias(f.name) for f in dtype.fields])
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
            return F.transform(value, lambda x: masked(x, dtype.elementType, path))
        return F.when(F.array_contains("row_fields", path), value)

    return F.to_json(F.struct(*[clean_value(masked(F.col(f"`{f.name}`"), f.dataType, f.name), f.dataType).alias(f.name) for f in records.schema.fields]))


def declare(df: DataFrame, by: list[str], order: str, max_tokens: int, fields: Fields = "auto", offset: int = 0, label: str = "records",
            hint: str | None = None, long_text: int = LONG_TEXT, segment_rows: int = prefix.SEGMENT_ROWS) -> DataFrame:
    """One row for each group of ``df``, as ``shape_payloads`` gives for payloads; ``payload_id`` is the group.

    ``order`` is a column that is unique in a group. ``fields``: "auto", a list of dotted paths, or None for all. A row costs at least
    ``MIN_ROW_COST``, so at most ``max_tokens / MIN_ROW_COST + 1`` rows of a group are looked at, and only those that fit are collected.
    """
    records = df.drop(*by)
    near = (max(0, offset), max(0, offset) + max_tokens // MIN_ROW_COST)
    # Constants stand in a group's first row.
    placed = prefix.positions(df, by, order, segment_rows, [near, (0, 0)] if fields == "auto" else [near])
    start = F.least(F.lit(max(0, offset)).cast("long"), F.col("n_total"))
    plan = decide(profile(df, by, fields, long_text), fields).withColumn("start", start)
    if fields == "auto":
        firsts = placed.where("pos = 0").select(*by, F.array(*value_texts(records, [p for p, _, _ in leaf_paths(records.schema)])).alias("texts"))
        plan = prefix._on(plan, firsts, by)
        constants = F.expr("transform(filter(leaf, l -> l.same), l -> named_struct('path', l.path, 'value', get(texts, l.ord)))")
    else:
        constants = F.expr("cast(array() AS array<struct<path:string,value:string>>)")
    before, after = rd.static_notes(0)
    plan = plan.withColumn("constants", constants).drop("leaf", "texts").withColumns({
        "label": F.lit(label), "hint": F.lit(hint).cast("string"), "meta": F.lit(""), "count_lines": F.lit(None).cast("array<string>"), "aliased": F.lit(0).cast("long")})
    plan = plan.withColumn("_floor", F.expr(rd.static_cost().replace("notes_0", f"({before})").replace("tail_0", f"({after})")))
    reached = prefix._on(placed.where(F.col("pos").between(*near)), plan.select(*by, "row_fields", "start", "_floor"), by)
    lines = reached.select(*by, "_segment", "pos", "start", "_floor", row_json(records).alias("line")).withColumn("_cost", token_count("line") + 1)
    held = prefix.running_sum(lines, by, "_cost", "_used").where((F.col("_floor") + F.col("_used") <= max_tokens) | (F.col("pos") == F.col("start")))
    body = held.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_rows")).select(*by, F.transform("_rows", lambda r: r["line"]).alias("_lines"))
    named = body.withColumnsRenamed({k: f"_r_{k}" for k in by})
    joined = plan.join(named, reduce(lambda a, b: a & b, [plan[k].eqNullSafe(named[f"_r_{k}"]) for k in by]), "left")
    mode = "list" if isinstance(fields, list) else fields or "all"
    return fit_lines(joined.withColumns({
        KEY: group_key(by), "lines": F.coalesce("_lines", F.expr("cast(array() AS array<string>)")), "passthrough": F.lit(None).cast("string"),
        "text": F.lit(None).cast("string"), "record_list": F.lit(True), "o_budget": F.lit(max_tokens), "o_mode": F.lit(mode)}))
