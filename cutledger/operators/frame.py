"""Frame mode: a typed DataFrame is the record list, optionally split by columns.

Paths come from the schema, so profiles are one aggregate with generated expressions: no
JSON, no leaf table, and the scan reads only the columns asked for. Groups may hold a large
share of the table; every aggregate here is partial before the shuffle, and row order is
only ever needed for the first rows that a budget can hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cutledger.functions.rules import last_segment, machine_url, nested_id
from cutledger.functions.tokens import token_count
from cutledger.operators.budget import budget_pack
from cutledger.operators.positions import first_positions


def leaf_paths(schema: T.DataType, prefix: str = "") -> list[tuple[str, T.DataType, bool]]:
    """``(path, leaf type, inside an array)`` in schema order."""
    if isinstance(schema, T.StructType):
        return [leaf for f in schema.fields for leaf in leaf_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return [(p, t, True) for p, t, _ in leaf_paths(schema.elementType, prefix)]
    return [(prefix, schema, False)]


def _fields(root: Column, schema: T.DataType, parts: list[str]) -> Column:
    """All values at a path as an array, walking through arrays."""
    if isinstance(schema, T.ArrayType):
        inner = F.transform(root, lambda x: _fields(x, schema.elementType, parts))
        return F.flatten(F.filter(inner, lambda x: x.isNotNull()))
    if not parts:
        return F.filter(F.array(root), lambda x: x.isNotNull())
    if isinstance(schema, T.MapType):
        return _fields(F.try_element_at(root, F.lit(parts[0]).cast(schema.keyType)), schema.valueType, parts[1:])
    child = next(f for f in schema.fields if f.name == parts[0])
    return _fields(root[parts[0]], child.dataType, parts[1:])


def path_values(df: DataFrame, path: str) -> Column:
    """Filled values of a path in one row, as ARRAY of its type."""
    parts = path.split(".")
    field = df.schema[parts[0]]
    values = _fields(F.col(f"`{parts[0]}`"), field.dataType, parts[1:])
    leaf = next((t for p, t, _ in leaf_paths(df.schema) if p == path), None)  # a path into a map is no path of the schema
    return F.filter(values, lambda x: x != "") if isinstance(leaf, T.StringType) else values


def clean_value(value: Column, dtype: T.DataType) -> Column:
    """Typed cleaning: "" and emptied containers become NULL, array positions stay."""
    if isinstance(dtype, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(dtype, T.StructType):
        kids = [clean_value(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        some = reduce(lambda a, b: a | b, [k.isNotNull() for k in kids], F.lit(False))
        return F.when(value.isNotNull() & some, F.struct(*kids))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda x: clean_value(x, dtype.elementType))
        return F.when(F.exists(items, lambda x: x.isNotNull()), items)
    if isinstance(dtype, T.MapType):
        return F.when(F.size(value) > 0, value)
    return value


def pick_columns(df: DataFrame, fields: list[str]) -> list[Column]:
    """Columns of the schema cut to dotted paths; a parent path keeps its subtree."""
    def prune(value: Column, dtype: T.DataType, paths: list[list[str]]) -> Column:
        if any(not p for p in paths):
            return value
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda x: prune(x, dtype.elementType, paths))
        if isinstance(dtype, T.MapType):
            asked = F.array(*[F.lit(p[0]).cast(dtype.keyType) for p in paths])
            held = F.map_filter(value, lambda k, _: F.array_contains(asked, k))
            below = lambda k, v: reduce(
                lambda rest, name: F.when(k == F.lit(name).cast(dtype.keyType), prune(v, dtype.valueType, [p[1:] for p in paths if p[0] == name])).otherwise(rest),
                sorted({p[0] for p in paths}), F.lit(None))
            return F.transform_values(held, below) if all(len(p) == 1 for p in paths) or isinstance(dtype.valueType, T.MapType) else held
        if not isinstance(dtype, T.StructType):
            return F.lit(None).cast(dtype)
        kept = [f for f in dtype.fields if any(p[0] == f.name for p in paths)]
        inner = F.struct(*[prune(value[f.name], f.dataType, [p[1:] for p in paths if p[0] == f.name]).alias(f.name) for f in kept])
        return F.when(value.isNotNull(), inner)

    split = [f.split(".") for f in fields]
    out = []
    for f in df.schema.fields:
        paths = [p[1:] for p in split if p[0] == f.name]
        if paths:
            out.append(prune(F.col(f"`{f.name}`"), f.dataType, paths).alias(f.name))
    return out


def profile_frame(df: DataFrame, by: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """``(*by, path, n_values, n_strings, string_chars, n_links, n_records, min_vals, max_vals, n_total)``."""
    by = by or []
    inner = df.drop(*by)
    paths = paths or [p for p, _, _ in leaf_paths(inner.schema)]
    types = {p: (t, a) for p, t, a in leaf_paths(inner.schema)}
    per_path = []
    for i, path in enumerate(paths):
        dtype, in_array = types[path]
        is_text = isinstance(dtype, T.StringType)
        if in_array:
            values = path_values(inner, path)
            n = F.size(values).cast("long")
            joined = F.when(n > 0, F.to_json(values))
            chars = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) if is_text else F.lit(0)
            links = F.size(F.filter(values, machine_url)) if is_text else F.lit(0)
        else:
            value = F.col(".".join(f"`{p}`" for p in path.split(".")))
            value = F.nullif(value, F.lit("")) if is_text else value
            n = F.when(value.isNotNull(), 1).otherwise(0).cast("long")
            joined = value.cast("string")
            chars = F.coalesce(F.length(value), F.lit(0)) if is_text else F.lit(0)
            links = F.when(machine_url(value), 1).otherwise(0) if is_text else F.lit(0)
        total = F.sum(n)
        per_path.append(F.struct(
            F.lit(i).alias("ord"), F.lit(path).alias("path"), F.coalesce(total, F.lit(0)).alias("n_values"),
            (F.coalesce(total, F.lit(0)) if is_text else F.lit(0).cast("long")).alias("n_strings"),
            F.coalesce(F.sum(chars), F.lit(0)).cast("long").alias("string_chars"),
            F.coalesce(F.sum(links), F.lit(0)).cast("long").alias("n_links"),
            F.count(joined).alias("n_records"), F.min(joined).alias("min_vals"), F.max(joined).alias("max_vals"),
        ).alias(f"p{i}"))
    grouped = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), *per_path)
    return grouped.select(*by, "n_total", F.explode(F.array(*[f"p{i}" for i in range(len(paths))])).alias("p")).select(*by, "n_total", "p.*")


def frame_auto_fields(profile: DataFrame, long_text: int = 200) -> DataFrame:
    from cutledger.operators.fields import keeps_auto

    return profile.where(keeps_auto(F.lit(long_text)))


def frame_constants(profile: DataFrame) -> DataFrame:
    from cutledger.operators.fields import is_constant

    return profile.where(is_constant(F.col("n_total")))


def frame_empty(profile: DataFrame) -> DataFrame:
    return profile.where("n_values = 0")


def frame_ragged(profile: DataFrame) -> DataFrame:
    """Paths that some rows have and others lack."""
    return profile.where("n_records > 0 AND n_records < n_total")


def row_text(df: DataFrame, fields: list[str] | None = None, drop: list[str] | None = None) -> Column:
    """One cleaned JSON line per row, in schema order."""
    kept = df.drop(*(drop or []))
    picked = kept.select(*pick_columns(kept, fields)) if fields else kept
    columns = pick_columns(kept, fields) if fields else [F.col(f"`{c}`") for c in kept.columns]
    cleaned = [clean_value(c, f.dataType).alias(f.name) for c, f in zip(columns, picked.schema.fields, strict=True)]
    return F.to_json(F.struct(*cleaned))


def shape_frame(df: DataFrame, by: list[str], order: str, max_tokens: int, fields: list[str] | None = None,
                header_cost: int = 0) -> DataFrame:
    """``(*by, pos, line, cost)``: the rows of every group that fit the budget, in order.

    A row costs at least three, so only the first ``max_tokens / 3`` rows of a group can fit;
    those are found in two salted steps and the rest is never rendered or moved.
    """
    reach = max_tokens // 3 + 1
    near = first_positions(df, by, order, reach)
    lines = near.select(*by, "pos", row_text(df, fields).alias("line")).withColumn("cost", token_count("line"))
    group = F.struct(*by) if len(by) > 1 else F.col(by[0])
    packed = budget_pack(lines.withColumn("_group", group), "_group", "pos", "cost", max_tokens, header_cost)
    return packed.select(*by, "pos", "line", "cost")


def flat_columns(df: DataFrame) -> list[tuple[str, Column]]:
    """Struct fields as dotted columns; arrays stay one JSON cell."""
    def walk(value: Column, dtype: T.DataType, path: str) -> list[tuple[str, Column]]:
        if isinstance(dtype, T.StructType):
            return [c for f in dtype.fields for c in walk(value[f.name], f.dataType, f"{path}.{f.name}")]
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            return [(path, F.to_json(value))]
        return [(path, value.cast("string"))]

    return [c for f in df.schema.fields for c in walk(F.col(f"`{f.name}`"), f.dataType, f.name)]


def tsv_cell(value: Column) -> Column:
    """Escape the four characters that would break a table line."""
    out = F.coalesce(value, F.lit(""))
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def tsv_line(df: DataFrame) -> Column:
    line = F.array_join(F.array(*[tsv_cell(c) for _, c in flat_columns(df)]), "\t")
    return F.when(F.startswith(line, F.lit("#")), F.concat(F.lit("\\"), line)).otherwise(line)


def tsv_header(df: DataFrame) -> str:
    return "\t".join(name for name, _ in flat_columns(df))
