"""Rebuilding a VARIANT record as JSON text with Spark SQL expressions only.

A record is walked by nesting one higher-order ``transform`` per level, so rebuilding is one
expression on the row that holds the record: no shuffle and no Python worker. Objects and arrays
are first brought to one list of ``(key, value)`` children (``key`` is NULL for array elements),
which keeps the generated expression linear in the levels. Subtrees below ``UNROLLED`` levels are
walked by a fold over their tokens (``jsonfold``), so records of any depth come out the same way.

All builders take and return SQL text; wrap the result in ``F.expr``.
"""

from __future__ import annotations

from itertools import count

from cutledger.functions import jsonfold

# Levels written out as nested expressions. Analysis time grows fast with each, and few records go deeper.
UNROLLED = 3

# JSON texts that count as "no value" (fixed values).
EMPTY_TEXTS = "('null', '\"\"', '[]', '{}')"

_names = count()


def _fresh(prefix: str) -> str:
    return f"{prefix}_{next(_names)}"


def quote(text: str) -> str:
    """SQL string literal for ``text``."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body) -> str:
    """Evaluate ``value`` once and use it in ``body(name)``."""
    name = _fresh("v")
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'struct<>') IS NOT NULL)"


def entries(v: str) -> str:
    """``array<struct<key, value>>`` of an object; NULL for anything else."""
    return f"map_entries(try_variant_get({v}, '$', 'map<string,variant>'))"


def elements(v: str) -> str:
    """``array<variant>`` of a JSON array; NULL for anything else."""
    return f"try_variant_get({v}, '$', 'array<variant>')"


def children(v: str) -> str:
    e = _fresh("e")
    return (
        f"coalesce({entries(v)}, transform({elements(v)}, "
        f"{e} -> named_struct('key', cast(NULL AS string), 'value', {e})))"
    )


def dotted(keys: tuple[str, ...]) -> str:
    """Dotted path of the keys walked so far; arrays (NULL keys) are transparent."""
    return f"concat_ws('.', {', '.join(keys)})" if keys else "''"


def covered(fields: str | None, path: str) -> str:
    """True when a requested field is ``path`` itself or one of its parents."""
    if fields is None:
        return "true"
    f = _fresh("f")
    return f"exists({fields}, {f} -> {f} = {path} OR startswith({path}, concat({f}, '.')))"


def json_string(s: str) -> str:
    """JSON text of a SQL string."""
    return f"to_json(cast({s} AS variant))"


def text(v: str, fields: str | None = None, aliases: str | None = None, cap: str | None = None,
         unrolled: int = UNROLLED) -> str:
    """Cleaned JSON text of a record, NULL when nothing is left.

    Empty values are dropped; an emptied array element becomes ``null`` so that positions
    stay. ``fields`` (array<string>) keeps only covered paths, ``aliases``
    (map<string,string>) replaces whole string values, ``cap`` cuts longer strings.
    """

    def value(j: str, s: str, path: str) -> str:
        cases = []
        if aliases is not None:
            hit = f"element_at({aliases}, {s})"
            cases.append(f"WHEN left({j}, 1) = '\"' AND {hit} IS NOT NULL THEN concat('\"', {hit}, '\"')")
        if cap is not None:
            cut = json_string(f"concat(left({s}, {cap}), '…')")
            cases.append(f"WHEN left({j}, 1) = '\"' AND length({s}) > {cap} THEN {cut}")
        out = f"CASE {' '.join(cases)} ELSE {j} END" if cases else j
        return f"CASE WHEN {j} IN {EMPTY_TEXTS} OR NOT ({covered(fields, path)}) THEN NULL ELSE {out} END"

    def scalar(v: str, keys: tuple[str, ...]) -> str:
        return let(f"to_json({v})", lambda j: value(j, f"try_variant_get({v}, '$', 'string')", dotted(keys)))

    def deep(v: str, keys: tuple[str, ...]) -> str:
        return let(f"to_json({v})", lambda j: f"CASE WHEN {jsonfold.is_container(j)} THEN {jsonfold.rebuilt(j, keys, value)} ELSE {scalar(v, keys)} END")

    def node(v: str, keys: tuple[str, ...]) -> str:
        if len(keys) == unrolled:
            return deep(v, keys)
        k, x, y, z = (_fresh(c) for c in "kxyz")
        sub = node(f"{k}.value", (*keys, f"{k}.key"))
        return let(
            children(v),
            lambda kids: f"CASE WHEN {kids} IS NULL THEN {scalar(v, keys)} ELSE "
            + let(
                f"transform({kids}, {k} -> named_struct('key', {k}.key, 't', {sub}))",
                lambda ts: f"CASE WHEN forall({ts}, {x} -> {x}.t IS NULL) THEN NULL "
                f"WHEN element_at({ts}, 1).key IS NULL THEN "
                f"concat('[', array_join(transform({ts}, {y} -> {y}.t), ',', 'null'), ']') "
                f"ELSE concat('{{', array_join(transform(filter({ts}, {z} -> {z}.t IS NOT NULL), "
                f"{z} -> concat({json_string(z + '.key')}, ':', {z}.t)), ','), '}}') END",
            )
            + " END",
        )

    return node(v, ())


def pick_text(v: str, fields: str, unrolled: int = UNROLLED) -> str:
    """JSON text of a record cut to ``fields`` with nothing else changed (no cleaning)."""

    def node(v: str, keys: tuple[str, ...]) -> str:
        whole = covered(fields, dotted(keys))
        if len(keys) == unrolled:
            picked = let(f"to_json({v})", lambda j: f"CASE WHEN {jsonfold.is_container(j)} THEN "
                         + jsonfold.rebuilt(j, keys, lambda t, _, path: f"CASE WHEN {covered(fields, path)} THEN {t} END", lambda path: covered(fields, path)) + " END")
            return f"CASE WHEN {whole} THEN to_json({v}) ELSE {picked} END"
        k, x, y, z = (_fresh(c) for c in "kxyz")
        sub = node(f"{k}.value", (*keys, f"{k}.key"))
        inner = let(
            f"transform({children(v)}, {k} -> named_struct('key', {k}.key, 't', {sub}))",
            lambda ts: f"CASE WHEN {ts} IS NULL OR size({ts}) = 0 THEN NULL "
            f"WHEN element_at({ts}, 1).key IS NULL THEN "
            f"CASE WHEN forall({ts}, {x} -> coalesce({x}.t, 'null') = 'null') THEN NULL ELSE "
            f"concat('[', array_join(transform({ts}, {y} -> {y}.t), ',', 'null'), ']') END "
            f"WHEN forall({ts}, {x} -> {x}.t IS NULL) THEN NULL "
            f"ELSE concat('{{', array_join(transform(filter({ts}, {z} -> {z}.t IS NOT NULL), "
            f"{z} -> concat({json_string(z + '.key')}, ':', {z}.t)), ','), '}}') END",
        )
        return f"CASE WHEN {whole} THEN to_json({v}) ELSE {inner} END"

    return node(v, ())
