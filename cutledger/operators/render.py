"""Note lines above the rows, and cell rules of the table form."""

from __future__ import annotations

from cutledger.functions.tokens import text_cost_sql, token_count_sql
from cutledger.operators.discovery import meta_display
from cutledger.operators.fields import name_fields_sql

# Note line formats (fixed values).
SAME = "# same in every record: "
EMPTY = "# empty (null) in every record: "
RAGGED = "# a field missing from a row is empty (null) in that record"
LEFT_OUT = "# left out fields: "
NOT_IN_DATA = "# not in data (null or missing in every record): "
ALIASES = "# @1, @2… are short ids; pass them unchanged in tool calls"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def static_notes(level: int) -> tuple[str, str]:
    """SQL for the notes before and after the line about rows not shown, at a squeeze level.

    Level 0 is everything, 1 shortens field lists to numbers and drops the ragged hint,
    2 also replaces the count lines by their number.
    """
    same = (
        f"CASE WHEN size(constants) > 0 THEN concat({_lit(SAME)}, array_join(transform(constants, "
        "c -> concat(c.path, '=', c.value)), ' · ')) END"
    )
    absent = f"CASE WHEN size(not_in_data) > 0 THEN concat({_lit(NOT_IN_DATA)}, array_join(not_in_data, ', ')) END"
    aliased = f"CASE WHEN aliased > 0 THEN {_lit(ALIASES)} END"
    short = level >= 1
    empty = "concat(size(empty), ' fields')" if short else name_fields_sql("empty")
    left = "concat(size(left_out), ' (list too long for budget)')" if short else name_fields_sql("left_out")
    ragged = "CAST(NULL AS string)" if short else f"CASE WHEN ragged THEN {_lit(RAGGED)} END"
    counts = (
        "CASE WHEN size(count_lines) > 0 THEN concat('# ', size(count_lines), ' count lines left out for budget') END"
        if level == 2 else "CASE WHEN size(count_lines) > 0 THEN array_join(count_lines, '\\n') END"
    )
    before = (
        f"concat_ws('\\n', {same}, CASE WHEN size(empty) > 0 THEN concat({_lit(EMPTY)}, {empty}) END, {ragged}, "
        f"CASE WHEN size(left_out) > 0 THEN concat({_lit(LEFT_OUT)}, {left}) END, {absent})"
    )
    return f"nullif({before}, '')", f"nullif(concat_ws('\\n', {counts}, {aliased}), '')"


def first_line(n: str, with_meta: bool = True) -> str:
    """SQL for the line that says how many records are shown; no range when there are none."""
    which = f"CASE WHEN start > 0 AND {n} > 0 THEN concat(' (records ', start + 1, '–', start + {n}, ')') ELSE '' END"
    meta = ", CASE WHEN meta <> '' THEN concat(' · ', meta) ELSE '' END" if with_meta else ""
    return f"concat('# ', label, ': showing ', {n}, ' of ', n_total, {which}{meta})"


def rest_line(n: str) -> str:
    """SQL for the line about the rows not shown, NULL when there are none."""
    return (
        f"CASE WHEN start + {n} < n_total THEN concat('# ', n_total - start - {n}, ' records not shown', "
        "CASE WHEN hint IS NOT NULL THEN concat(' · ', replace(hint, '{next}', cast(start + "
        f"{n} AS string))) ELSE '' END) END"
    )


def head(n: str, level: int) -> str:
    """SQL for everything above the rows. Level 0 uses the columns ``notes_0`` and ``tail_0``."""
    before, after = ("notes_0", "tail_0") if level == 0 else static_notes(level)
    return f"concat_ws('\\n', {first_line(n)}, {before}, {rest_line(n)}, {after})"


def static_cost() -> str:
    """Cost of what does not move with the rows shown, line breaks before the notes included."""
    meta = f"CASE WHEN meta <> '' THEN {token_count_sql('meta')} + 1 ELSE 0 END"
    return " + ".join([meta, *(f"coalesce({text_cost_sql(c)} + 1, 0)" for c in ("notes_0", "tail_0"))])


def moving_cost(n: str) -> str:
    """Cost of the two lines that depend on the number of rows shown."""
    rest = rest_line(n)
    return f"{token_count_sql(first_line(n, with_meta=False))} + coalesce({token_count_sql(rest)} + 1, 0)"


def meta_text() -> str:
    """SQL for the envelope values in the first line, from ``meta_list``."""
    return f"array_join(transform(meta_list, m -> concat(m.path, '=', {meta_display('m.js')})), ' · ')"


def tsv_cell(js: str) -> str:
    """SQL for one table cell from the JSON text of a value: strings bare, four characters escaped."""
    raw = (
        f"CASE WHEN {js} IS NULL OR {js} = 'null' THEN '' WHEN left({js}, 1) = '\"' "
        f"THEN try_variant_get(try_parse_json({js}), '$', 'string') ELSE {js} END"
    )
    return f"replace(replace(replace(replace({raw}, '\\\\', '\\\\\\\\'), '\\t', '\\\\t'), '\\n', '\\\\n'), '\\r', '\\\\r')"


def tsv_line(cells: str) -> str:
    """SQL for a table line; a leading # is escaped so that it cannot pass for a note."""
    line = f"array_join({cells}, '\\t')"
    return f"CASE WHEN startswith({line}, '#') THEN concat('\\\\', {line}) ELSE {line} END"
