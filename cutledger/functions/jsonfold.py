"""Walking JSON of any depth: one fold over the tokens of a subtree, with a stack of its open containers.

The nested expressions of ``jsonwalk`` and the chain of explodes of ``operators.leaves`` unroll a fixed number
of levels, which covers nearly all records. What lies deeper is walked here, so no level is out of reach.
All builders take and return SQL text; ``keys`` are the keys already walked, NULL for array elements.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

# Strings, brackets, separators and bare values. The possessive groups keep long strings off the regex stack.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]++'
# Strings with the colon that marks a key.
STRING = r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?'

_names = count()


def _fresh(prefix: str) -> str:
    return f"{prefix}_{next(_names)}"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unquoted(token: str) -> str:
    """Value of a JSON string token; NULL for other tokens."""
    return f"try_variant_get(try_parse_json({token}), '$', 'string')"


def is_container(js: str) -> str:
    return f"(left({js}, 1) IN ('[', '{{') AND {js} NOT IN ('[]', '{{}}'))"


def longest_string(v: str) -> str:
    """Length of the longest string value anywhere in a VARIANT; 0 without one."""
    s, t = _fresh("s"), _fresh("t")
    found = f"filter(regexp_extract_all(to_json({v}), {_literal(STRING)}, 0), {s} -> right({s}, 1) = '\"')"
    return f"coalesce(array_max(transform({found}, {t} -> length({unquoted(t)}))), 0)"


def rebuilt(js: str, keys: tuple[str, ...], scalar: Callable[[str, str, str], str], keep: Callable[[str], str] | None = None) -> str:
    """JSON text of the container ``js`` with every value replaced by ``scalar(token, string, path)``; NULL drops it.

    Without ``keep`` a container without a value is dropped. With it, one whose path it accepts stays
    whole, and an array of nothing but null is dropped otherwise.
    """
    s, t, f, x = (_fresh(c) for c in "stfx")
    frame = "struct<key:string,name:string,arr:boolean,parts:array<string>>"
    top, rest = f"try_element_at({s}.st, -1)", f"slice({s}.st, 1, size({s}.st) - 1)"
    names = ", ".join((*keys, f"transform({s}.st, {f} -> {f}.name)"))

    def state(st: str, key: str, res: str) -> str:
        return f"named_struct('st', {st}, 'key', {key}, 'res', {res})"

    def put(stack: str, key: str, text: str) -> str:
        """``stack`` with one more part in its last frame."""
        last, y = f"element_at({stack}, -1)", _fresh("y")
        part = f"CASE WHEN {y}.arr THEN {text} ELSE concat({key}, ':', {text}) END"
        grown = f"transform(array({last}), {y} -> named_struct('key', {y}.key, 'name', {y}.name, 'arr', {y}.arr, 'parts', concat({y}.parts, array({part}))))"
        return f"concat(slice({stack}, 1, size({stack}) - 1), {grown})"

    none = "cast(NULL AS string)"
    opened = f"named_struct('key', {s}.key, 'name', {unquoted(s + '.key')}, 'arr', {t} = '[', 'parts', cast(array() AS array<string>))"
    joined = f"CASE WHEN {top}.arr THEN concat('[', array_join({top}.parts, ',', 'null'), ']') ELSE concat('{{', array_join({top}.parts, ','), '}}') END"
    if keep is None:
        closed = f"CASE WHEN forall({top}.parts, {x} -> {x} IS NULL) THEN NULL ELSE {joined} END"
    else:
        gone = f"forall({top}.parts, {x} -> {x} IS NULL OR ({top}.arr AND {x} = 'null'))"
        whole = keep(f"concat_ws('.', {names})")
        closed = f"CASE WHEN NOT ({whole}) AND {gone} THEN NULL ELSE {joined} END"
    c = _fresh("c")
    popped = (
        f"element_at(transform(array({closed}), {c} -> CASE WHEN size({s}.st) = 1 THEN {state(rest, none, c)} "
        f"ELSE {state(put(rest, top + '.key', c), none, none)} END), 1)"
    )
    value = scalar(t, unquoted(t), f"concat_ws('.', {names}, {unquoted(s + '.key')})")
    step = (
        f"CASE WHEN {t} IN (',', ':') THEN {s} "
        f"WHEN {t} IN ('{{', '[') THEN {state(f'concat({s}.st, array({opened}))', none, none)} "
        f"WHEN {t} IN ('}}', ']') THEN {popped} "
        f"WHEN NOT {top}.arr AND {s}.key IS NULL THEN {state(s + '.st', t, none)} "
        f"ELSE {state(put(s + '.st', s + '.key', value), none, none)} END"
    )
    start = state(f"cast(array() AS array<{frame}>)", none, none)
    return f"aggregate(regexp_extract_all({js}, {_literal(TOKEN)}, 0), {start}, ({s}, {t}) -> {step}).res"


def leaves(js: str, path: str, apath: str, in_array: str) -> str:
    """``array<struct<path, apath, i, js>>``: the leaves of the container ``js`` in order, ``i`` rising.

    ``path``, ``apath`` and ``in_array`` are those of the container; an empty container is a leaf.
    """
    s, t, f, g = (_fresh(c) for c in "stfg")
    frame, leaf = "struct<name:string,arr:boolean>", "struct<path:string,apath:string,i:int,js:string>"
    top = f"try_element_at({s}.st, -1)"
    none = "cast(NULL AS string)"

    def state(st: str, key: str, out: str) -> str:
        return f"named_struct('st', {st}, 'key', {key}, 'prev', {t}, 'i', {s}.i + 1, 'out', {out})"

    def added(js: str, key: str) -> str:
        first = f"array_position(transform({s}.st, {f} -> {f}.arr), true)"
        outer = f"CASE WHEN {first} = 0 THEN {s}.st ELSE slice({s}.st, 1, cast({first} AS int)) END"
        name = unquoted(key)
        whole = f"concat_ws('.', nullif({path}, ''), transform({s}.st, {g} -> {g}.name), {name})"
        upto = (f"CASE WHEN {in_array} THEN {apath} ELSE concat_ws('.', nullif({apath}, ''), "
                f"transform({outer}, {g} -> {g}.name), CASE WHEN {first} = 0 THEN {name} END) END")
        return f"concat({s}.out, array(named_struct('path', {whole}, 'apath', {upto}, 'i', {s}.i, 'js', {js})))"

    opened = f"concat({s}.st, array(named_struct('name', {unquoted(s + '.key')}, 'arr', {t} = '[')))"
    empty = f"CASE WHEN {s}.prev IN ('{{', '[') THEN {added(f'concat({s}.prev, {t})', none)} ELSE {s}.out END"
    step = (
        f"CASE WHEN {t} IN ('{{', '[') THEN {state(opened, none, s + '.out')} "
        f"WHEN {t} IN ('}}', ']') THEN {state(f'slice({s}.st, 1, size({s}.st) - 1)', none, empty)} "
        f"WHEN {t} IN (',', ':') THEN {state(s + '.st', s + '.key', s + '.out')} "
        f"WHEN NOT {top}.arr AND {s}.key IS NULL THEN {state(s + '.st', t, s + '.out')} "
        f"ELSE {state(s + '.st', none, added(t, s + '.key'))} END"
    )
    start = f"named_struct('st', cast(array() AS array<{frame}>), 'key', {none}, 'prev', '', 'i', 0, 'out', cast(array() AS array<{leaf}>))"
    return f"aggregate(regexp_extract_all({js}, {_literal(TOKEN)}, 0), {start}, ({s}, {t}) -> {step}).out"
