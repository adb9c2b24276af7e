"""Walking the JSON text of VARIANT records in Arrow tasks: cut to fields, or taken apart into leaves.

``to_json`` of a VARIANT is compact, with sorted keys, so its tokens are taken as they are and every number and string keeps
its text. One pass over the tokens with a stack of open containers costs a fraction of the nested expressions of ``jsonwalk``,
which stay where a record is inside another expression, or where rows must keep the partitioning of their payloads (Spark
forgets it behind a Python step). Rules and results are the same, at any depth.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from decimal import Decimal
from functools import cached_property
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from cutledger.functions import rules
from cutledger.functions.jsonfold import TOKEN as WORD
from cutledger.functions.jsonwalk import UNROLLED

# Tasks get these functions by value, so workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Strings (with the colon of a key), brackets and bare values.
TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+":?|[{}\[\]]|[^\s{}\[\],:"]++')
EMPTY = {"null", '""'}
_EMPTY_KIND = {"null": 0, '""': 1}.get
MOST_PATHS = 20_000  # remembered paths of a field list; they start anew beyond it
OFTEN = 32  # a layout seen as often is read by a pattern of its own
MOST_LAYOUTS = 2_000  # remembered layouts of records, and of filled paths in one; they start anew beyond it

LEAF = pa.struct([("path", pa.string()), ("apath", pa.string()), ("js", pa.string()), ("str", pa.string())])
_LEAVES = "array<struct<path:string,apath:string,js:string,str:string>>"
_PROFILE = (
    "struct<leaf:array<struct<path:string,prefixes:array<string>,n_values:bigint,n_strings:bigint,string_chars:bigint,n_links:bigint,"
    "n_records:bigint,min_vals:string,max_vals:string,vals_per_record:bigint>>,tops:array<string>,shapes:array<array<struct<path:string,apath:string>>>>"
)
_STRINGS = pa.list_(pa.string())
PROFILE = pa.struct([
    ("leaf", pa.list_(pa.struct([
        ("path", pa.string()), ("prefixes", _STRINGS), *((n, pa.int64()) for n in ("n_values", "n_strings", "string_chars", "n_links", "n_records")),
        ("min_vals", pa.string()), ("max_vals", pa.string()), ("vals_per_record", pa.int64())]))),
    ("tops", _STRINGS), ("shapes", pa.list_(pa.list_(pa.struct([("path", pa.string()), ("apath", pa.string())])))),
])
MARKS = frozenset(":{}[]")  # last characters of keys and brackets; no value ends with one
_PATTERNS = ("URL_START", "URL_HOST", "URL_PATH", "HOST", "API_OR_AVATAR_HOST", "API_PATH", "IMAGE_PATH")
URL_START, URL_HOST, URL_PATH, HOST, API_HOST, API_PATH, IMAGE = (re.compile(getattr(rules, p).replace(r"\z", r"\Z"), re.ASCII) for p in _PATTERNS)


def unquoted(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


class Fields(dict):
    """``(path, key token)`` to the path below and whether a field covers it; ``None`` is the path of the record itself."""

    def __init__(self, fields: tuple | None, clean: bool):
        # A comparison with a null field is unknown: cleaning then keeps the value, a plain pick drops it.
        self.every = clean and (fields is None or None in fields)
        self.fields = [f for f in fields or () if f is not None]
        self.root = self.covers("")

    def covers(self, path: str) -> bool:
        return self.every or any(path == f or path.startswith(f + ".") for f in self.fields)

    def __missing__(self, at: tuple) -> tuple[str, bool]:
        path, token = at
        below = unquoted(token[:-1]) if path is None else f"{path}.{unquoted(token[:-1])}"
        if len(self) >= MOST_PATHS:
            self.clear()
        self[at] = found = below, self.covers(below)
        return found


def cut(js: str | None, fields: Fields, clean: bool) -> str | None:
    """A record with the covered values only; None when nothing is left.

    ``clean`` drops empty values and containers; without it a covered container stays whole.
    """
    if js is None:
        return None
    parts, array, path, held, live, key, out = [], True, None, fields.root, False, "", None
    above = []
    for t in TOKEN.findall(js):
        if t[-1] == ":":
            key = t
            continue
        if t == "}" or t == "]":
            kept = live or (held and not clean)
            out = (f"[{','.join(parts)}]" if array else f"{{{','.join(parts)}}}") if kept else None
            parts, array, path, held, live, key = above.pop()
        else:
            below, covered = (path, held) if array else fields[path, key]
            covered = covered or (held and not clean)
            if t == "{" or t == "[":
                above.append((parts, array, path, held, live, key))
                parts, array, path, held, live = [], t == "[", below, covered, False
                continue
            out = t if covered and not (clean and t in EMPTY) else None
        if array:
            parts.append("null" if out is None else out)
            live = live or (out is not None and (clean or out != "null"))
        elif out is not None:
            parts.append(key + out)
            live = True
    return out


class Cuts(dict):
    """``cut`` of records one after the other, by the keys and brackets they share: a layout seen often is cut once for each set of
    empty values, and other records of it only put their values into that text."""

    last: list | None = None

    def __init__(self, fields: tuple | None, clean: bool):
        self.fields, self.clean = Fields(fields, clean), clean

    def text(self, js: str | None) -> str | None:
        if js is None:
            return None
        last = self.last
        if last is not None and (found := last[1].fullmatch(js)):
            return self.filled(last[2], js, found.groups())
        tokens = TOKEN.findall(js)
        marks = "".join([t if t[-1] in MARKS else "\0" for t in tokens])
        layout = self.get(marks)
        if layout is None:
            if len(self) >= MOST_LAYOUTS:
                self.clear()
            # Times seen, pattern, and the texts by what is empty.
            self[marks] = layout = [0, None, {}]
        layout[0] += 1
        if layout[0] < OFTEN:
            return cut(js, self.fields, self.clean)
        if layout[1] is None:
            layout[1] = own_pattern(js)
        self.last = layout
        return self.filled(layout[2], js, tuple([t for t in tokens if t[-1] not in MARKS]))

    def filled(self, known: dict, js: str, values: tuple) -> str | None:
        """The cut of a record by its values: only which of them are null or an empty string decides what is kept."""
        empty = tuple(map(_EMPTY_KIND, values))
        if empty not in known:
            if len(known) >= MOST_LAYOUTS:
                known.clear()
            known[empty] = self.template(js, empty)
        made = known[empty]
        return made and made[0] % made[1](values)

    def template(self, js: str, empty: tuple) -> tuple | None:
        """The cut with a place for each value, and what picks the values; None when nothing is left."""
        tokens, i = re.findall(WORD, js), 0
        for at, (t, after) in enumerate(zip(tokens, [*tokens[1:], ""], strict=True)):
            if t not in ",:{}[]" and after != ":":
                tokens[at] = t if empty[i] is not None else f"\1{i}\1"  # JSON text holds no bare control character
                i += 1
        text = cut("".join(tokens), self.fields, self.clean)
        if text is None:
            return None
        parts = text.replace("%", "%%").split("\1")
        places = [int(x) for x in parts[1::2]]
        parts[1::2] = ["%s"] * len(places)
        pick = (lambda _: ()) if not places else itemgetter(*places) if len(places) > 1 else lambda values, x=places[0]: (values[x],)
        return "".join(parts), pick


def machine_url(text: str) -> bool:
    """``rules.machine_url`` of one string."""
    if not URL_START.match(text):
        return False
    host, path = URL_HOST.match(text)[1].lower(), URL_PATH.match(text)[1].strip(" ")
    return bool(HOST.search(host) and (API_HOST.search(host) or API_PATH.search(path) or IMAGE.search(path)))


def slots(js: str) -> list[tuple[tuple, str, str, int]]:
    """``(ord, path, apath, index)`` of every leaf, as in ``leaf_values``; the index counts values and is -1 for an empty container."""
    out, above, n = [], [], 0
    array, path, apath, inside, pos, at, start, key, last = True, "", "", False, -1, (), 0, None, ""
    placed = lambda here, i: (*here, *(-1,) * (UNROLLED - len(here)), i - start if len(above) > UNROLLED else 0)
    for i, t in enumerate(re.findall(WORD, js)):
        if t == "," or t == ":":
            continue
        before, last = last, t
        if t == "}" or t == "]":
            frame = above.pop()
            if before == "{" or before == "[":
                out.append((placed(at, i), path, apath, -1))
            array, path, apath, inside, pos, at, start = frame
            continue
        if not array and key is None:
            key = unquoted(t)
            continue
        below, upto, here, pos = path, apath, at, pos + 1
        if not array:
            below = f"{path}.{key}" if path else key
            upto, key = apath if inside else below, None
        if 0 < len(above) <= UNROLLED:
            here = (*at, pos)
        if t == "{" or t == "[":
            above.append((array, path, apath, inside, pos, at, start))
            # The record itself lies in no array.
            inside = inside or (array and len(above) > 1)
            start = i if len(above) == UNROLLED + 1 else start
            array, path, apath, pos, at = t == "[", below, upto, -1, here
        else:
            out.append((placed(here, i), below, upto, n))
            n += 1
    return out


class Layout:
    """What all records of the same keys and brackets share: their paths, each with its places among the values."""

    def __init__(self, leaves: list[tuple[tuple, str, str, int]]):
        self.leaves, self.seen, self.pattern = leaves, 0, None
        self.known: dict[tuple, tuple] = {}

    @cached_property
    def paths(self) -> list[tuple]:
        paths = {}
        for at, path, apath, i in self.leaves:
            first, upto, places = paths.get(path, (at, apath, []))
            paths[path] = min(first, at), min(upto, apath), [*places, i]
        return [(path, *x, prefixes(path)) for path, x in paths.items()]

    @cached_property
    def columns(self) -> tuple[list[str], list[str], list[int]]:
        """Paths, array-free paths and indexes of the leaves in order."""
        return [x[1] for x in self.leaves], [x[2] for x in self.leaves], [x[3] for x in self.leaves]

    def shape(self, filled: tuple[bool, ...]) -> tuple[set, tuple]:
        """Top-most paths without a value, and the filled paths, of a record whose ``paths`` are filled or not."""
        if filled not in self.known:
            if len(self.known) >= MOST_LAYOUTS:
                self.known.clear()
            rows = list(zip(self.paths, filled, strict=True))
            kept = [(path, upto) for (path, _, upto, *_), x in rows if x]
            above = {q for (*_, up), x in rows if x for q in up}
            free = ([q for q in up if q not in above] for (path, *_, up), x in rows if path and not x)
            self.known[filled] = {f[0] for f in free if f}, tuple(sorted(kept))
        return self.known[filled]


class Layouts(dict):
    """Layouts by the keys and brackets of a record's text, so each is walked once."""

    last: Layout | None = None

    def read(self, js: str) -> tuple[Layout, list[str]]:
        """The layout of a record and its values, with a null at the end for empty containers."""
        last = self.last
        if last is not None and last.pattern is not None and (found := last.pattern.fullmatch(js)):
            return last, [*found.groups(), "null"]
        tokens = TOKEN.findall(js)
        marks = "".join([t if t[-1] in MARKS else "\0" for t in tokens])
        if marks not in self:
            if len(self) >= MOST_LAYOUTS:
                self.clear()
            self[marks] = Layout(slots(js))
        self.last = layout = self[marks]
        layout.seen += 1
        if layout.seen == OFTEN:
            layout.pattern = own_pattern(js)
        return layout, [*[t for t in tokens if t[-1] not in MARKS], "null"]


def own_pattern(js: str) -> re.Pattern:
    """Texts with the keys and brackets of ``js``, each value a group."""
    value = r'("(?:[^"\\]++|\\.)*+"|[^\s{}\[\],:"]++)'
    words = re.findall(WORD, js)
    after = [*words[1:], ""]
    return re.compile("".join(re.escape(w) if w in ",:{}[]" or x == ":" else value for w, x in zip(words, after, strict=True)))


def prefixes(path: str) -> list[str]:
    parts = path.split(".")
    return [".".join(parts[:i]) for i in range(1, len(parts) + 1)]


def _merged(parts: list[tuple[Layout, list[str]]]) -> tuple[Layout, list[str]]:
    """Records of one number from payloads of one id, taken as one record."""
    rows = sorted((at, values[i], path, apath) for layout, values in parts for at, path, apath, i in layout.leaves)
    return Layout([(at, path, apath, i) for i, (at, _, path, apath) in enumerate(rows)]), [js for _, js, _, _ in rows]


def profile(payloads: list[list[str] | None], layouts: Layouts) -> tuple | None:
    """``(leaf, tops, shapes)`` over the records of all payloads of one id; None without records.

    A single shape is left out, as only different ones matter.
    """
    lists = [x for x in payloads or () if x]
    alike: dict[Layout, tuple[list[int], list[list[str]]]] = {}
    for n in range(max(map(len, lists), default=0)):
        parts = [layouts.read(x[n]) for x in lists if n < len(x)]
        layout, values = parts[0] if len(parts) == 1 else _merged(parts)
        numbers, rows = alike.setdefault(layout, ([], []))
        numbers.append(n)
        rows.append(values)
    paths, tops, shapes = {}, set(), set()
    for layout, (numbers, rows) in alike.items():
        columns, filled = list(zip(*rows, strict=True)), []
        for path, first, _, places, up in layout.paths:
            if len(places) == 1:
                column = columns[places[0]]
                filled.append([x not in EMPTY for x in column])
                texts = joined = [x for x in column if x not in EMPTY]
                most = 1
            else:
                found = [[x for x in one if x not in EMPTY] for one in zip(*(columns[i] for i in places), strict=True)]
                filled.append([bool(one) for one in found])
                texts, joined = [x for one in found for x in one], [",".join(one) for one in found if one]
                most = max(map(len, found))
            row = paths.get(path)
            if row is None:
                # First seen, prefixes, values, strings, their characters, links, records, smallest and largest values, most values.
                paths[path] = row = [(numbers[0], first), up, 0, 0, 0, 0, 0, None, None, None]
            row[0] = min(row[0], (numbers[0], first))
            if not texts:
                continue
            strings = [unquoted(x) for x in texts if x[0] == '"']
            row[2] += len(texts)
            row[3] += len(strings)
            row[4] += sum(map(len, strings))
            row[5] += sum([machine_url(x) for x in strings if x.startswith("http")])
            row[6] += len(joined)
            if row[7] is not None:
                joined, most = [row[7], row[8], *joined], max(row[9], most)
            row[7:] = min(joined), max(joined), most
        for mask in set(zip(*filled, strict=True)):
            empty, shape = layout.shape(mask)
            tops |= empty
            shapes.add(shape)
    if not paths:
        return None
    leaf = [(path, *row[1:]) for path, row in sorted(paths.items(), key=lambda x: (x[1][0], x[0]))]
    return leaf, sorted(tops), sorted(shapes) if len(shapes) > 1 else []


def _number(text: str) -> Decimal:
    """A number as a VARIANT keeps it: integers exactly, fractions and very long ones to the precision of a double."""
    exact = Decimal(text)
    return exact if exact.as_tuple().exponent == 0 and len(exact.as_tuple().digits) <= 38 else Decimal(repr(float(text)))


def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(parse_float=_number, parse_int=_number)


SAME = "# same in every record: "  # as in ``render``, which tasks can't import


def _filled(node, path: str | None = None) -> list[tuple[str, bool, object]]:
    """``(path, whether it is a boolean, value)`` of every value of a parsed record that isn't empty."""
    if isinstance(node, dict):
        return [x for k, v in node.items() for x in _filled(v, k if path is None else f"{path}.{k}")]
    if isinstance(node, list):
        return [x for v in node for x in _filled(v, path)]
    return [] if node is None or node == "" else [(path, isinstance(node, bool), node)]


def _same_values(line: str, hoisted: list[str], parsed: json.JSONDecoder) -> dict[str, list]:
    """The values that a note declares as the same in every record, by path; an error if it names others."""
    at, found = len(SAME), {}
    for i, path in enumerate(hoisted):
        start = f"{' · ' if i else ''}{path}="
        if not line.startswith(start, at):
            raise ValueError(path)
        value, at = parsed.raw_decode(line, at + len(start))
        found[path] = [x[1:] for x in _filled(value)]
    if at != len(line):
        raise ValueError(line)
    return found


def page_differs(records: list, aliases: dict, row_fields: list[str] | None, hoisted: list[str], page: dict, parsed: json.JSONDecoder) -> bool:
    """Whether a page shows anything that its records don't hold, or leaves a value of its fields out."""
    if page["fallback"]:
        return False
    lines, cap = page["text"].split("\n"), page["cut_cap"]

    def shown(value: tuple) -> tuple:
        path, _, text = value
        if isinstance(text, str):
            text = aliases.get(text, text)
            text = text if cap is None or len(text) <= cap else text[:cap] + "…"
        return path, value[1], text

    covers = (lambda path: True) if row_fields is None else (lambda path: any(path == f or path.startswith(f + ".") for f in row_fields))
    try:
        rows = [_filled(parsed.decode(x)) for x in lines if not x.startswith("#")]
        notes = [x for x in lines if x.startswith(SAME)]
        same = _same_values(notes[0], hoisted, parsed) if notes else {}
    except ValueError:
        return True
    source = records[page["start"]:page["start"] + page["shown"]]
    if len(rows) != len(source) or len(notes) != bool(hoisted):
        return True
    known: dict[str, bool] = {}
    for row, record in zip(rows, source, strict=True):
        for path, _, _ in record:
            if path not in known:
                known[path] = covers(path)
        if Counter(row) != Counter(shown(x) for x in record if known[x[0]]):
            return True
    return any([x[1:] for x in record if x[0] == path] != values for path, values in same.items() for record in records)


def differs_from_source(text: Column, path: Column, aliases: Column, row_fields: Column, hoisted: Column, pages: Column) -> Column:
    """``page_differs`` for each page of a payload, whose records lie in ``text`` below the keys ``path``; false for a missing page."""

    def records(js: str, keys: list[str], parsed: json.JSONDecoder) -> list:
        node = parsed.decode(js)
        for key in keys:
            node = node[key]
        return [_filled(x) for x in node]

    def each(text: pa.Array, path: pa.Array, aliases: pa.Array, row_fields: pa.Array, hoisted: pa.Array, pages: pa.Array) -> pa.Array:
        out, parsed = [], _decoder()
        for js, keys, names, fields, same, two in zip(*(c.to_pylist() for c in (text, path, aliases, row_fields, hoisted, pages)), strict=True):
            source = records(js, keys, parsed)
            out.append([page is not None and page_differs(source, dict(names or ()), fields, same, page, parsed) for page in two])
        return pa.array(out, pa.list_(pa.bool_()))

    return F.arrow_udf(each, "array<boolean>")(text, path, aliases, row_fields, hoisted, pages)


def cut_text(record: Column, fields: list[str] | None, clean: bool = True) -> Column:
    """``cut`` of a VARIANT column to ``fields``, or to all."""

    def each(js: pa.Array) -> pa.Array:
        known = Cuts(None if fields is None else tuple(fields), clean)
        return pa.array([known.text(text) for text in js.to_pylist()], pa.string())

    return F.arrow_udf(each, "string")(F.to_json(record))


def leaf_list(record: Column) -> Column:
    """The leaves of a VARIANT column: ``array<struct<path, apath, js, str>>``."""

    def each(js: pa.Array) -> pa.Array:
        layouts, ends, paths, apaths, values = Layouts(), [0], [], [], []
        for text in js.to_pylist():
            layout, found = layouts.read("null" if text is None else text)
            path, apath, places = layout.columns
            paths += path
            apaths += apath
            values += [found[i] for i in places]
            ends.append(len(values))
        values = [None if x in EMPTY else x for x in values]
        texts = [unquoted(x) if x is not None and x[0] == '"' else None for x in values]
        rows = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (paths, apaths, values, texts)], fields=list(LEAF))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return F.arrow_udf(each, _LEAVES)(F.to_json(record))


def payload_profile(payloads: Column) -> Column:
    """``profile`` of ``array<array<string>>``: the records' texts of all payloads of one id."""

    def each(lists: pa.Array) -> pa.Array:
        layouts = Layouts()
        return pa.array([profile(x, layouts) for x in lists.to_pylist()], PROFILE)

    return F.arrow_udf(each, _PROFILE)(payloads)
