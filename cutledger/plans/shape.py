"""Payload table to budgeted text with every cut declared.

All steps group, join and window on ``payload_id`` first, so the text is shuffled once by
``payload_id`` and everything after it stays in place. A payload is one JSON document, so
no group is larger than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cutledger.functions import jsonfold as jf, jsontasks, jsonwalk as jw
from cutledger.functions.tokens import token_count_sql
from cutledger.operators import counts as ct
from cutledger.operators import discovery as dc
from cutledger.operators import fields as fl
from cutledger.operators import leaves as lv
from cutledger.operators import render as rd

KEY = "payload_id"
# The shortest row, "{}", costs two tokens and its line break (fixed value).
MIN_ROW_COST = 3


def with_options(
    payloads: DataFrame,
    fields: str | list[str] | None = None,
    hoist: bool | None = None,
    offset: int = 0,
    max_tokens: int | None = None,
    counts: list[str] | None = None,
    long_text: int = fl.LONG_TEXT,
    label: str | None = None,
    hint: str | None = None,
) -> DataFrame:
    """Add the options as columns; a column already there wins, which sets it per payload."""
    names = [f for f in fields if f] if isinstance(fields, list) else None
    mode = "auto" if fields == "auto" else "list" if names else "all"
    strings = "array<string>"
    defaults: dict[str, Column] = {
        "o_mode": F.lit(mode),
        "o_fields": F.array(*map(F.lit, names)) if names else F.lit(None).cast(strings),
        "o_offset": F.lit(offset).cast("long"),
        "o_budget": F.lit(max_tokens).cast("long"),
        "o_long_text": F.lit(long_text),
        "o_label": F.lit(label).cast("string"),
        "o_hint": F.lit(hint).cast("string"),
        "o_counts": F.array(*map(F.lit, counts)) if counts else F.lit(None).cast(strings),
    }
    df = payloads.withColumns({k: v for k, v in defaults.items() if k not in payloads.columns})
    if "o_hoist" not in df.columns:
        df = df.withColumn("o_hoist", F.col("o_mode") == "auto" if hoist is None else F.lit(hoist))
    return df


def discover(payloads: DataFrame) -> DataFrame:
    """One shuffle by payload, then parsing and record discovery in place."""
    return dc.find_records(dc.parse_payloads(payloads.repartition(KEY)))


def envelope_of(found: DataFrame) -> DataFrame:
    """One row per payload with everything known before its records are looked at."""
    options = [c for c in found.columns if c.startswith("o_")]
    extra = [c for c in ("aliases", "count_items") if c in found.columns]
    n_total = F.coalesce(F.size("record_list"), F.lit(0)).cast("long")
    return dc.passthrough_reason(found).select(
        KEY, "text", "passthrough", "record_list", *options, *extra,
        n_total.alias("n_total"),
        F.when(F.col("record_list").isNotNull(), F.expr(dc.meta_entries())).alias("meta_list"),
        F.coalesce("o_label", F.try_element_at("record_path", F.lit(-1)), F.lit("records")).alias("label"),
        F.least(F.greatest("o_offset", F.lit(0)), n_total).alias("start"),
        F.col("o_hint").alias("hint"),
    )


def profiled(envelope: DataFrame, *drop: str) -> DataFrame:
    """Add the path profile of the payload's records (``leaf``, ``tops``, ``shapes``) to its row, and leave ``drop`` out.

    Payloads of one id share a profile; those without an id have none, and are kept apart to keep groups small. The rows are
    in place by id, and one group is one document, so nothing is shuffled, joined or sorted beside it.
    """
    rows = envelope.withColumns({"_records": F.transform("record_list", lambda r: F.to_json(r)), "_apart": F.when(F.col(KEY).isNull(), F.xxhash64("text"))})
    kept = [c for c in envelope.columns if c not in (KEY, *drop)]
    same = rows.groupBy(KEY, "_apart").agg(F.collect_list(F.struct("_records", *kept)).alias("same"))
    found = same.withColumn("profile", jsontasks.payload_profile(F.when(F.col(KEY).isNotNull(), F.col("same._records"))))
    return found.select(KEY, "profile", F.explode("same").alias("one")).select(KEY, *(f"one.{c}" for c in kept), "profile.*")


def _added(payloads: DataFrame, found: DataFrame) -> list[str]:
    """Options that are the same for all payloads, which rows needn't carry."""
    return [c for c in found.columns if c.startswith("o_") and c not in payloads.columns]


def counted(found: DataFrame) -> DataFrame:
    """Add the value counts that ``o_counts`` asks for, where the payloads lie."""
    leaves = lv.leaf_values(dc.explode_records(found, KEY, "o_counts"), KEY, "o_counts", "rec_idx")
    wanted = leaves.where(F.array_contains("o_counts", F.col("path")))
    top = ct.value_counts(ct.record_values(wanted, KEY), KEY, "path")
    return found.join(ct.count_items(top), KEY, "left")


def shape_payloads(payloads: DataFrame, use_counts: bool | None = None, **options) -> DataFrame:
    """Shape every payload of ``(payload_id, text)``; one output row per payload.

    Options are those of ``with_options``. A column ``aliases`` (MAP of real id to alias)
    replaces whole string values in the rows. Budgets use the pattern token cost. Anything
    that cannot be handled comes back unchanged with ``passthrough`` set. ``use_counts``
    must be true when ``o_counts`` is given as a column.
    """
    use_counts = bool(options.get("counts")) if use_counts is None else use_counts
    return _fit(decided(payloads, use_counts, **options))


def audited_payloads(payloads: DataFrame, use_counts: bool | None = None, **options) -> DataFrame:
    """``shape_payloads`` with what ``evaluation.audit`` checks a text against, from where the payload lies.

    Adds ``source`` (``text``, ``path`` of the record list, ``aliases``), ``hint``, ``asked`` (the offset that the hint in the text names)
    and ``after``: the page that the payload gives at that offset. Only the rows shown depend on an offset, so that page is fitted
    from the same decisions; rows already rendered are fitted again.
    """
    use_counts = bool(options.get("counts")) if use_counts is None else use_counts
    plan = decided(payloads, use_counts, paths=True, **options)
    rows = _rows(plan, pages=2)
    held = [c for c in rows.columns if c != KEY]
    first = fit_lines(rows.withColumn("_plan", F.struct(*held)), "_plan")
    page = [c for c in first.columns if c not in (KEY, "_plan")]
    form = "concat('(?m)^# [0-9]+ records not shown · \\\\Q', replace(_plan.hint, '{next}', '\\\\E([0-9]+)\\\\Q'), '\\\\E$')"
    asked = F.expr(f"CASE WHEN passthrough IS NULL AND contains(_plan.hint, '{{next}}') THEN try_cast(regexp_extract(text, {form}, 1) AS bigint) END")
    # A hint that doesn't name the first record not shown is wrong, so its page isn't needed.
    leads = F.when(F.col("asked") == F.col("start") + F.col("shown"), F.col("shown").cast("int"))
    again = first.withColumn("asked", asked).select(
        KEY, F.struct(*page, "asked").alias("_page"), leads.alias("_skip"), *(F.col(f"_plan.{c}").alias(c) for c in held if c != "start"),
        F.coalesce(F.col("start") + leads, "_plan.n_total").alias("start"))
    again = again.withColumns({c: F.coalesce(F.slice(c, F.col("_skip") + 1, F.size(c)), F.expr(fl.NO_PATHS)) for c in ("plain", "lines") if c in held})
    aliased = "aliases" in held
    if aliased:
        again = again.withColumn("aliased", F.expr(_ALIASED))
    source = F.struct("text", F.col("o_record_path").alias("path"), *(["aliases"] if aliased else []))
    followed = fit_lines(again.withColumns({"source": source, "o_hint": F.col("hint")}), "_page", "_skip", "o_hint", "source")
    after = F.when(F.col("_skip").isNotNull(), F.struct("start", "shown", "fallback", "cut_cap", "text"))
    return followed.select(KEY, "_page.*", "source", F.col("o_hint").alias("hint"), after.alias("after"))


def decided(payloads: DataFrame, use_counts: bool, beside: DataFrame | None = None, paths: bool = False, **options) -> DataFrame:
    """One row per payload with its fields, notes and options decided, before any row is rendered.

    ``beside`` has one row per payload id and columns named ``o_...``, which come along from where the payloads lie; with ``paths``
    the keys above the record list come along as ``o_record_path``.
    """
    placed = discover(payloads)
    if paths:
        placed = placed.withColumn("o_record_path", F.col("record_path"))
    if beside is not None:
        placed = placed.join(beside, KEY, "left")
    # Options are added after the shuffle, so that counts reuse the same one.
    found = with_options(placed, **options)
    plan = with_options(profiled(envelope_of(counted(found) if use_counts else found), *_added(placed, found)), **options)
    plan = plan.withColumns({
        "meta": F.expr(rd.meta_text()),
        "count_lines": F.expr(ct.COUNT_LINES if use_counts else "cast(NULL AS array<string>)"),
    })
    return fl.decide_fields(plan)


def field_decisions(payloads: DataFrame, **options) -> DataFrame:
    """Fields, constants and field-level cuts per payload, without rendering anything."""
    placed = discover(payloads)
    found = with_options(placed, **options)
    plan = profiled(envelope_of(found), "record_list", "text", "meta_list", *_added(placed, found))
    return fl.decide_fields(with_options(plan, **options))


_REACH = f"CASE WHEN o_budget IS NULL THEN n_total ELSE o_budget div {MIN_ROW_COST} + 1 END"


# How many values of the rendered rows that could fit are short ids.
_MARKS = "aggregate(transform(slice({c}, 1, cast({reach} AS int)), l -> regexp_count(l, '\"@[0-9]+\"')), 0, (a, x) -> a + x)"
_ALIASED = f"cast({_MARKS.format(c='lines', reach=_REACH)} - {_MARKS.format(c='plain', reach=_REACH)} AS bigint)"


def _rows(plan: DataFrame, pages: int = 1) -> DataFrame:
    """Add ``lines``: the rendered rows that could fit, from ``start`` on, for as many pages in a row.

    A row costs at least MIN_ROW_COST, so rows past ``budget / MIN_ROW_COST`` cannot fit and
    are never rendered.
    """
    window = f"slice(record_list, cast(start AS int) + 1, cast(least(n_total, {pages} * ({_REACH})) AS int))"
    line = lambda aliases: f"transform({window}, r -> coalesce({jw.text('r', 'row_fields', aliases)}, '{{}}'))"
    if "aliases" not in plan.columns:
        return plan.withColumns({"lines": F.expr(line(None)), "aliased": F.lit(0).cast("long")})
    return plan.withColumns({"plain": F.expr(line(None)), "lines": F.expr(line("aliases"))}).withColumn("aliased", F.expr(_ALIASED))


def _cost(c: str) -> str:
    return f"({token_count_sql(c)} + length({c}) - length(replace({c}, '\\n', '')))"


def _fit(plan: DataFrame) -> DataFrame:
    return fit_lines(_rows(plan))


def fit_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """Longest prefix of ``lines`` within the budget, then squeeze, cut-to-fit or fallback; ``keep`` columns come along."""
    before, after = rd.static_notes(0)
    costed = rows.withColumns({"notes_0": F.expr(before), "tail_0": F.expr(after)}).withColumn(
        "notes_cost", F.expr(f"CASE WHEN o_budget IS NOT NULL THEN {rd.static_cost()} END"))
    prefix = (
        "aggregate(transform(lines, l -> named_struct('c', {cost} + 1)), "
        "named_struct('used', notes_cost, 'n', 0L, 'fit', 0L), "
        "(s, x) -> CASE WHEN s.used > o_budget THEN s ELSE named_struct('used', s.used + x.c, 'n', s.n + 1, 'fit', "
        "CASE WHEN s.used + x.c + {moving} <= o_budget THEN s.n + 1 ELSE s.fit END) END).fit"
    ).format(cost=token_count_sql("l"), moving=rd.moving_cost("s.n + 1"))
    fitted = costed.withColumn("fitted", F.expr(
        f"CASE WHEN record_list IS NULL THEN 0L WHEN o_budget IS NULL THEN cast(size(lines) AS bigint) ELSE {prefix} END"))
    body = "array_join(slice(lines, 1, cast(fitted AS int)), '\\n')"
    full = f"CASE WHEN fitted > 0 THEN concat_ws('\\n', {rd.head('fitted', 0)}, {body}) ELSE {rd.head('fitted', 0)} END"
    over = lambda c: f"o_budget IS NOT NULL AND {_cost(c)} > o_budget"
    tried = fitted.withColumn("text_0", F.expr(f"CASE WHEN record_list IS NOT NULL THEN {full} END")).withColumn(
        "over_0", F.expr(f"fitted = 0 AND {over('text_0')}")
    ).withColumns({
        "text_1": F.expr(f"CASE WHEN over_0 THEN {rd.head('0L', 1)} END"),
        "text_2": F.expr(f"CASE WHEN over_0 THEN {rd.head('0L', 2)} END"),
        # Only when the next row alone is over budget.
        "row": F.expr("CASE WHEN o_budget IS NOT NULL AND fitted = 0 AND start < n_total THEN try_parse_json(get(lines, 0)) END"),
    }).withColumns({
        "level": F.expr(f"CASE WHEN NOT over_0 THEN 0 WHEN {over('text_1')} THEN 2 ELSE 1 END"),
        "longest": F.expr(f"CASE WHEN row IS NOT NULL THEN cast({jf.longest_string('row')} AS bigint) END"),
        "cut_head": F.expr(f"CASE WHEN row IS NOT NULL THEN {rd.head('1L', 2)} END"),
    })
    # The largest cap that fits, by halving the range of caps.
    note = (
        "CASE WHEN p < longest THEN concat('# record ', start + 1, ' is larger than the budget: text values cut to ', "
        "p, ' characters (longest is ', longest, ')') END"
    )
    halving = (
        "aggregate(sequence(1, 1 + cast(ceil(log2(longest + 2)) AS int)), "
        "named_struct('lo', 0L, 'hi', longest, 'best', cast(NULL AS string), 'cap', cast(NULL AS bigint)), "
        "(s, i) -> CASE WHEN s.lo > s.hi THEN s ELSE element_at(transform(transform(array((s.lo + s.hi) div 2), "
        f"p -> named_struct('p', p, 't', concat_ws('\\n', cut_head, {note}, {jw.text('row', cap='p')}))), "
        f"q -> CASE WHEN {_cost('q.t')} <= o_budget "
        "THEN named_struct('lo', q.p + 1, 'hi', s.hi, 'best', q.t, 'cap', q.p) "
        "ELSE named_struct('lo', s.lo, 'hi', q.p - 1, 'best', s.best, 'cap', s.cap) END), 1) END)"
    )
    cut = tried.withColumn("cut", F.expr(f"CASE WHEN longest IS NOT NULL THEN {halving} END")).withColumn(
        "squeezed", F.expr("CASE level WHEN 0 THEN text_0 WHEN 1 THEN text_1 ELSE text_2 END"))
    fallback = (
        "concat('# ', label, ': showing 0 of ', n_total, '; budget too small', "
        "CASE WHEN hint IS NOT NULL THEN concat(' · ', replace(hint, '{next}', cast(start AS string))) "
        "ELSE ', raise maxTokens' END)"
    )
    done = cut.withColumn("fallback", F.expr(f"passthrough IS NULL AND cut.best IS NULL AND level = 2 AND {over('squeezed')}"))
    done = done.withColumn("shaped", F.expr(
        f"CASE WHEN cut.best IS NOT NULL THEN cut.best WHEN fallback THEN {fallback} ELSE squeezed END"))
    no_gain = F.expr(
        "passthrough IS NULL AND o_mode = 'all' AND o_budget IS NULL AND start = 0 AND length(shaped) >= length(text)")
    done = done.withColumn("passthrough", F.when(no_gain, "no_gain").otherwise(F.col("passthrough")))
    done = done.withColumn("out", F.when(F.col("passthrough").isNotNull(), F.col("text")).otherwise(F.col("shaped")))
    empty_list = F.expr(fl.NO_PATHS)
    result = F.struct(
        "passthrough",
        F.col("out").alias("text"),
        F.col("n_total").alias("records"),
        F.when(F.col("cut.best").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("fitted")).alias("shown"),
        "start", "level", "fallback",
        F.expr("CASE WHEN cut.cap < longest THEN cut.cap END").alias("cut_cap"), "longest", "aliased",
        F.coalesce("count_lines", empty_list).alias("count_lines"),
        F.coalesce(F.transform("constants", lambda c: c["path"]), empty_list).alias("hoisted"),
        "fields", "row_fields", "left_out", "not_in_data", "empty", "ragged",
        F.length("text").cast("long").alias("input_chars"),
        F.length("out").cast("long").alias("output_chars"),
        F.octet_length("text").cast("long").alias("input_bytes"),
        F.octet_length("out").cast("long").alias("output_bytes"),
        F.expr(_cost("text")).cast("long").alias("input_tokens"),
        F.expr(_cost("out")).cast("long").alias("output_tokens"),
        F.col("o_budget").alias("budget"),
    )
    # The generator keeps filters on the result from being rewritten in terms of the rules above.
    return done.select(KEY, *keep, F.inline_outer(F.array(result)))


def manifest(shaped: DataFrame) -> DataFrame:
    """The ledger: one row per cut, ``(payload_id, kind, path, n)``."""
    def listed(kind: str, column: str) -> Column:
        return F.transform(column, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("path"), F.lit(1).cast("long").alias("n")))

    def number(kind: str, n: Column) -> Column:
        row = F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("path"), n.cast("long").alias("n")))
        return F.when(n > 0, row).otherwise(F.array().cast("array<struct<kind:string,path:string,n:bigint>>"))

    cuts = F.concat(
        listed("hoisted", "hoisted"), listed("empty", "empty"), listed("left_out", "left_out"),
        listed("not_in_data", "not_in_data"),
        number("rows_cut", F.col("records") - F.col("start") - F.col("shown")),
        number("counts_cut", F.when((F.col("level") == 2) | F.col("fallback"), F.size("count_lines")).otherwise(0)),
        number("text_cut", F.when(F.col("cut_cap").isNotNull(), F.col("longest") - F.col("cut_cap")).otherwise(0)),
        number("aliased", F.col("aliased")),
    )
    return shaped.where("passthrough IS NULL").select(KEY, F.explode(cuts).alias("cut")).select(
        KEY, "cut.kind", "cut.path", "cut.n")
