"""Calls end to end: what is shaped, what stays, what a handle gives back."""

import json

import pytest
from pyspark.sql import functions as F

from cutledger.functions.requests import request_problem
from cutledger.functions.tokens import token_count
from cutledger.operators.frame import path_values, pick_columns
from cutledger.plans.calls import call_archive, call_results, handles, recover_views
from cutledger.sources.pages import detail_projection

DEPOTS = json.dumps({"depots": [
    {"no": i, "town": f"Town {i}", "kind": "yard", "report": f"Day {i} passed without news. " * 30} for i in range(1, 25)]})
SHORT = json.dumps({"depots": [{"no": i, "town": f"T{i}"} for i in range(1, 101)], "pages": 1})
SAME = json.dumps({"depots": [{"no": i, "kind": "yard", "state": "open"} for i in range(1, 101)]})
DENSE = '[{"k":1},{"k":2}]'
# call: (id, session, arrival, tool, text, structured, has_schema, is_error)
CALLS = [
    ("failed", "s", 1, "list", DEPOTS, None, None, True),
    ("skipped", "s", 2, "quiet", DEPOTS, DEPOTS, False, None),
    ("prose", "s", 3, "list", "all is well", None, None, False),
    ("object", "s", 4, "list", '{"fine":true}', None, None, False),
    ("dense", "s", 5, "list", DENSE, DENSE, False, False),
    ("schema", "s", 6, "list", DEPOTS, DEPOTS, True, False),
    ("unknown_schema", "s", 7, "list", DEPOTS, DEPOTS, None, False),
    ("other_copy", "s", 8, "list", DEPOTS, '{"sum":24}', False, False),
    ("copy", "s", 9, "list", DEPOTS, json.dumps(json.loads(DEPOTS), indent=2), False, False),
    ("tight", "s", 10, "tight", DEPOTS, None, None, False),
    ("rows", "t", 1, "rows", SHORT, None, None, False),
    ("all_rows", "t", 2, "all_rows", SHORT, None, None, False),
    ("same", "t", 4, "list", SAME, None, None, False),
    ("nothing", "t", 3, "list", None, None, None, False),
]
CALL_COLUMNS = "payload_id string, session_id string, arrival bigint, tool string, text string, structured string, has_schema boolean, is_error boolean"
# policy: (tool, fields, counts, budget, long text, skip)
POLICIES = [("quiet", None, None, None, None, True), ("tight", ["no", "town"], None, 256, None, None),
            ("rows", None, None, 300, None, None), ("all_rows", [], None, 100_000, None, None)]
POLICY_COLUMNS = "tool string, fields array<string>, counts array<string>, budget_tokens bigint, long_text_chars int, skip boolean"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(CALLS, CALL_COLUMNS), spark.createDataFrame(POLICIES, POLICY_COLUMNS)


@pytest.fixture(scope="module")
def results(tables):
    rows = call_results(*tables).withColumn("cost", token_count("text") + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).collect()
    assert len(rows) == len(CALLS)
    return {r.payload_id: r for r in rows}


def records(text):
    return [json.loads(line) for line in text.split("\n") if not line.startswith("#")]


def test_what_is_left_alone(results):
    calls = {c[0]: c for c in CALLS}
    expected = {"failed": "error", "skipped": "skip", "prose": "not_json", "object": "no_records", "dense": "no_gain", "all_rows": "no_gain", "schema": "structured",
                "unknown_schema": "structured", "other_copy": "structured", "nothing": "not_json"}
    for name, outcome in expected.items():
        r = results[name]
        assert (r.outcome, r.text, r.structured) == (outcome, calls[name][4], calls[name][5]), name


def test_a_copy_is_dropped_only_when_its_text_is_shaped(results):
    r = results["copy"]
    assert r.outcome == "shaped" and r.structured is None and r.tokens_after < r.tokens_before
    assert '# same in every record: kind="yard"' in r.text and "# left out fields: report" in r.text


def test_handles_count_results_with_records(results):
    assert {n: r.handle for n, r in results.items() if r.handle} == {"dense": "r1", "copy": "r2", "tight": "r3", "rows": "r1", "all_rows": "r2", "same": "r3"}


def test_receipt_fits_the_budget_and_names_the_next_offset(results):
    for name, budget in (("tight", 256), ("rows", 300)):
        r = results[name]
        assert r.text.startswith('# handle="') and r.cost == r.tokens_after <= budget
        assert 0 < r.shown == len(records(r.text)) == r.next_offset < r.records
        assert f'handle="{r.handle}" and offset={r.shown}' in r.text


def test_no_receipt_when_nothing_is_left_out(results):
    r = results["same"]
    assert (r.outcome, r.shown, r.next_offset) == ("shaped", 100, None) and "handle=" not in r.text


def test_results_do_not_depend_on_partitioning(spark, tables, results):
    calls, policies = tables
    again = call_results(calls.repartition(7), policies).collect()
    assert {r.payload_id: (r.text, r.handle) for r in again} == {n: (r.text, r.handle) for n, r in results.items()}


def test_empty_calls(spark, tables):
    assert call_results(tables[0].limit(0), tables[1]).count() == 0


@pytest.fixture(scope="module")
def recovered(spark, tables, results):
    asks = [("next", "s", "r3", results["tight"].next_offset, None, None), ("again", "s", "r3", results["tight"].next_offset, None, None),
            ("field", "s", "r2", None, ["no", "report"], 2000), ("every", "t", "r1", 98, ["*"], None), ("small", "s", "r1", 1, None, None),
            ("wider", "s", "r3", 0, None, 4000), ("gone", "s", "r9", 0, None, None), ("below", "s", "r3", -1, None, None),
            ("poor", "s", "r3", 0, None, 255), ("blank", "s", "r3", 0, [""], None), ("no_handle", "s", None, 0, None, None)]
    requests = spark.createDataFrame(asks, "request_id string, session_id string, handle string, offset bigint, fields array<string>, budget_tokens bigint")
    rows = recover_views(requests, call_archive(*tables), tables[1]).collect()
    assert len(rows) == len(asks)
    return {r.request_id: r for r in rows}


def test_recovery_pages_under_the_policy_of_the_tool(results, recovered):
    first, r = results["tight"], recovered["next"]
    assert r.error is None and r.start == first.next_offset and list(records(r.text)[0]) == ["no", "town"]
    assert f"(records {r.start + 1}–{r.start + r.shown})" in r.text and records(r.text)[0]["no"] == r.start + 1
    assert recovered["again"].text == r.text
    assert recovered["wider"].shown == 24 and recovered["wider"].next_offset is None


def test_paging_shows_every_record_once(spark, tables, results):
    archive, seen, at = call_archive(*tables), records(results["tight"].text), results["tight"].next_offset
    for _ in range(24):
        if at is None:
            break
        ask = spark.createDataFrame([("q", "s", "r3", at, None, None)], "request_id string, session_id string, handle string, offset bigint, fields array<string>, budget_tokens bigint")
        r = recover_views(ask, archive, tables[1]).first()
        seen, at = seen + records(r.text), r.next_offset
    assert [x["no"] for x in seen] == list(range(1, 25))


def test_left_out_fields_and_small_originals_come_back(recovered):
    assert records(recovered["field"].text)[0] == {"no": 1, "report": json.loads(DEPOTS)["depots"][0]["report"]}
    assert records(recovered["every"].text) == [{"no": 99, "town": "T99"}, {"no": 100, "town": "T100"}]
    assert records(recovered["small"].text) == [{"k": 2}]


def test_bad_requests_are_rows_with_an_error(recovered):
    assert recovered["gone"].error == "unknown or expired handle"
    for name in ("below", "poor", "blank", "no_handle"):
        assert recovered[name].error == "invalid arguments" and recovered[name].text is None


def test_paths_into_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, map('x', named_struct('p', 1, 'q', 2)) AS n")
    row = df.select(path_values(df, "m.a").alias("a"), path_values(df, "m.c").alias("c"), path_values(df, "n.x.q").alias("q"), *pick_columns(df, ["m.b"])).first()
    assert (row.a, row.c, row.q, row.m) == ([1], [], [2], {"b": 2})


def test_property_names_may_hold_any_character(spark):
    name = "o'x \\\" $.a"
    df = spark.createDataFrame([(json.dumps({"id": "7", "properties": {name: 1, "plain": None}}),)], "js string").select(F.try_parse_json("js").alias("rec"))
    detail = detail_projection(df, "hubspot", [name, "plain", "none"]).first().detail
    assert json.loads(detail) == {"id": "7", "properties": {name: 1, "plain": None, "none": None}}
    with pytest.raises(ValueError):
        detail_projection(df, "jira", ["summary'"])


def test_first_broken_rule_of_a_request(spark):
    cases = [("hubspot_search", '{"object_type":"deals","budget_tokens":8193}', "budget_tokens"), ("hubspot_search", '{"object_type":"deals","extra":1}', None),
             ("jira_get_issue", "not json", "args"), ("jira_get_issue", None, "args"), ("other", "{}", "form"), (None, "{}", "form"),
             ("jira_get_issue", "{}", "issue_key"), ("github_get_issue", '{"owner":"a","repo":"b","issue_number":true,"fields":["body"]}', "issue_number")]
    df = spark.createDataFrame(cases, "form string, args string, problem string")
    assert [r.got for r in df.select(request_problem(F.col("form"), F.col("args")).alias("got")).collect()] == [c[2] for c in cases]


def test_handles_shuffle_no_text(spark):
    views = spark.createDataFrame([("a", "s", 2, '[{"n":1}]'), ("b", "s", 1, '[{"n":1}]'), ("c", "s", 0, "no records")], "payload_id string, session_id string, arrival long, text string")
    numbered = handles(views)
    assert "REPARTITION" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert {r.payload_id: r.handle for r in numbered.collect()} == {"a": "r2", "b": "r1"}
