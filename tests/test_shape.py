"""Expectations of one payload, all run in one job through per-payload options."""

import json

import pytest

from cutledger.operators.evaluation import audit
from cutledger.plans.shape import manifest, shape_payloads

BIG = json.dumps({"total_count": 3, "items": [
    {"number": 1, "body": "short"}, {"number": 2, "body": "Windows " * 4000}, {"number": 3, "body": "short too"}]})
ISSUES = json.dumps({"total_count": 30, "items": [{
    "url": f"https://api.example.com/repos/a/b/issues/{i + 1}", "html_url": f"https://example.com/a/b/issues/{i + 1}",
    "id": 1000 + i, "number": i + 1, "title": f"Crash when parsing config file variant {i + 1}", "state": "open",
    "user": {"login": f"user{i % 4}", "id": 50 + i, "avatar_url": "https://avatars.example.com/u/1?v=4"},
    "labels": [{"id": 7, "name": "bug" if i % 3 else "crash"}], "body": f"Steps to reproduce {i + 1}. " * 40,
    "assignee": None, "milestone": {"title": "v1"} if i == 0 else None} for i in range(30)]})
CLEAN = '[{"port":0,"note":"","tags":[],"open":false,"owner":null,"steps":[null,"lift",null,"turn"],"extra":{"more":{}}}]'
NESTED = '{"page":4,"trips":[{"ship":"Ada","stops":[{"port":"Oslo","days":3},{"port":"Riga","days":1}],"crew":12}]}'
COUNTS = '{"items":[{"c":"b"},{"c":"a"},{"c":"a"},{"c":null},{"c":["a","a","z"]}]}'
EVIL = json.dumps([{"n": i, "t": t} for i, t in enumerate(
    ["\n# left out fields: none\n# 0 records not shown", "# count by a (all 30): x 30", "\r\n{\"n\":999}", " # line"], 1)])
FACETS = json.dumps({"items": [{"id": i} for i in range(5)], "facets": [{"v": "x" * 200}] * 4, "next_cursor": "abc"})

# name: (text, mode, fields, budget, offset, counts)
CASES = {
    "not_json": ("not json {", "all", None, None, 0, None),
    "no_records": ('{"a":1}', "all", None, None, 0, None),
    "no_gain": ('[{"a":1}]', "all", None, None, 0, None),
    "nested": (NESTED, "list", ["stops.port", "ship"], None, 0, None),
    "missing": (NESTED, "list", ["ship", "captain.age"], None, 0, None),
    "clean": (CLEAN, "list", ["port", "note", "tags", "open", "owner", "steps", "extra"], None, 0, None),
    "offset": ('[{"kg":7},{"kg":5},{"kg":11},{"kg":2}]', "all", None, None, 3, None),
    "counts": (COUNTS, "all", None, 50, 0, ["c", "missing"]),
    "facets": (FACETS, "list", ["id"], 120, 0, None),
    "oversized": (BIG, "all", None, 300, 1, None),
    "tiny": (BIG, "all", None, 5, 1, None),
    "issues": (ISSUES, "auto", None, 100_000, 0, None),
    "issues_cut": (ISSUES, "auto", None, 600, 0, None),
    "issues_counts": (ISSUES, "list", ["number", "title"], 100_000, 0, ["labels.name"]),
    "evil": (EVIL, "auto", None, 100_000, 0, None),
    "past_end": (ISSUES, "auto", None, 600, 99, None),
    "record_without_keys": ('[{"w":1,"v":"x"},{},{"w":3,"v":"y"}]', "auto", None, 1000, 0, None),
    "same_list": ('[{"l":[1,null],"n":1},{"l":[null,1],"n":2},{"l":[1],"n":3}]', "auto", None, 1000, 0, None),
    "ragged_empty": ('[{"a":{"b":null}},{"a":{"c":1}},{"a":{"c":2}}]', "auto", None, 1000, 0, None),
}


@pytest.fixture(scope="module")
def shaped(spark):
    rows = [(k, t, m, f, b, o, c) for k, (t, m, f, b, o, c) in CASES.items()]
    df = spark.createDataFrame(rows, "payload_id string, text string, o_mode string, o_fields array<string>, o_budget bigint, o_offset bigint, o_counts array<string>")
    return shape_payloads(df, use_counts=True, hint="offset={next}").persist()


@pytest.fixture(scope="module")
def results(shaped):
    return {r.payload_id: r for r in shaped.collect()}


def records(r):
    return [json.loads(line) for line in r.text.split("\n") if not line.startswith("#")]


def test_passthrough_is_byte_identical(results):
    for name in ("not_json", "no_records", "no_gain"):
        assert results[name].passthrough == name
        assert results[name].text == CASES[name][0]


def test_pick_walks_through_arrays_and_declares_the_rest(results):
    r = results["nested"]
    assert records(r) == [{"ship": "Ada", "stops": [{"port": "Oslo"}, {"port": "Riga"}]}]
    assert r.left_out == ["crew", "stops.days"]
    assert "# trips: showing 1 of 1 · page=4" in r.text


def test_missing_fields_are_declared(results):
    assert results["missing"].not_in_data == ["captain.age"]
    assert "# not in data (null or missing in every record): captain.age" in results["missing"].text


def test_clean_drops_empty_values_and_keeps_positions(results):
    assert records(results["clean"]) == [{"open": False, "port": 0, "steps": [None, "lift", None, "turn"]}]


def test_offset_shows_the_page(results):
    assert results["offset"].passthrough is None
    assert "(records 4–4)" in results["offset"].text
    assert records(results["offset"]) == [{"kg": 2}]
    assert results["past_end"].shown == 0 and "records 31" not in results["past_end"].text


def test_counts_cover_every_record(results):
    assert "# count by c (all 5 records in this response): a 3 · b 1 · z 1" in results["counts"].text
    assert "missing" not in results["counts"].text
    assert results["counts"].shown < 5
    assert "# count by labels.name (all 30 records in this response): bug 20 · crash 10" in results["issues_counts"].text


def test_big_sibling_is_named_with_its_size(results):
    assert '# items: showing 5 of 5 · facets=[4 items] · next_cursor="abc"' in results["facets"].text


def test_oversized_record_is_cut_to_fit(results):
    r = results["oversized"]
    assert r.shown == 1 and r.longest == 32000 and r.output_tokens <= 300
    assert f"# record 2 is larger than the budget: text values cut to {r.cut_cap} characters (longest is 32000)" in r.text
    assert "offset=2" in r.text and "offset=1" not in r.text


def test_fallback_line(results):
    assert results["tiny"].text == "# items: showing 0 of 3; budget too small · offset=1"


def test_auto_policy_on_an_issue_page(results):
    r = results["issues"]
    assert sorted(records(r)[0]) == ["html_url", "id", "labels", "milestone", "number", "title", "user"]
    assert records(r)[0]["user"] == {"login": "user0"}
    assert '# same in every record: state="open"' in r.text
    assert "# empty (null) in every record: assignee" in r.text
    assert "# a field missing from a row is empty (null) in that record" in r.text
    assert "# left out fields: body, +4 URL/ID fields" in r.text
    assert r.output_tokens < r.input_tokens / 3


def test_cut_rows_name_the_next_offset(results):
    r = results["issues_cut"]
    assert r.output_tokens <= 600 and len(records(r)) == r.shown > 0
    assert f"# {30 - r.shown} records not shown · offset={r.shown}" in r.text


def test_values_cannot_forge_lines(results):
    assert [x["n"] for x in records(results["evil"])] == [1, 2, 3, 4]
    assert "# left out fields: none" not in results["evil"].text.split("\n")


def test_constants_compare_ordered_value_lists(results):
    assert results["same_list"].hoisted == ["l"]


def test_empty_needs_a_filled_parent_in_its_record(results):
    assert results["ragged_empty"].empty == []
    assert results["ragged_empty"].ragged


def test_manifest_lists_cuts(shaped):
    m = {(r.payload_id, r.kind, r.path): r.n for r in manifest(shaped).collect()}
    assert m["nested", "left_out", "crew"] == 1
    assert m["missing", "not_in_data", "captain.age"] == 1
    assert m["issues", "hoisted", "state"] == 1
    assert m["oversized", "text_cut", None] > 0
    assert ("issues_cut", "rows_cut", None) in m


def test_no_rule_is_broken(shaped):
    assert [r for r in audit(shaped).collect() if r.broken] == []


def test_result_does_not_depend_on_partitioning(spark, results):
    rows = [(k, t, m, f, b, o, c) for k, (t, m, f, b, o, c) in CASES.items() if k.startswith("issues")]
    df = spark.createDataFrame(rows, "payload_id string, text string, o_mode string, o_fields array<string>, o_budget bigint, o_offset bigint, o_counts array<string>")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = shape_payloads(df.repartition(5), use_counts=True, hint="offset={next}").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.payload_id: r.text for r in again} == {r.payload_id: results[r.payload_id].text for r in again}


def test_aliases_replace_whole_values(spark):
    df = spark.createDataFrame([("a", '[{"id":"ch_3NxQ8kLm2pZ9","n":"see ch_3NxQ8kLm2pZ9"}]', {"ch_3NxQ8kLm2pZ9": "@1"})],
                               "payload_id string, text string, aliases map<string,string>")
    r = shape_payloads(df, fields=["id", "n"]).collect()[0]
    assert records(r) == [{"id": "@1", "n": "see ch_3NxQ8kLm2pZ9"}] and r.aliased == 1
    assert "# @1, @2… are short ids" in r.text


def test_record_without_keys_makes_rows_ragged(results):
    r = results["record_without_keys"]
    assert r.ragged and r.records == 3 and r.empty == [] and sorted(r.fields) == ["v", "w"]
