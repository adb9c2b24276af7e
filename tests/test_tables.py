"""Skew, recovery, sources and frames on small tables, against plain Python."""

import json
import random

from pyspark.sql import functions as F

from cutledger.operators import budget, frame, ids, recover
from cutledger.operators.positions import first_positions, group_positions
from cutledger.sources import pages as pg, views
from cutledger.sources.payloads import archive, read_payloads


def test_positions_in_a_hot_group(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 900)
    rows = [("hot" if i % 3 else f"g{i % 50}", k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "g string, k bigint")
    expected = {(g, k): sorted(x for h, x in rows if h == g).index(k) for g, k in rows}
    assert {(r.g, r.k): r.pos for r in group_positions(df, ["g"], "k", block=100).collect()} == expected
    firsts = {(r.g, r.k): r.pos for r in first_positions(df, ["g"], "k", 5, salts=4).collect()}
    assert firsts == {gk: p for gk, p in expected.items() if p < 5}


def test_payloads_are_dealt_as_rows(spark):
    """Records are made behind the last shuffle, of rows that may have any column names."""
    rows = [("a" if i % 3 else "b", i * 7 % 40, f"v{i}") for i in range(40)] + [(None, 1, "lost")]
    df = spark.createDataFrame(rows, "g string, k bigint, pos string")
    packed = views.pack(df, "g", "k", 4, F.struct("k", F.concat(F.lit("made-"), "pos").alias("group_rows")))
    placed, below = packed._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)
    assert "made-" in placed and "made-" not in below
    expected = {}
    for g in "ab":
        records = sorted((k, f"made-{v}") for h, k, v in rows if h == g)
        expected |= {f"{g}/{i // 4}": records[i:i + 4] for i in range(0, len(records), 4)}
    found = {r.payload_id: json.loads(r.text) for r in packed.collect()}
    assert {p: [(x["k"], x["group_rows"]) for x in t["items"]] for p, t in found.items()} == expected
    assert all(t["total_count"] == len(expected[p]) for p, t in found.items())


def test_a_task_reads_little_of_a_table(spark):
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"


def test_budget_pack_is_the_longest_prefix(spark):
    rng = random.Random(2)
    costs = {g: [rng.randint(1, 30) for _ in range(40)] for g in "abc"}
    df = spark.createDataFrame([(g, i, c) for g, cs in costs.items() for i, c in enumerate(cs)], "g string, i bigint, c bigint")
    got = {r.g: r.n for r in budget.budget_pack(df, "g", "i", "c", 200, 10).groupBy("g").agg(F.count("*").alias("n")).collect()}
    for g, cs in costs.items():
        used, n = 10, 0
        for c in cs:
            used += c + 1
            if used > 200:
                break
            n += 1
        assert got[g] == n


def test_alias_numbers_are_stable_when_ids_arrive(spark):
    first = spark.createDataFrame([("s", "ch_3NxQ8kLm2pZ9", 1), ("s", "plain words", 2)], "session_id string, value string, seen bigint")
    later = spark.createDataFrame([("s", "cus_AbCdEf123456", 3), ("s", "ch_3NxQ8kLm2pZ9", 4)], "session_id string, value string, seen bigint")
    one = ids.assign_aliases(ids.alias_candidates(first))
    two = ids.assign_aliases(ids.alias_candidates(later), one)
    numbers = {r.value: r.alias_no for r in two.collect()}
    assert numbers == {"ch_3NxQ8kLm2pZ9": 1, "cus_AbCdEf123456": 2}
    args = spark.createDataFrame([("s", a) for a in ("@1", "@2", "@99", "see @1", "#1", "@01")], "session_id string, argument string")
    restored = {r.argument: r.restored for r in ids.restore_aliases(args, two).collect()}
    assert restored == {"@1": "ch_3NxQ8kLm2pZ9", "@2": "cus_AbCdEf123456", "@99": "@99", "see @1": "see @1", "#1": "#1", "@01": "@01"}


def test_recovery_rules_in_order(spark):
    regs = spark.sql("""SELECT 's' AS session_id, timestamp'2026-01-01 00:00:00' AS ts, 'github' AS adapter,
        map('owner', 'acme', 'repo', 'api') AS scope, array('title', 'body') AS allowed, array('body') AS redacted""")
    cases = {
        "1": ("00:05:00", "github", "api", ["title"], None),
        "2": ("00:05:00", "jira", "api", ["title"], "recovery adapter mismatch: expected github, got jira"),
        "3": ("00:05:00", "github", "vault", ["title"], "scope mismatch for repo: expected api, got vault"),
        "4": ("00:05:00", "github", "api", ["title", "body"], "field 'body' is permanently redacted by policy and cannot be recovered"),
        "5": ("00:05:00", "github", "api", ["reactions"], "field 'reactions' is not in the allowed recovery field list"),
        "6": ("00:10:00", "github", "api", ["title"], "session not found or expired"),
        "7": ("00:00:00", "github", "api", ["title"], None),
    }
    rows = [(k, "s", f"2026-01-01 {t}", a, {"owner": "acme", "repo": r}, f) for k, (t, a, r, f, _) in cases.items()]
    rows.append(("8", "other", "2026-01-01 00:00:01", "github", {}, ["title"]))
    reqs = spark.createDataFrame(rows, "request_id string, session_id string, ts string, adapter string, scope map<string,string>, fields array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.request_id: r.reason for r in recover.validate_recovery(reqs, regs).collect()}
    assert got == {**{k: v[4] for k, v in cases.items()}, "8": "session not found or expired"}


def test_recover_pages_and_errors(spark):
    body = json.dumps([{"id": i, "name": f"n{i}", "note": "x " * 101} for i in (1, 2, 3)])
    stored = archive(spark.createDataFrame([("s", 1, "t", "[]"), ("s", 2, "t", body)], "session_id string, arrival bigint, tool string, text string"), keep=1)
    assert [r.handle for r in stored.collect()] == ["r2"]
    reqs = spark.createDataFrame([
        (1, "s", "r2", 2, None, None), (2, "s", "r2", 0, ["*"], None), (3, "s", "r1", 0, None, None), (4, "s", "r2", -1, None, None),
        (5, "s", "r2", 0, ["id", "note"], 256)], "request_id bigint, session_id string, handle string, offset bigint, fields array<string>, budget_tokens bigint")
    got = {r.request_id: r for r in recover.recover(reqs, stored).collect()}
    assert '{"id":3,"name":"n3"}' in got[1].text and got[1].start == 2
    assert '"note":"x x' in got[2].text and got[2].shown == 3
    assert got[3].error == recover.UNKNOWN and got[4].error == recover.INVALID
    assert got[5].next_offset == got[5].shown < 3 and f"offset={got[5].shown}" in got[5].text


def test_details_of_three_sources(spark):
    one = lambda js: spark.range(1).select(F.parse_json(F.lit(js)).alias("rec"))
    detail = lambda js, source, fields: json.loads(pg.detail_projection(one(js), source, fields).collect()[0].detail)
    issue = '{"number":7,"labels":[{"name":"bug","id":1},"x"],"milestone":{"title":"v1","id":3},"reactions":{"+1":2},"assignee":null}'
    assert detail(issue, "github", ["labels", "milestone", "reactions", "assignee", "body"]) == {
        "number": 7, "labels": ["bug", "x"], "milestone": {"title": "v1", "state": None}, "assignee": None, "body": None,
        "reactions": {"total_count": 0, "+1": 2, "-1": 0, "laugh": 0, "hooray": 0, "confused": 0, "heart": 0, "rocket": 0, "eyes": 0}}
    ticket = '{"key":"A-1","fields":{"summary":"s","status":{"name":"Open","id":1},"comment":{"comments":[{"body":"hi"}]}}}'
    assert detail(ticket, "jira", ["summary", "status", "comments", "priority"]) == {
        "key": "A-1", "summary": "s", "status": {"name": "Open"}, "comments": [{"author": "unknown", "body": "hi", "created": ""}], "priority": None}
    assert detail('{"id":"9","properties":{"name":"Acme"}}', "hubspot", ["name", "city"]) == {"id": "9", "properties": {"name": "Acme", "city": None}}


def test_frame_text_matches_payload_text(spark):
    rows = spark.sql("""SELECT 1 AS id, named_struct('a', '', 'b', 2) AS s, array(named_struct('x', 'p', 'y', 1), named_struct('x', '', 'y', CAST(NULL AS INT))) AS l
        UNION ALL SELECT 2, named_struct('a', '', 'b', CAST(NULL AS INT)), array(named_struct('x', '', 'y', CAST(NULL AS INT)))""")
    lines = {r.id: r.line for r in rows.select("id", frame.row_text(rows).alias("line")).collect()}
    assert lines == {1: '{"id":1,"s":{"b":2},"l":[{"x":"p","y":1},null]}', 2: '{"id":2}'}
    flat = rows.select(F.struct(F.lit("x\ty").alias("b")).alias("a"), F.array(F.lit(1), F.lit(2)).alias("c"), F.lit("line1\nline2\\").alias("d"))
    assert frame.tsv_header(flat) == "a.b\tc\td"
    assert flat.select(frame.tsv_line(flat).alias("x")).first().x == "x\\ty\t[1,2]\tline1\\nline2\\\\"


def test_read_payloads_keeps_copies_apart(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([('[{"a":1}]',)] * 3, "value string").coalesce(1).write.text(path)
    got = read_payloads(spark, path, "lines").collect()
    assert len(got) == 3 and len({r.payload_id for r in got}) == 3
    assert read_payloads(spark, path, "text").count() == 1
