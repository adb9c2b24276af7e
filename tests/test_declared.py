"""Segmented positions and sums, and declared frames, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cutledger.operators import prefix
from cutledger.plans import declared, shape


@pytest.mark.parametrize("rows", [20, 100_000])
def test_positions_and_sums_in_a_hot_group(spark, rows):
    rng = random.Random(5)
    keys = rng.sample(range(-(10**12), 10**12), 500)  # sparse, so equal steps of the key would hold a row each
    made = [("hot" if i % 3 else (None if i % 2 else f"g{i % 7}"), k, rng.randrange(9)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(made, "g string, k long, c int")
    placed = prefix.positions(df, ["g"], "k", rows=rows)
    assert (placed.select("_segment").distinct().count() > 10) == (rows == 20)
    assert placed.where("g = 'hot'").groupBy("_segment").count().agg(F.max("count")).first()[0] <= max(60, rows)
    got = {(r["g"], r["k"]): (r["pos"], r["used"]) for r in prefix.running_sum(placed, ["g"], "c", "used").collect()}
    want = {}
    for g in {g for g, _, _ in made}:
        used = 0
        for pos, (k, c) in enumerate(sorted((k, c) for h, k, c in made if h == g)):
            used += c
            want[(g, k)] = (pos, used)
    assert got == want


def exchanged(df):
    """Rows that the shuffles of a plan that has run moved, without those that went to broadcasts."""
    def below(node):
        held = [node.metrics().apply("shuffleRecordsWritten").value()] if node.nodeName() == "Exchange" else []
        if node.nodeName() == "AdaptiveSparkPlan":
            return below(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return below(node.plan())
        kids = node.children()
        return held + [n for i in range(kids.size()) for n in below(kids.apply(i))]

    df.collect()
    return sum(below(df._jdf.queryExecution().executedPlan()))


def test_positions_in_reach_move_the_rows_of_their_segments_only(spark):
    made = [("hot" if i % 3 else None, (i * 7919) % 5003) for i in range(5000)]
    df = spark.createDataFrame(made, "g string, k long")
    reach = [(0, 0), (900, 940), (10**9, 10**9)]
    near = prefix.positions(df, ["g"], "k", 50, reach)
    want = {(g, k, pos) for g in ("hot", None) for pos, k in enumerate(sorted(k for h, k in made if h == g)) if pos == 0 or 900 <= pos <= 940}
    assert {(r["g"], r["k"], r["pos"]) for r in near.collect()} == want
    assert exchanged(near) < 500 < exchanged(prefix.positions(df, ["g"], "k", 50))
    # Too many segments for a broadcast are joined.
    sent = prefix.broadcast_few.__defaults__
    prefix.broadcast_few.__defaults__ = (0,)
    try:
        assert {(r["g"], r["k"], r["pos"]) for r in prefix.positions(df, ["g"], "k", 50, reach).collect()} == want
    finally:
        prefix.broadcast_few.__defaults__ = sent
    assert prefix.positions(df.limit(0), ["g"], "k", 50, reach).collect() == []


def test_segments_by_halving(spark):
    bounds = [-5, 0, 3, 4, 9, 12, 40]
    got = spark.range(-10, 60).select("id", prefix.segment_of(F.col("id"), bounds).alias("s")).collect()
    assert [r["s"] for r in got] == [sum(b <= r["id"] for b in bounds) for r in got]
    assert spark.range(1).select(prefix.segment_of(F.lit(None).cast("long"), bounds)).first()[0] == 0


SCHEMA = "g string, id long, name string, tags array<string>, part struct<size:int, ref_id:string>, gone string, kind string"


def rows_of(n, g, text="n"):
    return [(g, 7 * i, f"{text}{i}", ["a", ""] if i % 2 else None, (i, f"r{i}"), "", "k") for i in range(n)]


def views(df, budget, **how):
    return {r["payload_id"]: r for r in declared.declare(df, ["g"], "id", budget, segment_rows=4, **how).collect()}


def body(view):
    return [json.loads(x) for x in view["text"].split("\n") if not x.startswith("#")]


def test_declared_frame(spark):
    df = spark.createDataFrame(rows_of(9, "a") + rows_of(2, "b") + rows_of(4, None), SCHEMA)
    got = views(df, 2000, hint="offset={next}")
    assert {k: (v["records"], v["shown"]) for k, v in got.items()} == {"a": (9, 9), "b": (2, 2), "null": (4, 4)}
    a = got["a"]
    assert (a["hoisted"], a["left_out"], a["empty"], a["ragged"]) == (["kind"], ["part.ref_id"], ["gone"], True)
    assert "# same in every record: kind=\"k\"" in a["text"] and got["b"]["hoisted"] == []
    assert body(a)[1] == {"id": 7, "name": "n1", "tags": ["a", None], "part": {"size": 1}}
    assert body(got["b"])[0] == {"id": 0, "name": "n0", "part": {"size": 0}, "kind": "k"}
    cut = {(r["kind"], r["path"]) for r in shape.manifest(declared.declare(df, ["g"], "id", 100)).where("payload_id = 'a'").collect()}
    assert {("hoisted", "kind"), ("left_out", "part.ref_id"), ("empty", "gone"), ("rows_cut", None)} <= cut


def test_pages_of_a_declared_frame_show_each_row_once(spark):
    df = spark.createDataFrame(rows_of(12, "a"), SCHEMA)
    seen, at = [], 0
    while at < 12:
        view = views(df, 170, offset=at, hint="offset={next}")["a"]
        assert view["output_tokens"] <= 170 and view["shown"] > 0 and (f"offset={at + view['shown']}" in view["text"] or at + view["shown"] == 12)
        seen += [r["id"] for r in body(view)]
        at += view["shown"]
    assert seen == [7 * i for i in range(12)]
    assert views(df, 170, offset=99)["a"]["shown"] == 0


def test_group_whose_first_row_is_too_large(spark):
    df = spark.createDataFrame(rows_of(3, "a", "word " * 400) + rows_of(3, "b"), SCHEMA)
    got = views(df, 160, long_text=10_000)
    assert set(got) == {"a", "b"} and got["a"]["shown"] == 1 and got["a"]["cut_cap"] < got["a"]["longest"] == 2001
    assert got["a"]["output_tokens"] <= 160 and "is larger than the budget" in got["a"]["text"]
    tiny = views(df, 10)
    assert all(v["fallback"] and v["shown"] == 0 for v in tiny.values())


def test_asked_fields_and_empty_frames(spark):
    df = spark.createDataFrame(rows_of(3, "a"), SCHEMA)
    v = views(df, 500, fields=["part", "absent"])["a"]
    assert body(v)[1] == {"part": {"size": 1, "ref_id": "r1"}} and v["not_in_data"] == ["absent"] and v["left_out"] == ["id", "name", "tags", "kind"]
    every = views(df, 500, fields=None)["a"]
    assert every["left_out"] == [] and every["hoisted"] == [] and body(every)[0]["part"] == {"size": 0, "ref_id": "r0"}
    assert views(df.limit(0), 500) == {}
