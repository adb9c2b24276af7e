"""The audit compares what a text shows with the source and follows the hint; tampered texts must be found out."""

import json

import pytest
from pyspark.sql import functions as F

from cutledger.operators.evaluation import audit
from cutledger.plans.shape import audited_payloads, shape_payloads
from tests.test_shape import CASES, ISSUES

NUMBERS = '{"d":{"rows":[{"a":1.50,"b":12345678901234567890123,"c":1e3,"t":true},{"a":0.1,"b":2,"c":-7.25E-3,"t":1},{"a":9007199254740993,"b":"1","c":3,"t":false}]},"x":[{"y":1}]}'
SCHEMA = "payload_id string, text string, o_mode string, o_fields array<string>, o_budget bigint, o_offset bigint, o_counts array<string>"


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [(k, t, m, f, b, o, c) for k, (t, m, f, b, o, c) in CASES.items()]
    more = [("numbers", NUMBERS, "list", ["a", "b", "c", "t"], 500, 0, None), ("numbers_auto", NUMBERS, "auto", None, 500, 0, None),
            ("long", json.dumps([{"i": i, "s": "same"} for i in range(400)]), "auto", None, 90, 5, None)]
    return spark.createDataFrame(rows + more, SCHEMA)


@pytest.fixture(scope="module")
def audited(payloads):
    return collected(audited_payloads(payloads, use_counts=True, hint="offset={next}"))


def collected(df):
    """The same rows without the plan that made them."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def broken(df):
    return {r.payload_id: r.broken for r in audit(df).collect() if r.broken}


def test_sound_pages_break_no_rule(audited):
    # Where the budget holds the notes and no row, the hint leads to the same page for ever.
    page = audited.where("payload_id = 'counts'").collect()[0]
    assert (page.shown, page.after.shown, page.asked) == (page.after.start - page.start, 0, page.after.start)
    assert broken(audited) == {"counts": ["hint_broken"]}


def test_the_page_behind_a_hint_is_that_of_a_call_with_its_offset(payloads, audited):
    rows = {r.payload_id: r for r in audited.collect()}
    assert rows["issues_cut"].asked == rows["issues_cut"].shown and rows["long"].asked == 5 + rows["long"].shown
    asked = payloads.drop("o_offset").join(audited.where("asked IS NOT NULL").select("payload_id", F.col("asked").alias("o_offset")), "payload_id")
    again = {r.payload_id: r for r in shape_payloads(asked, use_counts=True, hint="offset={next}").collect()}
    assert len(again) >= 3
    for name, r in again.items():
        assert (r.text, r.start, r.shown, r.fallback, r.cut_cap) == tuple(rows[name].after[c] for c in ("text", "start", "shown", "fallback", "cut_cap"))


def test_a_value_that_is_not_the_sources_is_found(audited):
    changed = lambda old, new: audited.where("payload_id = 'issues_cut'").withColumn("text", F.replace("text", F.lit(old), F.lit(new)))
    wrong = {"issues_cut": ["value_not_source"]}
    assert broken(changed('"number":2,', '"number":3,')) == wrong
    assert broken(changed('"login":"user1"', '"login":"user2"')) == wrong
    assert broken(changed('"number":2,', "")) == wrong
    assert broken(changed('state="open"', 'state="shut"')) == wrong
    assert broken(changed('# same in every record: state="open"\n', "")) == wrong
    numbers = audited.where("payload_id = 'numbers'")
    assert broken(numbers.withColumn("text", F.replace("text", F.lit('"t":1}'), F.lit('"t":true}')))) == {"numbers": ["value_not_source"]}
    assert broken(numbers.withColumn("text", F.replace("text", F.lit("9007199254740993"), F.lit("9007199254740992")))) == {"numbers": ["value_not_source"]}


def test_a_hint_that_leads_elsewhere_is_found(audited):
    cut = audited.where("payload_id = 'issues_cut'")
    wrong = {"issues_cut": ["hint_broken"]}
    assert broken(cut.withColumn("asked", F.col("asked") + 1)) == wrong
    assert broken(cut.withColumn("asked", F.lit(None).cast("long"))) == wrong
    assert broken(cut.withColumn("after", F.col("after").withField("shown", F.lit(0).cast("long")))) == wrong
    assert broken(cut.withColumn("after", F.col("after").withField("text", F.replace("after.text", F.lit('"number":'), F.lit('"number":1'))))) == wrong


def test_aliases_and_repeated_ids(spark):
    text = json.dumps([{"id": "ch_3NxQ8kLm2pZ9", "n": "see"}, {"id": "x", "n": "ch_3NxQ8kLm2pZ9"}] * 20)
    df = spark.createDataFrame([("a", text, {"ch_3NxQ8kLm2pZ9": "@1"}), ("a", ISSUES, None), (None, ISSUES, {})], "payload_id string, text string, aliases map<string,string>")
    made = collected(audited_payloads(df, fields=["id", "n", "number"], max_tokens=150, hint="offset={next}"))
    assert len(audit(made).collect()) == 3 and broken(made) == {}
    assert broken(made.where("payload_id = 'a'").withColumn("text", F.replace("text", F.lit('"@1"'), F.lit('"@2"')))) == {"a": ["value_not_source"]}
