"""Records below the unrolled levels come out like all others, whatever the number of unrolled levels."""

import json

from pyspark.sql import functions as F

from cutledger.functions import jsonwalk as jw
from cutledger.operators import leaves as lv
from cutledger.plans.shape import shape_payloads

LONG = "colon: \"quoted\" \\ {brace, " + "word " * 600


def nest(keys, value):
    for k in reversed(keys):
        value = {k: value}
    return value


DOCS = [
    nest("abcdefgh", {"v": "a:b", "w": None, "z": [], 'q"x': [1, None, {"y": [{"u": 2.5, "t": ""}]}]}) | {"n": 1},
    {"n": 2, "r": [{"r": [{"r": [{"r": [{"q": 7, "s": "x" * 50}, {"q": None}, []]}]}]}]},
    nest("abcdefgh", {}) | {"n": 3},
]


def test_unrolled_levels_do_not_matter(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "id int, t string").select(
        "id", F.expr("parse_json(t)").alias("rec"), F.array(*map(F.lit, ["n", "a.b.c.d.e.f.g.h.v", "r.r.r.r.q"])).alias("fs"))
    seen = []
    for levels in (1, 3, 6):
        texts = [jw.text("rec", unrolled=levels), jw.text("rec", "fs", unrolled=levels), jw.pick_text("rec", "fs", unrolled=levels), jw.text("rec", cap="3", unrolled=levels)]
        leaves = lv.leaf_values(df.select("id", "rec"), "id", unrolled=levels).orderBy("id", "ord")
        seen.append(([tuple(r) for r in df.select("id", *map(F.expr, texts)).orderBy("id").collect()],
                     [(r.id, r.path, r.apath, r.js, r.str) for r in leaves.collect()]))
    assert seen[0] == seen[1] == seen[2]
    picked = {r[0]: r[3] for r in seen[0][0]}
    assert json.loads(picked[0]) == nest("abcdefgh", {"v": "a:b"}) | {"n": 1}
    assert json.loads(picked[2]) == {"n": 3}


def test_deep_text_is_cut_and_paging_goes_on(spark):
    doc = json.dumps({"items": [nest("abcdefghijkl", LONG), {"n": 2}]})
    row = shape_payloads(spark.createDataFrame([("p", doc)], "payload_id string, text string"), max_tokens=200).collect()[0]
    assert (row.shown, row.fallback, row.longest) == (1, False, len(LONG))
    value = json.loads(row.text.split("\n")[-1])
    for k in "abcdefghijkl":
        value = value[k]
    assert value == LONG[: row.cut_cap] + "…" and row.output_tokens <= 200
