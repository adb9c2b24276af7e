"""Records walked in Arrow tasks come out as by the nested expressions; settings and inputs that large tables need."""

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cutledger.functions import jsontasks as jt, jsonwalk as jw
from cutledger.llm import common as cm
from cutledger.operators import leaves as lv
from cutledger.plans import declared as dl, shape as sh
from cutledger.plans.catalog import fields

DOCS = [
    "{}", "[]", "null", "1", '"x"', '""', '[1,null,"",{}]', '{"a":null}', '{"a":{"b":[]},"c":[[1,2],[null]],"d":1.50,"e":1e400}',
    '{"":1,"x":{"":{"y":2}}}', '{"a.b":1,"a":{"b":"q\\"\\\\u\\n\\u0001é😀","c":[{"d":"x: {y}"},{"d":null},{"e":[[{"f":1}]]}]}}',
    '[{"a":1},{"a":[{"b":2}]}]', '{"l":[null,""],"m":[{"x":""}],"a":{"b":{"c":{"d":{"e":[[],{},[null]]},"g":"t"}}},"u":12345678901234567890123}',
    '{"k\\"q":{"z":true,"w":[false,null]}}', '{"a":{"b":{}},"n":{"o":null,"p":""}}', None,
]


def test_walked_records_equal_the_expressions(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "id int, t string").withColumn("rec", F.try_parse_json("t"))
    for fs in (["a"], ["a.b", "l", "c"], ['k"q.w', "x"], [""], ["a.b.c.d.e", "m.x"], ["nope"]):
        wanted = f"array({', '.join(jw.quote(f) for f in fs)})"
        rows = df.select("t", F.expr(jw.text("rec", wanted)), jt.cut_text(F.col("rec"), fs), F.expr(jw.pick_text("rec", wanted)), jt.cut_text(F.col("rec"), fs, clean=False),
                         F.expr(jw.text("rec")), jt.cut_text(F.col("rec"), None)).collect()
        for _, a, b, c, d, e, f in rows:
            assert (a, c, e) == (b, d, f)
    listed = lambda leaves: [(r.id, r.path, r.apath, r.js, r.str) for r in leaves.orderBy("id", "ord").collect()]
    assert listed(lv.walked_leaves(df, "id")) == listed(lv.leaf_values(df, "id"))


def _counted(monkeypatch, name):
    """Calls of a function of the module from now on."""
    real, calls = getattr(jt, name), []
    monkeypatch.setattr(jt, name, lambda *a: calls.append(a) or real(*a))
    return calls


def test_records_of_one_layout_are_cut_once(spark, monkeypatch):
    """Each record was walked token by token; now a layout seen often is cut once for each set of empty values."""
    odd = ['{"a":"100% %s","b":{"c":"x:"}}', '{"a":"%d","b":{"c":""}}', '{"a":"","b":{"c":null}}', '{"a":[1,null,""],"b":{"c":[null,null,"q"]}}', '{"a":["","",null],"b":{"c":["","",null]}}']
    texts = [r.j for r in spark.createDataFrame([(d,) for d in [d for d in DOCS + LINKS if d] + odd], "t string").select(F.to_json(F.try_parse_json("t")).alias("j")).collect()]
    for fields, clean in (((), False), (("a",), False), (("a.b", "l", "c"), True), (("a", None), True), (None, True), (("nope",), True), (("b.c", "u"), False)):
        expected = [jt.cut(x, jt.Fields(fields, clean), clean) for x in texts]
        made = jt.Cuts(fields, clean)
        for _ in range(jt.OFTEN + 3):
            assert [made.text(x) for x in texts] == expected
        again = jt.Cuts(fields, clean)
        assert [again.text(x) for x in texts for _ in range(jt.OFTEN + 3)][jt.OFTEN + 2::jt.OFTEN + 3] == expected
    calls, one = _counted(monkeypatch, "cut"), jt.Cuts(("n",), True)
    assert [one.text(f'{{"n":{i},"s":"{i}"}}') for i in range(1000)] == [f'{{"n":{i}}}' for i in range(1000)] and len(calls) == jt.OFTEN


def test_leaves_of_one_layout_are_found_once(monkeypatch):
    made = []
    monkeypatch.setattr(jt.F, "arrow_udf", lambda each, _: lambda column: made.append(each))
    monkeypatch.setattr(jt.F, "to_json", lambda column: column)
    jt.leaf_list(None)
    calls = _counted(monkeypatch, "slots")
    rows = made[0](pa.array([f'{{"a":{{"b":{i}}},"l":["x",null,[]]}}' for i in range(100)] + [None])).to_pylist()
    assert len(calls) == 2 and [len(x) for x in rows] == [4] * 100 + [1]
    leaf = lambda path, apath, js, text: {"path": path, "apath": apath, "js": js, "str": text}
    assert rows[7] == [leaf("a.b", "a.b", "7", None), leaf("l", "l", '"x"', "x"), leaf("l", "l", None, None), leaf("l", "l", None, None)]


def test_long_text_only_where_a_request_holds_it(spark, tmp_path):
    """Two of thirty argument patterns hold a text as long as the customer's number; a text for all would take 30 GB here."""
    spark.range(2_000_000, 2_015_000).select(F.col("id").alias("c_custkey")).where("id % 6 NOT IN (2, 3) OR id div 6 % 5 <> 2 OR id < 2000060").write.parquet(f"{tmp_path}/customer.parquet")
    found = {r.c_custkey: r.problem for r in fields.request_forms(spark, str(tmp_path)).collect()}
    assert {found[k] for k in found if k % 6 == 2 and k // 6 % 5 == 2} == {"jql"}


def test_requests_are_dealt_and_parsed_once(spark, tmp_path):
    """One file held all customers in one task, which parsed a long request for each of its rules."""
    spark.range(1, 400).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = fields.request_forms(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 1
    assert found.rdd.getNumPartitions() > 100


def test_parts_of_payloads_stay_small(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "2m"
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 2000


def test_tokenizer_tables_are_not_sent_with_a_task():
    cm._CACHES["vocabulary", "pattern"] = (open(__file__),)  # an object that cannot be sent
    try:
        cloudpickle.dumps(cm.frugal(iter))
    finally:
        cm._CACHES.pop(("vocabulary", "pattern"))[0].close()


def test_plain_values_of_a_frame_are_compared_without_json(spark):
    df = spark.createDataFrame([("g", 1, "", "s"), ("g", 2, None, "s"), ("g", 3, "http://api.x/y", "s")], "k string, a int, b string, c string")
    profiled = dl.profile(df, ["k"], "auto", 200)
    assert "to_json" not in profiled._jdf.queryExecution().analyzed().toString().lower().replace("structstojson", "to_json")
    leaf = {x.path: (x.filled, x.kept, x.same, x.some) for x in profiled.collect()[0].leaf}
    assert leaf == {"a": (True, True, False, False), "b": (True, False, False, True), "c": (True, True, True, False)}


LINKS = ['{"u":"http://api.x/y","v":["https://h/a.PNG","https://a b/api/","http:///api/","https://u@x.api.y","ftp://api.x"]}', '{"u":"https://avatar.x?z","v":"\\u212a é😀"}']


def test_profile_of_a_payload_equals_the_expressions(spark, monkeypatch):
    """Payloads of one and of many layouts, and several of one id, whose records of one number count as one."""
    monkeypatch.setattr(jt, "OFTEN", 2)
    docs = [d for d in DOCS + LINKS if d]
    # (id, payload of that id, record number, text)
    rows = [(f"p{i}", c, n, docs[(i * 7 + c * 5 + n * (i % 4)) % len(docs)]) for i in range(40) for c in range(1 + (i % 3 == 0)) for n in range(1 + (i + c) % 5)]
    df = spark.createDataFrame(rows, "payload_id string, c int, rec_idx long, t string").withColumn("rec", F.try_parse_json("t"))
    leaf = F.struct("first_seen", "path", "prefixes", "n_values", "n_strings", "string_chars", "n_links", "n_records", "min_vals", "max_vals", "vals_per_record")
    expected = {r.payload_id: r for r in lv.path_profile(lv.record_paths(lv.leaf_values(df.select("payload_id", "rec_idx", "rec"), "payload_id", "rec_idx"))).groupBy("payload_id").agg(
        F.array_sort(F.collect_list(leaf)).alias("leaf"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("empty_tops")))).alias("tops"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("shapes")))).alias("shapes")).collect()}
    texts = {}
    for r in df.select("payload_id", "c", "rec_idx", F.to_json("rec").alias("t")).orderBy("payload_id", "c", "rec_idx").collect():
        texts.setdefault(r.payload_id, {}).setdefault(r.c, []).append(r.t)
    layouts = jt.Layouts()
    for key, lists in texts.items():
        found, tops, shapes = jt.profile(list(lists.values()), layouts)
        e = expected[key]
        assert found == [tuple(x)[1:] for x in e.leaf] and tops == e.tops
        assert shapes == ([tuple(tuple(y) for y in x) for x in e.shapes] if len(e.shapes) > 1 else [])


def test_profiles_join_and_sort_nothing(spark):
    df = spark.createDataFrame([("a", '[{"n":1,"x":{"y":""}}]'), ("a", '[{"n":2},{"m":3}]'), (None, '[{"n":1}]'), ("b", None)], "payload_id string, text string")
    d = sh.field_decisions(df, fields="auto")
    plan = d._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Generate variant_explode" not in plan
    found = sorted((str(r.payload_id), r.n_total, r.fields, r.left_out, r.empty, r.ragged) for r in d.collect())
    # Payloads of one id have one profile; a payload without id has none.
    assert found == [("None", 1, [], [], [], False), ("a", 1, ["n", "m"], [], ["x"], True), ("a", 2, ["n", "m"], [], ["x"], True), ("b", 0, [], [], [], False)]
