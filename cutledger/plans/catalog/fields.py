"""Registered queries over field choice, projection and column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.functions import requests, jsontasks as jt
from cutledger.functions import rules
from cutledger.operators import fields as fl
from cutledger.operators import frame
from cutledger.operators import policies as po
from cutledger.plans import shape as sh
from cutledger.plans.catalog.common import CONV, DOCS, ORD, T, profile, records
from cutledger.sources import pages as pg
from cutledger.sources import views


def _text(spark, sf, fields):
    r = records(views.order_payloads(spark, sf))
    return r.select("payload_id", "rec_idx", jt.cut_text(F.col("rec"), fields).alias("line"))


def pick_paths(spark, sf):
    return _text(spark, sf, ["number", "user.login", "labels.name", "assignee", "milestone"])


def silent_projection(spark, sf):
    r = records(views.order_payloads(spark, sf))
    return r.select("payload_id", "rec_idx", jt.cut_text(F.col("rec"), ["number", "milestone", "user.id", "assignee"], clean=False).alias("line"))


def frame_pick(spark, sf):
    li = T(spark, sf, "lineitem")
    nested = li.select(
        "l_orderkey", F.struct("l_linenumber", "l_returnflag", "l_comment" if "l_comment" in li.columns else "l_linestatus").alias("line"),
        F.array(F.struct(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("flag"))).alias("tags"))
    picked = nested.select(*frame.pick_columns(nested, ["l_orderkey", "line.l_returnflag", "tags.id"]))
    return picked.groupBy(F.col("line.l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.sum(F.col("tags")[0]["id"]).alias("suppliers"))


def auto_fields_conv(spark, sf):
    return fl.auto_fields(profile(views.conversation_payloads(spark, sf))).select("payload_id", "path")


def auto_fields_docs(spark, sf):
    return fl.auto_fields(profile(views.document_payloads(spark, sf)), 2000).select("payload_id", "path")


def auto_fields_orders(spark, sf):
    d = sh.field_decisions(views.order_payloads(spark, sf), fields="auto")
    return d.select("payload_id", F.array_join("fields", ",").alias("fields"), F.array_join("row_fields", ",").alias("row_fields"))


_URL_FORMS = {
    "as_is": "url",
    "image": "concat(regexp_extract(url, '^[^?#]*', 0), '.PNG')",
    "api_host": "replace(url, '://', '://api.')",
    "rest_path": "concat(regexp_extract(url, '^[^?#]*', 0), '/rest/v2')",
    "upper_scheme": "replace(url, 'http', 'HTTP')",
    "broken": "concat(url, '.png nope')",
}


def machine_urls(spark, sf):
    p = T(spark, sf, "pages")
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.expr(v).alias("u")) for k, v in _URL_FORMS.items()])
    return p.select("page_id", F.explode(forms).alias("x")).select(
        "page_id", F.col("x.form").alias("form"), rules.machine_url(F.col("x.u")).alias("machine"))


def _filters(spark, sf):
    p = T(spark, sf, "part")
    cond = lambda name, value: F.struct(F.lit(name).alias("field"), F.lit("=").alias("type"), value.cast("string").alias("value"))
    inner = F.struct(F.lit("or").alias("op"), F.array(cond("p_type", F.col("p_type")), cond("p_full_size", F.col("p_size"))).alias("conditions"))
    doc = F.struct(
        F.lit("and").alias("op"),
        F.array(cond("p_brand", F.col("p_brand"))).alias("conditions"),
        F.when(F.col("p_size") > 25, inner).alias("more"),
    )
    return p.select("p_partkey", F.try_parse_json(F.to_json(doc)).alias("filters"))


def _rename(spark):
    return spark.createDataFrame([("p_full_size", "p_size")], "request string, response string")


def filter_fields_union(spark, sf):
    out = fl.filter_fields(_filters(spark, sf), "p_partkey", rename=_rename(spark), base=["p_partkey", "p_brand"])
    return out.select("p_partkey", "field")


def filter_fields_only(spark, sf):
    return fl.filter_fields(_filters(spark, sf), "p_partkey", rename=_rename(spark)).select("p_partkey", "field")


def filter_group_fields(spark, sf):
    s = T(spark, sf, "supplier")
    one = lambda name: F.struct(F.lit(name).alias("propertyName"), F.lit("EQ").alias("operator"), F.col("s_name").alias("value"))
    groups = F.array(
        F.struct(F.array(one("name"), one("city")).alias("filters")),
        F.struct(F.array(F.struct(F.concat(F.lit("nation_"), "s_nationkey").alias("propertyName"), F.lit("EQ").alias("operator"), F.col("s_name").alias("value"))).alias("filters")),
    )
    return s.select("s_suppkey", F.array_join(pg.filter_group_fields(groups), ",").alias("fields"))


def preset_projection(spark, sf):
    return _text(spark, sf, pg.preset_fields("github"))


def property_union(spark, sf):
    s = T(spark, sf, "supplier")
    defaults = F.array(*map(F.lit, pg.HUBSPOT_PROPERTIES["companies"]))
    asked = F.when(F.col("s_nationkey") % 3 > 0, F.array(F.lit("city"), F.concat(F.lit("p"), "s_nationkey")))
    return s.select("s_suppkey", F.array_join(fl.property_union(defaults, asked), ",").alias("properties"))


def detail_projection(spark, sf):
    r = records(views.order_payloads(spark, sf))
    return pg.detail_projection(r, "github", ["title", "body", "state", "labels", "assignee", "milestone"]).select("payload_id", "rec_idx", "detail")


_POLICIES = [
    ("click", ["a", "b"], None, 500, None, None),
    ("view", None, None, None, 50, None),
    ("error", None, None, None, None, True),
    ("signup", None, ["x"], 4000, 300, False),
]


def policy_precedence(spark, sf):
    policies = spark.createDataFrame(
        _POLICIES, "tool string, fields array<string>, counts array<string>, budget_tokens bigint, long_text_chars int, skip boolean")
    calls = T(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("tool"),
        F.when(F.col("event_id") % 5 == 0, F.array(F.lit("v"))).alias("view_fields"),
        F.when(F.col("event_id") % 7 == 0, 1000).alias("view_budget"))
    r = po.resolve_policy(calls, policies, budget=6000)
    return r.select("event_id", "o_mode", F.array_join("o_fields", ",").alias("fields"), "o_budget", F.col("o_long_text").cast("long").alias("o_long_text"), "o_skip")


def policy_rejects(spark, sf):
    p = T(spark, sf, "part")
    budget = (F.col("p_size") * 20).cast("string")
    text = (
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit('{"budget":'), budget, F.lit("}")))
        .when(F.col("p_partkey") % 7 == 1, F.lit('{"fields":["a",""]}'))
        .when(F.col("p_partkey") % 7 == 2, F.lit('{"long_text_chars":0}'))
        .when(F.col("p_partkey") % 7 == 3, F.lit('["not an object"]'))
        .when(F.col("p_partkey") % 7 == 4, F.concat(F.lit('{"budget_tokens":'), budget, F.lit('.5}')))
        .otherwise(F.concat(F.lit('{"fields":"auto","skip":false,"budget_tokens":'), budget, F.lit("}")))
    )
    valid, rejects = po.validate_policies(p.select("p_partkey", text.alias("policy")))
    return valid.select("p_partkey", F.lit("valid").alias("reason")).unionByName(rejects.select("p_partkey", "reason"))


def scope_conflicts(spark, sf):
    extra = F.when(F.col("doc_id") % 5 == 0, " repo:a/b").when(F.col("doc_id") % 5 == 1, " (IS:PR)").when(F.col("doc_id") % 5 == 2, " superuser:x").otherwise("")
    d = T(spark, sf, "documents")
    return d.select("doc_id", rules.scope_conflict(F.concat("text", extra)).alias("conflict"))


_FORM = """get(array('github_search_issues', 'github_get_issue', 'jira_search_issues', 'jira_get_issue', 'hubspot_search',
    CASE WHEN c_custkey div 6 % 5 = 4 THEN 'other' ELSE 'hubspot_get_record' END), cast(c_custkey % 6 AS int))"""
_REPO = '"owner":"acme","repo":"r.1"'
# The arguments of each form: sound ones and four variations.
_ARGS = [
    [f'{{{_REPO},"query":"is open"}}', f'{{{_REPO},"query":"is open","page":#}}', '{"owner":"a b","repo":"r","query":"q"}', f'{{{_REPO},"query":"q","budget_tokens":#}}', f'{{{_REPO},"query":""}}'],
    [f'{{{_REPO},"issue_number":#,"fields":["body"]}}', f'{{{_REPO},"issue_number":1,"fields":["body","age"]}}', f'{{{_REPO},"issue_number":0,"fields":["body"]}}',
     f'{{{_REPO},"issue_number":1.5,"fields":["body"]}}', f'{{{_REPO},"issue_number":1}}'],
    ['{"jql":"project = X"}', '{"jql":"x","cursor":null}', '{"jql":"~"}', '{"jql":"x","budget_tokens":"300"}', '{"jql":"x","session_id":7}'],
    ['{"issue_key":"A-#","fields":["summary"]}', '{"issue_key":"A-#","fields":[]}', '{"issue_key":"~","fields":["summary"]}', '{"issue_key":"A","fields":"summary"}', '{"issue_key":"A","fields":["summary","summary"]}'],
    ['{"object_type":"deals"}', '{"object_type":"leads"}', '{"object_type":"deals","properties":["a",1]}', '{"object_type":"deals","properties":[]}', '{"object_type":"deals","after":"x"}'],
    ['{"object_type":"deals","id":"#","properties":["x"]}', '{"object_type":"deals","id":"#","properties":[]}', '{"object_type":"deals","properties":["x"]}', '[#]', '{}'],
]


REQUEST_PARTS = 128  # fixed value: parts of the customers, as the size of their keys says nothing about their texts


def request_forms(spark, sf):
    """A request of each form for every customer: ``#`` is the customer's number, ``~`` a text of as many characters."""
    pattern = F.get(F.get(F.array(*[F.array(*map(F.lit, row)) for row in _ARGS]), (F.col("c_custkey") % 6).cast("int")), F.expr("cast(c_custkey div 6 % 5 AS int)"))
    key = F.col("c_custkey").cast("string")
    numbered = F.replace(pattern, F.lit("#"), key)
    # The long text is made only for the requests that hold it.
    filled = F.concat(F.substring_index(numbered, "~", 1), F.repeat(F.lit("k"), F.col("c_custkey").cast("int")), F.substring_index(numbered, "~", -1))
    args = F.when(numbered.contains("~"), filled).otherwise(numbered)
    # A few files hold all customers, but their requests are long: keys are dealt, and texts are made where they are checked.
    dealt = T(spark, sf, "customer").select("c_custkey").repartition(REQUEST_PARTS)
    return dealt.select("c_custkey", requests.request_problem(F.expr(_FORM), args).alias("problem"))


def valid_requests(spark, sf):
    c = T(spark, sf, "customer")
    owner = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit("-")))
    repo = F.concat(F.col("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string"))
    query = F.repeat(F.lit("q"), (F.col("c_custkey") % 600).cast("int"))
    page = F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 40)
    budget = F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") * 10)
    return c.select("c_custkey", rules.valid_request(owner, repo, query, page, budget).alias("valid"))


_ID_FORMS = {
    "md5": "md5(c_name)",
    "uuid": "concat(left(md5(c_name), 8), '-', substr(md5(c_name), 9, 4), '-', substr(md5(c_name), 13, 4), '-', substr(md5(c_name), 17, 4), '-', right(md5(c_name), 12))",
    "prefixed": "concat('ch_', left(md5(c_name), 12))",
    "mixed": "concat(upper(left(md5(c_name), 6)), '-', substr(md5(c_name), 9, 10))",
    "readable": "concat('order-', left(md5(c_name), 12))",
    "name": "c_name",
    "digits": "concat('9', c_custkey, '00000000000000000')",
}


def opaque_ids(spark, sf):
    c = T(spark, sf, "customer")
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.expr(v).alias("s")) for k, v in _ID_FORMS.items()])
    return c.select("c_custkey", F.explode(forms).alias("x")).select(
        "c_custkey", F.col("x.form").alias("form"), rules.is_opaque_id(F.col("x.s")).alias("opaque"))


def _forms_sql(table, key, forms, name):
    return " UNION ALL ".join(f"SELECT {key}, '{k}' AS form, {v} AS {name} FROM {table}" for k, v in forms.items())


_LABELS = """'"labels":[{"name":"' || o_orderstatus || '"},{"name":"' || o_orderpriority || '"}]'"""
_ASSIGNEE = """CASE WHEN assignee IS NOT NULL THEN '"assignee":{"login":"' || assignee || '"},' ELSE '' END"""

QUERIES = {
    "request_forms": (request_forms, """WITH c AS (SELECT c_custkey, c_custkey AS k, c_custkey % 6 AS f, c_custkey // 6 % 5 AS j FROM customer)
        SELECT c_custkey, CASE f
          WHEN 0 THEN CASE j WHEN 1 THEN CASE WHEN k NOT BETWEEN 1 AND 34 THEN 'page' END WHEN 2 THEN 'owner' WHEN 3 THEN CASE WHEN k NOT BETWEEN 256 AND 8192 THEN 'budget_tokens' END WHEN 4 THEN 'query' END
          WHEN 1 THEN CASE j WHEN 1 THEN 'fields' WHEN 2 THEN 'issue_number' WHEN 3 THEN 'issue_number' WHEN 4 THEN 'fields' END
          WHEN 2 THEN CASE j WHEN 1 THEN 'cursor' WHEN 2 THEN CASE WHEN k > 1024 THEN 'jql' END WHEN 3 THEN 'budget_tokens' WHEN 4 THEN 'session_id' END
          WHEN 3 THEN CASE j WHEN 1 THEN 'fields' WHEN 2 THEN CASE WHEN k > 64 THEN 'issue_key' END WHEN 3 THEN 'fields' END
          WHEN 4 THEN CASE j WHEN 1 THEN 'object_type' WHEN 2 THEN 'properties' END
          ELSE CASE j WHEN 1 THEN 'properties' WHEN 2 THEN 'id' WHEN 3 THEN 'args' WHEN 4 THEN 'form' END END AS problem FROM c"""),
    "pick_paths": (pick_paths, f"""WITH {ORD} SELECT payload_id, rec_idx, '{{' || {_ASSIGNEE} || {_LABELS} || ',"number":' || o_orderkey || ',"user":{{"login":"' || login || '"}}}}' AS line FROM ord"""),
    "silent_projection": (silent_projection, f"""WITH {ORD} SELECT payload_id, rec_idx,
        concat('{{"assignee":', CASE WHEN assignee IS NULL THEN 'null' ELSE concat('{{"login":"', assignee, '"}}') END, ',"milestone":"","number":', o_orderkey, ',"user":{{"id":', o_custkey, '}}}}') AS line FROM ord"""),
    "frame_pick": (frame_pick, "SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1"),
    "auto_fields_conv": (auto_fields_conv, f"""WITH {CONV} SELECT DISTINCT payload_id, 'turn' AS path FROM conv UNION ALL SELECT DISTINCT payload_id, 'role' FROM conv
        UNION ALL SELECT payload_id, 'text' FROM conv GROUP BY 1 HAVING sum(length(text)) <= 200 * count(*)"""),
    "auto_fields_docs": (auto_fields_docs, f"""WITH {DOCS}, p AS (SELECT DISTINCT payload_id FROM docs)
        SELECT payload_id, path FROM p CROSS JOIN (VALUES ('doc_id'), ('lang'), ('n_chars')) t(path)
        UNION ALL SELECT payload_id, 'text' FROM docs GROUP BY 1 HAVING sum(length(text)) <= 2000 * count(*)"""),
    "auto_fields_orders": (auto_fields_orders, f"""WITH {ORD}, g AS (SELECT payload_id, count(*) AS n, count(assignee) AS a, count(DISTINCT assignee) AS da,
          count(*) FILTER (rec_idx = 0 AND assignee IS NOT NULL) AS first, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p,
          count(DISTINCT CAST(o_orderdate AS DATE)) AS d, count(DISTINCT round(o_totalprice)) AS t FROM ord GROUP BY 1),
        f AS (SELECT payload_id, unnest([
            {{'at': CASE WHEN first > 0 THEN 0 ELSE 9 END, 'path': CASE WHEN a > 0 THEN 'assignee.login' END, 'const': n >= 3 AND a = n AND da = 1}},
            {{'at': 1, 'path': 'html_url', 'const': false}}, {{'at': 2, 'path': 'labels.name', 'const': n >= 3 AND s = 1 AND p = 1}},
            {{'at': 3, 'path': 'number', 'const': false}}, {{'at': 4, 'path': 'state', 'const': n >= 3 AND s = 1}},
            {{'at': 5, 'path': 'title', 'const': false}}, {{'at': 6, 'path': 'total', 'const': n >= 3 AND t = 1}},
            {{'at': 7, 'path': 'updated_at', 'const': n >= 3 AND d = 1}}, {{'at': 8, 'path': 'user.login', 'const': n >= 3}}]) AS x FROM g)
        SELECT payload_id, string_agg(x.path, ',' ORDER BY x.at) AS fields, string_agg(x.path, ',' ORDER BY x.at) FILTER (NOT x.const) AS row_fields
        FROM f WHERE x.path IS NOT NULL GROUP BY 1"""),
    "machine_urls": (machine_urls, f"""WITH u AS ({_forms_sql('pages', 'page_id', _URL_FORMS, 'u')}),
        s AS (SELECT *, lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM u)
        SELECT page_id, form, regexp_matches(u, '^https?://') AND regexp_matches(host, '^[^\\s<>^`{{|}}\\[\\]%"]+$') AND (regexp_matches(host, '^api\\.|\\.api\\.|avatar')
          OR regexp_matches(path, '/(api|rest)/') OR regexp_matches(path, '(?i)\\.(png|jpe?g|gif|svg|webp|ico)$')) AS machine FROM s"""),
    "filter_fields_union": (filter_fields_union, """SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN ['p_partkey', 'p_brand', 'p_type', 'p_size'] ELSE ['p_partkey', 'p_brand'] END) AS field FROM part"""),
    "filter_fields_only": (filter_fields_only, """SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN ['p_brand', 'p_type', 'p_size'] ELSE ['p_brand'] END) AS field FROM part"""),
    "filter_group_fields": (filter_group_fields, "SELECT s_suppkey, concat('properties.name,properties.city,properties.nation_', s_nationkey) AS fields FROM supplier"),
    "preset_projection": (preset_projection, f"""WITH {ORD} SELECT payload_id, rec_idx, '{{' || {_ASSIGNEE} || '"html_url":"https://example.com/orders/' || o_orderkey || '",' || {_LABELS} ||
        ',"number":' || o_orderkey || ',"state":"' || o_orderstatus || '","title":"' || title || '","updated_at":"' || strftime(o_orderdate, '%Y-%m-%d') || '","user":{{"login":"' || login || '"}}}}' AS line FROM ord"""),
    "property_union": (property_union, """SELECT s_suppkey, concat('name,domain,city,industry,numberofemployees', CASE WHEN s_nationkey % 3 > 0 THEN concat(',p', s_nationkey) ELSE '' END) AS properties FROM supplier"""),
    "detail_projection": (detail_projection, f"""WITH {ORD} SELECT payload_id, rec_idx, concat('{{"number":', o_orderkey, ',"title":"', title, '","body":null,"state":"', o_orderstatus,
        '","labels":["', o_orderstatus, '","', o_orderpriority, '"],"assignee":', CASE WHEN assignee IS NULL THEN 'null' ELSE concat('{{"login":"', assignee, '"}}') END, ',"milestone":""}}') AS detail FROM ord"""),
    "policy_precedence": (policy_precedence, """WITH p(tool, fields, budget, long_text, skip) AS (VALUES ('click', 'a,b', 500, NULL, false), ('view', NULL, NULL, 50, false), ('error', NULL, NULL, NULL, true), ('signup', NULL, 4000, 300, false))
        SELECT event_id, CASE WHEN event_id % 5 = 0 OR p.fields IS NOT NULL THEN 'list' ELSE 'auto' END AS o_mode,
          CASE WHEN event_id % 5 = 0 THEN 'v' ELSE p.fields END AS fields,
          CAST(coalesce(CASE WHEN event_id % 7 = 0 THEN 1000 END, p.budget, 6000) AS BIGINT) AS o_budget,
          CAST(coalesce(p.long_text, 200) AS BIGINT) AS o_long_text, coalesce(p.skip, false) AS o_skip
        FROM events e LEFT JOIN p ON p.tool = e.event_type"""),
    "policy_rejects": (policy_rejects, """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'unknown key' WHEN 1 THEN 'fields' WHEN 2 THEN 'long_text_chars' WHEN 3 THEN 'not an object'
        WHEN 4 THEN 'budget_tokens' ELSE CASE WHEN p_size * 20 < 256 THEN 'budget_tokens' ELSE 'valid' END END AS reason FROM part"""),
    "scope_conflicts": (scope_conflicts, """SELECT doc_id, regexp_matches(concat(text, CASE doc_id % 5 WHEN 0 THEN ' repo:a/b' WHEN 1 THEN ' (IS:PR)' WHEN 2 THEN ' superuser:x' ELSE '' END),
        '(?i)\\b(?:repo|org|user):|\\bis:pr\\b') AS conflict FROM documents"""),
    "valid_requests": (valid_requests, """SELECT c_custkey, c_custkey % 3 <> 0 AND regexp_matches(concat(c_mktsegment, '_', c_nationkey), '^[A-Za-z0-9_.-]+$')
        AND c_custkey % 600 BETWEEN 1 AND 512 AND (c_custkey % 4 = 0 OR c_custkey % 40 BETWEEN 1 AND 34)
        AND (c_custkey % 5 = 0 OR c_custkey * 10 BETWEEN 256 AND 8192) AS valid FROM customer"""),
    "opaque_ids": (opaque_ids, f"""WITH f AS ({_forms_sql('customer', 'c_custkey', _ID_FORMS, 's')}),
        b AS (SELECT *, regexp_matches(s, '^[A-Za-z]{{1,10}}_[A-Za-z0-9]{{6,}}$') AS prefixed FROM f),
        d AS (SELECT *, CASE WHEN prefixed THEN substr(s, instr(s, '_') + 1) ELSE s END AS body FROM b)
        SELECT c_custkey, form, regexp_matches(s, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') OR (
          length(s) >= 12 AND regexp_matches(s, '^[A-Za-z0-9_-]+$') AND (prefixed OR length(s) >= 16)
          AND NOT regexp_matches(body, '(^|[-_])[A-Za-z]{{3,}}([-_]|$)')
          AND len(regexp_extract_all(body, '[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+')) - 1 >= 4) AS opaque FROM d"""),
}
