"""Registered queries over the evaluation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.functions.tokens import token_count
from cutledger.operators import evaluation as ev
from cutledger.plans import shape as sh
from cutledger.plans.catalog.common import CONV, ORD, T, records, tok
from cutledger.sources import views

ARMS = ["raw", "shaped", "small"]
# Words of the generated prose to ask about (fixed values).
WORDS = ["Xyzzy", "thand", "Eau", "the", "de"]


def _records(spark, sf):
    r = records(views.order_payloads(spark, sf))
    get = lambda path, kind: F.try_variant_get("rec", F.lit(path), kind)
    return r.select(
        "payload_id", "rec_idx", get("$.number", "long").alias("number"), get("$.title", "string").alias("title"),
        get("$.user.login", "string").alias("author"),
        F.array_compact(F.array(get("$.assignee.login", "string"))).alias("assignees"), get("$.labels", "array<struct<name:string>>").alias("labels"))


def _totals(spark, sf):
    return views.order_payloads(spark, sf).select("payload_id", F.try_variant_get(F.try_parse_json("text"), F.lit("$.total_count"), "long").alias("total"))


def extract_facts(spark, sf):
    return ev.extract_facts(_records(spark, sf), _totals(spark, sf))


def _rendered(spark, sf):
    p = views.order_payloads(spark, sf)
    titles = F.regexp_extract_all("text", F.lit('"title":"([^"]*)"'), F.lit(1))
    agents = F.regexp_extract_all("text", F.lit("agent[0-9]"), F.lit(0))
    arms = F.array(
        F.struct(F.lit("titles").alias("arm"), F.array_join(titles, "\n").alias("text")),
        F.struct(F.lit("agents").alias("arm"), F.array_join(agents, " ").alias("text")))
    return p.select("payload_id", F.explode(arms).alias("a")).select("payload_id", "a.arm", "a.text")


def facts_kept(spark, sf):
    return ev.facts_kept(extract_facts(spark, sf), _rendered(spark, sf))


def compare_arms(spark, sf):
    tokens = _rendered(spark, sf).select("payload_id", "arm", token_count("text").cast("long").alias("tokens"))
    return ev.compare_arms(facts_kept(spark, sf).join(tokens, ["payload_id", "arm"])).select("payload_id", "arm", "tokens", "kept", "facts", "pct")


def arm_tokens(spark, sf):
    c = T(spark, sf, "conversations")
    arms = {
        "raw": F.col("text"), "projected": F.concat(F.lit('{"role":"'), "role", F.lit('","turn":'), F.col("turn"), F.lit("}")),
        "table": F.concat_ws("\t", "role", "turn"), "labelled": F.concat(F.col("role"), F.lit(": "), F.col("text"))}
    rows = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), token_count(v).cast("long").alias("tokens")) for k, v in arms.items()])).alias("a"))
    return ev.arm_tokens(rows.select("a.*"), "raw")


def derive_tasks_label(spark, sf):
    labels = _records(spark, sf).select("payload_id", "number", F.explode("labels.name").alias("label"))
    return ev.label_task(labels).select("payload_id", "label", F.array_join("numbers", ",").alias("numbers"))


def derive_tasks_counts(spark, sf):
    return ev.count_tasks(_records(spark, sf).withColumn("assigned", F.size("assignees") > 0))


def derive_tasks_word(spark, sf):
    r = records(views.conversation_payloads(spark, sf))
    get = lambda path, kind: F.try_variant_get("rec", F.lit(path), kind)
    return ev.word_task(r.select("payload_id", "rec_idx", get("$.turn", "long").alias("number"), get("$.text", "string").alias("body")), WORDS)


def _graded(spark, sf, kind, answer, expect_text, expect_numbers):
    c = T(spark, sf, "conversations")
    g = ev.grade(F.lit(kind), expect_text, expect_numbers, answer)
    return c.select("conv_id", "turn", g.alias("right"))



def grade_numbers(spark, sf):
    n = F.length("text")
    shown = F.when(n >= 1000, F.concat((n / 1000).cast("int").cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string"))
    answer = F.concat("text", F.lit("\n\n**"), F.when(F.col("turn") % 2 == 0, shown).otherwise(F.concat(F.lit("about "), (n + 1).cast("string"))), F.lit("**"))
    return _graded(spark, sf, "number", answer, F.lit(""), F.array(n.cast("long")))


def grade_sets(spark, sf):
    t = F.col("turn")
    answer = F.concat("text", F.lit("\n \nFound:\n#"), t + 5, F.lit(", #"), t, F.when(t % 2 == 0, F.lit("\n`7`")).otherwise(F.lit("")))
    expect = F.when(t % 3 == 0, F.array(t, t + 5)).otherwise(F.array_distinct(F.array(t, t + 5, F.lit(7).cast("long"))))
    return _graded(spark, sf, "set", answer, F.lit(""), expect)


def grade_yesno(spark, sf):
    answer = F.concat("text", F.lit("\n\n  "), F.when(F.col("turn") % 3 == 0, F.lit("*Yes.* It is.")).when(F.col("turn") % 3 == 1, F.lit("I can't say yes or no")).otherwise(F.lit("no")))
    return _graded(spark, sf, "yesno", answer, F.when(F.col("conv_id") % 2 == 0, "yes").otherwise("no"), F.array().cast("array<bigint>"))


def grade_logins(spark, sf):
    answer = F.concat("text", F.lit("\nIt was opened by\n`"), F.upper("role"), F.lit("`"))
    return _graded(spark, sf, "login", answer, F.when(F.col("turn") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")), F.array().cast("array<bigint>"))


def _runs(spark, sf):
    e = T(spark, sf, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return e.select(
        F.concat(F.lit("t"), F.col("user_id") % 20).alias("task"), F.get(F.array(*map(F.lit, ARMS)), (k % 3).cast("int")).alias("arm"),
        (F.col("event_id") % 4).alias("rep"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), status.alias("status"), F.col("event_id").alias("seq"), F.lit(None).cast("boolean").alias("correct"),
        F.when(status == "ok", F.when(k % 5 == 0, F.lit("It is not shown.")).otherwise(F.concat(F.lit("The answer:\n\n"), k % 4))).alias("answer"),
        F.when(status == "error", F.when(k % 2 == 0, "denied: shell").otherwise("timeout")).alias("error"),
        (k % 3).alias("more_calls"), (k % 7).alias("turns"), (k * 100).alias("input_tokens"), (k % 60).alias("seconds"), (k / 100).alias("cost_usd"))


def _tasks(spark, sf):
    c = T(spark, sf, "customer").select((F.col("c_custkey") % 20).alias("t")).distinct()
    return c.select(F.concat(F.lit("t"), "t").alias("task"), F.lit("number").alias("kind"), F.lit("").alias("expect_text"), F.array(F.col("t") % 4).alias("expect_numbers"))


def pending_runs(spark, sf):
    runs = _runs(spark, sf).where("task IN ('t1', 't2', 't3') OR arm <> 'small'")
    return ev.pending_runs(_tasks(spark, sf), ARMS, 5, runs, ["m0", "m1", "m2"])


def summarize_runs(spark, sf):
    return ev.summarize_runs(_runs(spark, sf), _tasks(spark, sf))


def wrong_answers(spark, sf):
    return ev.wrong_answers(_runs(spark, sf), _tasks(spark, sf)).select("task", "arm", "rep", "model", "answer")


def audit_violations(spark, sf):
    s = sh.audited_payloads(views.order_payloads(spark, sf), fields="auto", max_tokens=400, hint="offset={next}")
    return ev.audit(s).agg(F.count(F.lit(1)).alias("payloads"), F.sum(F.size("broken")).alias("violations"))


_REN = f"""{ORD}, ren AS (SELECT payload_id, 'titles' AS arm, string_agg(title, chr(10) ORDER BY o_orderkey) AS text FROM ord GROUP BY 1
    UNION ALL SELECT payload_id, 'agents', coalesce(string_agg(assignee, ' ' ORDER BY o_orderkey), '') FROM ord GROUP BY 1),
  facts AS (SELECT payload_id, 'number' AS kind, CAST(o_orderkey AS VARCHAR) AS value FROM ord UNION ALL SELECT payload_id, 'title', left(title, 40) FROM ord
    UNION ALL SELECT payload_id, 'assignee', assignee FROM ord WHERE assignee IS NOT NULL UNION ALL SELECT payload_id, 'total_count', CAST(count(*) AS VARCHAR) FROM ord GROUP BY 1),
  kept AS (SELECT payload_id, arm, count(*) AS facts, count(*) FILTER (CASE WHEN kind IN ('number', 'total_count') THEN regexp_matches(text, concat('(^|[^0-9])', value, '([^0-9]|$)'))
    ELSE contains(text, value) END) AS kept FROM ren JOIN facts USING (payload_id) GROUP BY 1, 2)"""
_RUNS = """e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
  runs AS (SELECT concat('t', user_id % 20) AS task, user_id % 20 % 4 AS expect, CASE k % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'shaped' ELSE 'small' END AS arm, event_id % 4 AS rep, concat('m', event_id % 3) AS model, event_id,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN k % 2 = 0 THEN 'denied' ELSE 'timeout' END AS error, k FROM e),
  done AS (SELECT * FROM runs WHERE status = 'ok' OR error = 'denied'),
  latest AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY task, arm, rep, model ORDER BY event_id DESC) = 1),
  graded AS (SELECT *, status = 'error' AS none, status = 'ok' AND k % 5 <> 0 AND k % 4 = expect AS ok, status = 'ok' AND k % 5 = 0 AS abst FROM latest)"""
_LAST = "regexp_replace(text, '[*`]', '', 'g')"

QUERIES = {
    "extract_facts": (extract_facts, f"WITH {_REN} SELECT payload_id, kind, value FROM facts"),
    "facts_kept": (facts_kept, f"WITH {_REN} SELECT payload_id, arm, facts, kept FROM kept"),
    "compare_arms": (compare_arms, f"""WITH {_REN}, t AS (SELECT k.payload_id, k.arm, {tok('text')} AS tokens, kept, facts FROM kept k JOIN ren r ON r.payload_id = k.payload_id AND r.arm = k.arm)
        SELECT payload_id, arm, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(facts) AS BIGINT) AS facts,
          CAST(floor(100.0 * sum(kept) / sum(facts) + 0.5) AS BIGINT) AS pct FROM t GROUP BY GROUPING SETS ((payload_id, arm), (arm))"""),
    "arm_tokens": (arm_tokens, f"""WITH a AS (SELECT 'raw' AS arm, {tok('text')} AS t FROM conversations UNION ALL SELECT 'projected', {tok("concat('{\"role\":\"', role, '\",\"turn\":', turn, '}')")} FROM conversations
        UNION ALL SELECT 'table', {tok("concat(role, chr(9), turn)")} FROM conversations UNION ALL SELECT 'labelled', {tok("concat(role, ': ', text)")} FROM conversations),
        s AS (SELECT arm, CAST(sum(t) AS BIGINT) AS tokens FROM a GROUP BY 1), b AS (SELECT tokens AS base FROM s WHERE arm = 'raw')
        SELECT arm, tokens, CAST(floor(1000.0 * (tokens - base) / base + 0.5) AS BIGINT) AS permille FROM s, b"""),
    "derive_tasks_label": (derive_tasks_label, f"""WITH {ORD}, l AS (SELECT payload_id, o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS label FROM ord),
        c AS (SELECT payload_id, label, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS numbers FROM l GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 6)
        SELECT payload_id, label, numbers FROM c QUALIFY row_number() OVER (PARTITION BY payload_id ORDER BY n, label) = 1"""),
    "derive_tasks_counts": (derive_tasks_counts, f"""WITH {ORD} SELECT payload_id, count(*) - count(assignee) AS unassigned, max(o_orderkey) AS last_number, max(login) AS last_author FROM ord GROUP BY 1"""),
    "derive_tasks_word": (derive_tasks_word, f"""WITH {CONV}, w AS (SELECT payload_id, rec_idx, turn, text, word, i, contains(text, word) AS yes, NOT contains(lower(text), lower(word)) AS no
          FROM conv, (VALUES {', '.join(f"({i}, '{w}')" for i, w in enumerate(WORDS))}) t(i, word)),
        g AS (SELECT payload_id, i, word, min(turn) FILTER (yes) AS yes_number, arg_min(turn, concat(lpad(CAST(1000000 - length(text) AS VARCHAR), 9, '0'), lpad(CAST(rec_idx AS VARCHAR), 9, '0'))) FILTER (no) AS no_number FROM w GROUP BY 1, 2, 3)
        SELECT payload_id, word, yes_number, no_number FROM g WHERE yes_number IS NOT NULL AND no_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY payload_id ORDER BY i) = 1"""),
    "grade_numbers": (grade_numbers, "SELECT conv_id, turn, turn % 2 = 0 AS right FROM conversations"),
    "grade_sets": (grade_sets, """SELECT conv_id, turn, list_sort(list_distinct(CASE WHEN turn % 2 = 0 THEN [turn, turn + 5, 7] ELSE [turn, turn + 5] END)) =
        list_sort(list_distinct(CASE WHEN turn % 3 = 0 THEN [turn, turn + 5] ELSE [turn, turn + 5, 7] END)) AS right FROM conversations"""),
    "grade_yesno": (grade_yesno, "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN conv_id % 2 = 0 WHEN 1 THEN false ELSE conv_id % 2 = 1 END AS right FROM conversations"),
    "grade_logins": (grade_logins, "SELECT conv_id, turn, role = CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS right FROM conversations"),
    "pending_runs": (pending_runs, f"""WITH {_RUNS}, f AS (SELECT * FROM done WHERE task IN ('t1', 't2', 't3') OR arm <> 'small'),
        p AS (SELECT DISTINCT concat('t', c_custkey % 20) AS task, arm, rep, model FROM customer, (VALUES ('raw'), ('shaped'), ('small')) a(arm), range(5) r(rep), (VALUES ('m0'), ('m1'), ('m2')) m(model))
        SELECT p.task, p.arm, p.rep, p.model FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.task = p.task AND f.arm = p.arm AND f.rep = p.rep AND f.model = p.model)"""),
    "summarize_runs": (summarize_runs, f"""WITH {_RUNS} SELECT arm, model, count(*) AS runs, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok AND NOT none AND NOT abst) AS wrong, count(*) FILTER (abst) AS abstained,
        count(*) FILTER (none) AS no_answer, CAST(floor(10.0 * sum(k % 3) / count(*) + 0.5) AS BIGINT) AS recovery_calls_x10, CAST(floor(10.0 * sum(k % 7) / count(*) + 0.5) AS BIGINT) AS turns_x10,
        CAST(floor(sum(k * 100.0) / count(*) + 0.5) AS BIGINT) AS input_tokens, CAST(floor(1.0 * sum(k % 60) / count(*) + 0.5) AS BIGINT) AS seconds, CAST(sum(k) AS BIGINT) AS cost_cents FROM graded GROUP BY 1, 2"""),
    "wrong_answers": (wrong_answers, f"WITH {_RUNS} SELECT task, arm, rep, model, concat('The answer:', chr(10), chr(10), k % 4) AS answer FROM graded WHERE NOT ok AND NOT none AND NOT abst"),
    "audit_violations": (audit_violations, f"WITH {ORD} SELECT count(DISTINCT payload_id) AS payloads, 0 AS violations FROM ord"),
}
