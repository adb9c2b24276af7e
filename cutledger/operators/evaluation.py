"""Evaluation jobs: facts kept by a rendering, derived tasks, grading and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cutledger.functions import jsontasks

TITLE_CHARS = 40  # fixed value: titles are compared on their first characters
LABEL_RECORDS = (2, 6)  # fixed value: a task label is on this many records
# Words a body may mention (fixed values).
TASK_WORDS = ["Windows", "macOS", "Linux", "regression", "panicked", "OAuth"]
# An answer that says the data is not there instead of guessing (fixed value).
ABSTAINED = (
    r"(?i)not (determined|shown|available|visible|included)|isn't available|cannot|can't|couldn't|could not|unable|"
    r"unknown|no answer|too large|reliabl"
)


def extract_facts(records: DataFrame, totals: DataFrame, key: str = "payload_id") -> DataFrame:
    """``(payload_id, kind, value)``: totals, numbers, title starts and assignees.

    Records need ``number, title, assignees ARRAY<string>``; totals need ``total``.
    """
    facts = F.concat(
        F.array(
            F.struct(F.lit("number").alias("kind"), F.col("number").cast("string").alias("value")),
            F.struct(F.lit("title").alias("kind"), F.left("title", F.lit(TITLE_CHARS)).alias("value")),
        ),
        F.transform(F.coalesce("assignees", F.array().cast("array<string>")),
                    lambda a: F.struct(F.lit("assignee").alias("kind"), a.alias("value"))),
    )
    per_record = records.select(key, F.explode_outer(facts).alias("f")).select(key, "f.kind", "f.value")
    total = totals.select(key, F.lit("total_count").alias("kind"), F.col("total").cast("string").alias("value"))
    return per_record.unionByName(total)


def fact_kept(kind: Column, value: Column, text: Column) -> Column:
    """Numbers need non-digit neighbours; other values match raw or JSON-escaped."""
    number = F.regexp_count(text, F.concat(F.lit("(^|[^0-9])"), value, F.lit("([^0-9]|$)"))) > 0
    escaped = F.to_json(F.array(value))
    inner = F.substr(escaped, F.lit(3), F.length(escaped) - 4)
    return F.when(kind.isin("number", "total_count"), number).otherwise(text.contains(value) | text.contains(inner))


def facts_kept(facts: DataFrame, rendered: DataFrame, key: str = "payload_id") -> DataFrame:
    """Facts per rendering, counted. ``rendered`` has ``(payload_id, arm, text)``.

    Facts are packed per payload first, so each text meets its facts in one row; a payload's
    facts are bounded by its document.
    """
    packed = facts.groupBy(key).agg(F.collect_list(F.struct("kind", "value")).alias("facts"))
    hits = F.size(F.filter("facts", lambda f: fact_kept(f["kind"], f["value"], F.col("text"))))
    return rendered.join(packed, key).select(key, "arm", F.size("facts").cast("long").alias("facts"), hits.cast("long").alias("kept"))


def compare_arms(per_payload: DataFrame, key: str = "payload_id") -> DataFrame:
    """Tokens and percent of facts per payload and arm, with a total row (NULL payload) per arm."""
    return (
        per_payload.groupingSets([[F.col(key), F.col("arm")], [F.col("arm")]], key, "arm")
        .agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"), F.sum("facts").alias("facts"))
        .withColumn("pct", F.floor(100 * F.col("kept") / F.col("facts") + 0.5).cast("long"))
    )


def arm_tokens(rendered: DataFrame, baseline: str) -> DataFrame:
    """Total tokens per arm and the change against a baseline arm in tenths of a percent."""
    totals = rendered.groupBy("arm").agg(F.sum("tokens").alias("tokens"))
    base = F.max(F.when(F.col("arm") == baseline, F.col("tokens"))).over(W.partitionBy(F.lit(1)))
    return totals.withColumn("permille", F.floor(1000 * (F.col("tokens") - base) / base + 0.5).cast("long"))


def label_task(labels: DataFrame, key: str = "payload_id") -> DataFrame:
    """Per payload the label on 2 to 6 records (fewest, then name) and the numbers that carry it.

    ``labels`` has ``(payload_id, number, label)``. The label is chosen from counts alone, so
    only the at most six numbers of the chosen label are ever collected.
    """
    low, high = LABEL_RECORDS
    counts = labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(low, high))
    chosen = counts.groupBy(key).agg(F.min(F.struct("n", "label")).alias("best")).select(key, "best.label")
    return labels.join(chosen, [key, "label"]).groupBy(key, "label").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def count_tasks(records: DataFrame, key: str = "payload_id") -> DataFrame:
    """Unassigned records, and number and author of the last record. Needs ``rec_idx, number, author, assigned``."""
    last = F.max_by(F.struct("number", "author"), "rec_idx")
    return records.groupBy(key).agg(
        F.count_if(~F.col("assigned")).alias("unassigned"), last.alias("last")
    ).select(key, "unassigned", F.col("last.number").alias("last_number"), F.col("last.author").alias("last_author"))


def word_task(records: DataFrame, words: list[str] | None = None, key: str = "payload_id") -> DataFrame:
    """Per payload the first word that one body has exactly and another has in no case.

    Gives the first record with it, and the longest body without it (first one wins). Needs
    ``rec_idx, number, body``. Each word adds fixed-size aggregates, so nothing is collected.
    """
    words = words or TASK_WORDS
    body = F.col("body")
    has_body = F.coalesce(F.length("body") > 0, F.lit(False))
    aggregates = []
    for i, w in enumerate(words):
        exact = has_body & body.contains(w)
        absent = has_body & ~F.lower(body).contains(w.lower())
        yes = F.min(F.when(exact, F.struct("rec_idx", "number")))
        no = F.min(F.when(absent, F.struct((-F.length("body")).alias("l"), F.col("rec_idx"), F.col("number"))))
        aggregates.append(F.struct(F.lit(w).alias("word"), yes["number"].alias("yes_number"), no["number"].alias("no_number")).alias(f"w{i}"))
    tasks = records.groupBy(key).agg(*aggregates)
    usable = F.filter(F.array(*[f"w{i}" for i in range(len(words))]), lambda w: w["yes_number"].isNotNull() & w["no_number"].isNotNull())
    return tasks.select(key, F.get(usable, F.lit(0)).alias("t")).where("t IS NOT NULL").select(key, "t.word", "t.yes_number", "t.no_number")


def last_paragraph(answer: Column) -> Column:
    """The last paragraph without marks, lines trimmed, empty lines gone."""
    plain = F.regexp_replace(F.regexp_replace(answer, "[*`]", ""), r"^\s+|\s+$", "")
    last = F.try_element_at(F.split(plain, r"\n\s*\n"), F.lit(-1))
    return F.array_join(F.filter(F.transform(F.split(last, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def last_line(answer: Column) -> Column:
    return F.coalesce(F.substring_index(last_paragraph(answer), "\n", -1), F.lit(""))


def integers(text: Column) -> Column:
    """Integers in a text as strings, thousands commas removed."""
    return F.regexp_extract_all(F.regexp_replace(text, r"(\d),(\d{3})", "$1$2"), F.lit(r"\d+"), F.lit(0))


def _big(x: Column) -> Column:
    return x.try_cast("decimal(38,0)")


def grade(kind: Column, expect_text: Column, expect_numbers: Column, answer: Column) -> Column:
    """Is the answer right? ``expect_numbers`` is ARRAY<BIGINT> for number (one) and set tasks."""
    line = last_line(answer)
    para = last_paragraph(answer)
    first = _big(F.get(integers(line), F.lit(0)))
    number = F.coalesce(first == F.get(expect_numbers, F.lit(0)), F.lit(False))
    login = F.lower(line).contains(F.lower(expect_text))
    verdict = F.regexp_extract(F.lower(line), r"^[^a-z0-9_]*(yes|no)\b", 1) == expect_text
    got = F.array_sort(F.array_distinct(F.transform(integers(para), _big)))
    want = F.array_sort(F.transform(expect_numbers, lambda n: n.cast("decimal(38,0)")))
    as_set = F.when(F.size(want) == 0, para.rlike("(?i)none") & (F.size(got) == 0)).otherwise(got == want)
    return (
        F.when(kind == "number", number).when(kind == "login", login)
        .when(kind == "yesno", verdict).when(kind == "set", as_set)
    )


def finished(status: Column, error: Column) -> Column:
    return (status == "ok") | no_answer(status, error)


def no_answer(status: Column, error: Column) -> Column:
    return (status == "error") & F.coalesce(F.startswith(error, F.lit("denied:")), F.lit(False))


def run_keys(runs: DataFrame) -> list[str]:
    """What one run is known by; a log of several models says which model it was."""
    return [c for c in ("task", "arm", "rep", "model") if c in runs.columns]


def pending_runs(tasks: DataFrame, arms: list[str], reps: int, runs: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Task × arm × repetition (× model) still to run; arms, repetitions and models are short fixed lists.

    With ``models`` a run finishes the task for its own model only.
    """
    planned = tasks.select("task", F.explode(F.array(*map(F.lit, arms))).alias("arm")).select(
        "task", "arm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))
    keys = ["task", "arm", "rep"]
    if models is not None:
        planned, keys = planned.select("*", F.explode(F.array(*map(F.lit, models))).alias("model")), [*keys, "model"]
    done = runs.where(finished(F.col("status"), F.col("error"))).select(*keys)
    return planned.join(done, keys, "left_anti")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest finished row per task, arm, repetition and model.

    ``max_by`` is partial before the shuffle, so a repetition that was retried very often
    costs one row per map task.
    """
    keys = run_keys(runs)
    rest = [c for c in runs.columns if c not in keys]
    done = runs.where(finished(F.col("status"), F.col("error")))
    return done.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")


def summarize_runs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per arm (and model, if the log has it): right, wrong, abstained, no answer, averages and total cost, all regraded.

    ``tasks`` has ``task, kind, expect_text, expect_numbers``.
    """
    graded = latest_runs(runs).drop("correct").join(tasks, "task").withColumns({
        "none": no_answer(F.col("status"), F.col("error")),
        "right": (F.col("status") == "ok") & F.coalesce(
            grade(F.col("kind"), F.col("expect_text"), F.col("expect_numbers"), F.coalesce("answer", F.lit(""))), F.lit(False)),
    }).withColumn("abstained", (F.col("status") == "ok") & ~F.col("right") & last_paragraph(F.coalesce("answer", F.lit(""))).rlike(ABSTAINED))
    average = lambda c: F.floor(F.sum(c) / F.count(F.lit(1)) + 0.5).cast("long")
    tenth = lambda c: F.floor(10 * F.sum(F.coalesce(F.col(c), F.lit(0))) / F.count(F.lit(1)) + 0.5).cast("long")
    return graded.groupBy(*[k for k in run_keys(runs) if k in ("arm", "model")]).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("right").alias("correct"),
        F.count_if(~F.col("right") & ~F.col("none") & ~F.col("abstained")).alias("wrong"),
        F.count_if("abstained").alias("abstained"),
        F.count_if("none").alias("no_answer"),
        tenth("more_calls").alias("recovery_calls_x10"),
        tenth("turns").alias("turns_x10"),
        average("input_tokens").alias("input_tokens"),
        average("seconds").alias("seconds"),
        F.sum(F.round(F.col("cost_usd") * 100).cast("long")).alias("cost_cents"),
    )


def wrong_answers(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Answers that were given and are wrong, with what was expected."""
    graded = latest_runs(runs).drop("correct").join(tasks, "task").where("status = 'ok'")
    right = F.coalesce(grade(F.col("kind"), F.col("expect_text"), F.col("expect_numbers"), F.coalesce("answer", F.lit(""))), F.lit(False))
    abstained = last_paragraph(F.coalesce("answer", F.lit(""))).rlike(ABSTAINED)
    return graded.where(~right & ~abstained).select(*run_keys(runs), "answer", "expect_text", "expect_numbers")


def audit(shaped: DataFrame) -> DataFrame:
    """``(payload_id, broken ARRAY<string>)``: the rules a shaped payload breaks, ideally none.

    Rules over the text need nothing else. Rows of ``shape.audited_payloads`` also carry the source and the page that the hint leads
    to: then every value shown, in rows and as the same in every record, is parsed back and compared with the source's, both ways,
    and the hint must name the first record not shown and lead to a page that shows it.
    """
    body = F.filter(F.split("text", "\n"), lambda x: ~F.startswith(x, F.lit("#")))
    cut = F.col("records") - F.col("start") - F.col("shown")
    rules = {
        "over_budget": ~F.col("fallback") & (F.col("output_tokens") > F.col("budget")),
        "row_not_json": F.exists(body, lambda x: F.try_parse_json(x).isNull()),
        "rows_not_shown": F.size(body) != F.col("shown"),
        "cut_not_declared": ~F.col("fallback") & (cut > 0) & ~F.col("text").contains(F.concat(F.lit("# "), cut, F.lit(" records not shown"))),
        "cap_not_smaller": F.coalesce(F.col("cut_cap") >= F.col("longest"), F.lit(False)),
    }
    done = shaped.where("passthrough IS NULL")
    if "source" in shaped.columns:
        aliases = F.col("source.aliases") if "aliases" in shaped.schema["source"].dataType.names else F.lit(None).cast("map<string,string>")
        page = lambda at: F.struct(*(at(c) for c in ("text", "start", "shown", "fallback", "cut_cap")))
        differs = jsontasks.differs_from_source(
            F.col("source.text"), F.col("source.path"), aliases, F.col("row_fields"), F.col("hoisted"),
            F.array(page(F.col), F.when(F.col("after").isNotNull(), page(lambda c: F.col(f"after.{c}")))))
        end = F.col("start") + F.col("shown")
        leads = (F.col("asked") == end) & (F.col("after.start") == end) & (F.col("after.fallback") | (F.col("after.shown") > 0)) & ~F.get("_differs", F.lit(1))
        named = F.col("hint").contains("{next}") & ~F.col("fallback") & (cut > 0)
        done = done.withColumn("_differs", differs)
        rules |= {"value_not_source": F.get("_differs", F.lit(0)), "hint_broken": F.coalesce(named, F.lit(False)) & ~F.coalesce(leads, F.lit(False))}
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return done.select("payload_id", broken.alias("broken"))
