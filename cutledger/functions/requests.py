"""Rules of the six request forms as data, and one expression that names the first broken one."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from cutledger.functions import rules as r
from cutledger.sources import pages as pg


class Rule(NamedTuple):
    """A field of a form: a text, an integer or a list of texts; ``low`` and ``high`` bound its length, value or size."""

    field: str
    kind: str
    low: int | None = None
    high: int | None = None
    required: bool = True
    pattern: str | None = None
    options: tuple[str, ...] | None = None


# Forms and their ranges (fixed values).
_OWNER = Rule("owner", "text", 1, r.MAX_SLUG, pattern=r.OWNER_SLUG)
_REPO = Rule("repo", "text", 1, r.MAX_SLUG, pattern=r.REPO_SLUG)
_BUDGET = Rule("budget_tokens", "integer", r.MIN_BUDGET, r.MAX_BUDGET, required=False)
_SESSION = Rule("session_id", "text", required=False)
_TYPE = Rule("object_type", "text", options=tuple(pg.HUBSPOT_PROPERTIES))
FORMS = {
    "github_search_issues": [_OWNER, _REPO, Rule("query", "text", 1, r.MAX_QUERY), Rule("page", "integer", 1, r.MAX_PAGE, required=False), _BUDGET, _SESSION],
    "github_get_issue": [_OWNER, _REPO, Rule("issue_number", "integer", 1), Rule("fields", "texts", 1, len(pg.GITHUB_DETAIL_FIELDS), options=tuple(pg.GITHUB_DETAIL_FIELDS)), _SESSION],
    "jira_search_issues": [Rule("jql", "text", 1, 1024), Rule("cursor", "text", required=False), _BUDGET, _SESSION],
    "jira_get_issue": [Rule("issue_key", "text", 1, 64), Rule("fields", "texts", 1, len(pg.JIRA_DETAIL_FIELDS), options=tuple(pg.JIRA_DETAIL_FIELDS)), _SESSION],
    "hubspot_search": [_TYPE, Rule("after", "text", required=False), Rule("properties", "texts", required=False), _BUDGET, _SESSION],
    "hubspot_get_record": [_TYPE, Rule("id", "text", 1, 100), Rule("properties", "texts", 1), _SESSION],
}


def _within(value: Column, rule: Rule) -> Column:
    low = F.lit(True) if rule.low is None else value >= rule.low
    return low if rule.high is None else low & (value <= rule.high)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _holds(value: Column, rule: Rule) -> Column:
    """Whether a VARIANT value has the rule's type and range; NULL counts as no."""
    as_ = lambda kind: F.try_variant_get(value, "$", kind)
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    if rule.kind == "integer":
        number = as_("double")
        return ~F.schema_of_variant(value).isin("STRING", "BOOLEAN") & (number == F.floor(number)) & _within(number, rule)
    if rule.kind == "texts":
        known = F.lit(True) if rule.options is None else F.size(F.array_except(as_("array<string>"), F.array(*map(F.lit, rule.options)))) == 0
        return F.forall(as_("array<variant>"), is_text) & _within(F.size(as_("array<variant>")), rule) & known

    def fits(text: Column) -> Column:
        form = F.lit(True) if rule.pattern is None else text.rlike(rule.pattern)
        return _within(F.length(text), rule) & form & (F.lit(True) if rule.options is None else text.isin(*rule.options))

    return is_text(value) & _let(as_("string"), fits)


def request_problem(form: Column, args: Column) -> Column:
    """The first field of a request that breaks its form's rules; ``form`` if the form is unknown, ``args`` if they are no JSON object.

    NULL when the request is valid. An optional field may be missing but not null. Fields that a form doesn't know are ignored.
    Arguments may be long, so they are parsed once, and the values of a request are taken apart once.
    """

    def problem(values: Column) -> Column:
        value = lambda rule: F.try_element_at(values, F.lit(rule.field))
        broken = lambda rule: F.when(F.map_contains_key(values, rule.field), ~F.coalesce(_holds(value(rule), rule), F.lit(False))).otherwise(F.lit(rule.required))
        first = F
        for name, fields in FORMS.items():
            first = first.when(form == name, F.coalesce(F.when(values.isNull(), "args"), *[F.when(broken(rule), rule.field) for rule in fields]))
        return first.otherwise("form")

    return _let(F.try_variant_get(F.try_parse_json(args), "$", "map<string,variant>"), problem)
