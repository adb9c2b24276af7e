"""Every registered query with its checking SQL, by name."""

from __future__ import annotations

from cutledger.plans.catalog import budgets, calls, declared, depth, evaluation, fields, parsing, profiles, recovery, sources

CATALOG = {
    **sources.QUERIES, **parsing.QUERIES, **depth.QUERIES, **fields.QUERIES, **profiles.QUERIES,
    **budgets.QUERIES, **recovery.QUERIES, **evaluation.QUERIES, **declared.QUERIES, **calls.QUERIES,
}
