"""Token budgets over a table of costed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HINT_STEP = 100  # fixed value: a suggested budget is rounded up to this
MAX_BUDGET = 8192  # fixed value: beyond it, narrow the query
MIN_ROOM = 64  # fixed value: least room for rows next to a receipt


def budget_pack(rows: DataFrame, by: str, idx: str, cost: str, max_tokens: Column | int,
                header_cost: Column | int = 0, offset: int = 0) -> DataFrame:
    """Rows of the longest prefix with ``header + sum(cost + 1) <= max_tokens``.

    ``idx`` is the dense 0-based position in the group. Every row costs at least one, so at
    most ``max_tokens`` rows can fit and later ones are dropped before the window sees them;
    the window group is bounded by the budget, not by the data.
    """
    budget = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    header = F.lit(header_cost) if isinstance(header_cost, int) else header_cost
    near = rows.where((F.col(idx) >= offset) & (F.col(idx) < F.lit(offset) + budget))
    running = W.partitionBy(by).orderBy(idx).rowsBetween(W.unboundedPreceding, W.currentRow)
    used = F.sum(F.col(cost) + 1).over(running)
    return near.withColumn("used", used + header).where(F.col("used") <= budget)


def page_start(offset: Column, total: Column) -> Column:
    """Offset clamped to [0, total]."""
    return F.least(F.greatest(offset, F.lit(0)), total)


def page_label(start: Column, shown: Column) -> Column:
    """The range shown, 1-based; NULL for the first page and for an empty one."""
    return F.when((start > 0) & (shown > 0), F.concat(F.lit("(records "), start + 1, F.lit("–"), start + shown, F.lit(")")))


def needed_budget(full_tokens: Column) -> Column:
    """The budget that shows everything, rounded up."""
    return (F.ceil(full_tokens / HINT_STEP) * HINT_STEP).cast("long")


def budget_hint(full_tokens: Column, records: Column, tool: str) -> Column:
    need = needed_budget(full_tokens)
    enough = F.concat(F.lit(f"call {tool} again with budget_tokens="), need, F.lit(" to see all "), records)
    narrow = F.concat(F.lit("narrow the query to see them; all "), records, F.lit(f" need over {MAX_BUDGET} tokens"))
    return F.when(need <= MAX_BUDGET, enough).otherwise(narrow)


def receipt_room(max_tokens: Column, receipt_cost: Column) -> Column:
    """Tokens left for rows and notes below a receipt and its line break."""
    return max_tokens - receipt_cost - 1


def next_offset(offset: Column, shown: Column, total: Column) -> Column:
    """Where the next page starts, NULL when everything has been shown."""
    return F.when(offset + shown < total, offset + shown)
