"""Positions and running sums in groups of any size, by segments of the order key.

The key's quantiles over the whole table cut it into segments of about equal size, so a group that holds a
third of all rows is spread over a third of the segments, however its keys are spaced. Inside a segment a window
numbers or sums the rows of each group; what stands before a segment comes from a table of segment totals, which has
at most ``MOST_SEGMENTS`` rows for each group.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SEGMENT_ROWS, MOST_SEGMENTS = 100_000, 4096
MOST_SENT = 20_000  # rows of a table of segments that is broadcast


def segment_bounds(df: DataFrame, key: str, rows: int = SEGMENT_ROWS) -> list:
    """At most ``MOST_SEGMENTS`` keys that part the table into segments of about ``rows`` rows."""
    n = min(MOST_SEGMENTS, -(-df.count() // rows))
    if n < 2:
        return []
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    return sorted(set(df.agg(F.percentile_approx(key, shares, 4 * MOST_SEGMENTS)).first()[0] or []))


def segment_of(key: Column, bounds: list) -> Column:
    """How many bounds are at or below the key, found by halving."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    # Beyond the last bound there is null, which is not below the key.
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= key, at + step).otherwise(at))


def before_segment(rows: DataFrame, by: list[str], total: Column, name: str) -> DataFrame:
    """``(*by, _segment, _t, name)``: ``total`` of the segment, and its sum over the group's earlier segments."""
    earlier = W.partitionBy(*by).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    return rows.groupBy(*by, "_segment").agg(total.alias("_t")).select(*by, "_segment", "_t", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias(name))


def broadcast_few(table: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``table`` computed and broadcast if it has at most ``most`` rows, else as it is."""
    rows = table.limit(most + 1).toArrow()
    return table if rows.num_rows > most else F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that lets null group keys meet."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return left.join(named, cond).drop(*[f"_r_{k}" for k in keys])


def positions(df: DataFrame, by: list[str], key: str, rows: int = SEGMENT_ROWS, reach: list[tuple[int, int]] | None = None) -> DataFrame:
    """Add ``_segment`` and ``pos``, the 0-based place of a row in its group by ``key``, which is unique there.

    With ``reach``, ranges of places (first, last), only rows at these places are returned. Rows of segments that hold none of them
    are dropped where they are read; with more than ``MOST_SENT`` segments left, as many small groups have, by a shuffled join.
    """
    cut = df.withColumn("_segment", segment_of(F.col(key), segment_bounds(df, key, rows)))
    before = before_segment(cut, by, F.count(F.lit(1)), "_before")
    if reach is not None:
        before = broadcast_few(before.where(reduce(or_, [(F.col("_before") <= last) & (F.col("_before") + F.col("_t") > first) for first, last in reach])))
    local = F.row_number().over(W.partitionBy(*by, "_segment").orderBy(key))
    placed = _on(cut, before.drop("_t"), [*by, "_segment"]).withColumn("pos", F.col("_before") + local - 1).drop("_before")
    return placed if reach is None else placed.where(reduce(or_, [F.col("pos").between(first, last) for first, last in reach]))


def running_sum(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` up to and with each row, by ``pos``, to rows of ``positions``."""
    local = F.sum(value).over(W.partitionBy(*by, "_segment").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    before = before_segment(rows, by, F.sum(value), "_before").drop("_t")
    return _on(rows.withColumn("_local", local), before, [*by, "_segment"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local")
