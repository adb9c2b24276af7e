"""Dense positions inside groups that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def group_positions(df: DataFrame, by: list[str], key: str, block: int = 100_000) -> DataFrame:
    """Add ``pos`` (0-based order of ``key`` in its group) and ``group_rows``.

    ``key`` is an integer that is unique in the group. Rows are numbered inside blocks of the
    key, and a small table of block counts gives each block its offset. A block holds at most
    ``block`` rows, so a hot group is spread over as many tasks as it has blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(key) / block).cast("long"))
    counts = blocked.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumns({
        "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "group_rows": F.sum("_n").over(W.partitionBy(*by)),
    }).drop("_n")
    local = F.row_number().over(W.partitionBy(*by, "_block").orderBy(key))
    numbered = blocked.withColumn("_local", local)
    return (
        numbered.join(offsets, [*by, "_block"])
        .withColumn("pos", F.col("_offset") + F.col("_local") - 1)
        .drop("_block", "_offset", "_local")
    )


def first_positions(df: DataFrame, by: list[str], key: str, limit: int, salts: int = 64) -> DataFrame:
    """The first ``limit`` rows of every group by ``key``, with their ``pos``.

    Two steps: per salt, then per group. The first step spreads a hot group over ``salts``
    tasks and keeps ``limit`` rows of each, which always include the group's own first ones.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(key))
    kept = salted.withColumn("_rank", rank(*by, "_salt")).where(F.col("_rank") <= limit).drop("_rank")
    return kept.withColumn("pos", rank(*by) - 1).where(F.col("pos") < limit).drop("_salt")
