"""Session dictionaries of short names for opaque identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cutledger.functions.rules import is_opaque_id
from cutledger.functions.tokens import token_count

BLOCK = 1_000_000
ALIAS_ONLY = r"^@[0-9]+$"  # fixed value


def alias_candidates(values: DataFrame, session: str = "session_id", value: str = "value", seen: str = "seen") -> DataFrame:
    """Distinct opaque ids per session that are worth an alias, with their first appearance.

    ``seen`` orders appearances in a session. The shortest alias costs two tokens, so an id
    must cost more. Aliases from ``@1000`` on cost three or more, which isn't weighed against the id.
    """
    firsts = values.where(is_opaque_id(F.col(value))).groupBy(session, value).agg(F.min(seen).alias("first_seen"))
    return firsts.where(token_count(value) > 2)


def assign_aliases(candidates: DataFrame, known: DataFrame | None = None, session: str = "session_id",
                   value: str = "value", block: int = BLOCK) -> DataFrame:
    """Dictionary ``(session, value, alias_no)`` numbered by first appearance.

    Ids already ``known`` keep their numbers and new ones continue after them. Numbering is
    done in blocks of ``first_seen`` with an offset per block, so a session that holds a large
    share of all ids is spread over many tasks. ``first_seen`` must be an integer that is
    unique per id in its session.
    """
    fresh = candidates
    start = None
    if known is not None:
        fresh = candidates.join(known.select(session, value), [session, value], "left_anti")
        start = known.groupBy(session).agg(F.max("alias_no").alias("_start"))
    blocked = fresh.withColumn("_block", F.floor(F.col("first_seen") / block).cast("long"))
    counts = blocked.groupBy(session, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(session).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if start is not None:
        offsets = offsets.join(start, session, "left").withColumn(
            "_offset", F.col("_offset") + F.coalesce("_start", F.lit(0))).drop("_start")
    local = F.row_number().over(W.partitionBy(session, "_block").orderBy("first_seen", value))
    numbered = blocked.withColumn("_local", local).join(offsets, [session, "_block"]).select(
        session, value, (F.col("_offset") + F.col("_local")).cast("long").alias("alias_no"))
    return numbered if known is None else known.select(session, value, "alias_no").unionByName(numbered)


def apply_aliases(values: DataFrame, dictionary: DataFrame, session: str = "session_id", value: str = "value") -> DataFrame:
    """Add ``shown``: the alias of a value that has one, or the value itself.

    The join key is ``(session, value)``. Every appearance of one hot id shares a key, so the
    side with the appearances is left to the skew handling of the sort-merge join.
    """
    alias = F.concat(F.lit("@"), F.col("alias_no"))
    return values.join(dictionary, [session, value], "left").withColumn("shown", F.coalesce(alias, F.col(value))).drop("alias_no")


def restore_aliases(arguments: DataFrame, dictionary: DataFrame, session: str = "session_id", value: str = "argument") -> DataFrame:
    """Add ``restored``: strings that are exactly a known ``@n`` become the real id again."""
    number = F.when(F.col(value).rlike(ALIAS_ONLY), F.substr(F.col(value), F.lit(2)).try_cast("long"))
    canonical = F.when(F.concat(F.lit("@"), number) == F.col(value), number)
    names = dictionary.select(F.col(session), F.col("alias_no"), F.col("value").alias("real"))
    return (
        arguments.withColumn("alias_no", canonical)
        .join(names, [session, "alias_no"], "left")
        .withColumn("restored", F.coalesce("real", value))
        .drop("alias_no", "real")
    )
