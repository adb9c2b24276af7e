"""Value counts over all records, before any row is cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TOP_VALUES = 20  # fixed value: values named in a count line


def record_values(leaves: DataFrame, *keys: str, rec: str = "rec_idx") -> DataFrame:
    """``(*keys, rec, path, value)``: each distinct scalar value once per record."""
    value = F.coalesce("str", "js")
    return leaves.where(F.col("js").isNotNull() & ~F.col("js").rlike(r"^[\[{]")).select(
        *keys, rec, "path", value.alias("value")).dropDuplicates([*keys, rec, "path", "value"])


def value_counts(values: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """Top values per group with their counts and the number of values not named.

    ``values`` has one row per record and distinct value. Counting is partial before the
    shuffle; the top filter is a row_number limit, which Spark also applies before the
    shuffle, so a group with very many values never lands in one task.
    """
    counted = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), order if order is not None else F.col("value")))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= TOP_VALUES)
    totals = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    return top.join(totals, list(keys)).withColumn(
        "more_values", F.greatest(F.col("n_values") - TOP_VALUES, F.lit(0))).drop("n_values")


def count_items(top: DataFrame, key: str = "payload_id") -> DataFrame:
    """Per payload the named values of every counted path, as ``array<struct<path, items>>``."""
    item = F.struct("rank", F.concat_ws(" ", "value", "n").alias("item"))
    lines = top.groupBy(key, "path").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("items"),
        F.max("more_values").alias("more"),
    )
    more = F.when(F.col("more") > 0, F.concat(F.lit("+"), "more", F.lit(" more values")))
    return lines.groupBy(key).agg(
        F.collect_list(F.struct("path", F.concat_ws(" · ", "items", more).alias("items"))).alias("count_items"))


# Lines in the order the counts were asked for; a path without values has no line.
COUNT_LINES = (
    "transform(filter(o_counts, c -> exists(count_items, i -> i.path = c)), c -> concat('# count by ', c, ' (all ', "
    "n_total, ' records in this response): ', get(filter(count_items, i -> i.path = c), 0).items))"
)
