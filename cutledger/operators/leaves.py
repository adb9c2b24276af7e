"""The long leaf table: one row per leaf of every record, by a chain of variant explodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cutledger.functions import jsonfold, jsontasks
from cutledger.functions.jsonwalk import UNROLLED
from cutledger.functions.rules import machine_url


def leaf_values(records: DataFrame, *keys: str, column: str = "rec", unrolled: int = UNROLLED) -> DataFrame:
    """``(*keys, path, apath, ord, js, str)`` for every leaf at any depth.

    Arrays are transparent in ``path``; ``apath`` stops at the first array. ``ord`` holds
    the positions walked, so it orders the leaves of a record. ``js`` is the JSON text, NULL
    for null, "", [] and {}; ``str`` is the value of a string leaf. The explodes keep the
    input partitioning, so nothing is shuffled here. Containers below the unrolled levels are
    folded in the row that holds them.
    """
    spark = records.sparkSession
    level = records.select(
        *keys,
        F.col(column).alias("node"),
        F.lit("").alias("path"),
        F.lit("").alias("apath"),
        F.lit(False).alias("in_array"),
        F.expr("cast(array() AS array<int>)").alias("ord"),
    )
    for _ in range(unrolled):
        step = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("node").outer()))
        named = F.col("key").isNotNull()
        child = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        array_now = F.col("in_array") | (F.col("pos").isNotNull() & F.col("key").isNull())
        level = step.select(
            *keys,
            F.coalesce("value", "node").alias("node"),
            F.when(named, child).otherwise(F.col("path")).alias("path"),
            F.when(named & ~F.col("in_array"), child).otherwise(F.col("apath")).alias("apath"),
            array_now.alias("in_array"),
            F.concat("ord", F.array(F.coalesce("pos", F.lit(-1)))).alias("ord"),
        )
    level = level.withColumn("js", F.expr("to_json(node)"))
    own = "named_struct('path', path, 'apath', apath, 'i', 0, 'js', js)"
    rows = level.select(*keys, "ord", F.expr(
        f"inline(CASE WHEN {jsonfold.is_container('js')} THEN {jsonfold.leaves('js', 'path', 'apath', 'in_array')} ELSE array({own}) END)"))
    filled = ~F.col("js").isin("null", '""', "[]", "{}")
    return rows.select(
        *keys, "path", "apath", F.concat("ord", F.array("i")).alias("ord"),
        F.when(filled, F.col("js")).alias("js"),
        F.when(filled & F.col("js").startswith('"'), F.expr(jsonfold.unquoted("js"))).alias("str"),
    )


def walked_leaves(records: DataFrame, *keys: str, column: str = "rec") -> DataFrame:
    """The rows of ``leaf_values``, each record walked by one pass over its text in an Arrow task.

    Much faster for deep records. Spark forgets how the rows were partitioned, so use it where no step groups by payload.
    """
    rows = records.select(*keys, F.posexplode(jsontasks.leaf_list(F.col(column))).alias("i", "leaf"))
    return rows.select(*keys, "leaf.path", "leaf.apath", F.array("i").alias("ord"), "leaf.js", "leaf.str")


# All dotted prefixes of a path, shortest first.
PREFIXES = "transform(sequence(1, size(split(path, '[.]'))), i -> substring_index(path, '.', i))"


def record_paths(leaves: DataFrame, key: str = "payload_id", rec: str = "rec_idx") -> DataFrame:
    """One row per ``(key, rec, path)``: ordered values, counts and how the record looks.

    ``empty_top`` is the top-most path above an empty leaf that holds no value in its record.
    ``shape`` lists the filled paths of the record, on one of its rows. No group here is larger
    than a record.
    """
    filled = F.col("js").isNotNull()
    # A record without keys has one row of the empty path, so its empty shape counts.
    rows = leaves.groupBy(key, rec, "path").agg(
        F.min("apath").alias("apath"),
        F.min("ord").alias("first_ord"),
        F.count("js").alias("n_values"),
        F.count("str").alias("n_strings"),
        F.coalesce(F.sum(F.length("str")), F.lit(0)).alias("string_chars"),
        F.count_if(machine_url(F.col("str"))).alias("n_links"),
        F.array_sort(F.collect_list(F.when(filled, F.struct("ord", "js")))).alias("vals"),
    )
    vals = F.when(F.col("n_values") > 0, F.array_join(F.transform("vals", lambda v: v["js"]), ","))
    path = F.struct("path", "apath", F.expr(PREFIXES).alias("prefixes"), "first_ord", "n_values", "n_strings",
                    "string_chars", "n_links", vals.alias("vals"))
    records = rows.groupBy(key, rec).agg(F.collect_list(path).alias("paths")).withColumn(
        "filled", F.expr("filter(paths, p -> p.n_values > 0)")
    ).withColumns({
        "filled_prefixes": F.expr("array_distinct(flatten(transform(filled, p -> p.prefixes)))"),
        "record_shape": F.expr("array_sort(transform(filled, p -> named_struct('path', p.path, 'apath', p.apath)))"),
    })
    one = records.select(key, rec, "filled_prefixes", "record_shape", F.posexplode_outer("paths").alias("i", "p"))
    top = F.expr("CASE WHEN p.n_values = 0 AND p.path <> '' THEN get(array_except(p.prefixes, filled_prefixes), 0) END")
    return one.select(key, rec, "p.*", top.alias("empty_top"), F.when(F.col("i") == 0, F.col("record_shape")).alias("shape"))


def path_profile(paths: DataFrame, key: str = "payload_id", rec: str = "rec_idx") -> DataFrame:
    """One row per ``(key, path)`` with everything the field rules and declarations need.

    The grouping keys start with ``key``, so an input partitioned by ``key`` is not shuffled.
    """
    return paths.groupBy(key, "path").agg(
        F.first("prefixes").alias("prefixes"),
        F.min(F.struct(rec, "first_ord")).alias("first_seen"),
        F.sum("n_values").alias("n_values"),
        F.sum("n_strings").alias("n_strings"),
        F.sum("string_chars").alias("string_chars"),
        F.sum("n_links").alias("n_links"),
        F.count("vals").alias("n_records"),
        F.min("vals").alias("min_vals"),
        F.max("vals").alias("max_vals"),
        F.max(F.when(F.col("vals").isNotNull(), F.col("n_values"))).alias("vals_per_record"),
        F.collect_set("empty_top").alias("empty_tops"),
        F.collect_set("shape").alias("shapes"),
    )
