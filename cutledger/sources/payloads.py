"""Reading, archiving and writing payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutledger.operators.positions import group_positions

KEEP_RESPONSES = 50  # fixed value: originals kept per session


def read_payloads(spark: SparkSession, path: str, fmt: str = "text", text: str = "text", key: str | None = None) -> DataFrame:
    """``(payload_id, text)``: whole text files, or rows of a table with a text column."""
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        return files.select(F.col("_metadata.file_path").alias("payload_id"), F.col("value").alias("text"))
    if fmt == "lines":
        # Copies of one text must keep separate ids, so the id is the place in the input.
        return spark.read.text(path).select(
            F.format_string("%s#%d", "_metadata.file_path", F.monotonically_increasing_id()).alias("payload_id"),
            F.col("value").alias("text"))
    rows = spark.read.format(fmt).load(path)
    if key is not None:
        identity = F.col(key).cast("string")
    elif fmt == "parquet":
        identity = F.format_string("%s#%d", "_metadata.file_path", "_metadata.row_index")
    else:
        raise ValueError(f"name the key column of a {fmt} table")
    kept = [c for c in rows.columns if c not in (text, "payload_id")]
    return rows.select(identity.alias("payload_id"), F.col(text).alias("text"), *kept)


def archive(payloads: DataFrame, session: str = "session_id", arrival: str = "arrival", keep: int = KEEP_RESPONSES) -> DataFrame:
    """Originals under a handle ``r<n>`` by arrival; only the latest ``keep`` per session stay.

    ``arrival`` is an integer, unique in its session.
    """
    numbered = group_positions(payloads, [session], arrival)
    latest = numbered.where(F.col("pos") >= F.col("group_rows") - keep)
    return latest.withColumn("handle", F.concat(F.lit("r"), F.col("pos") + 1)).drop("pos", "group_rows")


def write_archive(archived: DataFrame, path: str, partition: str | None = None) -> None:
    writer = archived.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_rendered(shaped: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Rendered text per payload; ``manifest`` has its own table."""
    shaped.select("payload_id", "passthrough", "text").write.mode("overwrite").format(fmt).save(path)


def append_trace(events: DataFrame, path: str) -> None:
    """Append-only JSON lines, one folder per day."""
    events.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").json(path)
