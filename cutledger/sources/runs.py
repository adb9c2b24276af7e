"""The run log of evaluation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUN_SCHEMA = (
    "task string, arm string, rep bigint, model string, status string, correct boolean, answer string, error string, "
    "search_calls bigint, more_calls bigint, input_tokens bigint, output_tokens bigint, seconds bigint, cost_usd double, "
    "turns bigint, cache_write bigint, cache_read bigint, seq bigint"
)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)
