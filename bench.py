"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from cutledger.plans.catalog import CATALOG
from cutledger.plans.shape import shape_payloads
from cutledger.session import configure
from cutledger.sources import views

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "token_counts", "records_exploded", "auto_fields_conv", "constant_fields", "value_counts_top20", "frame_profile",
    "budget_pack", "frame_budget", "pick_paths", "pages_normalized", "validate_recovery", "assign_aliases", "summarize_runs",
]


def run(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    views.table(spark, SF_DIR, "orders").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(CATALOG[name][0](spark, SF_DIR))
        seconds[name] = round(time.perf_counter() - start, 3)
    for budget in (500, 2000, 8000):
        start = time.perf_counter()
        run(shape_payloads(views.order_payloads(spark, SF_DIR), fields="auto", max_tokens=budget, hint="offset={next}"))
        seconds[f"shape_orders_{budget}"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    run(shape_payloads(views.document_payloads(spark, SF_DIR), fields="auto", max_tokens=8000))
    seconds["shape_documents_8000"] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
