"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tickloom.plans.catalogue import QUERIES
from tickloom.sources.stage import forget

HEADLINE = ("bars", "macd", "adx", "entry_state", "exit_signals", "trend_template", "regime_series", "trend_recommend_default", "consensus_ranking", "benchmark_returns", "strategy_table", "exit_variants", "state_regime_axis", "filter_counts")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars"](spark, sf_dir).count()  # starts the JVM's compilers and fills the file cache
    took = {}
    for name in HEADLINE:
        forget()  # each query is timed with the tables that it shares with others
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
