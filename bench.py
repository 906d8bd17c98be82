"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line.

Each query is run once to warm up and then timed once, written to a sink that keeps nothing. The start of
the session is not counted. The times of the first run are reported as ``cold``.
"""

from __future__ import annotations

import json
import os
import time

from tallycast.catalog import QUERIES
from tallycast.session import local_session

HEADLINE = [
    "clean_ledger",
    "daily_entity_sum",
    "monthly_series",
    "monthly_series_sparse",
    "series_profile",
    "smart_duration",
    "decompose",
    "seasonality_flag",
    "adf_test",
    "css_scores",
    "seasonal_fit",
    "holt_winters",
    "forecast_models",
    "anomalies_model",
    "backtest_seasonal",
    "forecast_selected",
    "forecast_sparse",
    "by_code_pipeline",
    "whole_ledger_pipeline",
    "usage_overview",
    "duplicate_files",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    warm, cold = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    suppliers = spark.read.parquet(f"{folder}/supplier.parquet").count()
    out = {
        "metric": "total of the headline queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(folder.rstrip("/")),
        "ledger_rows_per_sec": round(lines / warm["monthly_series"]),
        "series_forecast_per_sec": round(suppliers / warm["forecast_selected"], 1),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
