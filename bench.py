"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelcast.catalog import REGISTRY
from panelcast.session import build_session

HEADLINE = [
    "daily_slice",
    "scan_range",
    "json_unpack_hourly",
    "upsert_ignore",
    "stream_ingest",
    "completeness_profile",
    "fill_mean",
    "join_inner_ts",
    "join_regions_wide",
    "daily_agg_map",
    "daily_gap_fill",
    "chunk_agg_24",
    "dedupe_first",
    "lags",
    "rolling_full",
    "dew_point",
    "standardize",
    "kmeans_assign",
    "silhouette",
    "kmeans_fit",
    "ar_seasonal_fit",
    "ar_select",
    "backtest_refit",
    "backtest_direct",
    "backtest_frozen",
    "backtest_refit_lags",
    "wide_features",
    "classification_report",
    "next_day_features",
    "forecast_7d",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", int(cpus))
    REGISTRY["season"](spark, sf).write.format("noop").mode("overwrite").save()  # start the engine
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        REGISTRY[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(sf.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
