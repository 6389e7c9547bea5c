"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1). BENCH_CPUS: cores (default 8).
Each query is built and run to a discarding sink twice; the faster run counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_sales", "daily_gmv", "weekly_resample", "campaign_lift", "seasonal_trend_forecast",
    "category_trend_forecast", "forecast_additive", "campaign_plan", "forecast_accuracy",
    "sku_rollup", "synth_inventory", "sku_demand", "sku_metrics", "month_topk", "hero_products",
    "discount_scenarios", "scenario_grid", "stockout_risk_count", "dashboard_document",
    "planned_order", "live_gmv_hourly", "live_oos_eta", "live_sessions", "sessions_batch",
    "duplicate_keys", "callout_candidates", "callout_clean",
]
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from tidemark.plans.queries import QUERIES
    from tidemark.session import build_session

    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
