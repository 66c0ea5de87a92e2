"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is written to the no-op sink, so all of its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans.catalog import REG
from barloom.session import local_session

HEADLINE = (
    "session_bars", "resample_weekly", "period_status", "weekly_indicator_snapshot", "daily_feature_rows", "upsert_merge", "batch_classification",
    "latest_vintage_as_of", "trades_asof_price", "position_replay", "average_cost_ledger", "account_returns", "money_weighted_returns", "label_losses",
    "temperature_calibration", "fan_quantiles", "similar_windows", "rule_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus=cpus, app="barloom-bench")
    REG.queries["session_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    times = {}
    for name in only:
        start = time.perf_counter()
        REG.queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
