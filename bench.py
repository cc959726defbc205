"""Time the headline queries and print one JSON line.

Bars are landed first, as their own entry; every query then starts from the landed bars and the
source tables, and nothing written for an earlier query is reused.
"""

from __future__ import annotations

import json
import os
import time

from barloom.plans import catalog
from barloom.plans.market import market
from barloom.session import local_session

HEADLINE = [
    "clean_bars", "pit_membership", "assemble_bars", "raw_factors", "forward_labels",
    "research_dataset", "latest_scores", "factor_report", "selection_report",
    "market_regime_report", "benchmark_metrics", "drawdown_episode", "order_feasibility",
    "ledger_nav", "order_plan", "select_portfolio", "audit_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's code paths and the file system cache.
    catalog.flagship(spark, sf_dir).count()
    times = {}
    m = market(spark, sf_dir)
    m.forget()
    start = time.perf_counter()
    m.panel  # noqa: B018 - writes bars and panel
    times["land_bars"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        m.forget(("bars", "panel"))
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of landing the bars and of the headline queries",
                "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
