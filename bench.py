"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("scan_panel", "supplier_signals", "supplier_rank_ic", "weekly_long_short", "tiered_cost", "preflight_rules", "universe_audit",
            "quantile_returns", "cpcv_paths", "capacity_curve", "supplier_search")


def main() -> None:
    from panelwright.plans.queries import QUERIES
    from panelwright.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
