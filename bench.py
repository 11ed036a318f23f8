"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores, BENCH_RUNS
how often each query runs (the last run counts). Results are computed in full and thrown away.
"""

import json
import os
import sys
import time

from harborlens.plans.catalog import QUERIES
from harborlens.session import local_session

HEADLINE = [
    "weekly_stock_value_by_type",
    "product_pnl",
    "pnl_by_level",
    "running_balance",
    "month_end_snapshots",
    "replenishment",
    "allocate_stock",
    "fifo_batches",
    "clip_ledger",
    "shortfall",
    "impacted_orders",
    "bom_requirements",
    "metrics",
    "metric_list",
    "route_messages",
    "run_checks",
    "content_manifest",
    "dirty_keys",
    "what_if_pricing",
    "gen_sales_lines",
    "radius_join",
    "radius_counts",
    "cosine_topk",
    "cosine_radius_graph",
    "select_entities",
    "reachable",
    "connected_components",
    "dag_depth",
    "build_url_corpus",
    "repetition_filter",
    "language_filter",
    "evaluate",
    "distinctiveness",
    "stream_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    seconds = {}
    for name in wanted:
        for _ in range(runs):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
