"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder (default sf0.1), ``BENCH_CPUS`` the local cores. Each query runs to a
sink that throws the rows away, once to warm up and then ``BENCH_RUNS`` times; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "exec_metrics", "exec_rollup", "exec_with_tasks", "task_pipeline", "task_timeline", "status_transitions",
    "version_history", "function_rates", "agg_merge", "agg_concat", "agg_reduce", "collector", "shard_hash",
    "shard_round_robin", "transform_map", "join_theta", "backoff_schedule", "retry_stats", "validate_rules",
    "validate_json", "validate_all", "dq_verdict", "dlq_route", "dlq_stats", "log_query", "log_facets",
    "log_retain_last", "metric_counter", "metric_histogram", "metric_summary", "metric_window",
    "activity_sessions", "worker_liveness", "checksum", "doc_chunks", "transfer_batch", "distinct_first",
    "fn_string", "fn_encode", "dag_levels", "udaf_custom", "function_chain", "stream_metrics", "stream_rollup",
]


def main() -> None:
    from millrace.plans.catalog import QUERIES
    from millrace.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = max(int(os.environ.get("BENCH_RUNS", "2")), 1)
    spark = local_session("bench", cores=cpus)

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in HEADLINE:
        once(name)
        times[name] = round(min(once(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
