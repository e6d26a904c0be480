"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
Each query runs whole, its result going to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from regspark.session import local_session
from workload import all_queries

HEADLINE = (
    "repos_per_month", "month_histogram", "status_histogram", "top_origins", "repos_per_secret",
    "secret_repo_layer_counts", "layer_uniqueness", "filetype_frequency", "file_size_stats", "layer_stats",
    "has_secret_exists", "random_tag_lateral", "link_pairs", "secret_occurrences", "upsert_replace",
    "upsert_coalesce", "surrogate_ids", "gap_thinning", "sentinel_fill", "rank_in_query", "first_seen_rank",
    "reservoir", "stratified_bytes", "bias_table", "bias_bins", "ks_2samp", "chi2_gof", "association_metrics",
    "feature_row", "spearman_per_group", "ndcg_per_group", "secret_findings", "scan_distinct",
    "jsonl_scan", "stream_dedup",
    "run_study", "run_validation", "import_all", "ranking_quality", "layer_secret_list",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    queries = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("repos_per_month")  # starts the JVM's compilers and caches
    times: dict[str, float] = {}
    for name in HEADLINE:
        times[name] = run(name)
        print(f"{times[name]:8.3f} {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
