"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_QUERIES (comma separated names, default the list below), BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabloom.session import local_session  # noqa: E402
from tabloom.workloads import QUERIES, runner  # noqa: E402

HEADLINE = [
    "browse_page", "browse_page_info", "filter_rows", "filter_text", "quick_search", "count_exact", "page_offset",
    "page_after_key", "document_filters", "search_index_filters", "key_value_filters", "terms_buckets", "metrics_row",
    "distinct_count_exact", "daily_summary", "compact_sums", "latest_version", "customer_revenue", "revenue_by_segment",
    "payments_by_region", "update_from_aggregate", "orphan_keys", "unique_violations", "table_rules", "infer_fields",
    "documents_to_rows", "items_to_rows", "explode_hash", "text_of_cells", "canon_numbers", "sql_literals", "digest_orders",
    "digest_lineitem", "fingerprint_result", "verify_changed", "edited_rows", "edit_match_counts", "csv_round_trip",
    "tsv_round_trip", "ndjson_round_trip", "insert_batches", "import_rows", "copy_table", "propose_types", "fit_report",
    "radius_join_meters", "shape_columns", "observe_ticks", "alert_value_edge", "run_history", "cron_ticks", "missed_ticks",
    "summary_stream",
]


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    runner(name)(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark = local_session(cpus, "bench")
    # The first job pays for starting the engine, not for a query.
    run(spark, "row_keys_hidden", folder)
    times = {n: round(min(run(spark, n, folder) for _ in range(runs)), 3) for n in names}
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
