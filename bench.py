"""Headline queries over the driver's tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.intake_queries import intake_queries, opened_chunks, recorded
from checks.queries import all_queries
from checks.sample_view import distinct_table, event_table, long_visits, people_table, session_table
from footlog.session import local_session

HEADLINES = [
    "e01_timeseries", "e17_pages_top", "e20_pages_detail", "e70_bundle_scalars", "e72_period_comparison", "e72_unique_comparison_bitmaps", "e78_segment_change",
    "f01_sessions", "f01_sessions_over_days", "d05_entry_exit_filter", "f10_journeys", "f13_funnel_repeats", "f15_retention", "f16_accounting", "f16_accounting_ledger", "f20_plan_changes", "f24_people", "f24_people_ledger",
    "f36_portfolio", "f40_revenue_by_channel", "f44_vitals_overview", "f50_geo_sessions",
    "c01_sessions", "b24_reject_reasons", "b14_request_channels", "a05_import_summary", "f52_heatmap_points", "e80_claim_check",
    "c04_recordings", "f55_replay_list", "f57_markers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "16g")
    queries = intake_queries() | all_queries()
    times = {}
    # Tables written once: the partitioned events with their sessions, the side tables of sessions, people and ids, opened and placed chunks.
    writes = {
        "event_table_write": event_table, "session_table_write": session_table, "long_visits_write": long_visits, "people_table_write": people_table,
        "distinct_table_write": distinct_table,
        "chunks_open": opened_chunks, "chunks_place": recorded,
    }
    for name, write in writes.items():
        started = time.perf_counter()
        write(spark, sf_dir)
        times[name] = round(time.perf_counter() - started, 3)
    for name in HEADLINES:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
