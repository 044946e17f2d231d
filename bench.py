"""Benchmark of the headline queries; prints one JSON line.

Each query runs once cold and once warm on the whole tables, with the result written to the
no-op sink; the warm time is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tabloom import plans
from tabloom.session import local_session

HEADLINE = [
    "p7_drop_high_cardinality", "p9_iqr_filter", "p17_missing_cells",
    "j1_retrieval_lookup", "j4_vocabulary_lookup", "j6_cell_lookup", "j7_best_profile",
    "a3_schema_profile", "a4_target_summary", "a5_class_distribution", "a10_mode", "a12_distinct_counts",
    "a13_sorted_vocabulary", "a18_best_epoch",
    "w1_top_per_group", "w3_schema_runs", "w5_group_median_fill", "w6_ordered_target_statistics",
    "w8_chronological_split", "o1_sort_by_date", "o3_global_topk",
    "t4_standard_scaler", "t6_one_hot", "t11_multi_label", "t14_target_encoder", "t15_text_sequences",
    "t18_column_pipeline", "t20_stratified_split",
    "m3_rmse", "m10_median_absolute_error", "m11_f1_micro_macro", "m16_auc",
    "r3_hybrid_index", "r5_hybrid_topk",
    "h1_page_title", "h2_section_text", "h6_page_text", "h7_reply_validation",
    "s1_sniffed_scan", "k2_append_resume", "x1_incremental_ingest",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8)
    run(spark, "a1_shape", sf_dir)
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, sf_dir), 3)
        warm[name] = round(run(spark, name, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
