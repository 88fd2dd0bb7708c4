"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` an optional comma list of names.  Every query is built and all its rows are
produced into a sink that drops them; one untimed query warms the JVM up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a2_event_log_scan",
    "b5_diagnose_table",
    "c3_route_all_apps",
    "c12_match_summary",
    "d2_window_aggregation",
    "d2_window_aggregation_5min",
    "d9_top_values_per_window",
    "e2_near_window_match",
    "e3_refinement_cascade",
    "e5_attach_window_features",
    "e7_conversion_budget",
    "e9_final_labels",
    "f17_category_hashes",
    "f19_interactions",
    "g10_target_correlation",
    "g13_correlation_matrix",
    "h1_group_hash_split",
    "h4_stratified_split",
    "h10_dual_holdout",
    "i2_exact_counts",
    "i4_numeric_summary",
    "i8_box_statistics",
    "j1_mutual_information",
    "j2_anova_f",
    "j14_gaussian_naive_bayes",
    "j16_nearest_neighbours",
    "j24_roc_auc",
    "l3_rank_in_group",
    "m7_field_comparison",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)

    from flowsieve.plans.catalogue import load_catalogue, runnable
    from flowsieve.session import build_session

    spark = build_session(
        "flowsieve-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(2, int(cpus) if cpus.isdigit() else 8)),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    catalogue = load_catalogue()

    def run(name: str) -> float:
        start = time.perf_counter()
        runnable(catalogue[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("b4_event_type_counts")
    seconds = {name: round(run(name), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
