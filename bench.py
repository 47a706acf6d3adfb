"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

``BENCH_QUERIES`` (comma separated names) replaces the default list.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from netreach.registry import catalog  # noqa: E402

HEADLINE = [
    "A1_weekly_od", "A4_weekly_totals", "A7_period_stats", "A11_county_monthly", "A16_od_flow_stats",
    "C4_county_clinical", "R1_pooled_clinical_range", "R2_import_risk", "R5_weekly_risk_summary",
    "N1_site_edges", "N2_components", "N3_nearest_other", "K2_month_rank_table",
    "V2_link_weights_intensity_exp", "V3_union_coverage_cap_sum", "V4_coverage_table",
    "X1_select_sites", "B2_greedy_new_area", "B5_farthest_first", "E9_evaluate",
    "G4_uncovered_population", "M3_projections", "M9_diffuse", "M22_perturbation", "M25_series_corr",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("netreach-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # JVM start-up
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        # writing to nowhere computes every row and column without moving results to the driver
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
