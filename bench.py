"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, or "all").  Every query runs to completion into a sink that
discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "panel_minimum_slice", "modelling_table", "hourly_to_daily_complete", "antecedent7_lag3", "asof_latest_available", "longest_run",
    "dedupe_keep_last", "history_upsert", "split_masks", "scores_by_lead", "scores_sliced", "contingency", "bootstrap_skill_ci",
    "conserve_rain", "conservation_report", "bias_oof", "idw_knn", "idw_all_parents", "weighted_mean_nullaware", "zonal_stats",
    "focal_tpi", "slope_aspect", "components_min_area", "polygon_grid_weights", "largest_overlap", "point_in_polygon", "locate_with_cap",
    "line_distance", "et0_daily", "rules_weather", "overall_severity", "sms_packed", "message_fanout", "latest_review", "text_clean",
    "grid_file_roundtrip", "issue_payload", "stream_daily", "stream_latest", "ridge_mos",
]


def session(cpus: str):
    from pyspark.sql import SparkSession

    scratch = os.environ.get("FINEGRID_SCRATCH") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("finegrid-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
             .config("spark.checkpoint.dir", scratch).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from finegrid.plans.catalog import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    known = all_queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = session(cpus)
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # starts the engine
    seconds: dict[str, float] = {}
    for name in names:
        t = time.time()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
