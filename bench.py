"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from claimcheck import catalog

HEADLINE = [
    "profile_report", "profile_summarize_approx", "profile_null_counts", "dq_numeric_text", "base_facts",
    "sql_guard", "guarded_sql", "passthrough_agg", "passthrough_window", "customer_claims", "judged_findings",
    "recompute_families", "recompute_filters", "recompute_sql", "verdict_summary", "plant_cases", "bench_overall", "bench_by_cell",
    "ml_split", "ml_roc_auc", "ml_fit_predict", "report_problems", "report_roundtrip", "verified_reports", "tool_call_pairs",
    "chat_reshape", "tokens",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimcheck-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.load()
    names = os.environ["BENCH_QUERIES"].split(",") if "BENCH_QUERIES" in os.environ else HEADLINE
    # One untimed query so that the first timed one does not pay for starting up.
    catalog.QUERIES["passthrough_agg"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
