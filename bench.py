"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of median seconds."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "description_quality", "suite_row_findings", "check_language_mismatch", "check_duplicate_description",
    "check_duplicate_title", "check_vendor_casing", "check_title_casing_outlier", "check_tag_casing",
    "check_duplicate_sku", "check_weight_units_mixed", "check_price_outlier", "check_missing_sku",
    "peer_outlier_by_part", "check_spelling", "quality_score", "cap_findings", "recheck_merge",
    "full_scan_summary", "daily_snapshot", "validate_values",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("wareproof-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wareproof.plans.queries import QUERIES

    rounds = int(os.environ.get("BENCH_ROUNDS", "1"))
    seconds = {}
    for name in HEADLINE:
        runs = []
        for i in range(rounds + 1):  # the first run warms up
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i or rounds == 0:
                runs.append(time.time() - start)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
