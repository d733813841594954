"""Times headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from checks.corpus import corpus
from checks.queries import QUERIES

HEADLINE = ("rule_scan", "heuristic_scan", "merged_findings", "scan_report", "report_summary",
            "heuristic_dedup", "table_merge", "context_validate", "classified_findings",
            "keyword_lines", "prompt_render", "prompt_window_join", "training_set",
            "changed_file_scan", "request_batch", "cosine_threshold", "cosine_best",
            "mean_pool", "detector_scan", "semantic_report")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    files = corpus(spark, sf_dir)
    size = files.selectExpr("count(*) AS n", "sum(octet_length(content)) AS bytes").first()
    QUERIES["merged_findings"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    scan = seconds["merged_findings"]
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "files": size.n, "megabytes": round(size.bytes / 1e6, 1),
        "scan_files_per_second": round(size.n / scan),
        "scan_megabytes_per_second": round(size.bytes / 1e6 / scan, 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
