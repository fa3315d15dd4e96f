"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from showerloom.plans import catalog

#: first run of each, after one warm-up query; each is counted in full by a no-op write
QUERIES = ("compression_report", "grid_cloud_none", "grid_cloud_ccl4", "dbscan_labels", "clue_labels", "layer_rq", "avg_profiles", "containment_delta")


def main() -> None:
    at = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    found["scan_steps"](spark, at).write.format("noop").mode("overwrite").save()
    took = {}
    for name in QUERIES:
        began = time.time()
        found[name](spark, at).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(at.rstrip("/")).removeprefix("sf")}), flush=True)


if __name__ == "__main__":
    main()
