"""Headline queries, each run to completion once; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from pyspark.sql import SparkSession

HEADLINE = ["flagship_node_match", "j1_centroid_suppression", "m1_average_precision", "j15_failure_buckets", "t2_tile_assignment", "x2_tag_parse",
            "q3_get_neighbors", "g3_components", "g4_eliminate", "l8_endpoint_binding", "l15_corridor"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "20g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from checks import all_queries
    queries, took, began = all_queries(), {}, time.time()
    each, limit = (float(os.environ.get(k, d)) for k, d in (("BENCH_QUERY_S", 240), ("BENCH_TOTAL_S", 1300)))
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        if time.time() - began > limit:
            print(name, "left out: the time for this run is over", file=sys.stderr, flush=True)
            continue
        t = time.time()
        # a query over its limit is cancelled and has no time; the others still count
        timer = threading.Timer(each, spark.sparkContext.cancelAllJobs)
        timer.start()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - t, 3)
        except Exception as e:
            print(name, "stopped:", str(e)[:200], file=sys.stderr, flush=True)
        timer.cancel()
        print(name, took.get(name), file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
