"""Times the headline queries and prints one line of JSON: the median of three warm runs of each, in seconds."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from strandloom.plans.registry import QUERIES

HEADLINE = {
    "bundled_links": "p08_p09_g01_bundled_links",
    "library_stats": "a02_library_stats",
    "coverage": "a03_coverage",
    "percentile_outliers": "p11_outliers",
    "connected_components": "g02_components",
    "betweenness": "g04_betweenness",
    "orientation": "g08_orientation",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, key in HEADLINE.items():
        runs = []
        for _ in range(4):
            began = time.time()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
