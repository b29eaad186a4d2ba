"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

QUERIES = (
    "match_path2",
    "match_triangle",
    "match_cycle4",
    "match_exploded",
    "evolve_events",
    "causal_pairs",
    "branchial_pairs",
    "canonical_states",
    "transitive_reduction",
    "evolution_causal_branchial_graph",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from braidwork import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = catalog.queries()
    run[QUERIES[0]](spark, sf).write.format("noop").mode("overwrite").save()  # the JVM is warm from here on
    took = {}
    for name in QUERIES:
        start = time.perf_counter()
        run[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
