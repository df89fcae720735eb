"""Headline queries, timed: one JSON line. BENCH_SF_DIR, BENCH_CPUS. Each is run once to warm up; the median of three more counts."""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

QUERIES = ["pagerank_10", "sssp_dense", "cc_min", "wcc", "in_degree_multi", "partition_summary", "reciprocal_count", "triangle_total", "gather_sum"]


def main() -> None:
    from pyspark.sql import SparkSession

    from vertexloom.plans import algorithms, derived
    from vertexloom.plans.queries import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # on the larger tables vertex 1 reaches nobody in the sparse graph, so hops are timed on the dense one
    run = queries() | {"sssp_dense": lambda s, d: algorithms.sssp(derived.dense(s, d), mode="frontier").state}
    times = {}
    for name in QUERIES:
        took = []
        for _ in range(4):
            began = time.time()
            run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        times[name] = round(statistics.median(took[1:]), 3)
    spark.stop()
    out = {"metric": "graph queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
