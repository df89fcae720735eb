"""Weakly connected components by star contraction: rounds grow with the logarithm of the diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .graph import Graph
from .lineage import Kept


def weak_components(graph: Graph) -> DataFrame:
    """id, min_id: the smallest vertex of each vertex's weak component.

    Links point from larger to smaller ids. A round hands every vertex's smallest neighbour to its larger
    neighbours, then to its smaller ones; both steps aggregate on the map side before they join. It
    ends when a round leaves the links, by their count and the sum of their hashes, as they were.
    """
    e = graph.edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    spark, before = e.sparkSession, None
    kept = Kept(spark)
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        seen = Observation()
        links = small.where("a <> b").distinct().observe(seen, F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
        e = kept.put(links.withColumn("changed", F.lit(True)))[0].drop("changed")
        now = seen.get["sum"], seen.get["n"]
        if now == before:
            break
        before = now
    return graph.vertices.join(e.withColumnsRenamed({"a": "id", "b": "min_id"}), "id", "left").select("id", F.coalesce("min_id", "id").alias("min_id"))
