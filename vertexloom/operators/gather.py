"""Single steps of gather and combine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def gather_join(edges: DataFrame, values: DataFrame) -> DataFrame:
    """src, dst and the source's value columns; ``values``: id and values. Spark broadcasts small values by their size."""
    return edges.join(values.withColumnRenamed("id", "src"), "src")


def gather(edges: DataFrame, values: DataFrame, **combine: str) -> DataFrame:
    """For every target the combined values of its in-neighbours: gather(e, v, low="min:value")."""
    sent = gather_join(edges, values)
    aggs = [AGGREGATES[how.split(":")[0]](how.split(":")[1]).alias(name) for name, how in combine.items()]
    return sent.groupBy(F.col("dst").alias("id")).agg(*aggs)


def combine_two_level(edges: DataFrame, values: DataFrame, column, **combine: str) -> DataFrame:
    """As gather, but combined within each source column first and across columns then."""
    sent = gather_join(edges, values).withColumn("col", column)
    parts = {name: how.split(":") for name, how in combine.items()}
    partial = sent.groupBy(F.col("dst").alias("id"), "col").agg(*[AGGREGATES[f](c).alias(name) for name, (f, c) in parts.items()])
    return partial.groupBy("id").agg(*[AGGREGATES[f](name).alias(name) for name, (f, _) in parts.items()])


def apply_to_all(vertices: DataFrame, combined: DataFrame) -> DataFrame:
    """Combined messages for all vertices, null where none came."""
    return vertices.join(combined, "id", "left")


def edge_weights(graph) -> DataFrame:
    """src, dst, weight = 1 / out-degree of the source."""
    d = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
    return graph.edges.join(d, "src").select("src", "dst", (1.0 / F.col("out_degree")).alias("weight"))
