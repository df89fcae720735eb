"""Edges that arrive as files: degrees and weak components kept up to date in micro-batches.

An extension; results equal a batch run over all edges seen so far. State lives in versioned Parquet
folders, so a batch that is run again writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexloom.plans.contraction import weak_components
from vertexloom.plans.graph import Graph

EDGE_SCHEMA = "src long, dst long"


def _state(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/v={version}") if version >= 0 else spark.createDataFrame([], schema)


def maintain_degrees(spark: SparkSession, incoming: str, state: str, checkpoint: str) -> StreamingQuery:
    """Start a query that adds new edge files in ``incoming`` to the degrees at ``state``; it ends when all is read."""

    def add(batch: DataFrame, number: int) -> None:
        new = batch.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(batch.select("dst", F.lit(0), F.lit(1)))
        old = _state(spark, state, number - 1, "id long, out_degree long, in_degree long").select("id", F.col("out_degree").alias("o"), F.col("in_degree").alias("i"))
        out = new.union(old).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        out.write.mode("overwrite").parquet(f"{state}/v={number}")

    edges = spark.readStream.schema(EDGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(incoming)
    return edges.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def degrees_at(spark: SparkSession, state: str, version: int) -> DataFrame:
    return _state(spark, state, version, "id long, out_degree long, in_degree long")


def maintain_components(spark: SparkSession, incoming: str, state: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps the weak components of all edges seen so far at ``state``; it ends when all is read.

    A batch contracts its own edges and the links from each known vertex to its component, not older edges.
    """

    def add(batch: DataFrame, number: int) -> None:
        old = components_at(spark, state, number - 1)
        links = batch.select("src", "dst").union(old)
        ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
        weak_components(Graph(ids, links)).write.mode("overwrite").parquet(f"{state}/v={number}")

    edges = spark.readStream.schema(EDGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(incoming)
    return edges.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def components_at(spark: SparkSession, state: str, version: int) -> DataFrame:
    return _state(spark, state, version, "id long, min_id long")
