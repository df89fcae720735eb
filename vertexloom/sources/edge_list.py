"""Text edge lists: one edge ``a b`` (a -> b) a line, separated by any white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.scalars import parse_edge


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst. Lines without two numbers (comments, empty lines) are left out."""
    src, dst = parse_edge(F.col("value"))
    return spark.read.text(path).select(src.alias("src"), dst.alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def write_edge_list(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws("\t", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def write_partitions(edges: DataFrame, path: str) -> None:
    """Edges (pid, src, dst) as Parquet, a folder for each partition number."""
    edges.repartition("pid").sortWithinPartitions("pid", "dst", "src").write.mode("overwrite").partitionBy("pid").parquet(path)


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """pid, src, dst; a filter on pid reads the folders of those partitions only."""
    return spark.read.schema("src long, dst long, pid long").parquet(path).select("pid", "src", "dst")


def write_degrees(degrees: DataFrame, path: str) -> None:
    """(id, degree) as text, one pair a line."""
    degrees.select(F.concat_ws("\t", *degrees.columns).alias("value")).write.mode("overwrite").text(path)


def dataset_size(spark: SparkSession, path: str) -> DataFrame:
    """n_files and n_bytes of a folder, through Spark's own file listing."""
    return spark.read.format("binaryFile").load(path).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
