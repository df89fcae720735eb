"""The graph that the driver tables hold: parts, linked when they stand on following lines of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_part"))
    both = line.join(after, ["l_orderkey", "l_linenumber"])
    return both.select(F.col("l_partkey").cast("long").alias("src"), F.col("to_part").cast("long").alias("dst"), "l_quantity")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"))


def multi(spark: SparkSession, sf_dir: str) -> Graph:
    """With duplicates and self-loops."""
    return Graph(vertices(spark, sf_dir), _pairs(spark, sf_dir).select("src", "dst"))


def dense(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(vertices(spark, sf_dir), _pairs(spark, sf_dir).where("src <> dst").select("src", "dst"))


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(vertices(spark, sf_dir), _pairs(spark, sf_dir).where("src <> dst AND l_quantity >= 45").select("src", "dst"))


#: The same in SQL.
CTES = """
pairs AS (SELECT CAST(a.l_partkey AS BIGINT) AS src, CAST(b.l_partkey AS BIGINT) AS dst, a.l_quantity AS q
          FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
v AS (SELECT CAST(p_partkey AS BIGINT) AS id FROM part),
em AS (SELECT src, dst FROM pairs),
ed AS (SELECT DISTINCT src, dst FROM pairs WHERE src <> dst),
edm AS (SELECT src, dst FROM pairs WHERE src <> dst),
es AS (SELECT DISTINCT src, dst FROM pairs WHERE src <> dst AND q >= 45),
esm AS (SELECT src, dst FROM pairs WHERE src <> dst AND q >= 45)"""
