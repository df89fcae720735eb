"""A directed graph as DataFrames: vertices (id) and edges (src, dst), with duplicates kept in ``multi``."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Graph:
    """``vertices``: id (long, dense from 0 where partitions are used). ``multi``: src, dst (long), duplicates and self-loops kept."""

    vertices: DataFrame
    multi: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    @cached_property
    def edges(self) -> DataFrame:
        """Distinct edges; all algorithms run on these."""
        return self.multi.select("src", "dst").distinct()

    @cached_property
    def n(self) -> int:
        return self.vertices.count()

    def hold(self, df: DataFrame) -> DataFrame:
        """Persist (memory, then disk); lost blocks are recomputed from files. ``release`` frees all."""
        self.held.append(df.persist())
        return df

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    def reverse(self) -> Graph:
        return Graph(self.vertices, self.multi.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def symmetrize(self) -> Graph:
        return Graph(self.vertices, self.multi.select("src", "dst").union(self.multi.select("dst", "src")).distinct())

    def _degree(self, of: DataFrame, key: str, name: str) -> DataFrame:
        counts = of.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(name))
        return self.vertices.join(counts, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def in_degrees(self, multi: bool = False) -> DataFrame:
        return self._degree(self.multi if multi else self.edges, "dst", "in_degree")

    def out_degrees(self) -> DataFrame:
        return self._degree(self.edges, "src", "out_degree")

    def stats(self) -> DataFrame:
        v = self.vertices.agg(F.count(F.lit(1)).alias("n_vertices"))
        m = self.multi.agg(F.count(F.lit(1)).alias("n_edges_multi"))
        e = self.edges.agg(F.count(F.lit(1)).alias("n_edges"))
        return v.crossJoin(m).crossJoin(e)  # three single rows

    def in_lists(self) -> DataFrame:
        """In-neighbours of every vertex that has any, sorted."""
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("neighbors"))


def densify(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense ids 0..N-1 for arbitrary ones, in their order: (mapping old, id; edges in new ids).

    Ranks come from range partitions and their offsets, so no task sorts all ids.
    """
    ids = edges.select(F.col("src").alias("old")).union(edges.select("dst")).distinct()
    parts = ids.repartitionByRange("old").withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("old")) - 1)
    sizes = parts.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    mapping = local.join(F.broadcast(offsets), "_p").select("old", (F.col("_r") + F.col("_o")).cast("long").alias("id"))
    new = edges.join(mapping.select(F.col("old").alias("src"), F.col("id").alias("_s")), "src").join(mapping.select(F.col("old").alias("dst"), F.col("id").alias("_d")), "dst")
    return mapping, new.select(F.col("_s").alias("src"), F.col("_d").alias("dst"))
