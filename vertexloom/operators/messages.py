"""Views of a step's messages: changed values only, all values, differences, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sparse messages pay below this share of changed vertices.
SPARSE_BELOW = 0.2


def changed_vertices(step: DataFrame) -> DataFrame:
    """``step``: id, old, new."""
    return step.where(~F.col("new").eqNullSafe(F.col("old")))


def sparse(step: DataFrame) -> DataFrame:
    return changed_vertices(step).select("id", F.col("new").alias("value"))


def dense(vertices: DataFrame, messages: DataFrame, identity) -> DataFrame:
    """A value for every vertex, the combine's identity where there is no message. ``messages``: id, value."""
    return vertices.join(messages, "id", "left").select("id", F.coalesce("value", F.lit(identity)).alias("value"))


def delta(step: DataFrame) -> DataFrame:
    """new - old of the changed vertices; old + delta gives the receiver's new value."""
    return changed_vertices(step).select("id", (F.col("new") - F.col("old")).alias("delta"))


def encoding(step: DataFrame, pid: DataFrame, below: float = SPARSE_BELOW) -> DataFrame:
    """pid, changed, encoding: which view is the smaller one for each partition."""
    share = step.join(pid, "id").groupBy("pid").agg(F.sum((~F.col("new").eqNullSafe(F.col("old"))).cast("long")).alias("changed"), F.count(F.lit(1)).alias("n"))
    return share.select("pid", "changed", F.when(F.col("changed") < below * F.col("n"), "sparse").otherwise("dense").alias("encoding"))


def list_messages(graph, edges: DataFrame | None = None) -> DataFrame:
    """Every vertex sends the list of its in-neighbours along its out-edges: src, dst, msg (array of ids).

    All lists together have a length for every pair of an in-edge and an out-edge; ``edges``, such as one of
    ``edge_windows``, are those that a step sends along, which bounds it.
    """
    return (graph.edges if edges is None else edges.select("src", "dst")).join(graph.in_lists().select(F.col("id").alias("src"), F.col("neighbors").alias("msg")), "src", "left").select("src", "dst", F.coalesce("msg", F.array().cast("array<bigint>")).alias("msg"))
