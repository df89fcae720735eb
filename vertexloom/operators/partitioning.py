"""How a graph is dealt out: degree-balanced ranges, columns, workers, rounds, rows and source indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vertices of a block in prefix sums: a block is summed by one task, blocks are summed over their totals.
BLOCK = 65_536


def degree_prefix_sum(graph, multi: bool = True, block: int = BLOCK) -> DataFrame:
    """id, in_degree, before: the in-degrees of all smaller ids, in two passes (blocks, then totals of blocks)."""
    d = graph.in_degrees(multi).withColumn("_b", F.floor(F.col("id") / block))
    totals = d.groupBy("_b").agg(F.sum("in_degree").alias("_t"))
    up = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(up), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_w", F.coalesce(F.sum("in_degree").over(inner), F.lit(0))).join(offsets, "_b").select("id", "in_degree", (F.col("_w") + F.col("_o")).cast("long").alias("before"))


def partition_assign(graph, partitions: int, multi: bool = True) -> DataFrame:
    """id, pid: ranges of ids with about equally many in-edges, least(P - 1, before div ceil(E / P))."""
    d = degree_prefix_sum(graph, multi)
    e = (graph.multi if multi else graph.edges).agg(F.greatest(F.ceil(F.count(F.lit(1)) / partitions), F.lit(1)).alias("_each"))
    return d.crossJoin(F.broadcast(e)).select("id", F.least(F.lit(partitions - 1), F.expr("before div _each")).cast("long").alias("pid"))  # e: one row


def column_of(v: Column, n: int, columns: int) -> Column:
    """Equal ranges of ids."""
    return F.least(F.lit(columns - 1), F.floor(v * columns / n)).cast("long")


def column_by_bounds(v: Column, bounds: list[int]) -> Column:
    """Column c with bounds[c] <= v < bounds[c + 1]; 0 outside of all."""
    out = F.lit(0)
    for c in range(len(bounds) - 1):
        out = F.when((v >= bounds[c]) & (v < bounds[c + 1]), c).otherwise(out)
    return out.cast("long")


def worker_of(pid: Column, partitions: int, workers: int) -> Column:
    """Contiguous blocks of ceil(P / W) partitions."""
    return F.floor(pid / -(-partitions // workers)).cast("long")


def in_round(pid: Column, partitions: int, rounds: int, number: int) -> Column:
    each = -(-partitions // rounds)
    return (pid >= number * each) & (pid < min((number + 1) * each, partitions))


def partitioned_edges(graph, partitions: int, multi: bool = False) -> DataFrame:
    """pid of the target, src, dst."""
    pid = partition_assign(graph, partitions)
    return (graph.multi if multi else graph.edges).join(pid.withColumnRenamed("id", "dst"), "dst").select("pid", "src", "dst")


def partition_summary(graph, partitions: int) -> DataFrame:
    """pid, n_vertices, n_edges (duplicates counted), and the id range."""
    pid = partition_assign(graph, partitions)
    d = graph.in_degrees(multi=True)
    return pid.join(d, "id").groupBy("pid").agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("in_degree").alias("n_edges"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def partition_source_index(edges: DataFrame) -> DataFrame:
    """Which sources occur in which partition, exactly: pid, src."""
    return edges.select("pid", "src").distinct()


def active_partitions(index: DataFrame, active: DataFrame) -> DataFrame:
    """Partitions with at least one active source. ``active``: id."""
    return index.join(active.select(F.col("id").alias("src")), "src", "left_semi").select("pid").distinct()


def skipped_partitions(index: DataFrame, active: DataFrame) -> DataFrame:
    return index.select("pid").distinct().join(active_partitions(index, active), "pid", "left_anti")


def partition_density(state: DataFrame, pid: DataFrame) -> DataFrame:
    """pid, density: changed vertices in percent. ``state``: id, changed."""
    return state.join(pid, "id").groupBy("pid").agg((100.0 * F.sum(F.col("changed").cast("int")) / F.count(F.lit(1))).alias("density"))


def row_allocation(sizes: DataFrame, rows: int) -> DataFrame:
    """col, pid, row: a column's partitions in order, dealt to ``rows`` workers by running size. ``sizes``: col, pid, size."""
    up = Window.partitionBy("col").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("col")
    return sizes.select("col", "pid", "size", F.least(F.lit(rows - 1), F.floor(F.coalesce(F.sum("size").over(up), F.lit(0)) * rows / F.sum("size").over(total))).cast("long").alias("row"))


def row_allocation_greedy(sizes: DataFrame, rows: int) -> DataFrame:
    """col, pid, row: as ``row_allocation``, but sizes are summed anew for each row.

    The partition with which the sum reaches the column's mean per row opens the next row, whose sum starts at 0 all
    the same. The list of a column's partitions (thousands, not edges) is folded as one array.
    """
    all_of = sizes.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("pid", "size"))).alias("_all"), (F.sum("size") / rows).alias("_mean"))

    def deal(acc: Column, one: Column) -> Column:
        full = acc["got"] + one["size"] >= acc["mean"]
        row = F.when(full, F.least(acc["row"] + 1, F.lit(rows - 1))).otherwise(acc["row"]).cast("long").alias("row")
        return F.struct(
            acc["mean"].alias("mean"),
            F.when(full, F.lit(0)).otherwise(acc["got"] + one["size"]).cast("double").alias("got"),
            row,
            F.concat(acc["dealt"], F.array(F.struct(one["pid"].cast("long").alias("pid"), row))).alias("dealt"),
        )

    start = F.struct(F.col("_mean").cast("double").alias("mean"), F.lit(0.0).alias("got"), F.lit(0).cast("long").alias("row"), F.expr("cast(array() as array<struct<pid: bigint, row: bigint>>)").alias("dealt"))
    return all_of.select("col", F.explode(F.aggregate("_all", start, deal)["dealt"]).alias("_d")).select("col", "_d.pid", "_d.row")


def edge_windows(edges: DataFrame, width: int) -> DataFrame:
    """Windows of ``width`` edges within a partition, in (dst, src) order: pid, src, dst, window."""
    rn = F.row_number().over(Window.partitionBy("pid").orderBy("dst", "src"))
    return edges.select("pid", "src", "dst", F.floor((rn - 1) / width).cast("long").alias("window"))


def replication_ratio(edges: DataFrame, n: int, columns: int) -> DataFrame:
    """For each column of sources: the share of vertices it must hold, and of those it sends to."""
    by = edges.withColumn("col", column_of(F.col("src"), n, columns))
    return by.groupBy("col").agg((F.count_distinct("src") / n).alias("need_ratio"), (F.count_distinct("dst") / n).alias("update_ratio"))


def replication_mean(ratios: DataFrame) -> DataFrame:
    """The means of ``replication_ratio`` over its columns."""
    return ratios.agg(F.avg("need_ratio").alias("need_ratio"), F.avg("update_ratio").alias("update_ratio"))
