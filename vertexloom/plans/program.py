"""The superstep loop: user-defined gather, combine and apply as Catalyst plans.

A step is one plan and one job: it joins the state to the edges, aggregates messages by target (with
partial aggregation before the exchange), and joins the result to all vertices. Edges are dealt by
source and states by id, into as many partitions and sorted, so steps shuffle messages alone. Each state
is checkpointed in shared storage, which ends its lineage; the same job observes how many vertices changed.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from contextlib import AbstractContextManager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.operators.partitioning import active_partitions, partition_assign, partition_source_index
from vertexloom.operators.sketch import bloom_active, bloom_index

from .graph import Graph
from .lineage import Kept, settings

#: Edges and vertices of a partition, while there are more partitions than cores.
EDGES_EACH, VERTICES_EACH = 200_000, 50_000


@dataclass
class VertexProgram:
    """init: state columns over (id, out_degree). gather: messages over the source's state, ``src``, ``dst``
    and the source's ``out_degree`` (at least 1). combine: an aggregate for each message. apply: new state
    over the old one and the combined messages, null where none came. ``monotone``: applying a message
    twice changes nothing and missing unchanged messages changes nothing (min, max), so frontiers are allowed.
    ``before_step`` gets the state (id, state columns, ``changed``) and the step's number and returns the state the
    step starts from, with the same rows and columns (async states have two more). ``after_step`` gets the new state and the number; a run ends
    when it returns False.
    """

    init: dict[str, Column]
    gather: dict[str, Column]
    combine: dict[str, Callable[[Column], Column]]
    apply: dict[str, Column]
    monotone: bool = False
    before_step: Callable[[DataFrame, int], DataFrame] | None = None
    after_step: Callable[[DataFrame, int], bool | None] | None = None


@dataclass
class EngineConfig:
    max_iter: int = 10
    #: Stop when nothing changed. A double counts as changed when it moved by more than ``tol``.
    tol: float = 0.0
    stop_when_stable: bool = True
    #: sync: all edges each step. frontier: edges of changed sources. selective: partitions with a changed
    #: source, once fewer than ``selective_below`` of the vertices changed. async: blocks of vertices in turn.
    mode: str = "sync"
    selective_below: float = 0.5
    #: A frontier step sends the changed sources' values only while less than this share of the vertices changed,
    #: and all values beyond it.
    sparse_below: float = 1.0
    #: How selective runs know the sources of a partition: exactly, or by a Bloom filter (which may keep too many).
    index: str = "exact"
    partitions: int = 8
    blocks: int = 2


@dataclass
class Result:
    state: DataFrame
    #: (step, changed vertices, their share); the last row of a converged run has none changed.
    metrics: list[tuple[int, int, float]] = field(default_factory=list)
    #: Messages that each step sent along edges, before they were combined.
    messages: list[int] = field(default_factory=list)
    #: Wall-clock seconds of each step, the state's count included.
    seconds: list[float] = field(default_factory=list)

    def report(self) -> DataFrame:
        """step, changed, ratio, messages, seconds: a row for each step."""
        rows = [(*m, n, s) for m, n, s in zip(self.metrics, self.messages, self.seconds)]
        return self.state.sparkSession.createDataFrame(rows, "step int, changed long, ratio double, messages long, seconds double")


def _moved(program: VertexProgram, tol: float) -> Column:
    out = F.lit(False)
    for c in program.apply:
        new, old = F.col(f"new_{c}"), F.col(c)
        out = out | (F.abs(new - old) > tol if tol else ~new.eqNullSafe(old))
    return out


def _as_dealt(spark: SparkSession, parts: int) -> AbstractContextManager[None]:
    """Plans made here keep their inputs' partitions: adaptive plans don't tell theirs, and a broadcast saves no shuffle."""
    return settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts), "spark.sql.autoBroadcastJoinThreshold": "-1"})


def _dealt(graph: Graph) -> tuple[DataFrame, int]:
    """The distinct edges with their source's ``out_degree``, held, by source and sorted; the number of their partitions.

    The derivation of the edges runs once, into Spark's number of partitions; small graphs then go to fewer.
    """
    spark = graph.vertices.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = graph.multi.select("src", "dst").repartition(most, "src").distinct()
    edges = graph.hold(edges.withColumn("out_degree", F.count(F.lit(1)).over(Window.partitionBy("src"))))
    parts = min(most, max(spark.sparkContext.defaultParallelism, -(-edges.count() // EDGES_EACH), -(-graph.n // VERTICES_EACH)))
    if parts < most:
        edges = graph.hold(edges.repartition(parts, "src").sortWithinPartitions("src"))
    return edges, parts


def _step(vertices: DataFrame, edges: DataFrame, program: VertexProgram, tol: float, senders: DataFrame | None = None) -> DataFrame:
    """One update: ``vertices`` with state, joined to ``edges`` (src, dst, out_degree).

    ``senders``: the vertices that send, if they aren't ``vertices``. Other columns of ``vertices`` stay.
    """
    state = list(program.init)
    other = [c for c in vertices.columns if c not in ("id", "changed", *state)]
    sent = edges.join((vertices if senders is None else senders).withColumnRenamed("id", "src").select("src", *state), "src")
    messages = sent.select(F.col("dst").alias("id"), *[c.alias(f"_m_{k}") for k, c in program.gather.items()])
    got = messages.groupBy("id").agg(F.count(F.lit(1)).alias("messages"), *[f(F.col(f"_m_{k}")).alias(k) for k, f in program.combine.items()])
    both = vertices.select("id", *state, *other).join(got, "id", "left")
    new = both.select("id", *state, *other, F.coalesce("messages", F.lit(0)).alias("messages"), *[c.alias(f"new_{k}") for k, c in program.apply.items()])
    return new.select("id", *[F.col(f"new_{k}").alias(k) if k in program.apply else F.col(k) for k in state], *other, _moved(program, tol).alias("changed"), "messages")


def run(graph: Graph, program: VertexProgram, config: EngineConfig = EngineConfig()) -> Result:
    """Run supersteps until nothing changes or ``max_iter``; the state has a row for every vertex."""
    if config.mode in ("frontier", "selective", "async") and not program.monotone:
        raise ValueError(f"{config.mode} needs a monotone program")
    spark = graph.vertices.sparkSession
    edges, parts = _dealt(graph)
    kept = Kept(spark)
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.first("out_degree").alias("out_degree"))
    first = graph.vertices.repartition(parts, "id").sortWithinPartitions("id").join(degrees, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    first = first.select("id", *[c.alias(k) for k, c in program.init.items()], F.lit(True).alias("changed"))
    index = None
    if config.mode in ("selective", "async"):
        # balanced by the edges that a run has, which are distinct and held
        pid = graph.hold(partition_assign(Graph(graph.vertices, edges), config.partitions if config.mode == "selective" else config.blocks))
        edges = graph.hold(edges.join(pid.withColumnRenamed("id", "dst"), "dst").repartition(parts, "src").sortWithinPartitions("src"))
    if config.mode == "selective":
        index = graph.hold(partition_source_index(edges) if config.index == "exact" else bloom_index(edges))
    with _as_dealt(spark, parts):
        if config.mode == "async":
            within = [graph.hold(edges.where(F.col("pid") == b)) for b in range(config.blocks)]
            first = first.join(pid.withColumnRenamed("pid", "_block"), "id").withColumn("_turn", F.lit(0))
            blocks = [kept.deal(first.where(F.col("_block") == b), slot=b)[0] for b in range(config.blocks)]
            state = reduce(DataFrame.unionByName, blocks)
        else:
            state, _ = kept.deal(first)
    alive = active_partitions if config.index == "exact" else bloom_active
    out, share = Result(state), 1.0
    for step in range(1, config.max_iter + 1):
        began = time.monotonic()
        if program.before_step:
            state = program.before_step(state, step)
        if config.mode == "async":
            seen = Counter()
            if program.before_step:  # who changed isn't known, so all send
                with _as_dealt(spark, parts):
                    state, _ = kept.deal(state.withColumn("_turn", F.lit((step - 1) * config.blocks)), slot="hooked")
                blocks = [state.where(F.col("_block") == b) for b in range(config.blocks)]
            for b in range(config.blocks):
                turn = (step - 1) * config.blocks + b + 1
                # those that changed since the block's last turn
                senders = reduce(DataFrame.unionByName, blocks).where(F.col("_turn") >= turn - config.blocks)
                with _as_dealt(spark, parts):
                    new = _step(blocks[b], within[b], program, config.tol, senders)
                    new = new.withColumn("_turn", F.when(F.col("changed"), F.lit(turn)).otherwise(F.col("_turn")))
                    blocks[b], got = kept.deal(new, "messages", slot=b)
                seen.update(got)
            state = reduce(DataFrame.unionByName, blocks)
        else:
            on, senders = edges, None
            if config.mode == "frontier" and step > 1 and share < config.sparse_below:
                senders = state.where("changed")
            elif config.mode == "selective" and step > 1 and share < config.selective_below:
                live = alive(index, state.where("changed").select("id"))
                on = edges.join(F.broadcast(live), "pid", "left_semi")  # one row a partition
            with _as_dealt(spark, parts):
                state, seen = kept.deal(_step(state, on, program, config.tol, senders), "messages")
        share = seen["changed"] / seen["n"] if seen["n"] else 0.0
        out.metrics.append((step, seen["changed"], share))
        out.messages.append(seen["messages"])
        out.seconds.append(time.monotonic() - began)
        stop = program.after_step and program.after_step(state, step) is False
        if stop or config.stop_when_stable and not seen["changed"]:
            break
    out.state = state.select("id", *program.init)
    graph.release()
    return out
