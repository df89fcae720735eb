"""The graph algorithms, as vertex programs or single plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contraction import weak_components
from .graph import Graph
from .program import EngineConfig, Result, VertexProgram, run

DAMPING = 0.85
#: Hops of vertices that the source doesn't reach.
UNREACHED = 10_000


def pagerank_program(n: int, teleport: str = "reference") -> VertexProgram:
    """r = 0.85 * sum(r_u / out_u) + t. teleport: ``reference`` adds 1/N (mass tends to 1/0.15), ``normalized`` 0.15/N."""
    t = 1.0 / n if teleport == "reference" else (1 - DAMPING) / n
    return VertexProgram(
        init={"rank": F.lit(1.0 / n)},
        gather={"m": F.col("rank") / F.col("out_degree")},
        combine={"m": F.sum},
        apply={"rank": F.coalesce("m", F.lit(0.0)) * DAMPING + t},
    )


def pagerank(graph: Graph, max_iter: int = 10, tol: float | None = None, teleport: str = "reference") -> Result:
    """``max_iter`` steps, or fewer when no rank moves by more than ``tol``. Vertices without out-edges drop their mass."""
    return run(graph, pagerank_program(max(graph.n, 1), teleport), EngineConfig(max_iter=max_iter, tol=tol or 0.0, stop_when_stable=tol is not None))


def pagerank_list(graph: Graph, max_iter: int = 10) -> Result:
    """PageRank whose message is a list of one rank, gathered from nothing in its first step: step s equals step s - 1 of pagerank."""
    n = max(graph.n, 1)
    program = VertexProgram(
        init={"msg": F.array().cast("array<double>")},
        gather={"m": F.coalesce(F.try_element_at("msg", F.lit(1)), F.lit(0.0)) / F.col("out_degree")},
        combine={"m": F.sum},
        apply={"msg": F.array(F.coalesce("m", F.lit(0.0)) * DAMPING + 1.0 / n)},
    )
    return run(graph, program, EngineConfig(max_iter=max_iter, stop_when_stable=False))


def sssp(graph: Graph, source: int = 1, inf: int | None = UNREACHED, mode: str = "sync", max_iter: int = 10_000) -> Result:
    """Hops from ``source`` along edges; ``inf`` (null with None) where it doesn't reach."""
    program = VertexProgram(
        init={"dist": F.when(F.col("id") == source, F.lit(0)).cast("long")},
        gather={"m": F.col("dist") + 1},
        combine={"m": F.min},
        apply={"dist": F.least("dist", "m")},
        monotone=True,
    )
    got = run(graph, program, EngineConfig(max_iter=max_iter, mode=mode))
    if inf is not None:
        got.state = got.state.select("id", F.coalesce("dist", F.lit(inf)).cast("long").alias("dist"))
    return got


def label_program(min_label: bool = True, max_label: bool = False) -> VertexProgram:
    """The smallest and/or largest id among a vertex's ancestors and itself."""
    ways = [("min_id", F.min, F.least)] * min_label + [("max_id", F.max, F.greatest)] * max_label
    return VertexProgram(
        init={c: F.col("id") for c, _, _ in ways},
        gather={f"m_{c}": F.col(c) for c, _, _ in ways},
        combine={f"m_{c}": agg for c, agg, _ in ways},
        apply={c: pick(c, f"m_{c}") for c, _, pick in ways},
        monotone=True,
    )


def labels(graph: Graph, min_label: bool = True, max_label: bool = False, mode: str = "frontier", max_iter: int = 10_000) -> Result:
    """Labels along edge direction. A vertex is active when either label improved."""
    return run(graph, label_program(min_label, max_label), EngineConfig(max_iter=max_iter, mode=mode))


def wcc(graph: Graph, mode: str = "contract") -> Result:
    """Weakly connected components: the smallest id of each. ``mode``: contract, or a mode of label propagation over both directions."""
    if mode == "contract":
        return Result(weak_components(graph))
    return labels(graph.symmetrize(), mode=mode)


def reciprocal_count(graph: Graph) -> DataFrame:
    """For every vertex v the u with u -> v and v -> u; a self-loop counts 1."""
    back = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = graph.edges.join(back, ["src", "dst"]).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return graph.vertices.join(both, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("reciprocal"))


def _triangles(graph: Graph) -> DataFrame:
    """Each undirected triangle once. Edges point from lower to higher degree, which bounds the wedges of hubs."""
    e = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    d = e.select(F.col("x").alias("v")).union(e.select("y")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    e = e.join(d.select(F.col("v").alias("x"), F.col("d").alias("dx")), "x").join(d.select(F.col("v").alias("y"), F.col("d").alias("dy")), "y")
    swap = (F.col("dx") > F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") > F.col("y")))
    o = graph.hold(e.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b")))
    wedge = o.join(o.select("a", F.col("b").alias("c")), "a").where("b <> c")
    return wedge.join(o.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b", "c")


def triangle_count(graph: Graph) -> DataFrame:
    """For every vertex the undirected triangles it is in."""
    at = _triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return graph.vertices.join(at, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("triangles"))


def triangle_total(graph: Graph) -> DataFrame:
    return _triangles(graph).agg(F.count(F.lit(1)).alias("triangles"))
