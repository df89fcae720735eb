"""Graph queries over the driver tables, each with the SQL it is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.scalars import cache_level, decode_id, encode_id
from vertexloom.operators import gather as g
from vertexloom.operators import messages as m
from vertexloom.operators import partitioning as p
from vertexloom.operators import sketch
from vertexloom.sources import binary, edge_list

from . import algorithms as alg
from . import derived
from .derived import CTES
from .graph import Graph
from .lineage import shared_dir
from .program import EngineConfig, VertexProgram, run

#: Sizes the queries use: partitions, columns, workers, rounds, rows of workers, edges of a window.
P, C, W, ROUNDS, ROWS, WINDOW = 8, 4, 3, 3, 2, 500

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"WITH RECURSIVE {CTES}{sql}"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# ---- degrees, edges, scans

_IN_MULTI = """, dm AS (SELECT v.id, CAST(count(em.src) AS BIGINT) AS in_degree FROM v LEFT JOIN em ON em.dst = v.id GROUP BY v.id)"""
_OUT = """, od AS (SELECT src AS id, count(*) AS out_degree FROM ed GROUP BY src)"""


@query("SELECT src, dst FROM ed")
def scan_edge_list(spark, d):
    path = _folder(spark)
    edge_list.write_edge_list(derived.dense(spark, d).edges, path)
    return edge_list.read_edge_list(spark, path)


@query(" SELECT id AS id, CAST(count(ed.src) AS DOUBLE) AS value FROM v LEFT JOIN ed ON ed.dst = v.id GROUP BY id")
def scan_npy_vector(spark, d):
    path = _folder(spark)
    degrees = derived.dense(spark, d).in_degrees()

    def make(pdf):
        import numpy as np
        import pandas as pd

        return pd.DataFrame({"name": ["vertexin.npy"], "content": [binary.npy(pdf.sort_values("id")["in_degree"].to_numpy(np.int32))]})

    # the format is one vector in one file, so one task writes it
    binary.write_files(degrees.groupBy(F.lit(0).alias("one")).applyInPandas(make, "name string, content binary"), path)
    return binary.read_vector(spark, path)


@query(f"""{_IN_MULTI}, c AS (SELECT id, sum(in_degree) OVER (ORDER BY id) - in_degree AS before FROM dm),
pid AS (SELECT id, CAST(least({P - 1}, before // ceil((SELECT count(*) FROM em) / {P}.0)::BIGINT) AS BIGINT) AS pid FROM c)
SELECT pid.pid, e.src, e.dst FROM (SELECT DISTINCT src, dst FROM em) e JOIN pid ON pid.id = e.dst""")
def scan_csr_partition(spark, d):
    return binary.read_csr(spark, _csr_files(spark, d))


def _csr_files(spark: SparkSession, d: str) -> str:
    """The folder of the CSR files; the edges are derived once."""
    path, graph = _folder(spark), derived.multi(spark, d)
    graph.multi = graph.hold(graph.multi)
    binary.write_files(binary.csr_partitions(graph.multi, graph.hold(p.partition_assign(graph, P))), path)
    graph.release()
    return path


_PID = f"""{_IN_MULTI}, c AS (SELECT id, in_degree, CAST(sum(in_degree) OVER (ORDER BY id) - in_degree AS BIGINT) AS before FROM dm),
pid AS (SELECT id, CAST(least({P - 1}, before // ceil((SELECT count(*) FROM em) / {P}.0)::BIGINT) AS BIGINT) AS pid FROM c),
de AS (SELECT DISTINCT src, dst FROM em), pe AS (SELECT pid.pid, de.src, de.dst FROM de JOIN pid ON pid.id = de.dst)"""
_COL = f"CAST(least({C - 1}, floor(src * {C} / (SELECT count(*) FROM v))) AS BIGINT)"


@query(f"{_PID} SELECT pid, {_COL} AS col, src, dst FROM pe")
def scan_edge_blocks_2d(spark, d):
    path, graph = _folder(spark), derived.multi(spark, d)
    graph.multi = graph.hold(graph.multi)
    blocks = p.partitioned_edges(graph, P).withColumn("col", p.column_of(F.col("src"), graph.n, C))
    binary.write_files(binary.block_partitions(blocks), path)
    graph.release()
    return binary.read_blocks(spark, path)


@query(f"{_OUT} SELECT v.id, CAST(coalesce(out_degree, 0) AS BIGINT) AS out_degree FROM v LEFT JOIN od USING (id)")
def out_degree(spark, d):
    return derived.dense(spark, d).out_degrees()


@query(f"{_OUT} SELECT v.id, CAST(greatest(coalesce(out_degree, 0), 1) AS BIGINT) AS out_degree FROM v LEFT JOIN od USING (id)")
def out_degree_guarded(spark, d):
    return derived.dense(spark, d).out_degrees().select("id", F.greatest("out_degree", F.lit(1).cast("long")).alias("out_degree"))


@query(" SELECT v.id, CAST(count(ed.src) AS BIGINT) AS in_degree FROM v LEFT JOIN ed ON ed.dst = v.id GROUP BY v.id")
def in_degree(spark, d):
    return derived.dense(spark, d).in_degrees()


@query(f"{_IN_MULTI} SELECT * FROM dm")
def in_degree_multi(spark, d):
    return derived.multi(spark, d).in_degrees(multi=True)


@query(" SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM em) AS n_edges_multi, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM em)) AS n_edges")
def graph_stats(spark, d):
    return derived.multi(spark, d).stats()


@query(" SELECT DISTINCT src, dst FROM em")
def distinct_edges(spark, d):
    return derived.multi(spark, d).edges


@query(" SELECT dst AS src, src AS dst FROM em")
def reverse_edges(spark, d):
    return derived.multi(spark, d).reverse().multi


@query(" SELECT src, dst FROM ed UNION SELECT dst, src FROM ed")
def symmetrize(spark, d):
    return derived.dense(spark, d).symmetrize().edges


# ---- partitions


@query(f"{_PID} SELECT id, in_degree, before FROM c")
def degree_prefix_sum(spark, d):
    return p.degree_prefix_sum(derived.multi(spark, d))


@query(f"{_PID} SELECT id, pid FROM pid")
def partition_assign(spark, d):
    return p.partition_assign(derived.multi(spark, d), P)


@query(f"{_PID} SELECT pid, count(*) AS n_vertices, CAST(sum(in_degree) AS BIGINT) AS n_edges, min(id) AS first_id, max(id) AS last_id FROM pid JOIN dm USING (id) GROUP BY pid")
def partition_summary(spark, d):
    return p.partition_summary(derived.multi(spark, d), P)


@query(f"{_PID} SELECT id, pid FROM pid WHERE pid >= 3 AND pid < 6")
def partition_filter(spark, d):
    return p.partition_assign(derived.multi(spark, d), P).where(p.in_round(F.col("pid"), P, ROUNDS, 1))


@query(f" SELECT id, CAST(least({C - 1}, floor(id * {C} / (SELECT count(*) FROM v))) AS BIGINT) AS col, CASE WHEN id >= 100 AND id < 1000 THEN 1 ELSE 0 END AS bound_col FROM v")
def column_assign(spark, d):
    graph = derived.dense(spark, d)
    return graph.vertices.select("id", p.column_of(F.col("id"), graph.n, C).alias("col"), p.column_by_bounds(F.col("id"), [0, 100, 1000]).cast("int").alias("bound_col"))


@query(f"{_PID} SELECT DISTINCT pid, CAST(pid // {-(-P // W)} AS BIGINT) AS worker FROM pid")
def worker_assign(spark, d):
    return p.partition_assign(derived.multi(spark, d), P).select("pid", p.worker_of(F.col("pid"), P, W).alias("worker")).distinct()


_SIZES = f"{_PID}, sizes AS (SELECT {_COL} AS col, pid, count(*) AS size FROM pe GROUP BY ALL)"


@query(f"""{_SIZES} SELECT col, pid, size, CAST(least({ROWS - 1}, floor((sum(size) OVER (PARTITION BY col ORDER BY pid) - size) * {ROWS} / sum(size) OVER (PARTITION BY col))) AS BIGINT) AS row FROM sizes""")
def row_allocation(spark, d):
    graph = derived.multi(spark, d)
    sizes = p.partitioned_edges(graph, P).groupBy(p.column_of(F.col("src"), graph.n, C).alias("col"), "pid").agg(F.count(F.lit(1)).alias("size"))
    return p.row_allocation(sizes, ROWS)


@query(f"""{_SIZES}, s2 AS (SELECT col, pid, size, row_number() OVER (PARTITION BY col ORDER BY pid) AS k, sum(size) OVER (PARTITION BY col) / {ROWS}::DOUBLE AS mean FROM sizes),
al(col, k, got, row) AS (SELECT DISTINCT col, 0::BIGINT, 0::DOUBLE, 0::BIGINT FROM sizes UNION ALL
  SELECT s2.col, s2.k, CASE WHEN got + size >= mean THEN 0 ELSE got + size END, CASE WHEN got + size >= mean THEN least(row + 1, {ROWS - 1}) ELSE row END
  FROM al JOIN s2 ON s2.col = al.col AND s2.k = al.k + 1)
SELECT s2.col, s2.pid, CAST(row AS BIGINT) AS row FROM al JOIN s2 ON s2.col = al.col AND s2.k = al.k""")
def row_allocation_greedy(spark, d):
    graph = derived.multi(spark, d)
    sizes = p.partitioned_edges(graph, P).groupBy(p.column_of(F.col("src"), graph.n, C).alias("col"), "pid").agg(F.count(F.lit(1)).alias("size"))
    return p.row_allocation_greedy(sizes, ROWS)


@query(f"{_PID} SELECT DISTINCT pid, src FROM pe")
def partition_source_index(spark, d):
    return p.partition_source_index(p.partitioned_edges(derived.multi(spark, d), P))


#: The frontier after so many hops from vertex 1 of the sparse graph: what selective scheduling sees late in a run.
HOPS = 20


def _frontier(spark, d) -> tuple[DataFrame, DataFrame]:
    """The source index of the sparse edges, and the vertices that HOPS steps have just reached."""
    graph = derived.sparse(spark, d)
    pid = p.partition_assign(derived.multi(spark, d), P)
    index = p.partition_source_index(graph.edges.join(pid.withColumnRenamed("id", "dst"), "dst"))
    return index, alg.sssp(graph, mode="frontier").state.where(F.col("dist") == HOPS).select("id")


_FRONTIER = f"""{_PID}, pes AS (SELECT es.src, pid FROM es JOIN pid ON pid.id = es.dst), r(i, id, val) AS (SELECT 0, id, CASE WHEN id = 1 THEN 0 ELSE 10000 END FROM v UNION ALL
  SELECT min(i) + 1, id, min(val) FROM (SELECT r.i, es.dst AS id, least(val + 1, 10000) AS val FROM r JOIN es ON es.src = r.id UNION ALL SELECT i, id, val FROM r) x WHERE i < 40 GROUP BY id),
live AS (SELECT DISTINCT pid FROM pes JOIN r ON r.id = pes.src WHERE i = 40 AND val = {HOPS})"""


@query(f"{_FRONTIER} SELECT pid FROM live")
def active_partitions(spark, d):
    return p.active_partitions(*_frontier(spark, d))


@query(f"{_FRONTIER} SELECT pid FROM live")
def active_partitions_bloom(spark, d):
    """By Bloom filters so large that a false positive is out of the question."""
    graph = derived.sparse(spark, d)
    pid = p.partition_assign(derived.multi(spark, d), P)
    index = sketch.bloom_index(graph.edges.join(pid.withColumnRenamed("id", "dst"), "dst"), fpp=1e-9)
    return sketch.bloom_active(index, _frontier(spark, d)[1], fpp=1e-9)


@query(f"{_FRONTIER} SELECT DISTINCT pid FROM pes WHERE pid NOT IN (SELECT pid FROM live)")
def skipped_partitions(spark, d):
    return p.skipped_partitions(*_frontier(spark, d))


@query(f"""{_PID}, ch AS (SELECT v.id, coalesce(min(es.src) < v.id, false) AS changed FROM v LEFT JOIN es ON es.dst = v.id GROUP BY v.id)
SELECT pid, round(100.0::DOUBLE * sum(changed::INT) / count(*), 6) AS density FROM ch JOIN pid USING (id) GROUP BY pid""")
def partition_density(spark, d):
    graph = derived.sparse(spark, d)
    low = g.apply_to_all(graph.vertices, g.gather(graph.edges, graph.vertices.select("id", F.col("id").alias("value")), low="min:value"))
    state = low.select("id", F.coalesce(F.col("low") < F.col("id"), F.lit(False)).alias("changed"))
    return p.partition_density(state, p.partition_assign(derived.multi(spark, d), P)).select("pid", F.round("density", 6).alias("density"))


@query(f"{_PID} SELECT pid, src, dst, CAST((row_number() OVER (PARTITION BY pid ORDER BY dst, src) - 1) // {WINDOW} AS BIGINT) AS window FROM pe")
def edge_windows(spark, d):
    return p.edge_windows(p.partitioned_edges(derived.multi(spark, d), P), WINDOW)


@query(f" SELECT {_COL} AS col, round(count(DISTINCT src) / (SELECT count(*) FROM v), 9) AS need_ratio, round(count(DISTINCT dst) / (SELECT count(*) FROM v), 9) AS update_ratio FROM ed GROUP BY 1")
def replication_ratio(spark, d):
    graph = derived.dense(spark, d)
    return p.replication_ratio(graph.edges, graph.n, C).select("col", F.round("need_ratio", 9).alias("need_ratio"), F.round("update_ratio", 9).alias("update_ratio"))


@query(f""" SELECT round(avg(n), 9) AS need_ratio, round(avg(u), 9) AS update_ratio FROM
(SELECT {_COL} AS col, count(DISTINCT src) / (SELECT count(*) FROM v) AS n, count(DISTINCT dst) / (SELECT count(*) FROM v) AS u FROM ed GROUP BY 1)""")
def replication_mean(spark, d):
    graph = derived.dense(spark, d)
    mean = p.replication_mean(p.replication_ratio(graph.edges, graph.n, C))
    return mean.select(F.round("need_ratio", 9).alias("need_ratio"), F.round("update_ratio", 9).alias("update_ratio"))


@query(f"{_PID} SELECT pid, src, dst FROM pe WHERE pid >= 3 AND pid < 6")
def partition_pruned(spark, d):
    """The second round of partitions, read from a layout with a folder for each."""
    path = _folder(spark)
    edge_list.write_partitions(p.partitioned_edges(derived.multi(spark, d), P), path)
    return edge_list.read_partitions(spark, path).where(p.in_round(F.col("pid"), P, ROUNDS, 1))


@query(f"{_PID} SELECT pid, dst, row_number() OVER (PARTITION BY pid ORDER BY dst, src) - 1 AS place, src FROM pe")
def csr_export(spark, d):
    return binary.read_csr(spark, _csr_files(spark, d), place=True).select("pid", "dst", "place", "src")


@query(" SELECT dst AS id, string_agg(src::VARCHAR, ',' ORDER BY src) AS neighbors FROM ed GROUP BY dst")
def adjacency_list(spark, d):
    return derived.dense(spark, d).in_lists().select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(" SELECT v.id, coalesce(string_agg(src::VARCHAR, ',' ORDER BY src), '') AS neighbors FROM v LEFT JOIN ed ON ed.dst = v.id GROUP BY v.id")
def neighbor_lists(spark, d):
    graph = derived.dense(spark, d)
    return g.apply_to_all(graph.vertices, graph.in_lists()).select("id", F.coalesce(F.array_join(F.col("neighbors").cast("array<string>"), ","), F.lit("")).alias("neighbors"))


@query("""SELECT a.dst AS id, count(DISTINCT a.src) AS n_lists, count(b.src) AS n_items, CAST(coalesce(sum((b.src = a.dst)::INT), 0) AS BIGINT) AS n_self
FROM ed a LEFT JOIN ed b ON b.dst = a.src GROUP BY a.dst""".join([" ", ""]))
def list_message(spark, d):
    sent = m.list_messages(derived.dense(spark, d))
    own = F.when(F.array_contains("msg", F.col("dst")), 1).otherwise(0)
    return sent.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_lists"), F.sum(F.size("msg")).cast("long").alias("n_items"), F.sum(own).cast("long").alias("n_self"))


# ---- gathers


def _values(graph: Graph) -> DataFrame:
    return graph.vertices.select("id", (F.col("id") * 37 % 101).alias("value"))


_VAL = ", x AS (SELECT id, id * 37 % 101 AS value FROM v)"


@query(f"{_VAL} SELECT src, dst, value FROM ed JOIN x ON x.id = ed.src")
def gather_join(spark, d):
    graph = derived.dense(spark, d)
    return g.gather_join(graph.edges, _values(graph)).select("src", "dst", "value")


@query(f"{_VAL}{_PID.replace(', de AS (SELECT DISTINCT src, dst FROM em)', ', de AS (SELECT * FROM ed)')} SELECT pid, {_COL} AS col, pe.dst, CAST(sum(value) AS BIGINT) AS total FROM pe JOIN x ON x.id = pe.src GROUP BY ALL")
def gather_join_2d(spark, d):
    graph = derived.multi(spark, d)
    sent = g.gather_join(p.partitioned_edges(graph, P), _values(graph))
    return sent.groupBy("pid", p.column_of(F.col("src"), graph.n, C).alias("col"), "dst").agg(F.sum("value").alias("total"))


@query(f"{_OUT} SELECT src, dst, round(1.0::DOUBLE / out_degree, 9) AS weight FROM ed JOIN od ON od.id = ed.src")
def edge_weight_by_outdegree(spark, d):
    return g.edge_weights(derived.dense(spark, d)).select("src", "dst", F.round("weight", 9).alias("weight"))


@query(f"{_OUT} SELECT dst AS id, round(sum(1.0::DOUBLE / out_degree), 9) AS total FROM ed JOIN od ON od.id = ed.src GROUP BY dst")
def gather_sum(spark, d):
    return g.edge_weights(derived.dense(spark, d)).groupBy(F.col("dst").alias("id")).agg(F.round(F.sum("weight"), 9).alias("total"))


@query(f"{_VAL} SELECT dst AS id, min(value) AS low, min(value + 1) AS low_hop FROM ed JOIN x ON x.id = ed.src GROUP BY dst")
def gather_min(spark, d):
    graph = derived.dense(spark, d)
    return g.gather(graph.edges, _values(graph).withColumn("hop", F.col("value") + 1), low="min:value", low_hop="min:hop")


@query(f"{_VAL} SELECT dst AS id, max(value) AS high FROM ed JOIN x ON x.id = ed.src GROUP BY dst")
def gather_max(spark, d):
    graph = derived.dense(spark, d)
    return g.gather(graph.edges, _values(graph), high="max:value")


@query(f"{_VAL} SELECT dst AS id, min(value) AS low, max(value) AS high FROM ed JOIN x ON x.id = ed.src GROUP BY dst")
def gather_minmax(spark, d):
    graph = derived.dense(spark, d)
    return g.gather(graph.edges, _values(graph), low="min:value", high="max:value")


def _two_level(spark, d, **how):
    graph = derived.dense(spark, d)
    return g.combine_two_level(graph.edges, _values(graph), p.column_of(F.col("src"), graph.n, C), **how)


@query(f"{_VAL} SELECT dst AS id, CAST(sum(value) AS BIGINT) AS total FROM ed JOIN x ON x.id = ed.src GROUP BY dst")
def combine_sum_2level(spark, d):
    return _two_level(spark, d, total="sum:value")


@query(f"{_VAL} SELECT dst AS id, min(value) AS low FROM ed JOIN x ON x.id = ed.src GROUP BY dst")
def combine_min_2level(spark, d):
    return _two_level(spark, d, low="min:value")


@query(f"{_VAL} SELECT dst AS id, min(value) AS low, max(value) AS high FROM ed JOIN x ON x.id = ed.src GROUP BY dst")
def combine_minmax_2level(spark, d):
    return _two_level(spark, d, low="min:value", high="max:value")


@query(f"""{_OUT}, s AS (SELECT dst AS id, sum(1.0::DOUBLE / out_degree) AS total FROM ed JOIN od ON od.id = ed.src GROUP BY dst)
SELECT v.id, round(0.85 * coalesce(total, 0) / (SELECT count(*) FROM v) + 1.0::DOUBLE / (SELECT count(*) FROM v), 9) AS rank FROM v LEFT JOIN s USING (id)""")
def apply_left_join(spark, d):
    graph = derived.dense(spark, d)
    got = g.edge_weights(graph).groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("total"))
    return g.apply_to_all(graph.vertices, got).select("id", F.round(0.85 * F.coalesce("total", F.lit(0.0)) / graph.n + 1.0 / graph.n, 9).alias("rank"))


# ---- messages: the first label step on the sparse graph


def _first_step(graph: Graph) -> DataFrame:
    low = g.gather(graph.edges, graph.vertices.select("id", F.col("id").alias("value")), low="min:value")
    return g.apply_to_all(graph.vertices, low).select("id", F.col("id").alias("old"), F.least("id", "low").alias("new"))


_STEP = ", st AS (SELECT v.id, v.id AS old, least(v.id, coalesce(min(es.src), v.id)) AS new FROM v LEFT JOIN es ON es.dst = v.id GROUP BY v.id)"


@query(f"{_STEP} SELECT id, old, new FROM st WHERE old <> new")
def changed_vertices(spark, d):
    return m.changed_vertices(_first_step(derived.sparse(spark, d)))


@query(f"{_STEP} SELECT id, new AS value FROM st WHERE old <> new")
def message_sparse(spark, d):
    return m.sparse(_first_step(derived.sparse(spark, d)))


@query(" SELECT v.id, coalesce(min(es.src), (SELECT count(*) FROM v)) AS value FROM v LEFT JOIN es ON es.dst = v.id GROUP BY v.id")
def message_dense(spark, d):
    graph = derived.sparse(spark, d)
    got = g.gather(graph.edges, graph.vertices.select("id", F.col("id").alias("value")), value="min:value")
    return m.dense(graph.vertices, got, graph.n)


@query(f"{_STEP} SELECT id, new - old AS delta FROM st WHERE old <> new")
def message_delta(spark, d):
    return m.delta(_first_step(derived.sparse(spark, d)))


@query(f"{_STEP}{_PID} SELECT pid, CAST(sum((old <> new)::INT) AS BIGINT) AS changed, CASE WHEN sum((old <> new)::INT) < 0.2 * count(*) THEN 'sparse' ELSE 'dense' END AS encoding FROM st JOIN pid USING (id) GROUP BY pid")
def message_encoding(spark, d):
    return m.encoding(_first_step(derived.sparse(spark, d)), p.partition_assign(derived.multi(spark, d), P))


@query(" SELECT id * 12347 AS id, id * 12347 % 10000 AS low, id * 12347 // 10000 AS high, id * 12347 AS decoded FROM v")
def id_codec(spark, d):
    big = derived.vertices(spark, d).select((F.col("id") * 12347).alias("id"))
    low, high = encode_id(F.col("id"))
    return big.select("id", low.alias("low"), high.alias("high"), decode_id(low, high).alias("decoded"))


@query(" SELECT id, CASE WHEN id <= 50 * 1.1 THEN 0 WHEN id * 0.5 <= 50 * 1.1 THEN 1 WHEN id * 0.25 <= 50 * 1.1 THEN 2 ELSE 3 END AS level FROM v")
def cache_level_choice(spark, d):
    return derived.vertices(spark, d).select("id", cache_level(F.col("id"), F.lit(50)).alias("level"))


# ---- algorithms


def _ranks(state: DataFrame, column: str = "rank") -> DataFrame:
    return state.select("id", F.round(column, 9).alias("rank"))


def _pagerank_sql(steps: int) -> str:
    return f"""{_OUT}, w AS (SELECT src, dst, 1.0::DOUBLE / out_degree AS w FROM ed JOIN od ON od.id = ed.src), n AS (SELECT count(*)::DOUBLE AS n FROM v),
r(i, id, rank) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v, n UNION ALL
  SELECT min(i) + 1, id, 0.85::DOUBLE * sum(x) + 1.0::DOUBLE / min(n) FROM
    (SELECT r.i, w.dst AS id, r.rank * w.w AS x, n FROM r JOIN w ON w.src = r.id, n UNION ALL SELECT r.i, r.id, 0.0::DOUBLE, n FROM r, n) WHERE i < {steps} GROUP BY id)
"""


@query(f"{_pagerank_sql(10)} SELECT id, round(rank, 9) AS rank FROM r WHERE i = 10")
def pagerank_10(spark, d):
    return _ranks(alg.pagerank(derived.dense(spark, d), 10).state)


@query(f"{_pagerank_sql(3)} SELECT id, round(rank, 9) AS rank FROM r WHERE i = 3")
def pagerank_3(spark, d):
    return _ranks(alg.pagerank(derived.dense(spark, d), 3).state)


@query(f"""{_pagerank_sql(60)}, far AS (SELECT a.i, max(abs(a.rank - b.rank)) AS m FROM r a JOIN r b ON a.id = b.id AND a.i = b.i + 1 GROUP BY a.i)
SELECT id, round(rank, 9) AS rank FROM r WHERE i = (SELECT min(i) FROM far WHERE m <= 1e-6)""")
def pagerank_converged(spark, d):
    return _ranks(alg.pagerank(derived.dense(spark, d), 60, tol=1e-6).state)


@query(f"{_pagerank_sql(10)} SELECT id, round(rank, 9) AS rank FROM r WHERE i = 10 ORDER BY round(rank, 9) DESC, id LIMIT 20")
def pagerank_topk(spark, d):
    """A top-k report: the limit is its feature."""
    return pagerank_10(spark, d).orderBy(F.desc("rank"), "id").limit(20)


@query(f"{_pagerank_sql(9)} SELECT id, round(rank, 9) AS rank FROM r WHERE i = 4")
def pagerank_list(spark, d):
    return alg.pagerank_list(derived.dense(spark, d), 5).state.select("id", F.round(F.col("msg")[0], 9).alias("rank"))


def _spread(start: str, message: str, best: str, edges: str = "es", steps: int = 40) -> str:
    return f""", r(i, id, val) AS (SELECT 0, id, {start} FROM v UNION ALL
  SELECT min(i) + 1, id, {best}(val) FROM (SELECT r.i, e.dst AS id, {message} AS val FROM r JOIN {edges} e ON e.src = r.id UNION ALL SELECT i, id, val FROM r) x
  WHERE i < {steps} GROUP BY id)
"""


_SSSP = f"{_spread('CASE WHEN id = 1 THEN 0 ELSE 10000 END', 'least(val + 1, 10000)', 'min')} SELECT id, CAST(val AS BIGINT) AS dist FROM r WHERE i = 40"
_MIN = f"{_spread('id', 'val', 'min')} SELECT id, val AS min_id FROM r WHERE i = 40"
_SYM = ", sy AS (SELECT src, dst FROM es UNION SELECT dst, src FROM es)"


@query(_SSSP)
def sssp(spark, d):
    return alg.sssp(derived.sparse(spark, d)).state


@query(_SSSP)
def sssp_frontier(spark, d):
    return alg.sssp(derived.sparse(spark, d), mode="frontier").state


@query(_SSSP)
def sssp_selective(spark, d):
    return alg.sssp(derived.sparse(spark, d), mode="selective").state


@query(_SSSP)
def sssp_async(spark, d):
    return alg.sssp(derived.sparse(spark, d), mode="async").state


@query(_MIN)
def cc_min(spark, d):
    return alg.labels(derived.sparse(spark, d)).state


@query(_MIN)
def cc_min_async(spark, d):
    return alg.labels(derived.sparse(spark, d), mode="async").state


@query(f"{_spread('id', 'val', 'max')} SELECT id, val AS max_id FROM r WHERE i = 40")
def cc_max(spark, d):
    return alg.labels(derived.sparse(spark, d), min_label=False, max_label=True).state


@query(f"""{_spread('id', 'val', 'min')}, q(i, id, val) AS (SELECT 0, id, id FROM v UNION ALL
  SELECT min(i) + 1, id, max(val) FROM (SELECT q.i, e.dst AS id, val FROM q JOIN es e ON e.src = q.id UNION ALL SELECT i, id, val FROM q) x WHERE i < 40 GROUP BY id)
SELECT r.id, r.val AS min_id, q.val AS max_id FROM r JOIN q USING (id) WHERE r.i = 40 AND q.i = 40""")
def cc_minmax(spark, d):
    return alg.labels(derived.sparse(spark, d), max_label=True).state


@query(f"{_SYM}{_spread('id', 'val', 'min', 'sy')} SELECT id, val AS component FROM r WHERE i = 40")
def wcc(spark, d):
    return alg.wcc(derived.sparse(spark, d)).state.withColumnRenamed("min_id", "component")


@query(f"{_SYM}{_spread('id', 'val', 'min', 'sy')} SELECT id, val AS component FROM r WHERE i = 40")
def wcc_by_labels(spark, d):
    return alg.wcc(derived.sparse(spark, d), mode="frontier").state.withColumnRenamed("min_id", "component")


# the same over all edges


@query(_SSSP.replace("JOIN es e", "JOIN ed e"))
def sssp_dense(spark, d):
    return alg.sssp(derived.dense(spark, d), mode="frontier").state


@query(_MIN.replace("JOIN es e", "JOIN ed e"))
def cc_min_dense(spark, d):
    return alg.labels(derived.dense(spark, d)).state


@query(f"{_spread('id', 'val', 'max', 'ed')} SELECT id, val AS max_id FROM r WHERE i = 40")
def cc_max_dense(spark, d):
    return alg.labels(derived.dense(spark, d), min_label=False, max_label=True).state


@query(f"{_SYM.replace('FROM es', 'FROM ed')}{_spread('id', 'val', 'min', 'sy')} SELECT id, val AS component FROM r WHERE i = 40")
def wcc_dense(spark, d):
    return alg.wcc(derived.dense(spark, d)).state.withColumnRenamed("min_id", "component")


@query(""", de AS (SELECT DISTINCT src, dst FROM em), b AS (SELECT a.dst AS id, count(*) AS n FROM de a JOIN de b ON a.src = b.dst AND a.dst = b.src GROUP BY a.dst)
SELECT v.id, CAST(coalesce(n, 0) AS BIGINT) AS reciprocal FROM v LEFT JOIN b USING (id)""")
def reciprocal_count(spark, d):
    return alg.reciprocal_count(derived.multi(spark, d))


_TRIANGLES = """, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ed),
t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b)"""


@query(f"{_TRIANGLES}, corner AS (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) SELECT v.id, count(corner.id) AS triangles FROM v LEFT JOIN corner ON corner.id = v.id GROUP BY v.id")
def triangle_count(spark, d):
    return alg.triangle_count(derived.dense(spark, d))


@query(f"{_TRIANGLES} SELECT count(*) AS triangles FROM t")
def triangle_total(spark, d):
    return alg.triangle_total(derived.dense(spark, d))


@query(f"{_OUT} SELECT v.id, coalesce(max(od.out_degree), -1) AS best FROM v LEFT JOIN ed ON ed.dst = v.id LEFT JOIN od ON od.id = ed.src GROUP BY v.id")
def vertex_program_custom(spark, d):
    """A user's program: the largest out-degree among a vertex's in-neighbours."""
    program = VertexProgram(
        init={"degree": F.col("out_degree"), "best": F.lit(-1).cast("long")},
        gather={"seen": F.col("degree")},
        combine={"seen": F.max},
        apply={"best": F.greatest("best", "seen")},
        monotone=True,
    )
    return run(derived.dense(spark, d), program, EngineConfig(max_iter=5)).state.select("id", "best")


@query(f"""{_spread('id', 'val', 'min')}, ch AS (SELECT b.i AS step, sum((a.val <> b.val)::INT) AS changed, count(*) AS n FROM r a JOIN r b ON a.id = b.id AND b.i = a.i + 1 GROUP BY b.i)
, ms AS (SELECT now.i + 1 AS step, count(*) AS messages FROM r now JOIN es ON es.src = now.id LEFT JOIN r old ON old.id = now.id AND old.i = now.i - 1 WHERE now.i = 0 OR old.val <> now.val GROUP BY 1)
SELECT step, CAST(changed AS BIGINT) AS changed, round(changed / n, 6) AS ratio, CAST(coalesce(messages, 0) AS BIGINT) AS messages FROM ch LEFT JOIN ms USING (step) WHERE step <= (SELECT min(step) FROM ch WHERE changed = 0)""")
def iteration_metrics(spark, d):
    """A row for each step of label-min: vertices that changed against the step before, messages sent; the last row has none changed."""
    return alg.labels(derived.sparse(spark, d)).report().select("step", "changed", F.round("ratio", 6).alias("ratio"), "messages")
