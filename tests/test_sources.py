import numpy as np
import pytest

from vertexloom.operators import partitioning
from vertexloom.plans.graph import Graph
from vertexloom.sources import binary, edge_list

EDGES = [(0, 1), (0, 1), (1, 2), (2, 0), (2, 3), (3, 2), (3, 4), (4, 4), (6, 5), (5, 6), (7, 6)]


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark.range(9), spark.createDataFrame(EDGES, "src long, dst long"))


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n3\t4\n  5   6 \n# no edge\n\n7\n")
    assert pairs(edge_list.read_edge_list(spark, str(tmp_path))) == [(1, 2), (3, 4), (5, 6)]
    assert edge_list.dataset_size(spark, str(tmp_path)).first()[0] == 1


def test_csr_round_trip(spark, graph, tmp_path):
    n = binary.write_files(binary.csr_partitions(graph.multi, partitioning.partition_assign(graph, 3)), str(tmp_path))
    assert n == 3
    got = binary.read_csr(spark, str(tmp_path))
    assert pairs(got) == sorted(set(EDGES))
    head = np.frombuffer((tmp_path / "0.edge").read_bytes(), "<i4")[:5]
    assert head.tolist() == [5, 4, 4, 0, 3]  # five edges with the duplicate, four without, three vertices


def test_blocks_round_trip(spark, graph, tmp_path):
    blocks = partitioning.partitioned_edges(graph, 3).withColumn("col", partitioning.column_of(__import__("pyspark").sql.functions.col("src"), 9, 2))
    binary.write_files(binary.block_partitions(blocks), str(tmp_path))
    got = binary.read_blocks(spark, str(tmp_path))
    assert pairs(got) == sorted(set(EDGES))
    assert sorted(map(tuple, got.select("pid", "col", "src", "dst").collect())) == sorted(map(tuple, blocks.select("pid", "col", "src", "dst").collect()))


def test_vectors(spark, tmp_path):
    (tmp_path / "outdegree.npy").write_bytes(binary.npy(np.array([3, 0, 5], np.int32)))
    assert [tuple(r) for r in binary.read_vector(spark, str(tmp_path)).orderBy("id").collect()] == [(0, 3.0), (1, 0.0), (2, 5.0)]
    assert binary.vector(np.array([1, 2], "<i4").tobytes()).tolist() == [1, 2]
    with pytest.raises(ValueError):
        binary.vector(binary.npy(np.zeros((2, 2))))


def test_streamed_degrees(spark, tmp_path):
    from vertexloom.streaming import incremental

    for i, part in enumerate([EDGES[:5], EDGES[5:]]):
        spark.createDataFrame(part, "src long, dst long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = incremental.maintain_degrees(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {r[0]: r[1:] for r in incremental.degrees_at(spark, str(tmp_path / "state"), 1).collect()}
    assert got[2] == (2, 2) and got[6] == (1, 2)


@pytest.mark.parametrize("chunk", [64, 100, 1 << 20])
def test_vectors_in_ranges(spark, tmp_path, chunk):
    long = np.arange(500, dtype=np.int64) * 3
    (tmp_path / "a.npy").write_bytes(binary.npy(long))
    got = binary.read_vector(spark, str(tmp_path), chunk=chunk).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(i, float(v)) for i, v in enumerate(long)]
    (tmp_path / "b.raw").write_bytes(np.arange(7, dtype="<i4").tobytes() + b"x")  # a torn last word
    assert [r[1] for r in binary.read_vector(spark, str(tmp_path), "*.raw", chunk=chunk).orderBy("id").collect()] == list(range(7))


def test_edges_in_folders(spark, graph, tmp_path):
    path = str(tmp_path / "e")
    whole = partitioning.partitioned_edges(graph, 3)
    edge_list.write_partitions(whole, path)
    own = edge_list.read_partitions(spark, path).where("pid = 1")
    assert pairs(own) == pairs(whole.where("pid = 1"))
    assert "PartitionFilters: [isnotnull(pid" in own._jdf.queryExecution().explainString(own._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_degrees_and_words(spark, graph, tmp_path):
    from pyspark.sql import functions as F

    from vertexloom.functions import scalars

    edge_list.write_degrees(graph.in_degrees(multi=True), str(tmp_path / "d"))
    lines = spark.read.text(str(tmp_path / "d")).collect()
    assert sorted(r[0] for r in lines)[:2] == ["0\t1", "1\t2"]
    row = spark.range(1).select(scalars.word_list(F.lit("12 it's, 7")), scalars.part_name(F.lit(42))).first()
    assert row[0] == ["12", "it's", "7"] and row[1] == "part-00042"


def test_streamed_components(spark, tmp_path):
    from vertexloom.streaming import incremental

    for i, part in enumerate([[(1, 2), (5, 6)], [(2, 5), (8, 9)]]):
        spark.createDataFrame(part, "src long, dst long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.maintain_components(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    got = {r[0]: r[1] for r in incremental.components_at(spark, str(tmp_path / "state"), 1).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}


@pytest.fixture(scope="module")
def larger(spark):
    """A hub of 30,000 sources, targets without sources, duplicates; partitions whose ids have gaps."""
    hub = [(s, 777) for s in range(30_000)]
    edges = spark.createDataFrame(hub + [(5, v) for v in range(0, 40_000, 3)] + [(5, 6)] * 3, "src long, dst long").repartition(3)
    pid = spark.range(40_000).where("id % 10 <> 9 or id = 39999").selectExpr("id", "least(id div 15000, 1) as pid")
    return edges.join(pid.selectExpr("id as dst"), "dst", "left_semi").select("src", "dst"), pid


def test_csr_in_pieces_and_ranges(spark, larger, tmp_path):
    edges, pid = larger
    pieces = binary.csr_partitions(edges, pid)
    assert max(len(r["content"]) for r in pieces.select("content").collect()) <= 4 * binary.PIECE
    assert binary.write_files(pieces, str(tmp_path)) == 2
    rows = edges.join(pid.withColumnRenamed("id", "dst"), "dst").toPandas()
    for p, (first, end) in enumerate([(0, 14_999), (15_000, 40_000)]):
        own = rows[rows["pid"] == p]
        assert (tmp_path / f"{p}.edge").read_bytes() == binary.csr_bytes(own["dst"].to_numpy(), own["src"].to_numpy(), first, end)
    whole = [tuple(r) for p in (0, 1) for r in zip([p] * 99_999, *[x.tolist() for x in binary.csr_edges((tmp_path / f"{p}.edge").read_bytes())])]
    for chunk in (1000, 7001):
        got = binary.read_csr(spark, str(tmp_path), chunk=chunk, place=True).orderBy("pid", "place").select("pid", "dst", "src").collect()
        assert [tuple(r) for r in got] == whole


def test_blocks_in_pieces_and_ranges(spark, larger, tmp_path):
    edges, pid = larger
    blocks = edges.join(pid.withColumnRenamed("id", "dst"), "dst").selectExpr("pid", "src % 2 as col", "src", "dst")
    pieces = binary.block_partitions(blocks)
    assert max(len(r["content"]) for r in pieces.select("content").collect()) <= 4 * binary.PIECE
    rows = blocks.toPandas()
    assert binary.write_files(pieces, str(tmp_path)) == rows.groupby(["pid", "col"]).ngroups
    for (p, c), own in rows.groupby(["pid", "col"]):
        expected = binary.npy(np.frombuffer(binary.block_bytes(own["dst"].to_numpy(), own["src"].to_numpy()), "<i4"))
        assert (tmp_path / f"{p}-{c}.edge.npy").read_bytes() == expected
    whole = sorted(map(tuple, rows[["pid", "col", "src", "dst"]].to_numpy().tolist()))
    for chunk in (1001, 1 << 20):
        assert sorted(map(tuple, binary.read_blocks(spark, str(tmp_path), chunk=chunk).collect())) == whole
