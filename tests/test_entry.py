"""The entry module works with and without the corpus parts, and queries agree with their SQL."""

import warnings

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SOME = ["out_degree", "partition_summary", "combine_minmax_2level", "message_delta", "reciprocal_count", "triangle_total", "pagerank_3", "csr_export", "wcc_dense"]


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("missing", ["vertexloom.llm", "vertexloom.llm.queries", "some_package"])
def test_without_corpus(monkeypatch, missing):
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def broken(name, *a):
        if name in ("vertexloom.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError(missing, name=missing)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", broken)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert "pagerank_10" in e.queries() and not any(k.startswith("op") for k in e.queries())


@pytest.mark.parametrize("name", SOME)
def test_sql_agrees(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(e.oracle_sql()[name])
    cols = sorted(rel.columns)
    df = e.queries()[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall())
