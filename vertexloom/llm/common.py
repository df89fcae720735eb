"""Shared pieces of the corpus operators: input tables, lineage cuts, distributed ranks."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.plans.lineage import shared_dir

_written: dict[str, SparkSession] = {}
BATCH_BYTES = str(4 << 20)
#: Tables of a few numbers a row are broadcast up to so many rows (some 10 MB).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python of a few MB, whatever the texts' lengths, where the session doesn't say otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow over batches that are bounded by bytes."""
    _bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The files outlive any executor, so a lost one costs a read and no recomputation. They are
    removed by ``drop``, or when the session's driver ends.
    """
    spark = df.sparkSession
    _bound_batches(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Remove the files of frames made by ``cut`` that nothing will read any more."""
    for df in cuts:
        path = df._cut_path
        _remove(_written.pop(path), path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow rows, made by ``cut``), to be broadcast if it has at most ``rows`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def stored_place(docs: DataFrame) -> tuple[Column, Column]:
    """File and row that each row of ``docs``, as read from Parquet, is stored at; files sort in the order of writing."""
    path = F.col("_metadata.file_path")
    number = F.regexp_extract(path, r".*part-(\d+)[^/]*$", 1)
    return F.struct(F.when(number != "", number.cast("long")).alias("number"), path.alias("path")), F.col("_metadata.row_index")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int | None = None, chunk: Column | None = None) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within ``keys``, without putting a key's rows in one task.

    Rows of a key are dealt over hash buckets of ``order``; the rank runs over (bucket, order). Bucket
    counts are pre-aggregated, so a key that holds a third of all rows is ranked by many tasks.
    ``chunk`` stands for the bucket then, for a rank in true order: rows of a smaller chunk come first.
    """
    buckets = buckets or max(64, n_parts(df.sparkSession))
    df = df.withColumn("_rb", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if chunk is None else chunk)
    counts = df.groupBy(*keys, "_rb").agg(F.count(F.lit(1)).alias("_rc"))
    before = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_rb").alias("_ob"), F.coalesce(F.sum("_rc").over(before), F.lit(0)).alias("_ro"))
    local = df.withColumn("_rl", F.row_number().over(Window.partitionBy(*keys, "_rb").orderBy(*order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_rb") == F.col("_ob")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return local.join(offsets, cond).withColumn(out, (F.col("_rl") + F.col("_ro")).cast("long")).drop("_rb", "_rl", "_ro", "_ob", *[f"_k_{k}" for k in keys])
