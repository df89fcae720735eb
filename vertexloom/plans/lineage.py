"""Where iterative plans keep what they have computed: Parquet files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; a folder of our own only where it is not, and only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vertexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for plans that are made and run within."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Kept:
    """The states of a loop: each is written once, without its lineage, and its predecessor is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self.number, self.dealt = 0, {}
        atexit.register(self._end)

    def put(self, df: DataFrame, tally: str | None = None) -> tuple[DataFrame, dict[str, int]]:
        """Write ``df`` (with a boolean ``changed``); the written copy and, from the same job, ``changed`` rows and all ``n`` rows.

        ``tally``: a column that is summed under its name and not written.
        """
        counted, seen = self._counted(df, tally)
        counted.write.parquet(f"{self.folder}/{self.number}")
        out = self.spark.read.schema(counted.schema).parquet(f"{self.folder}/{self.number}")
        if self.number:
            self._delete(f"{self.folder}/{self.number - 1}")
        self.number += 1
        return out, {k: v or 0 for k, v in seen.get.items()}

    def deal(self, df: DataFrame, tally: str | None = None, slot: int | str = 0) -> tuple[DataFrame, dict[str, int]]:
        """As ``put``, but the copy stays in the partitions and the order of ``df``, if that wasn't planned adaptively. The predecessor of ``slot`` is deleted."""
        sc = self.spark.sparkContext
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(shared_dir(self.spark))
        counted, seen = self._counted(df, tally)
        out = counted.checkpoint()
        path = out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        if slot in self.dealt:
            self._delete(self.dealt[slot])
        self.dealt[slot] = path
        return out, {k: v or 0 for k, v in seen.get.items()}

    @staticmethod
    def _counted(df: DataFrame, tally: str | None) -> tuple[DataFrame, Observation]:
        seen, more = Observation(), [F.sum(tally).alias(tally)] if tally else []
        counted = df.observe(seen, F.sum(F.col("changed").cast("long")).alias("changed"), F.count(F.lit(1)).alias("n"), *more)
        return counted.drop(tally) if tally else counted, seen

    def _end(self) -> None:
        for path in (self.folder, *self.dealt.values()):
            self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # at the driver's end, when the JVM may be gone
            return
