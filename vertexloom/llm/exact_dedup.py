"""Exact deduplication by a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent; one exact count verifies them and
names their winners, at most ``COUNTERS`` rows, which are broadcast so that copies of a frequent
text are settled on the map side. All other digests are rare by the summary's guarantee; they are
aggregated on the map side too, and joined back by an ordinary shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Counters of a summary: a digest with more than rows / (COUNTERS + 1) copies is certain to be found.
COUNTERS = 512
#: Summaries merged by one task.
FAN_IN = 32


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        out = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass").lower()).digest() for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["doc_id", "digest"])


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text with A-Z lower-cased (bytes.lower touches ASCII alone); null is empty."""
    return map_arrow(docs.select("doc_id", "text"), _digests, f"doc_id {dict(docs.dtypes)['doc_id']}, digest binary")


def _shrink(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """Misra-Gries merge step: subtract the (k+1)-th largest count and keep what stays positive."""
    if len(counts) <= k:
        return counts
    cut_at = sorted(counts.values(), reverse=True)[k]
    return {d: n - cut_at for d, n in counts.items() if n > cut_at}


def _summary(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            more = b.column(1).to_pylist() if b.num_columns > 1 else None
            for i, d in enumerate(b.column(0).to_pylist()):
                held[d] = held.get(d, 0) + (more[i] if more else 1)
                if len(held) > 8 * k:
                    held = _shrink(held, k)
        held = _shrink(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, all with more than rows / (counters + 1) copies among them.

    One summary a partition, then a tree of merges of FAN_IN summaries each: no task and not the
    driver ever holds more than FAN_IN * 8 * counters entries.
    """
    schema = "digest binary, n long"
    parts = digests.rdd.getNumPartitions()
    found = digests.select("digest").mapInArrow(_summary(counters), schema)
    while True:
        parts = -(-parts // FAN_IN)
        found = found.repartition(parts).mapInArrow(_summary(counters), schema)
        if parts == 1:
            return found


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts (A-Z lower-cased; null equals empty) the largest doc_id stays. A null
    doc_id stays only if all of its group are null (keep_id is then null); equal doc_ids of a group
    are all marked kept. Empty input: no rows.
    """
    d = cut(text_digests(docs))
    found = frequent_digests(d, counters).select("digest")
    heavy = F.broadcast(d.join(F.broadcast(found), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    heavy = F.broadcast(cut(heavy))
    hot = d.join(heavy, "digest")
    cold = d.join(heavy, "digest", "left_anti")
    # written, so that both sides of the join have an exchange of their own and adaptive execution can split them
    winners = cut(cold.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    rest = cold.join(winners, "digest").select("digest", "doc_id", "keep_id", "group_size")
    both = hot.select("digest", "doc_id", "keep_id", "group_size").unionByName(rest)
    return both.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
