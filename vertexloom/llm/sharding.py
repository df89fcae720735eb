"""Longest-processing-time sharding of groups that must stay together.

Groups of one size are interchangeable, so the schedule is computed from the histogram of group
sizes: a heap of shard loads takes the sizes in descending order, and a size with many groups is
dealt out in closed form (its groups go to the earliest finishing shards, as single heap steps
would). The histogram streams through the driver in descending order and the schedule is written
SIZES sizes at a time, so the driver holds the heap and one such run of sizes at any scale (with T
bytes in all there are at most sqrt(2 T) distinct sizes); groups never leave the executors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ranked, stored_place

#: A group with more than rows / HOT_SHARE rows is joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 512
#: Rows of a file that one task numbers in stored order.
CHUNK = 65_536
#: Sizes of the schedule that the driver holds at a time.
SIZES = 50_000


def lpt(hist: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """hist: (size, groups of that size), largest first. Per size: shard numbers and the ranks at which each shard's run of groups ends."""
    heap = [(0, s) for s in range(shards)]
    for size, n in hist:
        take = [0] * shards
        if n <= 4 * shards:
            for _ in range(n):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                take[s] += 1
        else:
            loads = {s: load for load, s in heap}
            lo, hi = 0, max(loads.values()) + size * n
            fits = lambda t: sum(max(0, -(-(t - v) // size)) for v in loads.values())  # noqa: E731  groups that start before t
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if fits(mid) <= n else (lo, mid - 1)
            for s, v in loads.items():
                take[s] = max(0, -(-(lo - v) // size))
            left = n - sum(take)
            for v, s in sorted((v + take[s] * size, s) for s, v in loads.items())[:left]:
                take[s] += 1
            heap = [(v + take[s] * size, s) for s, v in loads.items()]
            heapq.heapify(heap)
        ends, own, done = [], [], 0
        for s, k in enumerate(take):
            if k:
                done += k
                own.append(s)
                ends.append(done)
        yield size, own, ends


def _schedule(spark: SparkSession, groups: DataFrame, shards: int) -> DataFrame:
    """deal_bytes, own, ends: the rows of ``lpt`` over the sizes of ``groups``."""
    schema = "deal_bytes long, own array<int>, ends array<long>"
    hist = groups.groupBy("group_bytes").count().orderBy(F.col("group_bytes").desc()).toLocalIterator()
    plan = lpt(((r[0], r[1]) for r in hist), shards)
    out = spark.createDataFrame([], schema)
    while some := list(islice(plan, SIZES)):
        out = out.union(cut(spark.createDataFrame(some, schema)))
    return out


def shard_documents(docs: DataFrame, shards: int = 8, stored_order: bool = False) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts stay together and null equals empty (both have size 1). Groups go to the least
    loaded of ``shards`` shards, largest first, so sizes are as near to equal as whole groups allow.
    ``slot`` numbers a shard's rows from 0; repeated and null doc_ids get slots of their own. With
    ``stored_order``, ``docs`` is as read from Parquet and slots follow the order of its files and rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    stored = [c.alias(name) for c, name in zip(stored_place(docs), ["_file", "_row"])] if stored_order else []
    base = cut(docs.select(*stored, "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    groups = cut(base.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).select("digest", "n", (F.col("n") * F.col("size")).alias("group_bytes")))
    deal = _schedule(spark, groups, shards)
    place = ranked(groups, ["group_bytes"], ["digest"], "rank").join(deal, F.col("group_bytes") == F.col("deal_bytes"))
    place = cut(place.select("digest", "n", F.expr("own[size(filter(ends, e -> e <= rank))]").alias("shard")))
    rows = groups.agg(F.sum("n")).first()[0] or 0
    hot = place.where(F.col("n") * HOT_SHARE > rows).select("digest", "shard")
    cold = place.where(F.col("n") * HOT_SHARE <= rows).select("digest", "shard")
    placed = base.join(F.broadcast(hot), "digest").unionByName(base.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest"))
    if stored_order:
        out = ranked(placed, ["shard"], ["_row"], "slot", chunk=F.struct("_file", F.expr(f"_row div {CHUNK}").alias("at")))
    else:
        out = ranked(placed, ["shard"], ["doc_id", "digest"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
