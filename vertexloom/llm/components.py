"""Connected components of link tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, map_arrow

#: Links that a map task contracts at a time.
LINKS_AT_ONCE = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of links as stars around the smallest node of each piece: at most one link a node."""
    up: dict[int, int] = {}
    seen = 0

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in list(up) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= LINKS_AT_ONCE:
            yield stars()
            up.clear()
            seen = 0
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component, for every node that has a link. ``links``: a, b (long).

    Map tasks contract their links to forests first; if at most LINKS_AT_ONCE links are left, one task
    contracts them to the end. Else star steps follow, which aggregate before they join. The aggregates
    are cut to files, so each join has an exchange of its own on either side and adaptive execution can
    split the links of a root that holds a large part of them. Rounds grow with the logarithm of the
    longest path.
    """
    e = cut(map_arrow(links.select("a", "b"), _forest, "a long, b long"))
    before = None
    if e.count() <= LINKS_AT_ONCE:
        old, e = e, cut(map_arrow(e.coalesce(1), _forest, "a long, b long"))
        drop(old)
        before = "done"
    while before != "done":
        # large star: each node hands the smallest node around it to its larger neighbours
        both = e.union(e.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: each node links its smaller neighbours and itself to the smallest of them; b < a in every link now
        lower = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        old, e = e, cut(small.where("a <> b").distinct())
        drop(old, least, large, lower)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        before = "done" if now == before else now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("x"), "b").distinct())
