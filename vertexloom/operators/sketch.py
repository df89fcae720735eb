"""Bloom filters of a partition's sources as rows: pid, word, bits. A union of filters is their bitwise or.

Built and probed by aggregations and joins alone, so a filter of any size stays distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def bloom_size(expected: int, fpp: float) -> tuple[int, int]:
    """Bits and hash functions for ``expected`` members and a share ``fpp`` of false positives."""
    bits = max(WORD, math.ceil(-expected * math.log(fpp) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(expected, 1) * math.log(2)))


def _places(key: str, bits: int, hashes: int) -> Column:
    """Bit numbers of a key: h1 + i * h2 modulo ``bits``."""
    h1, h2 = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits - 1)) + 1
    return F.array(*[F.pmod(h1 + i * h2, F.lit(bits)) for i in range(hashes)])


def bloom_index(edges: DataFrame, expected: int = 1_000_000, fpp: float = 0.01) -> DataFrame:
    """pid, word, bits: a filter of the sources of each partition. ``edges``: pid, src; ``expected``: sources of a partition."""
    places = edges.select("pid", F.explode(_places("src", *bloom_size(expected, fpp))).alias("_p"))
    bit = F.expr(f"shiftleft(1L, cast(_p % {WORD} as int))")
    return places.select("pid", F.floor(F.col("_p") / WORD).alias("word"), bit.alias("_b")).groupBy("pid", "word").agg(F.bit_or("_b").alias("bits"))


def bloom_union(index: DataFrame) -> DataFrame:
    """word, bits: one filter of all partitions."""
    return index.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def bloom_active(index: DataFrame, active: DataFrame, expected: int = 1_000_000, fpp: float = 0.01) -> DataFrame:
    """pid of each partition that may hold one of ``active`` (id) as a source: none is missed, ``fpp`` of tests are wrong.

    Sizes must be those of ``bloom_index``.
    """
    bits, hashes = bloom_size(expected, fpp)
    asked = active.select("id", F.explode(F.array_distinct(_places("id", bits, hashes))).alias("_p"))
    wanted = active.select("id", F.size(F.array_distinct(_places("id", bits, hashes))).alias("_k"))
    asked = asked.select("id", F.floor(F.col("_p") / WORD).alias("word"), F.expr(f"cast(_p % {WORD} as int)").alias("_at")).join(index, "word")
    found = asked.where("getbit(bits, _at) = 1").groupBy("id", "pid").agg(F.count(F.lit(1)).alias("_n"))
    return found.join(wanted, "id").where("_n = _k").select("pid").distinct()
