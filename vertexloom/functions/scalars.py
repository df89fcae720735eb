"""Scalar helpers of the graph formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_BASE = 10_000


def encode_id(v: Column) -> tuple[Column, Column]:
    """An id as (low, high) digits in base 10000, each small enough for a float."""
    return F.pmod(v, F.lit(ID_BASE)).cast("long"), F.floor(v / ID_BASE).cast("long")


def decode_id(low: Column, high: Column) -> Column:
    return (low + high * ID_BASE).cast("long")


def parse_edge(line: Column) -> tuple[Column, Column]:
    """(src, dst) of a line ``a b`` separated by white space; null where a number is missing."""
    parts = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    return parts[0].try_cast("long"), F.try_element_at(parts, F.lit(2)).try_cast("long")


def word_list(line: Column) -> Column:
    """All runs of word characters and apostrophes."""
    return F.regexp_extract_all(line, F.lit(r"([\w']+)"))


def part_name(n: Column, width: int = 5) -> Column:
    return F.concat(F.lit("part-"), F.lpad(n.cast("string"), width, "0"))


def cache_level(data_gb: Column, cache_gb: Column) -> Column:
    """0 to 3: raw, or compressed to about a half, a quarter or less, so that the data fits 1.1 times the cache."""
    fits = cache_gb * 1.1
    return F.when(data_gb <= fits, 0).when(data_gb * 0.5 <= fits, 1).when(data_gb * 0.25 <= fits, 2).otherwise(3)
