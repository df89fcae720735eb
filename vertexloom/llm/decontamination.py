"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets. An item of a partition with sizes up to u is
stood for by its bottom-k sketch, the k = floor((1 - threshold) u) + 1 smallest hashes of its set (all
of a smaller set). A text that contains the threshold's share of an item misses at most k - 1 of its
shingles, so it holds one hash of the sketch: the search loses nothing, however long the text. Found
pairs are verified by exact containment of the shingle sets.

An item of fewer than SHINGLE words is searched for as a whole, as a run of its own length.

Sketches and sets of items go to the executors in slices. Their sizes are counted before they are
collected: hash buckets of items are put together up to SLICE shingles (the bound of a broadcast).
Texts are passed over once a slice, and no text is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .textvec import NOT_ALNUM, pieces, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles of the items that are searched for in one pass.
SLICE = 2_000_000


def _item_sets(items: DataFrame, k: int) -> DataFrame:
    """item_id, width (words of a shingle: ``k``, or all words of a shorter item), n and the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, sets = [], []
            for _, data, at in pieces(b.column(1)):
                h, wat = words(data, at, NOT_ALNUM)
                for i in range(len(at) - 1):
                    own = h[wat[i] : wat[i + 1]]
                    width.append(min(k, len(own)))
                    sets.append(np.unique(shingles(own, np.array([0, len(own)]), max(1, width[-1]), False)[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(width, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["item_id", "width", "n", "shingles"])

    return map_arrow(items.select("item_id", "text"), run, f"item_id {dict(items.dtypes)['item_id']}, width int, n long, shingles binary")


class _Index:
    """The items of a slice: sketch hashes with their items, and all sets."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.sets = sets
        keys, owners = [], []
        for i, s in enumerate(sets):
            upper = 1 << (len(s) - 1).bit_length()  # size partitions end at powers of two
            k = min(len(s), math.floor((1 - threshold) * upper + 1e-9) + 1)
            keys.append(s[:k])  # sorted hashes: the smallest come first
            owners.append(np.full(k, i))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.least = [math.ceil(threshold * len(s) - 1e-9) for s in sets]

    def search(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) of the items whose sets ``text`` contains to the threshold."""
        lo = np.searchsorted(self.keys, text, "left")
        hi = np.searchsorted(self.keys, text, "right")
        hit = hi > lo
        if not hit.any():
            return
        for i in np.unique(np.concatenate([self.owners[a:b] for a, b in zip(lo[hit], hi[hit])])).tolist():
            s = self.sets[i]
            shared = int(np.count_nonzero(text[np.minimum(np.searchsorted(text, s), len(text) - 1)] == s))
            if shared >= self.least[i]:
                yield i, shared


class _Search:
    """The items of a slice, by width: finds what a piece of a text column contains."""

    def __init__(self, rows: list[tuple[int, bytes]], threshold: float):
        self.by_width: dict[int, tuple[np.ndarray, _Index]] = {}
        for width in sorted({w for w, _ in rows}):
            at = [i for i, (w, _) in enumerate(rows) if w == width]
            self.by_width[width] = np.array(at), _Index([np.frombuffer(rows[i][1], np.uint64) for i in at], threshold)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shingles of the item, shared shingles)"""
        for row, data, at in pieces(texts):
            h, wat = words(data, at, NOT_ALNUM)
            for width, (items, index) in self.by_width.items():
                s, sat = shingles(h, wat, width, False)
                for i in range(len(at) - 1):
                    if sat[i] < sat[i + 1]:
                        for j, shared in index.search(np.unique(s[sat[i] : sat[i + 1]])):
                            yield row + i, int(items[j]), len(index.sets[j]), shared


def _slices(items: DataFrame, k: int, slice_size: int) -> Iterator[list]:
    """Rows (item_id, width, shingles) of the items with words, some ``slice_size`` shingles at a time."""
    sets = cut(_item_sets(items, k).where("n > 0"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = 1 if total <= slice_size else 64 * -(-total // slice_size)
    bucket = F.pmod(F.xxhash64("item_id", "shingles"), F.lit(buckets))
    sizes = sorted((r[0], r[1]) for r in sets.groupBy(bucket.alias("bucket")).agg(F.sum("n")).collect())
    while sizes:
        first, held = sizes[0][0], 0
        while sizes and (not held or held + sizes[0][1] <= slice_size):
            last, size = sizes.pop(0)
            held += size
        yield sets.where(bucket.between(first, last)).select("item_id", "width", "shingles").orderBy("item_id", "shingles").collect()


def contained_items(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, slice_size: int = SLICE) -> DataFrame:
    """Pairs of a text and an item it contains: doc_id, item_id, n_item, n_shared, containment.

    Words are runs of letters and digits, A-Z lower-cased. An item with fewer words than ``k`` is one
    shingle of its words and is found wherever they stand in a row. Items without words are found
    nowhere. Null texts are empty. Repeated rows give repeated pairs; null doc_ids are kept as null.
    """
    spark, schema = docs.sparkSession, f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, n_item long, n_shared long, containment double"
    found = None
    for rows in _slices(items, k, slice_size):
        held = spark.sparkContext.broadcast(([r[0] for r in rows], [(r[1], r[2]) for r in rows]))
        one = map_arrow(docs.select("doc_id", "text"), _searcher(held, threshold, pa.schema(_arrow(items, "item_id"))), schema)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], schema)


def _arrow(df: DataFrame, column: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(column, to_arrow_type(df.schema[column].dataType))]


def _searcher(held, threshold: float, id_schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = held.value
        search, ids = _Search(rows, threshold), pa.array(ids, id_schema.field(0).type)
        for b in batches:
            found = list(search(b.column(1)))
            at, item, n, shared = (np.array(c, np.int64) for c in (zip(*found) if found else [()] * 4))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), ids.take(pa.array(item)), pa.array(n), pa.array(shared), pa.array(shared / np.maximum(n, 1))], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return run


def without_contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, slice_size: int = SLICE) -> DataFrame:
    """All columns of the rows whose text contains no item. Rows are judged one by one, whatever their doc_id."""

    def clean(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _Search(held.value, threshold)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, *_ in search(b.column("text"))]] = False
                yield b.filter(pa.array(keep))

        return run

    schema = docs.schema
    for rows in _slices(items, k, slice_size):
        docs = map_arrow(docs, clean(docs.sparkSession.sparkContext.broadcast([(r[1], r[2]) for r in rows])), schema)
    return docs
