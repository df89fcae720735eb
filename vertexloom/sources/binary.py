"""Binary graph files: NumPy vectors, CSR partitions and 2-D edge blocks.

Files are listed by Spark and read on the executors in ranges (2-D blocks, which have no index, from front to
back), so no task holds a file. They are made as pieces of bounded size from sorted words, and a task writes the
pieces of a file in their order. Readers take files with or without an npy header in front.
"""

from __future__ import annotations

import io
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.plans.lineage import settings

#: CSR header words (edges, indices, row pointers, first id, end id) and 2-D header words (vertices, edges, last id, first id).
CSR_HEADER, BLOCK_HEADER = 5, 4
#: Vertices whose words one task sorts, words of a piece at most, and words that a reader takes at once.
SORTED, PIECE, AT_ONCE = 1 << 14, 1 << 14, 1 << 18


def vector(content: bytes, dtype: str = "<i4") -> np.ndarray:
    """A 1-D array from npy bytes, or from raw words of ``dtype``."""
    if content[:6] != b"\x93NUMPY":
        return np.frombuffer(content, dtype)
    out = np.load(io.BytesIO(content), allow_pickle=False)
    if out.ndim != 1:
        raise ValueError(f"a vector has one dimension, not {out.ndim}")
    return out


def npy(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(values))
    return out.getvalue()


def csr_bytes(dst: np.ndarray, src: np.ndarray, first: int, end: int) -> bytes:
    """A CSR partition of the targets [first, end): duplicates count in the header but are stored once."""
    pairs = np.unique(np.stack([dst, src], 1), axis=0) if len(dst) else np.empty((0, 2), np.int64)
    pointers = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0] - first, minlength=end - first))])
    return np.concatenate([[len(dst), len(pairs), len(pointers), first, end], pairs[:, 1], pointers]).astype("<i4").tobytes()


def csr_edges(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(dst, src) of a CSR partition."""
    a = vector(content)
    _, n_indices, n_pointers, first, end = (int(x) for x in a[:CSR_HEADER])
    indices = a[CSR_HEADER : CSR_HEADER + n_indices]
    pointers = a[CSR_HEADER + n_indices : CSR_HEADER + n_indices + n_pointers]
    return np.repeat(np.arange(first, end), np.diff(pointers)), indices


def block_bytes(dst: np.ndarray, src: np.ndarray) -> bytes:
    """A 2-D block: a header, then for each target its id, its length and its sources."""
    order = np.lexsort((src, dst))
    dst, src = dst[order], src[order]
    ids, at = np.unique(dst, return_index=True)
    records = [np.concatenate([[v, len(s)], s]) for v, s in zip(ids, np.split(src, at[1:]))]
    header = [len(ids), len(dst), ids[-1] if len(ids) else -1, ids[0] if len(ids) else 0]
    return np.concatenate([header, *records]).astype("<i4").tobytes()


def block_edges(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = vector(content)
    dst, src, at = [], [], BLOCK_HEADER
    for _ in range(int(a[0])):
        v, n = int(a[at]), int(a[at + 1])
        dst.append(np.full(n, v))
        src.append(a[at + 2 : at + 2 + n])
        at += 2 + n
    none = np.empty(0, np.int64)
    return np.concatenate([none, *dst]), np.concatenate([none, *src])


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    local = path.removeprefix("file:") if "://" not in path else None
    return fs.FileSystem.from_uri(f"file://{local}" if local else path)


def _numbers(path: str) -> list[int]:
    """Numbers of a file name: ``3-1.edge.npy`` is partition 3, column 1."""
    return [int(x) for x in re.findall(r"\d+", path.rsplit("/", 1)[1].split(".")[0])]


def _layout(head: bytes, dtype: str) -> tuple[int, np.dtype]:
    """Where the values of a vector file start, and their type."""
    if head[:6] != b"\x93NUMPY":
        return 0, np.dtype(dtype)
    from numpy.lib import format as npf

    f = io.BytesIO(head)
    version = npf.read_magic(f)
    shape, _, kind = (npf.read_array_header_1_0 if version == (1, 0) else npf.read_array_header_2_0)(f)
    if len(shape) != 1:
        raise ValueError(f"a vector has one dimension, not {len(shape)}")
    return f.tell(), kind


def read_vector(spark: SparkSession, path: str, pattern: str = "*.npy", dtype: str = "<i4", chunk: int = 1 << 25) -> DataFrame:
    """id (place in the vector, from 0), value. Files are read in ranges of ``chunk`` bytes, one a task, whatever their size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("at"))
    tasks = files.agg(F.sum(F.ceil(F.col("length") / chunk))).first()[0] or 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, length, at in zip(pdf["path"], pdf["length"].tolist(), pdf["at"].tolist()):
                store, own = _store(name)
                with store.open_input_file(own) as f:
                    start, kind = _layout(f.read_at(min(length, 4096), 0), dtype)
                    # the values whose first byte lies in this range
                    first, end = (max(-(-(x - start) // kind.itemsize), 0) for x in (at, min(at + chunk, length - kind.itemsize + 1)))
                    if end > first:
                        raw = f.read_at((end - first) * kind.itemsize, start + first * kind.itemsize)
                        yield pd.DataFrame({"id": np.arange(first, end), "value": np.frombuffer(raw, kind).astype(np.float64)})

    return ranges.repartition(int(tasks)).mapInPandas(run, "id long, value double")


class _Words:
    """Words of an open vector file, read when asked for."""

    def __init__(self, f, start: int, kind: np.dtype, at: int, n: int):
        self.f, self.kind, self.base, self.n = f, kind, start + at * kind.itemsize, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        lo, hi = (i.start, min(i.stop, self.n)) if isinstance(i, slice) else (i, i + 1)
        out = np.frombuffer(self.f.read_at((hi - lo) * self.kind.itemsize, self.base + lo * self.kind.itemsize), self.kind)
        return out if isinstance(i, slice) else int(out[0])


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where("length > 0").select("path", "length")


def read_csr(spark: SparkSession, path: str, pattern: str = "*.edge*", chunk: int = AT_ONCE, place: bool = False) -> DataFrame:
    """pid, src, dst of CSR partitions, raw or npy; the partition number is in the file's name. ``place``: the index's place in its file, too.

    A task reads ``chunk`` indices and finds their targets by bisection of the row pointers.
    """
    files = _listed(spark, path, pattern)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / 4), F.lit(chunk).cast("long"))).alias("at"))
    tasks = files.agg(F.sum(F.ceil(F.col("length") / 4 / chunk))).first()[0] or 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, length, at in zip(pdf["path"], pdf["length"].tolist(), pdf["at"].tolist()):
                store, own = _store(name)
                with store.open_input_file(own) as f:
                    start, kind = _layout(f.read_at(min(length, 4096), 0), "<i4")
                    _, n_indices, n_pointers, first, _ = (int(x) for x in _Words(f, start, kind, 0, CSR_HEADER)[0:CSR_HEADER])
                    indices, pointers = _Words(f, start, kind, CSR_HEADER, n_indices), _Words(f, start, kind, CSR_HEADER + n_indices, n_pointers)
                    stop = min(at + chunk, n_indices)
                    v = bisect_right(pointers, at) - 1 if at < stop else 0
                    while at < stop:
                        bounds = pointers[v : v + min(chunk, AT_ONCE) + 1].astype(np.int64)
                        if len(bounds) < 2:
                            raise ValueError(f"{name} has no pointers for its last indices")
                        end = min(int(bounds[-1]), stop)
                        if end > at:
                            dst = np.repeat(np.arange(first + v, first + v + len(bounds) - 1), np.diff(np.clip(bounds, at, end)))
                            yield pd.DataFrame({"pid": _numbers(name)[0], "src": indices[at:end].astype(np.int64), "dst": dst, "place": np.arange(at, end)})
                        at, v = max(end, at), v + len(bounds) - 1

    out = ranges.repartition(int(tasks)).mapInPandas(run, "pid long, src long, dst long, place long")
    return out if place else out.drop("place")


def read_blocks(spark: SparkSession, path: str, pattern: str = "*.edge.npy", chunk: int = AT_ONCE) -> DataFrame:
    """pid, col, src, dst of 2-D blocks named ``<pid>-<col>.edge.npy``. A task reads a file from front to back, ``chunk`` words at once."""
    files = _listed(spark, path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, length in zip(pdf["path"], pdf["length"].tolist()):
                pid, col = _numbers(name)[:2]
                store, own = _store(name)
                with store.open_input_file(own) as f:
                    start, kind = _layout(f.read_at(min(length, 4096), 0), "<i4")
                    words = _Words(f, start, kind, 0, (length - start) // kind.itemsize)
                    targets, at, v, left = words[0], BLOCK_HEADER, 0, 0
                    while at < len(words) and (targets or left):
                        a = words[at : at + max(chunk, 2)]
                        values, i, ids, sizes, keep = a.tolist(), 0, [], [], np.ones(len(a), bool)
                        if left:
                            i = min(left, len(a))
                            ids, sizes, left = [v], [i], left - i
                        while targets and i + 1 < len(a):
                            v, n, keep[i : i + 2] = values[i], values[i + 1], False
                            n, left = min(n, len(a) - i - 2), max(n - (len(a) - i - 2), 0)
                            ids.append(v)
                            sizes.append(n)
                            i, targets = i + 2 + n, targets - 1
                        if not i:
                            raise ValueError(f"{name} ends within a record")
                        keep[i:] = False
                        at += i
                        yield pd.DataFrame({"pid": pid, "col": col, "src": a[keep].astype(np.int64), "dst": np.repeat(np.array(ids, np.int64), sizes)})

    return files.repartition(max(files.count(), 1)).mapInPandas(run, "pid long, col long, src long, dst long")


def _pieces(words: DataFrame, keys: list[str], heads: DataFrame, npy_head: bool, name: Column) -> DataFrame:
    """name, section, block, part, content. ``words``: keys, section, block, a, b, word, by which they are sorted. ``heads``: keys, head (array of words), n (all words of the file)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, part = None, 0
        for pdf in batches:
            for key, own in pdf.groupby([*keys, "section", "block"], sort=False):
                part, last = (part if key == last else 0), key
                content = own["word"].to_numpy().astype("<i4")
                cut = [content[i : i + PIECE].tobytes() for i in range(0, len(content), PIECE)]
                yield pd.DataFrame({**dict(zip([*keys, "section", "block"], key)), "part": range(part, part + len(cut)), "content": cut})
                part += len(cut)

    def front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                f = io.BytesIO()
                if npy_head:
                    np.lib.format.write_array_header_1_0(f, {"descr": "<i4", "fortran_order": False, "shape": (int(r["n"]),)})
                f.write(np.array(r["head"]).astype("<i4").tobytes())
                yield pd.DataFrame({**{k: [r[k]] for k in keys}, "section": 0, "block": 0, "part": 0, "content": [f.getvalue()]})

    schema = ", ".join(f"{k} long" for k in keys) + ", section long, block long, part long, content binary"
    by = [*keys, "section", "block"]
    body = words.repartition(*by).sortWithinPartitions(*by, "a", "b").select(*by, "word").mapInPandas(pack, schema)
    return heads.mapInPandas(front, schema).unionByName(body).select(name.alias("name"), "section", "block", "part", "content")


def csr_partitions(edges: DataFrame, pid: DataFrame) -> DataFrame:
    """The CSR file of each partition, in pieces. ``edges``: src, dst; ``pid``: id, pid, which also gives the ranges."""
    block = F.floor(F.col("id") / SORTED).alias("block")
    ranges = pid.groupBy("pid").agg(F.min("id").alias("first"), (F.max("id") + 1).alias("end"))
    unique = edges.join(pid.withColumnRenamed("id", "dst"), "dst").groupBy("pid", "dst", "src").agg(F.count(F.lit(1)).alias("copies"))
    degrees = unique.groupBy("pid", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    sums = degrees.groupBy("pid", block).agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    # every block of a partition's range, whether or not it has edges
    blocks = ranges.select("pid", "first", "end", F.explode(F.sequence(F.floor(F.col("first") / SORTED), F.floor((F.col("end") - 1) / SORTED))).alias("block"))
    up = Window.partitionBy("pid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(sums, ["pid", "block"], "left").withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    ids = F.sequence(F.greatest("first", F.col("block") * SORTED), F.least(F.col("end"), (F.col("block") + 1) * SORTED) - 1)
    each = blocks.select("pid", "block", "before", F.explode(ids).alias("id")).join(degrees.select("pid", "id", "n"), ["pid", "id"], "left")
    inner = Window.partitionBy("pid", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    pointer = F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))
    words = unique.select("pid", F.lit(1).alias("section"), F.floor(F.col("dst") / SORTED).alias("block"), F.col("dst").alias("a"), F.col("src").alias("b"), F.col("src").alias("word"))
    words = words.union(ranges.select("pid", F.lit(2), F.lit(-1), F.lit(0), F.lit(0), F.lit(0)))
    words = words.union(each.select("pid", F.lit(2), "block", "id", F.lit(0), pointer))
    heads = blocks.groupBy("pid", "first", "end").agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    heads = heads.select("pid", F.array("copies", "n", F.col("end") - F.col("first") + 1, "first", "end").alias("head"), "n")
    return _pieces(words, ["pid"], heads, False, F.format_string("%d.edge", "pid"))


def block_partitions(edges: DataFrame) -> DataFrame:
    """The 2-D block file of each (pid, col), in pieces. ``edges``: pid, col, src, dst."""
    keys = ["pid", "col"]
    dealt = edges.select(*keys, F.floor(F.col("dst") / SORTED).alias("block"), "dst", "src").repartition(*keys, "block")
    own = Window.partitionBy(*keys, "block", "dst").orderBy("src")
    sized = dealt.select("*", F.row_number().over(own).alias("_k"), F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    # a target's id and number of sources stand before its first source
    record = F.when(F.col("_k") == 1, F.array("dst", "_n", "src")).otherwise(F.array("src"))
    words = sized.select(*keys, F.lit(1).alias("section"), "block", F.col("dst").alias("a"), F.col("_k"), F.posexplode(record).alias("_p", "word"))
    words = words.select(*keys, "section", "block", "a", F.when(F.col("_k") == 1, F.col("_p") - 2).otherwise(F.col("_k")).alias("b"), "word")
    sizes = edges.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("e"), F.max("dst").alias("high"), F.min("dst").alias("low"))
    heads = sizes.select(*keys, F.array("v", "e", "high", "low").alias("head"), (BLOCK_HEADER + 2 * F.col("v") + F.col("e")).alias("n"))
    return _pieces(words, keys, heads, True, F.format_string("%d-%d.edge.npy", "pid", "col"))


def write_files(blobs: DataFrame, path: str) -> int:
    """Write (name, content) rows as files below ``path``, from the executors; a rewritten file has the same bytes. Returns their number.

    Where there are more columns, a file's rows are its pieces in the order of those; one task writes them, a few at a time.
    """
    order = [c for c in blobs.columns if c not in ("name", "content")]
    if order:
        blobs = blobs.repartition("name").sortWithinPartitions("name", *order).select("name", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        last, out, n = None, None, 0
        try:
            for pdf in batches:
                for name, content in zip(pdf["name"], pdf["content"]):
                    if name != last:
                        if out:
                            out.close()
                        last, out, n = name, store.open_output_stream(f"{root}/{name}"), n + 1
                    out.write(content)
        finally:
            if out:
                out.close()
        yield pd.DataFrame({"n": [n]})

    with settings(blobs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}):
        return blobs.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
