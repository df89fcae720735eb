"""Substring deduplication by hashing units of text.

A text is cut into units at line ends and, within longer lines, after words where the hash of a word
pair is the smallest within REACH pairs on either side. Such cuts depend on nearby words alone, so a
passage that is pasted into the middle of other lines has the same inner units everywhere; units of
long lines have more than REACH words. Units are normalised (A-Z lower-cased, white space
collapsed) and hashed to 128 bits; of equal units the occurrence with the smallest (doc_id, offset)
stays and all others go, if they stand in a run of removed units of MIN_WORDS words or more or, with
``short_lines``, are a whole line of any length.

Each map task settles the repeats among its own rows first, so even a unit of every document reaches
the shuffle only once a task; one shuffle and a window over each digest decide the rest. Which units
go doesn't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, map_arrow, small
from .textvec import SPACES, _grow, mix, pieces, words

REACH, MIN_WORDS = 4, 10
#: Rows that a map task settles among themselves at a time, which bounds its memory.
ROWS_AT_ONCE = 1_000_000
_U = np.uint64
_COLUMNS = ["d1", "d2", "doc_id", "no_id", "row", "start", "end", "n_words", "line", "repeat"]
_SCHEMA = "d1 long, d2 long, doc_id long, no_id boolean, row long, start long, end long, n_words int, line boolean, repeat boolean"


def _word_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte position after each word, in the order of words()."""
    inside = ~SPACES[data]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    inner = offsets[1:-1]
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(inside & ~after) + 1


def units(data: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """Units of a piece of a column: d1, d2, text number, start and end in code points, words, is it a whole line.

    A unit runs from the end of the one before it (or the text's start) to the end of its last word.
    """
    h, wat = words(data, offsets)
    n = len(h)
    if not n:
        return (*(np.empty(0, np.int64) for _ in range(6)), np.empty(0, bool))
    end = _word_ends(data, offsets)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.zeros(n, bool)  # the last word of its line or text
    last[-1] = True
    last[:-1] = lines[end[1:] - 1] > lines[end[:-1]]
    last[wat[1:][wat[1:] > 0] - 1] = True
    # a cut stands after word i if its pair (i, i + 1) is the smallest around, among the pairs of its line
    line_no = np.concatenate([[0], np.cumsum(last)[:-1]])
    pair = np.full(n + 2 * reach, np.iinfo(np.uint64).max, _U)
    mid = pair[reach : reach + n]
    mid[:-1] = mix(h[:-1] * _U(0x9FB21C651E98DF25) + h[1:])
    mid[last] = np.iinfo(np.uint64).max
    line_pad = np.concatenate([np.full(reach, -1), line_no, np.full(reach, -1)])
    cut_here = ~last
    for i in range(1, reach + 1):
        before, after = slice(reach - i, reach - i + n), slice(reach + i, reach + i + n)
        # the line's ends count as out of reach: no unit of fewer than reach words is cut off a line
        cut_here &= (mid < pair[before]) & (line_pad[before] == line_no)
        cut_here &= (mid <= pair[after]) & (line_pad[after] == line_no)
    cut_after = np.flatnonzero(cut_here | last)
    first = np.concatenate([[0], cut_after[:-1] + 1])
    power, inverse = _grow(n + 1)
    d = []
    for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
        sums = np.zeros(n + 1, _U)
        np.cumsum(mix(h ^ _U(salt)) * power[:n], out=sums[1:])
        d.append(mix((sums[cut_after + 1] - sums[first]) * inverse[first]).view(np.int64))
    text = np.searchsorted(wat, first, "right") - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = chars[offsets[text]]
    stop = chars[end[cut_after]] - base
    start = np.concatenate([[0], stop[:-1]])
    start[np.concatenate([[True], text[1:] != text[:-1]])] = 0
    return d[0], d[1], text, start, stop, cut_after - first + 1, last[cut_after] & last[first - 1]


def _settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """All rows, with all but the first ranked of equal units marked as repeats."""
    t = {c: np.concatenate(v) for c, v in zip(_COLUMNS, zip(*held))}
    order = np.lexsort((t["start"], t["row"], t["doc_id"], t["no_id"], t["d2"], t["d1"]))
    t = {k: v[order] for k, v in t.items()}
    repeat = np.zeros(len(order), bool)
    repeat[1:] = (t["d1"][1:] == t["d1"][:-1]) & (t["d2"][1:] == t["d2"][:-1])
    t["repeat"] = repeat
    for i in range(0, len(order), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(t[c][i : i + 50_000]) for c in _COLUMNS], _COLUMNS)


def _map(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            no_id = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids, rows = b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy()
            for first, data, at in pieces(b.column(2)):
                d1, d2, text, start, stop, k, line = units(data, at, reach)
                own = first + text
                held.append((d1, d2, ids[own], no_id[own], rows[own], start, stop, k.astype(np.int32), line))
                n += len(d1)
                if n >= ROWS_AT_ONCE:
                    yield from _settle(held)
                    held, n = [], 0
        if n:
            yield from _settle(held)

    return run


def _row_spans(rows: DataFrame, reach: int, min_words: int, short_lines: bool) -> DataFrame:
    """Of rows (doc_id long, row, text): the spans to remove, as row, doc_id, start, end, n_words, unit."""
    found = map_arrow(rows, _map(reach), _SCHEMA)
    # a map task's repeats are settled; they are dealt out evenly, each for itself
    deal = [F.when(F.col("repeat"), F.xxhash64("row", "start")).otherwise(F.col("d1")).alias("_d"), F.when(~F.col("repeat"), F.col("d2")).alias("_e")]
    first = F.row_number().over(Window.partitionBy("_d", "_e", "repeat").orderBy("no_id", "doc_id", "row", "start")) == 1
    gone = found.select("*", *deal).withColumn("_first", first).where("repeat OR NOT _first").drop("_d", "_e", "_first")
    w = Window.partitionBy("row").orderBy("start", "end")
    runs = gone.select("*", F.lag("end").over(w).alias("_end")).withColumn("_run", F.sum(F.when(F.col("start") == F.col("_end"), 0).otherwise(1)).over(w))
    # of a run that is too short, only its whole lines can go, and other units part them
    whole = F.col("line") if short_lines else F.lit(False)
    runs = runs.select("*", F.sum(F.when(whole, 0).otherwise(1)).over(w).alias("_part"), (F.sum("n_words").over(Window.partitionBy("row", "_run")) >= min_words).alias("_long"))
    runs = runs.where(F.col("_long") | whole).withColumn("_part", F.when(F.col("_long"), 0).otherwise(F.col("_part")))
    doc_id = F.first(F.when(~F.col("no_id"), F.col("doc_id")))
    return runs.groupBy("row", "_run", "_part").agg(doc_id.alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.min_by("d1", "start").alias("unit")).drop("_run", "_part")


def repeated_spans(docs: DataFrame, reach: int = REACH, min_words: int = MIN_WORDS, short_lines: bool = False) -> DataFrame:
    """Spans to remove: doc_id, start, end (code points of the original text), n_words, unit (digest of the span's first unit).

    Runs of fewer than ``min_words`` words stay; with ``short_lines``, the whole lines among them go too.
    Occurrences rank by doc_id (null last), then by row as stored, then by offset. Rows that share a
    doc_id, or have none, are texts of their own. Null texts have no units. doc_id must be an integer.
    """
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id is {kind}: occurrences are ranked by an integer doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return _row_spans(rows, reach, min_words, short_lines).select("doc_id", "start", "end", "n_words", "unit")


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, spans):
        if text is not None and gone is not None:
            kept, at = [], 0
            for s in sorted(gone, key=lambda s: s["start"]):
                kept.append(text[at : s["start"]])
                at = max(at, s["end"])
            text = "".join([*kept, text[at:]])
        out.append(text)
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, reach: int = REACH, min_words: int = MIN_WORDS, short_lines: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, with repeated spans cut out of the text, and their original offsets.

    The offsets are in a column ``removed`` (null without any), with underscores after it if ``docs`` has one of that name.
    Ranks are as in ``repeated_spans``, also for a doc_id that is no integer: then by row as stored.
    """
    key, removed = free_name(docs, "_key"), free_name(docs, "removed")
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    integer = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    doc_id = (F.col("doc_id") if integer else F.lit(None)).cast("long").alias("doc_id")
    spans = _row_spans(keyed.select(doc_id, F.col(key).alias("row"), "text"), reach, min_words, short_lines)
    spans = cut(spans.groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_gone")))
    both = keyed.join(small(spans), keyed[key] == spans["_row"], "left")
    text = F.pandas_udf(_without, "string")(keyed["text"], spans["_gone"])
    return both.select(*[text.alias("text") if c == "text" else keyed[c] for c in docs.columns], spans["_gone"].alias(removed))
