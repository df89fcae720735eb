"""N-gram Jaccard join by signature trees, and the components of its links.

Exact: no pair of texts at the threshold is lost.

1. Texts with equal shingle sets become one node. A node has a bitmap (each shingle sets one bit of
   at least BITS for each shingle) and routing shingles: with n shingles and threshold t, two linked
   sets share one of the first n - ceil(t n) + 1 shingles of both, in any common order. The order is by
   the count of the shingle's rarest word, from a table of word counts of all texts, then by hash, so
   that passages of many texts route nothing while there are rarer ones.
2. The nodes of a routing shingle are the children of one branch of the root. A few random leaders of
   each branch and size band are verified against the band's others first, which joins most groups of
   near copies. Branches of two nodes are a pair to verify and need no tree.
3. What is left open, a branch with nodes of several components, gets a signature tree: its nodes hold
   the OR of the bitmaps below them, their size range, and their component if they have only one. Two
   trees (or one with itself) are descended together; a pair of tree nodes is dropped if the sizes
   can't match, if all lies in one component already, or if the OR bitmaps share too few bits for the
   overlap that a link needs. What is left at the leaves are candidates.
4. A block gives at most one candidate for each of its components, a forest of them, to be verified by
   exact intersection. If it had others, and the links found don't make it one component, the sets
   of its nodes with candidates are brought to it, and one task verifies pair by pair what still
   would join two components. So no step makes more rows than it reads, however large a group is.

Everything about branches that needs no bitmaps is an aggregation or a join, so a routing shingle of a
third of all nodes is pre-aggregated and split like any key. A branch with more than BRANCH shingles is
dealt into blocks by component and size band; pairs of blocks that can hold a link go to tasks of
their own, and a component is never paired with itself. Tasks hold one block pair at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, free_name, map_arrow, n_parts, small
from .components import components
from .textvec import SPACES, mix, pieces, shingle_sets, shingles, words

#: Cells of the word count table, a fixed size at any scale; tables merged by one task; leaders of a group; shingles of a block (4 bytes of bitmap each at most); fan-out of a tree.
CELLS, FAN_IN, LEADERS, BRANCH, FAN_OUT = 1 << 20, 16, 16, 1 << 20, 8
#: Blocks of so many nodes are single leaves; the pairs of many leaves are tested together.
LEAF = 32
#: Bits of a bitmap for each shingle, at least: with 16, about one difference in twenty is hidden by a shared bit. They are kept deflated.
BITS = 16
#: Pairs of tree nodes that are looked at together.
STEP = 50_000
_U = np.uint64
_MASK = _U(CELLS - 1)


# ---- word counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for b in batches:
        for _, data, at in pieces(b.column(0)):
            h, _ = words(data, at)
            counts += np.bincount((h & _MASK).astype(np.int64), minlength=CELLS)
    yield pa.RecordBatch.from_arrays([pa.array([np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["counts"])


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for b in batches:
        for x in b.column(0):
            counts += np.frombuffer(x.as_buffer(), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["counts"])


def word_rarity(docs: DataFrame) -> np.ndarray:
    """For each cell of word hashes, the logarithm of how often its words occur in all texts."""
    made = map_arrow(docs.select("text"), _count_words, "counts binary")
    parts = docs.select("text").rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        made = made.repartition(parts).mapInArrow(_add_counts, "counts binary")
    rows = made.collect()
    counts = sum((np.frombuffer(r[0], np.uint32).astype(np.int64) for r in rows), np.zeros(CELLS, np.int64))
    return np.log2(counts + 1).astype(np.uint8)


# ---- nodes


def _bitmap(s: np.ndarray) -> bytes:
    bits = max(64, 1 << (BITS * len(s) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(s & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _signatures(k: int, percent: int, rarity, ends: np.ndarray):
    names = ["doc_id", "hash", "n", "d1", "d2", "bitmap", "route"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        for b in batches:
            for row, data, at in pieces(b.column(2)):
                h, wat = words(data, at, ends)
                s, sat = shingles(h, wat, k, True)
                rare = np.concatenate([table[(h & _MASK).astype(np.int64)], np.full(k, 255, np.uint8)])
                first = np.repeat(wat[:-1] - sat[:-1], np.diff(sat)) + np.arange(sat[-1])
                rarest = np.minimum.reduce([rare[first + i] for i in range(k)]).astype(_U)
                rows = []
                for i in range(len(at) - 1):
                    x, where = np.unique(s[sat[i] : sat[i + 1]], return_index=True)
                    if not len(x):
                        rows.append((0, 0, 0, b"", None))
                        continue
                    key = (rarest[sat[i] : sat[i + 1]][where] << _U(58)) | (x >> _U(6))
                    p = len(x) + (-percent * len(x)) // 100 + 1
                    route = x[np.argpartition(key, p - 1)[:p]]
                    d1, d2 = (int(mix(x ^ _U(c)).sum(dtype=_U).view(np.int64)) for c in (0x243F6A8885A308D3, 0x13198A2E03707344))
                    rows.append((len(x), d1, d2, zlib.compress(_bitmap(x), 1), route.view(np.int64)))
                n, d1, d2, bitmap, route = zip(*rows)
                at_route = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in route])]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int64), *[r for r in route if r is not None]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(rows)), b.column(1).slice(row, len(rows)), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bitmap, pa.binary()), pa.ListArray.from_arrays(at_route, pa.array(flat))], names)

    return run


# ---- branches


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Can sets of these sizes link?"""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _band(n: Column, percent: int) -> Column:
    """Size bands, so wide that linked sets lie in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9) if percent < 100 else n


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _branches(routed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of routed rows (token, node, n): the rows of branches of three and more nodes, and pairs (a, b) to verify first."""
    end = F.struct("n", "node")
    shared = cut(routed.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(end).alias("lo"), F.max(end).alias("hi")).where("m >= 2"))
    two = shared.where("m = 2").where(_fits(F.col("lo.n"), F.col("hi.n"), percent)).select(*_pairs(F.col("lo.node"), F.col("hi.node")))
    branch = cut(routed.join(shared.where("m > 2").select("token"), "token").withColumn("band", _band(F.col("n"), percent)))
    draw = F.struct(F.xxhash64("node", F.pmod("token", F.lit(LEADERS))), "node")
    lead = cut(branch.groupBy("token", "band").agg(F.min_by(F.struct("node", "n"), draw).alias("lead")))
    led = branch.join(lead, ["token", "band"]).where((F.col("node") != F.col("lead.node")) & _fits(F.col("n"), F.col("lead.n"), percent)).select(*_pairs(F.col("node"), F.col("lead.node")))
    above = lead.select("token", (F.col("band") - 1).alias("band"), F.col("lead").alias("up"))
    ladder = lead.join(above, ["token", "band"]).where(_fits(F.col("lead.n"), F.col("up.n"), percent)).select(*_pairs(F.col("lead.node"), F.col("up.node")))
    pairs = cut(two.union(led).union(ladder).distinct())
    drop(shared, lead)
    return branch, pairs


def _blocks(branch: DataFrame, label: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The branches with more than one component as block pairs: (block, side, node, n, label); side 0: a block with itself.

    Second, the files that this reads.

    Near copies share many branches with the same nodes; of such branches one is enough.
    """
    rows = cut(branch.join(label, "node", "left").select("token", "node", "n", "band", F.coalesce("root", "node").alias("label")))
    tokens = rows.groupBy("token").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
    tokens = cut(tokens.where("low <> high").groupBy("m", "h1", "h2").agg(F.min("token").alias("token"), F.first("size").alias("size")).select("token", "size"))
    rows, files = rows.join(tokens, "token"), [rows, tokens]
    whole = rows.where(F.col("size") <= BRANCH).select(F.col("token").alias("block"), F.lit(0).alias("side"), "node", "n", "label")
    if tokens.where(F.col("size") > BRANCH).isEmpty():
        return whole, files
    # larger ones by component and band; components of less than a block share the blocks of their band
    many = rows.where(F.col("size") > BRANCH)
    cells = many.groupBy("token", "band", "label").agg(F.sum("n").alias("cell"))
    cells = cells.withColumn("of", F.when(F.col("cell") * 2 > BRANCH, F.col("label")))
    number = F.ceil(F.sum("cell") / BRANCH)
    groups = cells.groupBy("token", "band", "of").agg(number.alias("k"))
    at = cells.alias("c").join(groups.alias("g"), (F.col("c.token") == F.col("g.token")) & (F.col("c.band") == F.col("g.band")) & F.col("c.of").eqNullSafe(F.col("g.of")))
    at = at.select(F.col("c.token").alias("token"), F.col("c.band").alias("band"), F.col("c.label").alias("label"), F.col("c.of").alias("of"), "k")
    dealt = cut(many.join(at, ["token", "band", "label"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("k"))).select("token", "node", "n", "label", "band", "of", "part"))
    place = cut(dealt.select("token", "band", "of", "part").distinct())
    key = F.struct("band", "of", "part")
    x, y = place.select("token", key.alias("x")), place.select(F.col("token").alias("_t"), key.alias("y"))
    near = (F.col("y.band") - F.col("x.band")).isin(0, 1) if percent < 100 else F.col("x.band") == F.col("y.band")
    both = x.join(y, (F.col("token") == F.col("_t")) & (F.col("x") <= F.col("y")) & near & (F.col("x.of").isNull() | F.col("y.of").isNull() | (F.col("x.of") != F.col("y.of"))))
    both = cut(both.select("token", "x", "y", F.xxhash64("token", "x", "y").alias("block")))
    sides = both.select("token", F.col("x").alias("at"), "block", F.when(F.col("x") == F.col("y"), 0).otherwise(1).alias("side"))
    sides = sides.union(both.where("x <> y").select("token", F.col("y").alias("at"), "block", F.lit(2).alias("side")))
    cold = dealt.withColumn("at", key).join(sides, ["token", "at"]).select("block", "side", "node", "n", "label")
    return whole.union(cold), [*files, dealt, place, both]


# ---- signature trees


def most_differing(total, percent: int):
    """In how many shingles two linked sets of together ``total`` shingles may differ: what the least whole overlap leaves."""
    return total - 2 * -(-percent * total // (100 + percent))


class SignatureTree:
    """Levels from the sets up to at most FAN_OUT nodes: OR bitmaps, least set bits, size range, label (-1: several)."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, label: np.ndarray):
        self.levels = [(bits, np.bitwise_count(bits).sum(1, dtype=np.int64), n, n, label)]
        while len(self.levels[-1][2]) > FAN_OUT:
            self.grow()

    def grow(self) -> None:
        bits, pop, low, high, label = self.levels[-1]
        at = np.arange(0, len(pop), FAN_OUT)
        one = np.minimum.reduceat(label, at)
        self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(pop, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where(one == np.maximum.reduceat(label, at), one, -1)))


def dual_traversal(s: SignatureTree, t: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets whose sizes, components and bitmaps allow a link; of a tree with itself, each pair once."""
    while len(s.levels) < len(t.levels):
        s.grow()
    while len(t.levels) < len(s.levels):
        t.grow()
    top = len(s.levels) - 1
    x, y = (g.ravel() for g in np.meshgrid(np.arange(len(s.levels[top][1])), np.arange(len(t.levels[top][1])), indexing="ij"))
    stack = [(top, x, y)]
    while stack:
        level, x, y = stack.pop()
        if len(x) > STEP:
            stack += [(level, x[i : i + STEP], y[i : i + STEP]) for i in range(0, len(x), STEP)]
            continue
        sb, sp, sl, sh, sc = s.levels[level]
        tb, tp, tl, th, tc = t.levels[level]
        if s is t:
            ok = x <= y if level else x < y
            x, y = x[ok], y[ok]
        ok = (percent * sl[x] <= 100 * th[y]) & (percent * tl[y] <= 100 * sh[x]) & ~((sc[x] == tc[y]) & (sc[x] >= 0))
        x, y = x[ok], y[ok]
        shared = np.bitwise_count(sb[x] & tb[y]).sum(1, dtype=np.int64)
        differ = sp[x] + tp[y] - 2 * shared
        ok = differ * (100 + percent) <= (100 - percent) * (sh[x] + th[y]) if level else differ <= most_differing(sh[x] + th[y], percent)
        x, y = x[ok], y[ok]
        if not level:
            yield x, y
        elif len(x):
            below_s, below_t = len(s.levels[level - 1][1]), len(t.levels[level - 1][1])
            i, j = (g.ravel() for g in np.meshgrid(np.arange(FAN_OUT), np.arange(FAN_OUT), indexing="ij"))
            x, y = (x[:, None] * FAN_OUT + i).ravel(), (y[:, None] * FAN_OUT + j).ravel()
            ok = (x < below_s) & (y < below_t)
            stack.append((level - 1, x[ok], y[ok]))


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of half the length: shingles keep their low hash bits, so the halves are OR-combined."""
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


def block_pairs(bitmaps: list[bytes], n: np.ndarray, label: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a block that may link: trees by bitmap length, each with itself and with the next longer ones."""
    width = np.array([len(b) // 8 for b in bitmaps])
    trees: dict[tuple[int, int], np.ndarray] = {}
    for w in np.unique(width):
        for d in np.unique(side):
            at = np.flatnonzero((width == w) & (side == d))
            if len(at):
                trees[int(w), int(d)] = at[np.lexsort((n[at], label[at]))]
    raw = {key: np.frombuffer(b"".join(bitmaps[i] for i in at), _U).reshape(len(at), key[0]) for key, at in trees.items()}
    built: dict[tuple[int, int, int], SignatureTree] = {}

    def tree(key: tuple[int, int], w: int) -> SignatureTree:
        if (*key, w) not in built:
            at = trees[key]
            built[(*key, w)] = SignatureTree(_fold(raw[key], w), n[at], label[at])
        return built[(*key, w)]

    for (w, d), at in trees.items():
        for (v, e), at2 in trees.items():
            if (v, e) < (w, d) or (d != e) != (d != 0) or (d == 0) != (e == 0):
                continue
            if percent * n[at2].min() > 100 * n[at].max() or percent * n[at].min() > 100 * n[at2].max():
                continue
            for x, y in dual_traversal(tree((w, d), w), tree((v, e), w), percent):
                yield at[x], at2[y]


def leaf_pairs(bitmaps: list[bytes], n: np.ndarray, label: np.ndarray, groups: list[tuple[int, int]], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets that may link, within each of many small groups (start, end)."""
    upper = {k: np.triu_indices(k, 1) for k in {hi - lo for lo, hi in groups}}
    x = np.concatenate([np.empty(0, np.int64), *[lo + upper[hi - lo][0] for lo, hi in groups]])
    y = np.concatenate([np.empty(0, np.int64), *[lo + upper[hi - lo][1] for lo, hi in groups]])
    ok = (label[x] != label[y]) & (percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y]))
    x, y = x[ok], y[ok]
    width = np.array([len(b) // 8 for b in bitmaps])
    least = np.minimum(width[x], width[y])
    for w in np.unique(least).tolist():
        at = least == w
        rows, place = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
        bits = np.empty((len(rows), w), _U)
        for v in np.unique(width[rows]).tolist():
            own = width[rows] == v
            bits[own] = _fold(np.frombuffer(b"".join(bitmaps[i] for i in rows[own]), _U).reshape(-1, v), w)
        px, py = place[: at.sum()], place[at.sum() :]
        x_, y_ = x[at], y[at]
        for i in range(0, len(px), max(1, (1 << 20) // w)):
            t = slice(i, i + max(1, (1 << 20) // w))
            differ = np.bitwise_count(bits[px[t]] ^ bits[py[t]]).sum(1, dtype=np.int64)
            near = differ <= most_differing(n[x_[t]] + n[y_[t]], percent)
            yield x_[t][near], y_[t][near]


def _moved(by: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in pairs:
        yield by + x, by + y


def _groups(key: np.ndarray) -> list[tuple[int, int]]:
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
    return list(zip(start.tolist(), np.append(start[1:], len(key)).tolist()))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by block (column 0, shingles in column 3): tables of whole blocks, of some BRANCH shingles if blocks are smaller."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != key[0] and size >= BRANCH:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        start = np.flatnonzero(key[1:] != key[:-1]) + 1
        weight, lo = np.concatenate([[0], np.cumsum(b.column(3).to_numpy())]), 0
        for at in start.tolist():
            if size + weight[at] - weight[lo] >= BRANCH:
                yield pa.Table.from_batches([*held, b.slice(lo, at - lo)])
                held, size, lo = [], 0, at
        held.append(b.slice(lo))
        size += weight[-1] - weight[lo]
    if held:
        yield pa.Table.from_batches(held)


def _candidates(held: pa.Table, bitmap: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a block that may link, for a table of whole blocks."""
    side, n, label = (held[c].to_numpy() for c in ("side", "n", "label"))
    groups = _groups(held["block"].to_numpy())
    yield from leaf_pairs(bitmap, n, label, [g for g in groups if g[1] - g[0] <= LEAF and side[g[0]] == 0], percent)
    for lo, hi in groups:
        if hi - lo > LEAF or side[lo]:
            yield from _moved(lo, block_pairs(bitmap[lo:hi], n[lo:hi], label[lo:hi], side[lo:hi], percent))


class _Joins:
    """Components of the rows of a table of blocks: at first, those of a block with the same label."""

    def __init__(self, held: pa.Table):
        own = np.stack([held["block"].to_numpy(), held["label"].to_numpy()])
        self.at = np.unique(own, axis=1, return_inverse=True)[1].ravel()
        self.up = np.arange(len(self.at))

    def _root(self, c: int) -> int:
        up = self.up
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up[self.at[x]] != self.up[self.at[y]]

    def join(self, x: np.ndarray, y: np.ndarray, linked=None) -> np.ndarray:
        """Which pairs join two components that are apart by then (and are ``linked``): fewer than there are components."""
        took = np.zeros(len(x), bool)
        for i in np.flatnonzero(self.apart(x, y)).tolist():
            a, b = self._root(self.at[x[i]]), self._root(self.at[y[i]])
            if a != b and (linked is None or linked(x[i], y[i])):
                self.up[max(a, b)] = min(a, b)
                took[i] = True
        return took


def _pair_batch(node: np.ndarray, x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    x, y = (node[np.concatenate([np.empty(0, np.int64), *i])] for i in (x, y))
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)


def _bitmaps(held: pa.Table) -> list[bytes]:
    return [zlib.decompress(x.as_buffer()) for c in held["bitmap"].chunks for x in c]


def _tree_pairs(percent: int):
    """Rows (block, side, node, n, label, bitmap) sorted by block: forests of pairs (a, b) of nodes that may link.

    Rows with only a block name those that have other such pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_blocks(batches):
            block, joins, found, more = held["block"].to_numpy(), _Joins(held), ([], []), set()
            for x, y in _candidates(held, _bitmaps(held), percent):
                took = joins.join(x, y)
                found[0].append(x[took])
                found[1].append(y[took])
                more.update(np.unique(block[x[~took]]).tolist())
            a, b = _pair_batch(held["node"].to_numpy(), *found)
            none = [None] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *none], pa.int64()), pa.array([*b.tolist(), *none], pa.int64()), pa.array([*[None] * len(a), *more], pa.int64())], ["a", "b", "block"])

    return run


def _tree_members(percent: int):
    """Of the same rows, without bitmaps, those whose nodes may link to another component of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_blocks(batches):
            marked = np.zeros(held.num_rows, bool)
            for x, y in _candidates(held, _bitmaps(held), percent):
                marked[x] = marked[y] = True
            yield from held.select(["block", "side", "node", "n", "label"]).filter(pa.array(marked)).to_batches()

    return run


def _tree_links(percent: int):
    """Rows (block, side, node, n, label, shingles) sorted by block: links (a, b) that join all components of a block that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_blocks(batches):
            sets = [np.frombuffer(x.as_buffer(), _U) for c in held["shingles"].chunks for x in c]
            joins, found = _Joins(held), ([], [])
            for x, y in _candidates(held, [_bitmap(s) for s in sets], percent):
                took = joins.join(x, y, lambda i, j: _linked(sets[i], sets[j], percent))
                found[0].append(x[took])
                found[1].append(y[took])
            a, b = _pair_batch(held["node"].to_numpy(), *found)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


# ---- verification


def _by_bitmap(percent: int):
    """Leaf test of single pairs: bitmaps may differ in no more bits than linked sets can in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            ok = []
            for total, p, q in zip(n.tolist(), b.column(4), b.column(5)):
                p, q = (np.frombuffer(zlib.decompress(x.as_buffer()), _U)[None] for x in (p, q))
                w = min(p.shape[1], q.shape[1])
                ok.append(int(np.bitwise_count(_fold(p, w) ^ _fold(q, w)).sum()) <= most_differing(total, percent))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


def _sets(k: int, ends: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column(0)
            held, first, size = [], 0, 0
            for row, s in shingle_sets(b.column(1), k, ends, True):
                held.append(s.tobytes())
                size += len(held[-1])
                if size > 1 << 22 or row == len(nodes) - 1:
                    yield pa.RecordBatch.from_arrays([nodes.slice(first, len(held)), pa.array(held, pa.binary())], ["node", "shingles"])
                    first, held, size = row + 1, [], 0

    return run


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Do these sorted sets link?"""
    if len(p) > len(q):
        p, q = q, p
    shared = int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p))
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_linked(np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U), percent) for p, q in zip(b.column(2), b.column(3))]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


def _node_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, ends: np.ndarray) -> DataFrame:
    """node, shingles of the wanted nodes, from one text for each: a row of the node's doc_id with the same text."""
    keys = cut(nodes.select("node", F.col("key.doc_id").alias("_id"), F.col("key.hash").alias("_hash")).join(wanted, "node"))
    texts = docs.select("doc_id", "text").join(small(keys), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))).groupBy("node").agg(F.any_value("text").alias("text"))
    sets = cut(map_arrow(texts, _sets(k, ends), "node long, shingles binary"))
    drop(keys)
    return sets


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, ends: np.ndarray) -> DataFrame:
    """Of candidate pairs (a, b) of nodes, those that are links: by bitmaps, then by the sets of the texts behind what is left."""
    either = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(either(pairs))
    marks = nodes.select("node", "n", "bitmap").join(small(wanted), "node")
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"bitmap_{side}")), side)
    likely = cut(map_arrow(pairs.select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b"), _by_bitmap(percent), "a long, b long"))
    sets = _node_sets(either(likely), nodes, docs, k, ends)
    both = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_p")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_q")), "b")
    links = cut(map_arrow(both.select("a", "b", "_p", "_q"), _verify(percent), "a long, b long"))
    drop(wanted, likely, sets)
    return links


def _leaves(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of blocks with their nodes' bitmaps or sets, sorted by block in their tasks."""
    rows = blocks.join(marks, "node").select("block", "side", "node", "n", "label", marks.columns[1])
    return rows.repartition(n_parts(blocks.sparkSession), "block").sortWithinPartitions("block", "side", "node")


def _links_within(blocks: DataFrame, label: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, ends: np.ndarray) -> DataFrame:
    """Links between components, as ``label`` has them, of the same block: every pair that may link is verified where the block is."""
    rows = cut(blocks.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
    several = cut(rows.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("block"))
    members = cut(map_arrow(_leaves(rows.join(small(several), "block", "left_semi"), nodes.select("node", "bitmap")), _tree_members(percent), "block long, side int, node long, n long, label long"))
    sets = _node_sets(members.select("node").distinct(), nodes, docs, k, ends)
    links = cut(map_arrow(_leaves(members, sets), _tree_links(percent), "a long, b long"))
    drop(rows, several, members, sets)
    return links


def _classes(docs: DataFrame, k: int, percent: int, ends: np.ndarray, one_document: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, hash, n, node, rep), nodes (node, key, bitmap, route), and node, root of every linked node.

    With ``one_document``, rows that share a doc_id are linked too, whatever their texts.
    """
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(word_rarity(docs))
    id_type = dict(docs.dtypes)["doc_id"]
    signed = cut(map_arrow(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"), _signatures(k, percent, rarity, ends), f"doc_id {id_type}, hash long, n long, d1 long, d2 long, bitmap binary, route array<long>"))
    digest = ["n", "d1", "d2"]
    key = F.struct("doc_id", "hash")
    first = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), key)), F.min(key))
    nodes = signed.where("n > 0").groupBy(*digest).agg(first.alias("key"), F.any_value("bitmap").alias("bitmap"), F.any_value("route").alias("route"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    names = nodes.select(*[F.col(c).alias(f"_{c}") for c in digest], "node", F.col("key.doc_id").alias("rep"))
    rows = signed.select("doc_id", "hash", *digest)
    rows = cut(rows.join(names, (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left").select("doc_id", "hash", "n", "node", "rep"))
    drop(signed)
    branch, pairs = _branches(nodes.select(F.explode("route").alias("token"), "node", "n"), percent)
    links = _links(pairs, nodes, docs, k, percent, ends)
    blocks, files = _blocks(branch, components(links), percent)
    tried = cut(map_arrow(_leaves(blocks, nodes.select("node", "bitmap")), _tree_pairs(percent), "a long, b long, block long"))
    more = cut(tried.where("block IS NULL").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    others = more if more.isEmpty() else _links(more, nodes, docs, k, percent, ends)
    every = links.union(others)
    left = cut(tried.where("block IS NOT NULL").select("block").distinct())
    if not left.isEmpty():
        every = every.union(_links_within(blocks.join(small(left), "block", "left_semi"), components(every), nodes, docs, k, percent, ends))
    drop(branch, tried, left, *files)
    if one_document:
        own = rows.where("doc_id IS NOT NULL AND node IS NOT NULL")
        several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
        every = every.union(own.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    label = components(every)
    drop(pairs, links, more)
    return rows, nodes, label


def linked_components(docs: DataFrame, k: int = 3, percent: int = 90, ends: np.ndarray = SPACES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Words are runs of other than ASCII white space (or what ``ends`` says), A-Z lower-cased; a text of
    fewer than ``k`` words is one shingle. Two rows link when 100 * shared >= ``percent`` * joint
    shingles. Null and empty texts have no shingles and no links. Rows that repeat a doc_id count as one
    document with the links of all its texts; rows with a null doc_id are documents of their own that
    are reached through links only, and the component of rows that reach no doc_id is null. Empty
    input: no rows. Sets are equal when their 128-bit digests are.
    """
    rows, nodes, label = _classes(docs, k, percent, ends, one_document=True)
    placed = label.join(nodes.select("node", F.col("key.doc_id").alias("rep")), "node")
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = cut(placed.join(smallest, "root").select("node", "component_id"))
    drop(nodes)
    out = rows.join(placed, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "rep")).alias("component_id"))


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, ends: np.ndarray = SPACES) -> DataFrame:
    """All columns of one row for each component of linked rows: the one with the smallest doc_id, null last.

    Every row is judged by its own text: rows that share a doc_id, or have none, are linked by their texts
    only. Of rows equal in doc_id and text one stays, of other rows with the same smallest doc_id the
    one whose text has the smaller 64-bit hash. Null and empty texts all stay. Empty input: no rows.
    """
    rows, nodes, label = _classes(docs, k, percent, ends, one_document=False)
    drop(nodes)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    rows = rows.where("node IS NOT NULL").select("node", rank.alias("rank"))
    placed = rows.groupBy("node").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("copies")).join(label, "node", "left")
    placed = cut(placed.withColumn("root", F.coalesce("root", "node")))
    stays = placed.groupBy("root").agg(F.min("least").alias("stays"), F.sum("copies").alias("_copies")).where("_copies > 1")
    winner = cut(placed.join(stays, "root").select("node", "stays"))
    judged = rows.join(small(winner), "node").groupBy("rank", "stays").agg(F.count(F.lit(1)).alias("copies"))
    judged = cut(judged.select(F.col("rank.doc_id").alias("_id"), F.col("rank.hash").alias("_hash"), F.col("rank").eqNullSafe(F.col("stays")).alias("_stays"), "copies"))
    drop(placed, winner)
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    gone, again = (cut(judged.where(which).select("_id", "_hash")) for which in ("NOT _stays", "_stays AND copies > 1"))
    drop(judged)
    kept = docs.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return kept
    text = free_name(docs, "_text_hash")
    several = docs.join(small(again), same, "left_semi").withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
    return kept.join(small(again), same, "left_anti").unionByName(several)
