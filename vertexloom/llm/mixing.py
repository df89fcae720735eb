"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

Documents of a source are shuffled by a seeded hash and cut into blocks. With weight w (a whole number
of UNIT-ths), block k of a source is released at floor(k / w) and due at ceil((k + 1) / w); every slot
takes the released block that is due first. On one processor this keeps each source within one block
of w times the slots passed, however long the schedule.

The schedule is computed in cycles, each by itself: a state in which every source has floor(w T) or
floor(w T) + 1 blocks, those due first, is sure to meet all later dues, and a cycle of schedule from
there leads to the state at the next cycle's start. Between two such states a cycle takes just the
blocks that lie between them, so no block is lost or repeated. (That each state leads exactly to the
next is tested, not proven; if one did not, some blocks would come before their release.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, n_parts, ranked, small

#: Slots of a cycle, which one task computes (at least ten slots a source, on average).
CYCLE = 1000
#: Weights are whole numbers of this part.
UNIT = 10**9
#: Slots are computed up to so many times the number of blocks; what is left then are sources of tiny weight.
HORIZON = 4
BLOCK = 32
#: Default weights: shares proportional to rows ** TEMPERATURE, which lifts small sources.
TEMPERATURE = 0.7
SEED = 7


def _whole_weights(sources: DataFrame) -> DataFrame:
    """src, n, blocks and ``a``: the weight in UNIT-ths, at least one, that sum to UNIT (largest remainders)."""
    every, order = Window.partitionBy(), Window.orderBy((F.col("_raw") - F.floor("_raw")).desc(), F.col("src"))
    out = sources.select("*", (F.col("w") / F.sum("w").over(every) * UNIT).alias("_raw"))
    more = F.when(F.row_number().over(order) <= UNIT - F.sum(F.floor("_raw")).over(every), 1).otherwise(0)
    out = out.select("src", "n", "blocks", F.greatest(F.lit(1), F.floor("_raw") + more).cast("long").alias("a"))
    largest = F.row_number().over(Window.orderBy(F.col("a").desc(), F.col("src"))) == 1
    return out.select("src", "n", "blocks", (F.col("a") - F.when(largest, F.sum("a").over(every) - UNIT).otherwise(0)).alias("a"))


#: Blocks of each source before slot ``since``, those due first taken up to a whole number of slots.
FROM = f"""
aggregate(
  slice(array_sort(filter(transform(srcs, (x, i) -> if(x.a * since % {UNIT} = 0, null, named_struct('due', ((x.a * since div {UNIT} + 1) * {UNIT} + x.a - 1) div x.a, 'i', i))), x -> x is not null)),
        1, cast(since - aggregate(srcs, 0L, (n, x) -> n + x.a * since div {UNIT}) as int)),
  transform(srcs, x -> x.a * since div {UNIT}),
  (k, p) -> transform(k, (v, j) -> if(j = p.i, v + 1L, v)))
"""


def _edf(start: str, until: str, room: str = "true") -> str:
    """Earliest deadline first over the slots since .. until - 1: k (blocks of each source then) and out (source of each slot)."""
    return f"""
aggregate(if(since < {until}, sequence(since, {until} - 1), cast(array() as array<bigint>)),
  named_struct('k', {start}, 'out', cast(array() as array<int>)),
  (st, t) -> transform(array(
      array_min(transform(srcs, (x, i) -> if({room}, if(st.k[i] * {UNIT} div x.a <= t,
        named_struct('late', 0, 'at', ((st.k[i] + 1) * {UNIT} + x.a - 1) div x.a, 'i', i),
        named_struct('late', 1, 'at', st.k[i] * {UNIT} div x.a, 'i', i)), null))).i),
    p -> named_struct('k', transform(st.k, (v, i) -> if(i = p, v + 1L, v)), 'out', array_append(st.out, p)))[0])
"""


def pfair_slots(weights: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """weights: src, n (rows), blocks, w (weight > 0). One row per block: src, block, slot, cycle (the slot's), n.

    Slots are distinct up to HORIZON times the number of blocks. Long before that a source has run
    out; blocks of sources that last longer stand at their due slots.
    """
    parts = n_parts(weights.sparkSession)
    whole = cut(_whole_weights(weights))
    length = max(cycle, 10 * whole.count())
    due = F.expr(f"(blocks * {UNIT} + a - 1) div a")
    one = whole.agg(F.array_sort(F.collect_list(F.struct("src", "a"))).alias("srcs"), F.least(F.max(due), HORIZON * F.sum("blocks")).alias("_slots"))
    one = one.where("_slots > 0").withColumn("length", F.lit(length).cast("long"))
    starts = one.select("srcs", "length", F.explode(F.expr("sequence(0L, (_slots + length - 1) div length)")).alias("c")).repartition(parts, "c")
    # the state at each cycle's start, from a cycle before
    states = starts.withColumn("since", F.greatest(F.lit(0).cast("long"), (F.col("c") - 1) * F.col("length")))
    states = cut(states.select("srcs", "length", "c", F.expr(_edf(FROM, "c * length"))["k"].alias("k")))
    both = states.join(states.select((F.col("c") - 1).alias("c"), F.col("k").alias("hi")), "c").withColumn("since", F.col("c") * F.col("length"))
    picks = both.select("srcs", "since", "k", F.posexplode(F.expr(_edf("k", "since + length", "st.k[i] < hi[i]"))["out"]).alias("at", "i"))
    place = F.row_number().over(Window.partitionBy("since", "i").orderBy("at")) - 1
    slots = picks.select(F.col("srcs")[F.col("i")]["src"].alias("src"), (F.col("k")[F.col("i")] + place).alias("block"), (F.col("since") + F.col("at")).alias("slot"))
    blocks = whole.where("blocks > 0").select("src", "n", "a", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    out = blocks.join(slots, ["src", "block"], "left")
    out = out.withColumn("slot", F.coalesce("slot", F.expr(f"((block + 1) * {UNIT} + a - 1) div a - 1")))
    return out.select("src", "block", "slot", F.expr(f"slot div {length}L").alias("cycle"), "n")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, cycle: int = CYCLE, temperature: float = TEMPERATURE, seed: int = SEED, key: str | None = None) -> DataFrame:
    """Per row: doc_id, source, block, slot, position (gapless from 0 over all rows), and ``key`` if one is named.

    ``weights`` gives each source's target; sources without one get weight by rows ** temperature of
    what is left of 1 (all of it without weights). Null sources form one source. While no source has
    run out, every prefix of slots holds each source within one block of its share; sources that have
    run out leave their slots and the rest keep their proportions. No row is dropped or repeated.
    Repeated and null doc_ids are rows of their own; they follow each other in the stored order, or in that of ``key``, a number
    that differs between rows. Other columns, texts among them, are not read.
    """
    src = F.coalesce(F.col("source"), F.lit(""))
    own = F.monotonically_increasing_id() if key is None else docs[key]
    base = cut(docs.select("doc_id", "source", src.alias("src"), F.xxhash64(F.lit(seed), "doc_id").alias("_h"), own.alias("_key")))
    base = cut(ranked(base, ["src"], ["_h", "doc_id", "_key"], "_r"))
    sizes = base.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    natural = F.pow(F.col("n").cast("double"), F.lit(temperature))
    if weights:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("src")]
        every = Window.partitionBy()
        left = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(given).over(every), F.lit(0.0)))
        rest = F.sum(F.when(given.isNull(), natural)).over(every)
        w = F.coalesce(given.cast("double"), F.greatest(left, F.lit(1e-9)) * natural / rest)
    else:
        w = natural
    blocks = F.expr(f"(n + {block} - 1) div {block}").alias("blocks")
    plan = pfair_slots(sizes.select("src", "n", blocks, w.alias("w")), cycle)
    plan = cut(plan.select("*", F.least(F.lit(block), F.col("n") - F.col("block") * block).alias("size")))
    # rows before each block: those of the cycles before, and those of its cycle's slots before
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cycles = plan.groupBy("cycle").agg(F.sum("size").alias("size")).select("cycle", before(Window.orderBy("cycle")).alias("_earlier"))
    plan = plan.select("src", "block", "slot", "cycle", before(Window.partitionBy("cycle").orderBy("slot", "src")).alias("_before")).join(cycles, "cycle").drop("cycle")
    rows = base.withColumn("block", F.expr(f"_r div {block}")).join(plan, ["src", "block"])
    keys = [] if key is None else [F.col("_key").alias(key)]
    return rows.select("doc_id", "source", "block", "slot", *keys, (F.col("_earlier") + F.col("_before") + F.col("_r") % block).alias("position"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """All columns and rows of ``docs``, stored in mixed order: range-dealt and sorted by position."""
    key, position = free_name(docs, "_key"), free_name(docs, "_position")
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    place = mix(keyed, key=key, **options)
    place = cut(place.select(F.col(key).alias("_k"), F.col("position").alias(position)))
    out = keyed.join(small(place), keyed[key] == place["_k"])
    return out.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)
