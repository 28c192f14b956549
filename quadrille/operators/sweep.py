"""Winding numbers everywhere: x-strips between neighbouring coordinates, swept upwards by a running sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.geometry import floor_log2
from ..tables import saved
from .edges import merge, segments
from .graph import sort_key

BLOCK = 5  # log2 of the strips in a block
ROWS = 1 << 19  # horizontals for each partition of the sweep, where there are more partitions than usual
FEW = 1 << 17  # coarse buckets that are broadcast at most
COARSE = 12  # log2 of the coordinates in a coarse bucket of the ranking: so many rows at most in one of its windows


def ranked(h: DataFrame) -> DataFrame:
    """(group_id, x, x1, r): the distinct ends of horizontals, each with its successor and its rank within the group, from 0.

    Ranks follow the data, not the width of the coordinates. No window holds a whole group: one ranks the at most 2**COARSE
    coordinates of a coarse bucket, another sums over the at most 2**(32 - COARSE) buckets of a group.
    """
    xs = h.select("group_id", F.explode(F.array("lo", "hi")).alias("x")).distinct().withColumn("c", F.shiftright(F.col("x"), COARSE))
    inside = Window.partitionBy("group_id", "c").orderBy("x")
    fine = xs.select("group_id", "c", "x", (F.row_number().over(inside) - 1).alias("k"), F.lead("x").over(inside).alias("after"))
    over = Window.partitionBy("group_id").orderBy("c")
    coarse = xs.groupBy("group_id", "c").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"))
    coarse = coarse.select("group_id", "c", (F.sum("n").over(over) - F.col("n")).alias("first"), F.lead("least").over(over).alias("beyond"))
    return fine.join(coarse, ["group_id", "c"]).select("group_id", "x", F.coalesce("after", "beyond").alias("x1"), (F.col("first") + F.col("k")).alias("r"))


def _placed(h: DataFrame, ranks: DataFrame) -> DataFrame:
    """(group_id, y, subj, clip, r0, r1): merged horizontals with the ranks of the strips from r0 up to r1, without it, that they cross."""
    first = ranks.select("group_id", F.col("x").alias("lo"), F.col("r").alias("r0"))
    last = ranks.select("group_id", F.col("x").alias("hi"), F.col("r").alias("r1"))
    return h.select("group_id", F.col("pos").alias("y"), "lo", "hi", "subj", "clip").join(first, ["group_id", "lo"]).join(last, ["group_id", "hi"])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows (group_id, r0, r1, ...), once per block of 2**BLOCK strips that they cross: `block`, r0 and r1 cut to it."""
    at = rows.select("*", F.explode(F.sequence(F.shiftright("r0", BLOCK), F.shiftright(F.col("r1") - 1, BLOCK))).alias("block"))
    low = F.col("block") * (1 << BLOCK)
    return at.withColumns({"r0": F.greatest("r0", low), "r1": F.least("r1", low + (1 << BLOCK))})


def _horizontals(contours: DataFrame) -> DataFrame:
    return merge(segments(contours).where("orient = 'H'"))


def _ends(h: DataFrame) -> tuple[DataFrame, int, bool]:
    """(group_id, x) on disk: the distinct ends of horizontals; how many horizontals there are; and whether many of them coincide. One pass."""
    seen = Observation()
    kinds = F.approx_count_distinct(F.xxhash64("group_id", "pos", "lo", "hi"))
    watched = h.observe(seen, F.count(F.lit(1)).alias("n"), kinds.alias("kinds"))
    xs = saved(watched.select("group_id", F.explode(F.array("lo", "hi")).alias("x")).distinct(), "sweep-ends")
    if not xs.take(1):  # nothing may have been observed then
        return xs, 0, False
    n, kinds = seen.get["n"], seen.get["kinds"]
    return xs, n, n > 2 * kinds


def _dealt(xs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group_id, c, first, shift): where the blocks of every coarse bucket that holds an end begin, and how wide they are; a block's number is
    first + ((x within the bucket) >> shift). And (group_id, block, x): the ends that a block holds.

    A bucket of m ends is cut into as many blocks of equal width as m has 2**BLOCK; buckets with fewer share blocks. So blocks follow the
    data, empty buckets have none, and numbers ascend with x. A block holds at most its width or its bucket's ends.
    """
    at = xs.withColumn("c", F.shiftright("x", COARSE))
    over = Window.partitionBy("group_id").orderBy("c")
    coarse = at.groupBy("group_id", "c").agg(F.count(F.lit(1)).alias("m"))
    cut = floor_log2(F.greatest(F.shiftright("m", BLOCK), F.lit(1).cast("long")))
    coarse = coarse.select("group_id", "c", F.shiftright(F.sum("m").over(over) - F.col("m"), BLOCK).alias("first"), (F.lit(COARSE) - cut).alias("shift"))
    coarse = saved(coarse, "sweep-buckets")  # counted, as Spark's guess of the sizes may send the horizontals instead
    coarse = coarse.hint("broadcast" if coarse.count() <= FEW else "merge")
    return coarse, at.join(coarse, ["group_id", "c"]).select("group_id", _block("x", "first", "shift").alias("block"), "x")


def _borders(own: DataFrame) -> DataFrame:
    """(group_id, block, borders): the ends that a block holds, and the first of the next block."""
    held = own.groupBy("group_id", "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    after = F.lead(F.col("xs")[0]).over(Window.partitionBy("group_id").orderBy("block"))
    held = held.withColumn("after", after)
    return held.select("group_id", "block", F.when(F.col("after").isNull(), F.col("xs")).otherwise(F.concat("xs", F.array("after"))).alias("borders"))


def _block(x: str, first: str, shift: str) -> Column:
    return F.col(first) + F.call_function("shiftright", F.col(x).bitwiseAND(F.lit((1 << COARSE) - 1)), F.col(shift))


def slabs(contours: DataFrame) -> DataFrame:
    """(group_id, x0, x1, y0, y1, ws, wc): disjoint rectangles of constant subject and clip winding."""
    return swept(*sent(contours)).drop("block")


def sent(contours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group_id, block, y, lo, hi, subj, clip): horizontals, once for every block of strips that they cross; and (group_id, block, x): its ends.

    Horizontals alone tell the winding everywhere. They are merged first, by an exchange of its own, only where many coincide. A first pass over them
    runs when this is called, and deals as many partitions as ROWS asks for.
    """
    raw = segments(contours).where("orient = 'H'")
    xs, n, crowded = _ends(raw)
    parts = max(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS)
    h = merge(raw) if crowded else raw
    coarse, own = _dealt(xs)
    of = lambda x: coarse.select("group_id", F.col("c").alias(f"c_{x}"), F.col("first").alias(f"first_{x}"), F.col("shift").alias(f"shift_{x}"))
    at = h.withColumns({"c_lo": F.shiftright("lo", COARSE), "c_hi": F.shiftright("hi", COARSE)}).join(of("lo"), ["group_id", "c_lo"]).join(of("hi"), ["group_id", "c_hi"])
    crossed = F.explode(F.sequence(_block("lo", "first_lo", "shift_lo"), _block("hi", "first_hi", "shift_hi")))
    rows = at.select("group_id", crossed.alias("block"), F.col("pos").alias("y"), "lo", "hi", "subj", "clip").repartition(parts, "group_id", "block")
    own.parts = parts
    return rows, own


def in_order(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(group_id, block, y, lo, hi, subj, clip): horizontals cut to their blocks, each block's in one partition, upwards."""
    held = own.groupBy("group_id", "block").agg(F.min("x").alias("from_x"), F.max("x").alias("most"))
    after = F.lead("from_x").over(Window.partitionBy("group_id").orderBy("block"))
    held = held.select("group_id", "block", "from_x", F.coalesce(after, "most").alias("to_x")).repartition(own.parts, "group_id", "block")
    cut = rows.join(held.hint("shuffle_hash"), ["group_id", "block"]).withColumns({"lo": F.greatest("lo", "from_x"), "hi": F.least("hi", "to_x")}).where("lo < hi")
    ends = own.agg(*[f(c) for c in ("group_id", "block") for f in (F.min, F.max)]).first()
    key = sort_key(["group_id", "block", "y"], [*ends, -(1 << 31), (1 << 31) - 1])
    return cut.sortWithinPartitions(*key).select("group_id", "block", "y", "lo", "hi", "subj", "clip")


def swept(rows: DataFrame, own: DataFrame) -> DataFrame:
    """slabs with the block of strips that a slab is in, by which they are dealt, out of what sent() gives.

    A horizontal is sent once to every block of strips that it crosses, and spread over the strips of a block where the block is. That one
    exchange on (group_id, block) serves the strips' coordinates and the running sums, which read sorted rows and keep none.
    """
    here = rows.join(_borders(own).repartition(own.parts, "group_id", "block").hint("shuffle_hash"), ["group_id", "block"])
    b = F.col("borders")
    begin = F.when(F.col("lo") <= b[0], 1).otherwise(F.array_position(b, F.col("lo")).cast("int"))
    end = F.when(F.col("hi") >= F.element_at(b, -1), F.size(b)).otherwise(F.array_position(b, F.col("hi")).cast("int"))
    cut = here.select("group_id", "block", "y", "subj", "clip", "borders", begin.alias("begin"), end.alias("end")).where("begin < end")
    spread = cut.select("group_id", "block", F.explode(F.sequence("begin", F.col("end") - 1)).alias("k"), "y", "subj", "clip", "borders")
    spread = spread.select("group_id", "block", F.element_at("borders", F.col("k")).alias("x0"), F.element_at("borders", F.col("k") + 1).alias("x1"), "y", "subj", "clip")
    w = Window.partitionBy("group_id", "block", "x0").orderBy("y")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = spread.select("group_id", "block", "x0", "x1", "y", F.sum("subj").over(upto).alias("ws"), F.sum("clip").over(upto).alias("wc"), F.lead("y").over(w).alias("after"))
    last = sums.where("after is null or after <> y")  # of each y
    old = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0).cast("long"))
    turns = last.select("group_id", "block", "x0", "x1", "y", "ws", "wc", ((F.col("ws") != old("ws")) | (F.col("wc") != old("wc"))).alias("turns")).where("turns")
    each = turns.select("group_id", "block", "x0", "x1", F.col("y").alias("y0"), F.lead("y").over(w).alias("y1"), "ws", "wc")
    return each.where("y1 is not null")


def merged(slab_table: DataFrame) -> DataFrame:
    """Slabs of any further columns beside x0 and x1, with neighbours that agree in all of these joined: as wide as their state lasts.

    A run of slabs of one height is found by a window over (group_id, y0, y1), which a strip has once; no window holds a strip.
    """
    state = [c for c in slab_table.columns if c not in ("x0", "x1")]
    w = Window.partitionBy(*state).orderBy("x0")
    begun = slab_table.withColumn("begin", F.when(F.coalesce(F.lag("x1").over(w) == F.col("x0"), F.lit(False)), F.lit(None)).otherwise(F.col("x0")))
    runs = begun.withColumn("run", F.last("begin", ignorenulls=True).over(w))
    return runs.groupBy(*state, "run").agg(F.max("x1").alias("x1")).withColumnRenamed("run", "x0").select(*slab_table.columns)


def unbalanced(contours: DataFrame) -> DataFrame:
    """Strips whose winding does not return to 0 above the last segment: none for closed rings."""
    h = _horizontals(contours)
    sent = _in_blocks(_placed(h, ranked(h))).repartition("group_id", "block")
    each = sent.select("group_id", "block", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "subj", "clip")
    return each.groupBy("group_id", "block", "r").agg(F.sum("subj").alias("ws"), F.sum("clip").alias("wc")).where("ws <> 0 or wc <> 0").drop("block")
