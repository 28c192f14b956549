"""Graphs as tables of longs: cycles of a permutation by pointer doubling, components by stars, numbers within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import forget, saved

FEW = 1 << 17  # partitions' counts that are broadcast at most
_PART = 33  # bits below the partition's number in an id of ordered_ids


def sort_key(columns: list[str], ends: list) -> list[Column]:
    """The order of these columns, whose least and greatest values are ends, as one long where they fit: Spark compares rows of several keys one by one."""
    bits = [0 if low is None else (int(high) - int(low)).bit_length() for low, high in zip(ends[::2], ends[1::2])]
    if sum(bits) > 62 or None in ends:
        return [F.col(c) for c in columns]
    key = F.lit(0).cast("long")
    for c, low, b in zip(columns, ends[::2], bits):
        key = F.shiftleft(key, b) + (F.col(c).cast("long") - F.lit(int(low)).cast("long"))
    return [key]


def ordered_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `id`, on disk: unique longs that ascend in `order`, with gaps. One range shuffle; no row leaves its partition for it."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(laid.withColumn("id", F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, group: str, number: str) -> DataFrame:
    """df (group, id, ...), ids as of ordered_ids, with `number`: 0, 1, 2... in order of id within the group.

    Rows are ranked within (group, range partition); a second window adds up the partitions' counts, at most one row per partition.
    """
    at = df.withColumn("_part", F.shiftright("id", _PART))
    own = at.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_part").orderBy("id")) - 1)
    counts = at.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_part")
    first = saved(counts.select(group, "_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_first")), "numbers")
    first = first.hint("broadcast" if first.count() <= FEW else "merge")  # else Spark may shuffle df to join it
    return own.join(first, [group, "_part"]).select(*df.columns, (F.col("_first") + F.col("_own")).alias(number))


def cycles(successors: DataFrame, name: str = "cycles") -> DataFrame:
    """successors: (id, next), a permutation. Returns (id, ring, ahead): the least id of the row's cycle and how many steps ahead that is.

    Pointer doubling: after k rounds a row knows the least id among the next 2**k and where it is. Every join is by unique keys on both
    sides, so cycles of any length are dealt out evenly. Two halves of a window with the same least id have gone all the way round; a
    round later all of that cycle has noticed, and its rows leave, so rounds read only what long cycles have left.
    """
    now = successors.select("id", "next", F.col("id").alias("ring"), F.lit(0).cast("long").alias("ahead"), F.lit(0).alias("shut"))
    done, width = None, 1
    while True:
        to = now.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("ring").alias("their"), F.col("ahead").alias("far"))
        nearer = F.coalesce(F.col("their") < F.col("ring"), F.lit(False))
        shut = (F.col("shut") > 0) | F.coalesce(F.col("their") == F.col("ring"), F.lit(False))
        step = now.join(to, "next", "left").select(
            "id", F.coalesce("beyond", "next").alias("next"), F.when(nearer, F.col("their")).otherwise(F.col("ring")).alias("ring"),
            F.when(nearer, F.col("far") + width).otherwise(F.col("ahead")).alias("ahead"), F.when(shut, F.col("shut") + 1).otherwise(0).alias("shut"),
        )
        step = saved(step, f"{name}-{width}")
        out = step.where("shut >= 2").select("id", "ring", "ahead")
        done = out if done is None else done.unionByName(out)
        now, width = step.where("shut < 2"), 2 * width
        if not now.take(1):
            return done


def _mark(edges: DataFrame) -> tuple:
    """Equal marks: the same edges, but for a chance of 2**-64."""
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return (r[0], r[1])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (u, v), in any direction. Returns (node, root) for every node of an edge; root is the smallest node of its component.

    Large-star and small-star steps in turn, until nothing moves. Only (node, smallest neighbour) pairs are grouped, with partial
    minima; a node's neighbours are never listed.
    """
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    before, step = None, 0
    while (now := _mark(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low-{step}")
        # large star: every larger neighbour of u moves to the smallest neighbour of u; e holds each edge at its larger end
        large = e.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, f"{name}-large-{step}")
        low2 = saved(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low2-{step}")
        # small star: u and its smaller neighbours move to the smallest of them
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        nxt = saved(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-small-{step}")
        forget(e, low, large, low2)
        e, step = nxt, step + 1
    star = e.groupBy("u").agg(F.min("v").alias("v"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
