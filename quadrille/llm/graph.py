"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _mark(edges: DataFrame) -> tuple:
    """Equal marks: the same edges, but for a chance of 2**-64. Sums of hashes would leave a long's range on large graphs."""
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return (r[0], r[1])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (u, v) longs, in any direction. Returns (node, root) for every node of an edge; root is the smallest node of its component.

    Only (node, smallest neighbour) pairs are grouped, with partial minima; a node's neighbours are never listed.
    """
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    before = None
    step = 0
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
