"""Boundary segments with masks, out of slabs, and the nodes where they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import filled, included, mask_of
from ..model import FillRule, OverlayRule

_SIDES = ("rs", "rc", "ls", "lc")  # subject and clip, right and left of a vertical


def masked_segments(slab_table: DataFrame, fill: FillRule) -> DataFrame:
    """(group_id, orient, ax, ay, bx, by, fill): every piece of line with different sides, a before b.

    Horizontals lie between neighbouring slabs of a strip. Verticals come from running sums, along each strip border, of what starts
    and ends on its two sides. Both kinds go through one aggregation and one window, so the slabs are computed once.
    """
    s, c = filled(F.col("ws"), fill), filled(F.col("wc"), fill)
    flags = slab_table.select("group_id", "x0", "x1", "y0", "y1", s.cast("int").alias("s"), c.cast("int").alias("c")).where("s + c > 0")
    end = lambda y, sign: F.struct(F.col(y).alias("y"), (sign * F.col("s")).alias("ds"), (sign * F.col("c")).alias("dc"))
    ends = flags.select("group_id", "x0", "x1", F.explode(F.array(end("y0", 1), end("y1", -1))).alias("e")).select("group_id", "x0", "x1", "e.*")
    steps = ends.groupBy("group_id", "x0", "x1", "y").agg(F.sum("ds").alias("ds"), F.sum("dc").alias("dc")).where("ds <> 0 or dc <> 0")
    upto = Window.partitionBy("group_id", "x0").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.withColumn("ts", F.sum("ds").over(upto)).withColumn("tc", F.sum("dc").over(upto))
    flat = mask_of(F.col("ts") > 0, F.col("ts") - F.col("ds") > 0, F.col("tc") > 0, F.col("tc") - F.col("dc") > 0)
    swept = swept.select("group_id", "x0", "x1", "y", "ds", "dc", flat.cast("int").alias("mask"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")

    def row(kind, x, x1, mask, rs, rc, ls, lc):
        values = (F.lit(kind), x, x1, mask, rs, rc, ls, lc)
        return F.struct(*[v.alias(n) for v, n in zip(values, ("orient", "x", "x1", "mask", *_SIDES))])

    ds, dc, x0, x1 = (F.col(n) for n in ("ds", "dc", "x0", "x1"))
    rows = F.array(row("H", x0, x1, F.col("mask"), zero, zero, zero, zero), row("V", x0, none, none, ds, dc, zero, zero), row("V", x1, none, none, zero, zero, ds, dc))
    spread = swept.select("group_id", "y", F.explode(rows).alias("r")).select("group_id", "y", "r.*")
    border = spread.groupBy("group_id", "orient", "x", "y").agg(F.max("x1").alias("x1"), F.max("mask").alias("mask"), *[F.sum(n).alias(n) for n in _SIDES])
    w = Window.partitionBy("group_id", "orient", "x").orderBy("y")
    border = border.select("group_id", "orient", "x", "y", "x1", "mask", F.lead("y").over(w).alias("y1"), *[F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in _SIDES])
    level = F.col("orient") == "H"
    upright = mask_of(F.col("ls") > 0, F.col("rs") > 0, F.col("lc") > 0, F.col("rc") > 0)
    out = border.where(level | (F.col("y1").isNotNull() & ((F.col("ls") != F.col("rs")) | (F.col("lc") != F.col("rc")))))
    return out.select(
        "group_id", "orient", F.col("x").alias("ax"), F.col("y").alias("ay"), F.when(level, F.col("x1")).otherwise(F.col("x")).alias("bx"),
        F.when(level, F.col("y")).otherwise(F.col("y1")).alias("by"), F.when(level, F.col("mask")).otherwise(upright).cast("int").alias("fill"),
    )


def links(masked: DataFrame, rule: OverlayRule) -> DataFrame:
    """The segments that bound the result of a rule."""
    return masked.where(included(F.col("fill"), rule))


def nodes(link_table: DataFrame) -> DataFrame:
    """(group_id, x, y, degree, h, v): the ends of links; degree is 2 or 4, h and v count horizontal and vertical links."""
    ends = link_table.select("group_id", "orient", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    count = lambda o: F.count(F.when(F.col("orient") == o, 1))
    return ends.groupBy("group_id", "p.x", "p.y").agg(F.count(F.lit(1)).alias("degree"), count("H").alias("h"), count("V").alias("v"))
