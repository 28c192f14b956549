"""Contours to signed, merged, axis-aligned segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import drop_collinear, following, orientation, ring_edges
from ..model import ShapeType


def quarantine(contours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rings, rejected rings with a reason). A ring is rejected whole: without one of its edges its winding wouldn't close."""
    # an explode of one value: predicates above it read the ready array instead of a copy of the expressions that make it
    ready = contours.select(*[c for c in contours.columns if c != "points"], F.explode(F.array("points")).alias("points"))
    points = F.col("points")

    def step(p, q):
        """3 where a point is null, 2 on a diagonal, 1 along an axis, 0 on the spot."""
        across, up = F.when(p["x"] != q["x"], 1).otherwise(0), F.when(p["y"] != q["y"], 1).otherwise(0)
        return F.when(p.isNull() | p["x"].isNull() | p["y"].isNull(), 3).otherwise(across + up)

    # written out for rings of four, as most are: a function over an array's elements is interpreted, not compiled
    at = [F.get(points, k) for k in range(4)]
    four = F.greatest(*[step(at[k], at[(k + 1) % 4]) for k in range(4)])
    worst = F.when(F.size(points) == 4, four).otherwise(F.array_max(F.zip_with(points, following(points), step)))
    known = F.coalesce(F.col("shape_type").isin([s.value for s in ShapeType]), F.lit(False))
    fault = (
        F.when(~known, "unknown shape type")
        .when(points.isNull() | (F.size(points) < 3), "fewer than 3 points")
        .otherwise(F.element_at(F.array(F.lit("zero length"), F.lit(None), F.lit("diagonal edge"), F.lit("null point")), worst + 1))
    )
    checked = ready.select("*", fault.alias("reason"))  # not in an explode, which would interpret it
    return checked.where("reason is null").select(*contours.columns), checked.where("reason is not null").select(*contours.columns, "reason")


def edges(contours: DataFrame, simplify: bool = False) -> DataFrame:
    """(group_id, shape_type, p, q): one row per ring edge of non-zero length; simplify drops points at which a ring doesn't turn."""
    rings = contours.withColumn("points", drop_collinear(F.col("points"))) if simplify else contours
    out = rings.select("group_id", "shape_type", F.explode(ring_edges(F.col("points"))).alias("e"))
    return out.select("group_id", "shape_type", "e.p", "e.q").where("p <> q")


def segments(contours: DataFrame, simplify: bool = False) -> DataFrame:
    """(group_id, orient, pos, lo, hi, subj, clip): +1 in the ring's role when walked to larger coordinates, else -1.

    Winding doesn't depend on simplify: pieces of a straight run, and the two ways of a spike, sum to the same.
    """
    e = edges(contours, simplify).withColumn("orient", orientation(F.col("p"), F.col("q"))).where("orient is not null")
    vertical = F.col("orient") == "V"
    a, b = F.when(vertical, F.col("p.y")).otherwise(F.col("p.x")), F.when(vertical, F.col("q.y")).otherwise(F.col("q.x"))
    sign = F.when(b > a, 1).otherwise(-1).cast("long")
    role = lambda s: F.when(F.col("shape_type") == s.value, sign).otherwise(F.lit(0).cast("long"))
    # known not to be null: else each join below adds null filters of its own, and what is shared is computed anew for every join
    sure = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    pos = F.when(vertical, F.col("p.x")).otherwise(F.col("p.y"))
    return e.select("group_id", F.coalesce("orient", F.lit("")).alias("orient"), sure(pos, "pos"), sure(F.least(a, b), "lo"), sure(F.greatest(a, b), "hi"), role(ShapeType.SUBJECT).alias("subj"), role(ShapeType.CLIP).alias("clip"))


def merge(segs: DataFrame) -> DataFrame:
    """Coincident segments as one; those that cancel are gone before anything is multiplied over strips."""
    merged = segs.groupBy("group_id", "orient", "pos", "lo", "hi").agg(F.sum("subj").alias("subj"), F.sum("clip").alias("clip"))
    return merged.where("subj <> 0 or clip <> 0")


def bounds(contours: DataFrame) -> DataFrame:
    """(group_id, min_x, max_x, min_y, max_y, n_points) of each group."""
    per = contours.select(
        "group_id", F.size("points").cast("long").alias("n"), F.array_min(F.transform("points", lambda p: p["x"])).alias("x0"), F.array_max(F.transform("points", lambda p: p["x"])).alias("x1"),
        F.array_min(F.transform("points", lambda p: p["y"])).alias("y0"), F.array_max(F.transform("points", lambda p: p["y"])).alias("y1"),
    )
    return per.groupBy("group_id").agg(F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y0").alias("min_y"), F.max("y1").alias("max_y"), F.sum("n").alias("n_points"))
