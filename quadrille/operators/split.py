"""Intersections of horizontal with vertical segments, by a hierarchy of grids, and the segments cut at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import ceil_log2
from .edges import merge


def bucket(x: Column, power: int) -> Column:
    """Number of the bucket of 2**power coordinates that holds x."""
    return F.shiftright(x.cast("long"), power)


def bucketed(segs: DataFrame, power: int) -> DataFrame:
    """Segments with `bucket`: a vertical once, a horizontal once per bucket it reaches (both ends included)."""
    vertical = F.col("orient") == "V"
    first = F.when(vertical, bucket(F.col("pos"), power)).otherwise(bucket(F.col("lo"), power))
    last = F.when(vertical, bucket(F.col("pos"), power)).otherwise(bucket(F.col("hi"), power))
    return segs.withColumn("bucket", F.explode(F.sequence(first, last)))


def levels(segs: DataFrame, power: int) -> DataFrame:
    """(group_id, h_levels, v_levels): the levels at which a group has horizontals and verticals; at most 33 of each."""
    at = segs.select("group_id", "orient", level(F.col("hi").cast("long") - F.col("lo"), power).alias("level"))
    of = lambda o: F.collect_set(F.when(F.col("orient") == o, F.col("level")))
    return at.groupBy("group_id").agg(of("H").alias("h_levels"), of("V").alias("v_levels"))


def level(length: Column, power: int) -> Column:
    """A segment's level: log2 of a cell that is no shorter than the segment, `power` at least. It reaches two such cells at most."""
    return F.greatest(F.lit(power), ceil_log2(length))


def intersections(segs: DataFrame, power: int = 3) -> DataFrame:
    """(group_id, x, y, v_lo, v_hi, h_lo, h_hi): meeting pairs, ends included.

    A hierarchy of grids: a segment lives at the level of its own length. A horizontal of level i and a vertical of level j meet in the grid
    of cells 2**i wide and 2**j high, which each of them crosses in at most two cells; there the other's place is the one ancestor
    cell that holds it. So each segment is listed at most twice for every level that the others use in its group, whatever its length, and
    only segments that are both long for the cell they share are ever compared. Equal keys (group_id, levels, cell) carry the join.
    """
    length = F.col("hi").cast("long") - F.col("lo")
    at = segs.join(levels(segs, power), "group_id").withColumn("level", level(length, power))
    cell = lambda c, p: F.call_function("shiftright", F.col(c).cast("long"), F.col(p))
    reach = F.explode(F.sequence(cell("lo", "level"), cell("hi", "level")))
    v = at.where("orient = 'V'").select("group_id", F.col("pos").alias("x"), F.col("lo").alias("v_lo"), F.col("hi").alias("v_hi"), F.col("level").alias("high"), "h_levels", reach.alias("cy"))
    v = v.select("*", F.explode("h_levels").alias("wide")).select("group_id", "x", "v_lo", "v_hi", "wide", "high", cell("x", "wide").alias("cx"), "cy")
    h = at.where("orient = 'H'").select("group_id", F.col("pos").alias("y"), F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"), F.col("level").alias("wide"), "v_levels", reach.alias("cx"))
    h = h.select("*", F.explode("v_levels").alias("high")).select("group_id", "y", "h_lo", "h_hi", "wide", "high", "cx", cell("y", "high").alias("cy"))
    meet = F.col("y").between(F.col("v_lo"), F.col("v_hi")) & F.col("x").between(F.col("h_lo"), F.col("h_hi"))
    return v.join(h, ["group_id", "wide", "high", "cx", "cy"]).where(meet).drop("wide", "high", "cx", "cy")


def runs(segs: DataFrame) -> DataFrame:
    """(group_id, orient, pos, lo, hi): what the segments of each line cover, as runs that neither overlap nor touch."""
    line = Window.partitionBy("group_id", "orient", "pos").orderBy("lo")
    reached = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    begun = segs.select("group_id", "orient", "pos", "lo", "hi", F.when(F.coalesce(F.col("lo") <= reached, F.lit(False)), F.lit(None)).otherwise(F.col("lo")).alias("begin"))
    marked = begun.withColumn("run", F.last("begin", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("group_id", "orient", "pos", "run").agg(F.max("hi").alias("hi")).select("group_id", "orient", "pos", F.col("run").alias("lo"), "hi")


def meeting_points(segs: DataFrame, power: int = 3) -> DataFrame:
    """(group_id, x, y): every point at which a horizontal and a vertical meet, ends included, once, however many pairs meet there.

    Runs of a line have no point in common, so a point is of one pair of runs, and pairs of segments are never listed.
    """
    return intersections(runs(segs), power).select("group_id", "x", "y")


def _on_lines(points: DataFrame) -> DataFrame:
    """(group_id, orient, pos, at): every point on the vertical and on the horizontal line through it."""
    line = lambda o, pos, at: F.struct(F.lit(o).alias("orient"), F.col(pos).alias("pos"), F.col(at).alias("at"))
    return points.select("group_id", F.explode(F.array(line("V", "x", "y"), line("H", "y", "x"))).alias("p")).select("group_id", "p.*")


def meetings(segs: DataFrame, power: int = 3) -> DataFrame:
    """(group_id, x, y, v, h, v_inside, h_inside): the meeting points, with the verticals and horizontals that hold each, and those
    of them that it isn't an end of. The point's meeting pairs number v * h; they are counted by running sums along the lines, not listed."""
    zero = F.lit(0).cast("long")
    step = lambda at, begins, ends: F.struct(F.col(at).alias("at"), F.lit(begins).cast("long").alias("begins"), F.lit(ends).cast("long").alias("ends"), F.lit(False).alias("met"))
    ends = segs.select("group_id", "orient", "pos", F.explode(F.array(step("lo", 1, 0), step("hi", 0, 1))).alias("e")).select("group_id", "orient", "pos", "e.*")
    points = _on_lines(meeting_points(segs, power)).select("group_id", "orient", "pos", "at", zero.alias("begins"), zero.alias("ends"), F.lit(True).alias("met"))
    both = ends.unionByName(points).groupBy("group_id", "orient", "pos", "at").agg(F.sum("begins").alias("begins"), F.sum("ends").alias("ends"), F.max("met").alias("met"))
    upto = Window.partitionBy("group_id", "orient", "pos").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    begun, ended = F.sum("begins").over(upto), F.sum("ends").over(upto)
    held = both.select("group_id", "orient", "pos", "at", "met", (begun - ended + F.col("ends")).alias("n"), (begun - F.col("begins") - ended).alias("inside")).where("met")
    level = F.col("orient") == "H"
    of = lambda c, name: [F.sum(F.when(~level, F.col(c))).alias(f"v{name}"), F.sum(F.when(level, F.col(c))).alias(f"h{name}")]
    at = held.select("group_id", F.when(level, F.col("at")).otherwise(F.col("pos")).alias("x"), F.when(level, F.col("pos")).otherwise(F.col("at")).alias("y"), "orient", "n", "inside")
    return at.groupBy("group_id", "x", "y").agg(*of("n", ""), *of("inside", "_inside"))


def split(segs: DataFrame, power: int = 3) -> DataFrame:
    """segs (merged) cut wherever a perpendicular segment meets their inside; coincident pieces merged again.

    A segment's first and last piece reach to the cuts next to its ends. All others lie between neighbouring cuts of its line, and their windings
    are running sums along it. So the work follows segments and meeting points, not the pairs or the cuts of each segment.
    """
    line = ["group_id", "orient", "pos"]
    none, zero = F.lit(None).cast("int"), F.lit(0).cast("long")
    cuts = _on_lines(meeting_points(segs, power)).select(*line, "at", none.alias("hi"), zero.alias("subj"), zero.alias("clip"), F.col("at").alias("cut"))
    rows = segs.select(*line, F.col("lo").alias("at"), "hi", "subj", "clip", none.alias("cut")).unionByName(cuts).repartition(*line)
    # a segment comes before the cut at its own end, so that the last cut seen is strictly inside
    down = Window.partitionBy(*line).orderBy(F.desc("at"), F.asc_nulls_first("cut")).rowsBetween(Window.unboundedPreceding, 0)
    first = rows.withColumn("first", F.last("cut", ignorenulls=True).over(down))
    first = first.select(*line, F.col("at").alias("lo"), "hi", "subj", "clip", "cut", "first", F.coalesce("hi", "at").alias("at"))
    up = Window.partitionBy(*line).orderBy(F.asc("at"), F.asc_nulls_first("cut")).rowsBetween(Window.unboundedPreceding, 0)
    known = first.withColumn("last", F.last("cut", ignorenulls=True).over(up))
    kind = lambda lo, hi, sign: F.struct(lo.alias("lo"), hi.alias("hi"), (sign * F.col("subj")).alias("subj"), (sign * F.col("clip")).alias("clip"))
    lo, hi, a, b = (F.col(c) for c in ("lo", "hi", "first", "last"))
    whole, one = F.array(kind(lo, hi, 1)), F.array(kind(lo, a, 1), kind(b, hi, 1))
    # rows without hi are steps of the running sum: at cuts, and where the pieces between a segment's first and last cut begin and end
    parts = F.when(hi.isNull(), F.array(kind(lo, none, 1))).when(a.isNull() | (a >= hi), whole).when(a == b, one).otherwise(F.concat(one, F.array(kind(a, none, 1), kind(b, none, -1))))
    spread = known.select(*line, F.explode(parts).alias("p")).select(*line, "p.*").groupBy(*line, "lo", "hi").agg(F.sum("subj").alias("subj"), F.sum("clip").alias("clip"))
    between = Window.partitionBy(*line, "step").orderBy("lo")
    upto, step = between.rowsBetween(Window.unboundedPreceding, 0), F.col("step")
    total = lambda c: F.when(step, F.sum(c).over(upto)).otherwise(F.col(c)).alias(c)
    ends = spread.withColumn("step", hi.isNull()).select(*line, "lo", F.when(step, F.lead("lo").over(between)).otherwise(hi).alias("hi"), total("subj"), total("clip"))
    return merge(ends.where("hi is not null"))
