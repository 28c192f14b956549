"""Columns of a group by count: borders so that every column holds about equally many verticals, and horizontals cut at them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sweep import COARSE


def _counts(segs: DataFrame) -> DataFrame:
    """(group_id, x, n, before, total): every x of a segment's end, its verticals, those further left, and those of the group.

    Sums run in two levels, as ranks do in the sweep: no window holds more than the 2**COARSE coordinates of a coarse bucket, or a group's buckets.
    """
    at_x = segs.where("orient = 'V'").select("group_id", F.col("pos").alias("x"), F.lit(1).cast("long").alias("n"))
    ends = segs.where("orient = 'H'").select("group_id", F.explode(F.array("lo", "hi")).alias("x"), F.lit(0).cast("long").alias("n"))
    xs = at_x.unionByName(ends).groupBy("group_id", "x").agg(F.sum("n").alias("n")).withColumn("c", F.shiftright("x", COARSE))
    inside = Window.partitionBy("group_id", "c").orderBy("x")
    fine = xs.select("group_id", "c", "x", "n", (F.sum("n").over(inside) - F.col("n")).alias("k"))
    group = Window.partitionBy("group_id")
    coarse = xs.groupBy("group_id", "c").agg(F.sum("n").alias("m"))
    coarse = coarse.select("group_id", "c", (F.sum("m").over(group.orderBy("c")) - F.col("m")).alias("first"), F.sum("m").over(group).alias("total"))
    return fine.join(coarse, ["group_id", "c"]).select("group_id", "x", "n", (F.col("first") + F.col("k")).alias("before"), "total")


def _dealt(segs: DataFrame, power: int) -> DataFrame:
    """(group_id, x, n, share): x falls into the share of `depth` verticals that the first of its own stands in."""
    depth = F.greatest(F.lit(1 << power).cast("long"), F.ceil(4 * F.sqrt("total")))
    first = F.greatest(F.least("before", F.col("total") - 1), F.lit(0))
    return _counts(segs).select("group_id", "x", "n", F.floor(first / depth).cast("long").alias("share"))


def _columns(dealt: DataFrame) -> DataFrame:
    by_share = Window.partitionBy("group_id").orderBy("share")  # n verticals make at most sqrt(n) / 4 shares
    cols = dealt.groupBy("group_id", "share").agg(F.min("x").alias("x0"), F.sum("n").alias("n"))
    return cols.select("group_id", "share", (F.row_number().over(by_share) - 1).cast("long").alias("column_no"), "x0", F.lead("x0").over(by_share).alias("x1"), "n")


def columns(segs: DataFrame, power: int = 6) -> DataFrame:
    """(group_id, column_no, x0, x1, n): the columns of each group from left to right, from x0 up to x1, without it (null: no end), and their verticals.

    A column ends once it holds 2**power verticals, or four times the root of the group's, if that is more. Its last x comes whole, so a column
    holds at most that and the verticals of one x. Borders follow the data: where coordinates crowd, columns are narrow.
    """
    return _columns(_dealt(segs, power)).drop("share")


def in_columns(segs: DataFrame, power: int = 6) -> DataFrame:
    """segs with column_no: a vertical once, in the column that holds it; a horizontal cut at the borders it crosses, a piece per column.

    A right end on a border belongs to the column before it. Joins are on equal keys only, as every end is itself an x of the layout.
    """
    dealt = _dealt(segs, power)
    cols = _columns(dealt)
    at = dealt.join(cols.drop("n"), ["group_id", "share"]).select("group_id", "x", "column_no", "x0")
    rest = ["group_id", "orient", "pos", "lo", "hi", "subj", "clip"]
    v = segs.where("orient = 'V'").join(at.select("group_id", F.col("x").alias("pos"), "column_no"), ["group_id", "pos"]).select(*rest, "column_no")
    first = at.select("group_id", F.col("x").alias("lo"), F.col("column_no").alias("c0"))
    last = at.select("group_id", F.col("x").alias("hi"), F.when(F.col("x") == F.col("x0"), F.col("column_no") - 1).otherwise(F.col("column_no")).alias("c1"))
    h = segs.where("orient = 'H'").join(first, ["group_id", "lo"]).join(last, ["group_id", "hi"])
    h = h.select(*rest, F.explode(F.sequence("c0", "c1")).alias("column_no")).join(cols.select("group_id", "column_no", "x0", "x1"), ["group_id", "column_no"])
    cut = h.withColumns({"lo": F.greatest("lo", "x0"), "hi": F.least("hi", "x1")})  # least() skips the null of a last column
    return v.unionByName(cut.select(*rest, "column_no"))
