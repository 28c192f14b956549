"""Benchmark workloads as distributed generators: contours by formula over spark.range, or over cells derived from a table.

Sizes, steps and offsets of the workloads are fixed values: their areas are known by formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contours import rectangle


def _table(parts: list[tuple[DataFrame, str, Column]]) -> DataFrame:
    out = None
    for base, role, ring in parts:
        t = base.select(F.lit(0).cast("long").alias("group_id"), F.lit(role).alias("shape_type"), F.col("id").alias("contour_id"), ring.alias("points"))
        out = t if out is None else out.unionByName(t)
    return out


def _squares(spark: SparkSession, n: int, start: int, size: int, step: int) -> tuple[DataFrame, Column]:
    """n * n clockwise squares; the two loop counters are the quotient and the remainder of one id."""
    x = F.lit(start) + F.floor(F.col("id") / n) * step
    y = F.lit(start) + (F.col("id") % n) * step
    return spark.range(n * n), rectangle(x, y, x + size, y + size, F.lit(True))


def checkerboard(spark: SparkSession, n: int) -> DataFrame:
    return _table([(b, role, r) for role, (b, r) in (("subject", _squares(spark, n, 0, 20, 30)), ("clip", _squares(spark, n - 1, 15, 20, 30)))])


def not_overlap(spark: SparkSession, n: int) -> DataFrame:
    return _table([(b, role, r) for role, (b, r) in (("subject", _squares(spark, n, 0, 10, 30)), ("clip", _squares(spark, n - 1, 15, 10, 30)))])


def lines_net(spark: SparkSession, n: int) -> DataFrame:
    s, at = 10 * n, F.col("id") * 20
    up = rectangle(at - s + 5, F.lit(-s), at - s + 15, F.lit(s), F.lit(True))
    across = rectangle(F.lit(-s), at - s - 5, F.lit(s), at - s + 5, F.lit(True))
    return _table([(spark.range(n), "subject", up), (spark.range(n), "clip", across)])


def windows(spark: SparkSession, n: int) -> DataFrame:
    o = -15 * n
    return _table([(b, role, r) for role, (b, r) in (("subject", _squares(spark, n, o, 20, 30)), ("clip", _squares(spark, n, o + 5, 10, 30)))])


def nested(spark: SparkSession, n: int) -> DataFrame:
    r = (F.col("id") + 1) * 8
    cw = F.lit(True)
    bars = [("subject", -r, -r, 4 - r, r), ("subject", r - 4, -r, r, r), ("clip", -r, r - 4, r, r), ("clip", -r, -r, r, 4 - r)]
    return _table([(spark.range(n), role, rectangle(x0, y0, x1, y1, cw)) for role, x0, y0, x1, y1 in bars])


#: corners of the windmill's cell in eighths of its size, from its centre: squares (least corner) and triangles
_MILL_SQUARES = ((-3, 1), (1, 2), (-2, -3), (2, -2))
_MILL_TRIANGLES = (((0, 0), (-3, 0), (0, 3)), ((0, 1), (0, 4), (3, 1)), ((1, 0), (1, -3), (-2, 0)), ((1, 1), (4, 1), (1, -2)))


def windmill(spark: SparkSession, n: int, size: int = 64) -> DataFrame:
    """Its subjects are triangles: diagonal edges, which are quarantined."""
    a = size // 8
    cx, cy = F.lit(size // 2) + F.floor(F.col("id") / n) * size, F.lit(size // 2) + (F.col("id") % n) * size
    point = lambda p: F.struct((cx + p[0] * a).cast("int").alias("x"), (cy + p[1] * a).cast("int").alias("y"))
    parts = [(spark.range(n * n), "clip", rectangle(cx + x * a, cy + y * a, cx + (x + 2) * a, cy + (y + 2) * a, F.lit(True))) for x, y in _MILL_SQUARES]
    return _table(parts + [(spark.range(n * n), "subject", F.array(*[point(p) for p in t])) for t in _MILL_TRIANGLES])


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, i, j): a cell of the plane per line item; some of them share one."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select((F.col("l_suppkey") % 16).cast("long").alias("group_id"), (F.col("l_partkey") % 20011).cast("int").alias("i"), (F.col("l_orderkey") % 50021).cast("int").alias("j"))


def in_cells(cells: DataFrame, parts: list[tuple[str, Column]]) -> DataFrame:
    """Contours: every part, a role and a ring over the columns i and j, in every cell."""
    each = F.array(*[F.struct(F.lit(role).alias("shape_type"), ring.alias("points")) for role, ring in parts])
    return cells.select("group_id", F.explode(each).alias("s")).select("group_id", "s.shape_type", F.monotonically_increasing_id().alias("contour_id"), "s.points")


def _in_cell(offset: int, size: int) -> Column:
    x, y = F.col("i") * 30 + offset, F.col("j") * 30 + offset
    return rectangle(x, y, x + size, y + size, F.lit(True))


def table_checkerboard(spark: SparkSession, d: str) -> DataFrame:
    return in_cells(lineitem_cells(spark, d), [("subject", _in_cell(0, 20)), ("clip", _in_cell(15, 20))])


def table_not_overlap(spark: SparkSession, d: str) -> DataFrame:
    return in_cells(lineitem_cells(spark, d), [("subject", _in_cell(0, 10)), ("clip", _in_cell(15, 10))])


def table_windows(spark: SparkSession, d: str) -> DataFrame:
    return in_cells(lineitem_cells(spark, d), [("subject", _in_cell(0, 20)), ("clip", _in_cell(5, 10))])


def table_lines_net(spark: SparkSession, d: str) -> DataFrame:
    """A vertical line for each i modulo 509, a horizontal one for each j modulo 503, over the whole plane of these."""
    i, j = F.col("i") % 509 * 20, F.col("j") % 503 * 20
    return in_cells(lineitem_cells(spark, d), [("subject", rectangle(i + 5, F.lit(0), i + 15, F.lit(10_240), F.lit(True))), ("clip", rectangle(F.lit(0), j + 5, F.lit(10_240), j + 15, F.lit(True)))])


def table_nested(spark: SparkSession, d: str) -> DataFrame:
    """A frame for each i modulo 101."""
    r = (F.col("i") % 101 + 1) * 8
    bars = [("subject", -r, -r, 4 - r, r), ("subject", r - 4, -r, r, r), ("clip", -r, r - 4, r, r), ("clip", -r, -r, r, 4 - r)]
    return in_cells(lineitem_cells(spark, d), [(role, rectangle(x0, y0, x1, y1, F.lit(True))) for role, x0, y0, x1, y1 in bars])


def table_windmill(spark: SparkSession, d: str, size: int = 64) -> DataFrame:
    """Its subjects are triangles, which are quarantined."""
    a, cx, cy = size // 8, F.col("i") * size + size // 2, F.col("j") * size + size // 2
    point = lambda p: F.struct((cx + p[0] * a).cast("int").alias("x"), (cy + p[1] * a).cast("int").alias("y"))
    squares = [("clip", rectangle(cx + x * a, cy + y * a, cx + (x + 2) * a, cy + (y + 2) * a, F.lit(True))) for x, y in _MILL_SQUARES]
    return in_cells(lineitem_cells(spark, d), squares + [("subject", F.array(*[point(p) for p in t])) for t in _MILL_TRIANGLES])


GENERATORS = {"checkerboard": checkerboard, "not_overlap": not_overlap, "lines_net": lines_net, "windows": windows, "nested": nested, "windmill": windmill}
