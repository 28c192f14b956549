"""Contour tables: reading, writing, and the rectangles derived from lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CONTOURS


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column, clockwise: Column) -> Column:
    """A rectangle as a ring."""
    p = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    ccw = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))
    return F.when(clockwise, F.reverse(ccw)).otherwise(ccw)


def read_contours(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    """A contour table in any format that Spark reads (parquet, json, orc, avro where present)."""
    return spark.read.schema(CONTOURS).format(source).load(path)


def write_table(df: DataFrame, path: str, sink: str = "parquet", mode: str = "errorifexists") -> None:
    """Any result table to any format that Spark writes."""
    df.write.format(sink).mode(mode).save(path)


def from_rects(spark: SparkSession, rects: list[tuple]) -> DataFrame:
    """Contours from (group_id, shape_type, x0, y0, x1, y1, clockwise) tuples."""
    rows = []
    for k, (g, role, x0, y0, x1, y1, cw) in enumerate(rects):
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        rows.append((g, role, k, ring[::-1] if cw else ring))
    return spark.createDataFrame(rows, CONTOURS)


def lineitem_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, shape_type, x0, y0, x1, y1, clockwise): one rectangle per line item."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    x0 = (F.col("l_partkey") % 509).cast("int")
    y0 = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 503).cast("int")
    return i.select(
        (F.col("l_suppkey") % 16).cast("long").alias("group_id"), F.when(F.col("l_returnflag") == "R", "clip").otherwise("subject").alias("shape_type"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 1 + (F.floor("l_quantity") % 13).cast("int")).alias("x1"), (y0 + 1 + (F.floor("l_extendedprice") % 11).cast("int")).alias("y1"), (F.col("l_linestatus") == "F").alias("clockwise"),
    )


def lineitem_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lineitem_rects(spark, sf_dir)
    ring = rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("clockwise"))
    return r.select("group_id", "shape_type", F.monotonically_increasing_id().alias("contour_id"), ring.alias("points"))
