"""Points at which rings don't turn, at the ends of the coordinates, where products leave 64 bits."""

from pyspark.sql import functions as F

from quadrille.functions.geometry import drop_collinear, drop_opposite_collinear


def test_far_spikes_and_rings_without_points(spark):
    low, high = -(2**31), 2**31 - 1
    rings = [[(low, low), (high, high), (low, low), (0, 5)], None, [], [(1, 1), (2, 2)], [(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)], [(low, low), (0, 0), (high, high), (low, high)]]
    table = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "id int, points array<struct<x:int,y:int>>").coalesce(1)
    got = table.select("id", drop_collinear(F.col("points")).alias("a"), drop_opposite_collinear(F.col("points")).alias("b")).orderBy("id").collect()
    plain = lambda r: None if r is None else [tuple(p) for p in r]
    ends = [(low, low), (low, low)]
    want = [ends, None, [], [(1, 1), (2, 2)], [(0, 0), (2, 0), (2, 2), (0, 2)], [(low, low), (high, high), (low, high)]]
    assert [plain(r["a"]) for r in got] == want
    assert [plain(r["b"]) for r in got] == [ends, None, [], [(1, 1), (2, 2)], rings[4], rings[5]]
