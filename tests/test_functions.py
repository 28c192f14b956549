"""Masks, geometry functions, splitting, sources and the entry module."""

import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.functions.rules import included, top_inside
from quadrille.model import CONTOURS, OverlayRule
from quadrille.operators import edges, split
from quadrille.sources.contours import from_rects, read_contours, write_table

#: masks that bound the result of each rule
INCLUDED = {
    OverlayRule.SUBJECT: [1, 2, 5, 6, 9, 10, 13, 14], OverlayRule.CLIP: [4, 5, 6, 7, 8, 9, 10, 11], OverlayRule.INTERSECT: [5, 7, 10, 11, 13, 14], OverlayRule.UNION: [1, 2, 4, 5, 8, 10],
    OverlayRule.DIFFERENCE: [1, 2, 6, 7, 9, 11], OverlayRule.INVERSE_DIFFERENCE: [4, 6, 8, 9, 13, 14], OverlayRule.XOR: [1, 2, 4, 7, 8, 11, 13, 14],
}


def test_masks(spark):
    m = spark.range(16).withColumn("mask", F.col("id").cast("int"))
    for rule, want in INCLUDED.items():
        assert [r["id"] for r in m.where(included(F.col("mask"), rule)).orderBy("id").collect()] == want
    assert m.where(included(F.col("mask"), OverlayRule.UNION) & top_inside(F.col("mask"), OverlayRule.UNION)).count() == 3


def test_ring_functions(spark):
    dense = [(0, 0), (5, 0), (10, 0), (10, 5), (10, 10), (5, 10), (0, 10), (0, 5)]
    spike = [(0, 0), (10, 0), (14, 0), (10, 0), (10, 10), (0, 10)]
    df = spark.createDataFrame([(0, "subject", 0, dense), (0, "subject", 1, spike)], CONTOURS)
    rows = df.select("contour_id", g.drop_collinear(F.col("points")).alias("a"), g.drop_opposite_collinear(F.col("points")).alias("b"), g.ring_area2(F.col("points")).alias("area2"), g.rotated_to_smallest(F.reverse("points")).alias("r")).orderBy("contour_id").collect()
    assert len(rows[0]["a"]) == 4 and len(rows[0]["b"]) == 8 and rows[0]["area2"] == 200
    assert (14, 0) not in [tuple(p) for p in rows[1]["b"]]
    assert tuple(rows[0]["r"][0]) == (0, 0)
    n = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "n long").select(g.floor_log2(F.col("n")).alias("f"), g.ceil_log2(F.col("n")).alias("c")).collect()
    assert [tuple(r) for r in n] == [(0, 0), (1, 1), (1, 2), (2, 2), (3, 4)]


def test_split_does_not_depend_on_bucket_width(spark):
    rects = [(0, "subject", 0, 0, 40, 10, False), (0, "clip", 5, -5, 9, 20, False), (0, "subject", 9, 3, 33, 20, True), (1, "clip", -7, -7, 0, 0, False)]
    segs = edges.merge(edges.segments(from_rects(spark, rects)))
    results = [sorted(map(tuple, split.split(segs, p).collect())) for p in (0, 3, 20)]
    assert results[0] == results[1] == results[2]
    # every meeting inside a segment cuts it: a plus sign of two bars has 4 crossings
    assert split.intersections(segs, 3).count() == split.intersections(segs, 12).count()


def test_intersections_of_all_lengths(spark):
    """Against all pairs, with lengths from 1 to nearly 2**32; short segments are listed once or twice for each level, however long others are."""
    r = random.Random(6)
    segs = []
    for g in range(3):
        for _ in range(150):
            lo = r.randrange(-60, 60) if r.random() < 0.8 else r.randrange(-(2**31), 0)
            length = r.choice([1, 2, 3, 8, 9, 31, 100, 2**20, 2**31])
            segs.append((g, r.choice("HV"), r.randrange(-60, 60), lo, min(2**31 - 1, lo + length), 1, 0))
    segs = sorted(set(segs))
    table = spark.createDataFrame(segs, "group_id long, orient string, pos int, lo int, hi int, subj long, clip long")
    want = sorted((v[0], v[2], h[2], v[3], v[4], h[3], h[4]) for v in segs if v[1] == "V" for h in segs if h[1] == "H" and h[0] == v[0] and v[3] <= h[2] <= v[4] and h[3] <= v[2] <= h[4])
    for power in (0, 3, 12):
        got = split.intersections(table, power).select("group_id", "x", "y", "v_lo", "v_hi", "h_lo", "h_hi").collect()
        assert sorted(map(tuple, got)) == want
    known = {r["group_id"]: r for r in split.levels(table, 3).collect()}
    assert all(len(known[g][k]) <= 9 for g in range(3) for k in ("h_levels", "v_levels"))


def test_split_and_meetings_of_crowded_lines(spark):
    """Against plain loops; where many segments overlap, every point counts once, not once for each pair that meets there."""
    r = random.Random(8)
    segs = {}
    for _ in range(500):
        lo = r.randrange(12)
        segs[(r.randrange(2), r.choice("HV"), r.randrange(12), lo, lo + r.randrange(1, 9))] = (r.choice([-1, 1]), r.choice([-1, 0, 1]))
    table = spark.createDataFrame([(*k, *w) for k, w in segs.items()], "group_id long, orient string, pos int, lo int, hi int, subj long, clip long")
    cover = {}
    for g, o, pos, lo, hi in segs:
        for at in range(lo, hi + 1):
            x, y = (pos, at) if o == "V" else (at, pos)
            n = cover.setdefault((g, x, y), {"V": [0, 0], "H": [0, 0]})[o]
            n[0], n[1] = n[0] + 1, n[1] + (lo < at < hi)
    met = {k: (n["V"][0], n["H"][0], n["V"][1], n["H"][1]) for k, n in cover.items() if n["V"][0] and n["H"][0]}
    want = {}
    for (g, o, pos, lo, hi), w in segs.items():
        cuts = [lo, *(at for at in range(lo + 1, hi) if ((g, pos, at) if o == "V" else (g, at, pos)) in met), hi]
        for a, b in zip(cuts, cuts[1:]):
            s = want.setdefault((g, o, pos, a, b), [0, 0])
            s[0], s[1] = s[0] + w[0], s[1] + w[1]
    want = {k: tuple(w) for k, w in want.items() if any(w)}
    assert split.meeting_points(table).count() == len(met) < split.intersections(table).count() / 5
    for power in (0, 3):
        assert {tuple(p[:3]): tuple(p[3:]) for p in split.meetings(table, power).select("group_id", "x", "y", "v", "h", "v_inside", "h_inside").collect()} == met
        got = split.split(table, power).select("group_id", "orient", "pos", "lo", "hi", "subj", "clip").collect()
        assert len(got) == len(want) and {tuple(p[:5]): tuple(p[5:]) for p in got} == want


def test_sources_round_trip(spark, tmp_path):
    table = from_rects(spark, [(0, "subject", 0, 0, 2, 2, False), (1, "clip", 0, 0, 3, 3, True)])
    for kind in ("parquet", "json", "orc"):
        write_table(table, str(tmp_path / kind), kind)
        assert sorted(map(str, read_contours(spark, str(tmp_path / kind), kind).collect())) == sorted(map(str, table.collect()))


def test_stream(spark, tmp_path):
    from quadrille.model import FillRule
    from quadrille.streaming.microbatch import overlay_stream

    from_rects(spark, [(0, "subject", 0, 0, 2, 2, False)]).write.parquet(str(tmp_path / "in"))
    got = []
    q = overlay_stream(spark.readStream.schema(CONTOURS).parquet(str(tmp_path / "in")), OverlayRule.SUBJECT, FillRule.NON_ZERO, lambda df, k: got.extend(df.collect()), checkpointLocation=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert len(got) == 1 and len(got[0]["contours"][0]) == 4


def test_a_group_gathers_over_batches(spark, tmp_path):
    """Group 1 arrives in three batches, group 2 in one; group 3 is never closed."""
    from quadrille.model import FillRule
    from quadrille.streaming.microbatch import gathered, overlay_stream

    ring = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    batches = [
        [(1, "subject", 0, ring(0, 0, 4)), (3, "subject", 0, ring(0, 0, 1))], [(1, "clip", 0, ring(1, 1, 2)), (2, "subject", 0, ring(5, 5, 3)), (2, "end", None, None)],
        [(1, "subject", 1, ring(10, 0, 1)), (1, "end", None, None)],
    ]
    got = []
    (tmp_path / "in").mkdir()
    stream = gathered(spark.readStream.schema(CONTOURS).parquet(str(tmp_path / "in")))
    for rows in batches:
        spark.createDataFrame(rows, CONTOURS).write.mode("append").parquet(str(tmp_path / "in"))
        q = overlay_stream(stream, OverlayRule.DIFFERENCE, FillRule.NON_ZERO, lambda df, k: got.extend(df.collect()), checkpointLocation=str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        if rows is batches[0]:
            assert not got
    assert sorted((r["group_id"], r["shape_id"], len(r["contours"])) for r in got) == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]


def test_entry_stands_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['quadrille.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'rule_union' in q and not any(k.startswith('op') for k in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_entry_imports_in_a_fresh_process():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q))"], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) >= 30
