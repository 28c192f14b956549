"""Overlay results on hand-made cases, random rectangles, topology cases and invalid input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.model import CONTOURS, ContourDirection, FillRule, Options, OverlayRule
from quadrille.operators import boundary, sweep
from quadrille.operators.overlay import Overlay
from quadrille.sources.contours import from_rects
from quadrille.sources.generators import GENERATORS

#: fill, rectangles (x0, y0, x1, y1, clockwise), area, rings per shape
HAND_MADE = [
    ("evenodd", [(0, 0, 10, 10, 0)], 100, 1),
    ("evenodd", [(0, 0, 5, 10, 0), (5, 0, 10, 10, 0)], 100, 1),
    ("evenodd", [(0, 0, 5, 5, 0), (0, 5, 5, 10, 0), (5, 0, 10, 5, 0), (5, 5, 10, 10, 0)], 100, 1),
    ("evenodd", [(1, 1, 3, 3, 1), (0, 0, 4, 4, 0)], 12, 2),
    ("nonzero", [(0, 5, 3, 7, 0), (0, 1, 1, 6, 0)], 10, 1),
    ("nonzero", [(5, 5, 6, 7, 0), (3, 1, 6, 6, 0), (6, 6, 7, 7, 0)], 17, 1),
    ("nonzero", [(4, 3, 7, 6, 0), (5, 5, 6, 7, 0)], 10, 1),
    ("nonzero", [(0, 0, 4, 4, 0), (4, 1, 6, 3, 0)], 20, 1),
    ("nonzero", [(0, 1, 4, 3, 0), (4, 0, 6, 4, 0)], 16, 1),
    ("nonzero", [(5, 0, 6, 6, 0), (3, 4, 6, 5, 0)], 8, 1),
    ("nonzero", [(0, 1, 6, 7, 0), (4, 0, 6, 1, 0)], 38, 1),
    ("nonzero", [(0, 0, 4, 6, 0), (1, 5, 4, 6, 0)], 24, 1),
    ("nonzero", [(6, 0, 7, 6, 0), (3, 2, 6, 4, 0), (0, 0, 6, 3, 0), (1, 0, 3, 2, 0)], 27, 1),
]


def subject(spark, rects, group=0):
    return from_rects(spark, [(group, "subject", *r[:4], bool(r[4])) for r in rects])


def rings_of(rows):
    rows = sorted(rows, key=lambda r: r["shape_id"])
    return {r["group_id"]: [[[(p["x"], p["y"]) for p in ring] for ring in s["contours"]] for s in rows if s["group_id"] == r["group_id"]] for r in rows}


def test_hand_made_cases(spark):
    for fill in ("evenodd", "nonzero"):
        cases = [(k, c) for k, c in enumerate(HAND_MADE) if c[0] == fill]
        table = from_rects(spark, [(k, "subject", *r[:4], bool(r[4])) for k, c in cases for r in c[1]])
        o = Overlay(table)
        area = {r["group_id"]: r["area"] for r in o.area(OverlayRule.SUBJECT, FillRule(fill)).collect()}
        shapes = rings_of(o.shapes(OverlayRule.SUBJECT, FillRule(fill)).collect())
        for k, (_, _, want, n) in cases:
            assert area[k] == want
            assert [len(s) for s in shapes[k]] == [n], k
        if fill == "evenodd":
            assert shapes[0] == [[[(0, 0), (10, 0), (10, 10), (0, 10)]]]


def squares(*cells):
    return [(x, y, x + 1, y + 1, 0) for x, y in cells]


TOPOLOGY = {
    "touching squares": (squares((0, 0), (1, 1)), [[4], [4]]),
    "touching holes": ([(0, 0, 4, 4, 0), (1, 1, 2, 2, 0), (2, 2, 3, 3, 0)], [[4, 4, 4]]),
    "hole touches outer": ([(0, 0, 3, 3, 0), (2, 2, 3, 3, 0), (1, 1, 2, 2, 0)], [[10]]),
    "island touches wall": ([(0, 0, 5, 5, 0), (1, 1, 4, 4, 0), (1, 1, 2, 2, 0), (2, 2, 3, 3, 0)], [[4, 10]]),
    "island in a hole": ([(0, 0, 9, 9, 0), (1, 1, 8, 8, 0), (3, 3, 6, 6, 0)], [[4, 4], [4]]),
}


def test_corner_touches(spark):
    names = list(TOPOLOGY)
    table = from_rects(spark, [(k, "subject", *r[:4], False) for k, n in enumerate(names) for r in TOPOLOGY[n][0]])
    shapes = rings_of(Overlay(table).shapes(OverlayRule.SUBJECT, FillRule.EVEN_ODD).collect())
    for k, n in enumerate(names):
        assert [[len(r) for r in s] for s in shapes[k]] == TOPOLOGY[n][1], n
    assert shapes[2][0][0] == [(0, 0), (3, 0), (3, 2), (2, 2), (2, 1), (1, 1), (1, 2), (2, 2), (2, 3), (0, 3)]
    hole = shapes[3][0][1]
    start = hole.index((1, 2)) if (1, 1) not in hole else 0
    assert set(hole) == {(1, 2), (1, 4), (4, 4), (4, 1), (2, 1), (2, 2), (3, 2), (3, 3), (2, 3)} and start >= 0


def random_groups(seed, groups, n, p):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        for _ in range(n):
            x, y = r.randint(0, 2**p - 2), r.randint(0, 2**p - 2)
            out.append((g, r.choice(["subject", "clip"]), x, y, r.randint(x + 1, 2**p - 1), r.randint(y + 1, 2**p - 1), r.random() < 0.4))
    return out


def raster(rects, groups, size):
    s, c = (np.zeros((groups, size, size), int) for _ in range(2))
    for g, role, x0, y0, x1, y1, cw in rects:
        (s if role == "subject" else c)[g, x0:x1, y0:y1] += -1 if cw else 1
    return s, c


FILLS = {"evenodd": lambda w: w % 2 != 0, "nonzero": lambda w: w != 0, "positive": lambda w: w > 0, "negative": lambda w: w < 0}
RULES = {
    "subject": lambda s, c: s, "clip": lambda s, c: c, "intersect": lambda s, c: s & c, "union": lambda s, c: s | c,
    "difference": lambda s, c: s & ~c, "inverse_difference": lambda s, c: c & ~s, "xor": lambda s, c: s ^ c,
}


@pytest.mark.parametrize("n,p", [(3, 3), (16, 4)])
def test_random_rectangles_against_raster(spark, n, p):
    groups = 40
    rects = random_groups(n * 31 + p, groups, n, p)
    s, c = raster(rects, groups, 2**p)
    o = Overlay(from_rects(spark, rects))
    got = {r["group_id"]: r for r in o.area_matrix().collect()}
    for f, fill in FILLS.items():
        for r, rule in RULES.items():
            want = rule(fill(s), fill(c)).sum((1, 2))
            assert [got[g][f"{f}_{r}"] for g in range(groups)] == want.tolist(), (f, r)
    # traced rings cover the same cells
    for f, r in (("nonzero", "union"), ("evenodd", "xor"), ("positive", "difference")):
        cells = np.zeros((groups, 2**p, 2**p), int)
        for row in o.shapes(OverlayRule(r), FillRule(f)).collect():
            for ring in row["contours"]:
                pts = [(q["x"], q["y"]) for q in ring]
                for (x0, y0), (x1, _) in zip(pts, pts[1:] + pts[:1]):
                    a, b, sign = (x0, x1, 1) if x1 > x0 else (x1, x0, -1)
                    if a != b:
                        cells[row["group_id"], a:b, y0:] += sign
        assert (cells == RULES[r](FILLS[f](s), FILLS[f](c))).all(), (f, r)


def test_long_edges_are_sent_once_per_block_and_regions_are_wide(spark):
    counts = []
    for n in (16, 32):
        o = Overlay(GENERATORS["nested"](spark, n))
        h = sweep._horizontals(o.contours)
        placed = sweep._placed(h, sweep.ranked(h))
        strips, edges = sweep.ranked(h).count() - 1, h.count()
        assert sweep._in_blocks(placed).count() <= edges * (strips / 2**sweep.BLOCK + 2)
        rects = o.region(OverlayRule.UNION)
        assert rects.selectExpr("sum((x1 - x0) * (y1 - y0)) a").first()["a"] == o.area(OverlayRule.UNION).first()["area"]
        counts.append((rects.count(), o._kept(OverlayRule.UNION, FillRule.NON_ZERO).count()))
    # a frame is a few rectangles however many strips it crosses; slabs grow with the square of n
    assert counts[1][0] <= 2.5 * counts[0][0] and counts[1][1] > 3 * counts[0][1]


def test_sweep_sends_sparse_horizontals_once_and_sums_sorted_rows(spark):
    """Far, near and crowded coordinates, where blocks are shared or cut; no hash table of horizontals or of their strips where few coincide."""
    r = random.Random(4)
    spots = [(r.randrange(-(2**30), 2**30), r.randrange(50)) for _ in range(300)] + [(r.randrange(5000), r.randrange(50)) for _ in range(900)]
    rects = [(g, "subject", x, y, x + r.choice([1, 7, 40, 2**20]), y + r.randrange(1, 9), False) for g, (x, y) in enumerate(spots)]
    rects = [(g % 2, *rest) for g, *rest in rects]
    o = Overlay(from_rects(spark, rects))
    assert not [line for line in o.slabs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "subj" in line]
    got = {p["group_id"]: p["a"] for p in o.slabs.groupBy("group_id").agg(F.expr("sum(ws * (cast(x1 as long) - x0) * (y1 - y0))").alias("a")).collect()}
    assert got == {k: sum((x1 - x0) * (y1 - y0) for g, _, x0, y0, x1, y1, _ in rects if g == k) for k in (0, 1)}
    assert sweep._ends(sweep.segments(o.contours).where("orient = 'H'"))[1:] == (2 * len(rects), False)


def test_links_have_even_degree_and_strips_close(spark):
    o = Overlay(from_rects(spark, random_groups(5, 20, 12, 4)))
    degrees = {r["degree"] for r in boundary.nodes(o.links(OverlayRule.XOR)).collect()}
    assert degrees <= {2, 4}
    assert sweep.unbalanced(o.contours).count() == 0


def test_rejects_and_empty_input(spark):
    rows = [
        (1, "subject", 0, [(0, 0), (3, 0), (0, 3)]), (1, "subject", 1, [(0, 0), (3, 0)]), (1, "clip", 2, None), (1, "subject", 3, [(1, 1), (1, 1), (1, 1)]),
        (1, "other", 4, [(0, 0), (1, 0), (1, 1), (0, 1)]), (1, None, 5, [(0, 0), (1, 0), (1, 1), (0, 1)]), (1, "subject", 6, [(0, 0), None, (1, 1)]),
    ]
    o = Overlay(spark.createDataFrame(rows, CONTOURS))
    reasons = {r["contour_id"]: r["reason"] for r in o.rejects.collect()}
    assert reasons == {0: "diagonal edge", 1: "fewer than 3 points", 2: "fewer than 3 points", 3: "zero length", 4: "unknown shape type", 5: "unknown shape type", 6: "null point"}
    assert o.area(OverlayRule.UNION).count() == 0 and o.shapes(OverlayRule.UNION).count() == 0
    mill = Overlay(GENERATORS["windmill"](spark, 2))
    assert mill.rejects.count() == 16 and mill.contours.count() == 16


def test_options(spark):
    table = subject(spark, [(0, 0, 6, 6, 0), (2, 2, 4, 4, 1), (10, 0, 11, 1, 0)])
    fill = FillRule.EVEN_ODD
    plain = rings_of(Overlay(table).shapes(OverlayRule.SUBJECT, fill).collect())[0]
    assert [len(s) for s in plain] == [2, 1]
    turned = rings_of(Overlay(table, Options(output_direction=ContourDirection.CLOCKWISE)).shapes(OverlayRule.SUBJECT, fill).collect())[0]
    assert turned[0][0] == [(0, 0), (0, 6), (6, 6), (6, 0)]
    for least, want in ((4, [2]), (5, [1])):  # the hole's area is 4, compared with >=
        got = rings_of(Overlay(table, Options(min_output_area=least)).shapes(OverlayRule.SUBJECT, fill).collect())[0]
        assert [len(s) for s in got] == want
    joined = subject(spark, [(0, 0, 2, 2, 0), (2, 0, 4, 2, 0), (2, 2, 3, 3, 0)])
    assert [len(r) for s in rings_of(Overlay(joined, Options.keep_output_points()).shapes(OverlayRule.SUBJECT).collect())[0] for r in s] >= [8]


def test_extremes(spark):
    m = 2**31 - 1
    wide = subject(spark, [(-m, -2, m, m, 0), (-m, -2, m, m, 0)], 3)
    assert Overlay(wide).area(OverlayRule.SUBJECT).first()["area"] == 2 * m * (m + 2) < 2**63
    same = from_rects(spark, [(0, r, 0, 0, 5, 5, False) for r in ("subject", "clip")])
    assert Overlay(same).area(OverlayRule.DIFFERENCE).count() == 0 and Overlay(same).area(OverlayRule.XOR).count() == 0
    stacked = from_rects(spark, [(0, "subject", 0, 0, 1, 1, False)] * 33_000)
    assert Overlay(stacked).slabs.first()["ws"] == 33_000
    assert Overlay(from_rects(spark, [(0, "subject", 0, 0, 1, 1, False), (0, "subject", 0, 0, 1, 1, True)])).slabs.count() == 0


@pytest.mark.parametrize("name,rule,area", [
    ("checkerboard", "xor", lambda n: 400 * (n * n + (n - 1) ** 2) - 200 * (n - 1) ** 2), ("not_overlap", "union", lambda n: 100 * (n * n + (n - 1) ** 2)),
    ("lines_net", "intersect", lambda n: 10 * n * (10 * n - 5)), ("windows", "difference", lambda n: 300 * n * n), ("nested", "xor", lambda n: 128 * n * n), ("nested", "union", lambda n: 128 * n * n + 64 * n),
])
def test_workloads(spark, name, rule, area):
    n = 4
    o = Overlay(GENERATORS[name](spark, n))
    assert o.area(OverlayRule(rule)).first()["area"] == area(n)
    assert o.area(OverlayRule(rule), FillRule.POSITIVE).count() == 0  # the rings run clockwise
    if name == "windows":
        assert [len(r["contours"]) for r in o.shapes(OverlayRule.DIFFERENCE).collect()] == [2] * n * n


def test_rings_are_checked_by_compiled_code(spark):
    """An explode of the reason once interpreted the whole check, for every ring."""
    o = Overlay(from_rects(spark, [(0, "subject", 0, 0, 1, 1, False)]))
    assert "reason" not in [c for line in o.contours._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line for c in line.replace("#", " ").replace("[", " ").split()]
    assert o.contours.count() == 1
