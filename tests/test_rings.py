"""Distributed rings against the plain walker, ring for ring; cycles, components and numbers against brute force."""

import random

import pytest

from plain_rings import plain_shapes
from quadrille.model import ContourDirection, FillRule, Options, OverlayRule
from quadrille.operators import graph, rings
from quadrille.operators.overlay import Overlay
from quadrille.sources.contours import from_rects
from quadrille.sources.generators import GENERATORS
from quadrille.tables import saved
from test_overlay import random_groups


def plain(points):
    return [(p["x"], p["y"]) for p in points]


def compare(masked, rule, options=Options(), flat=False):
    masked = saved(masked, "masked")
    by = {}
    for r in masked.collect():
        by.setdefault(r["group_id"], []).append(r)
    want = {g: plain_shapes(rows, rule, options) for g, rows in by.items()}
    got = {}
    for r in rings.shapes(masked, rule, options).collect():
        got.setdefault(r["group_id"], {})[r["shape_id"]] = [plain(c) for c in r["contours"]]
    for g, (shapes, _) in want.items():
        assert [got.get(g, {}).get(k) for k in range(len(got.get(g, {})))] == shapes, g
    if not flat:
        return sum(len(s) for s, _ in want.values()), sum(len(c) - 1 for s, _ in want.values() for c in s)
    flat = {}
    for r in rings.flat_contours(masked, rule, options).collect():
        flat.setdefault(r["group_id"], {})[r["contour_id"]] = (r["is_hole"], plain(r["points"]))
    for g, (shapes, ordered) in want.items():
        own = flat.get(g, {})
        assert [own[k][1] for k in range(len(own))] == ordered and sum(not h for h, _ in own.values()) == len(shapes), g
    return sum(len(s) for s, _ in want.values()), sum(len(c) - 1 for s, _ in want.values() for c in s)


#: sizes at which touching corners, nested holes and islands are common
@pytest.mark.parametrize("n,p,fill,rule,options", [
    (40, 5, "evenodd", "subject", Options()), (60, 5, "nonzero", "xor", Options(output_direction=ContourDirection.CLOCKWISE, min_output_area=2)), (30, 4, "evenodd", "union", Options(preserve_output_collinear=True)),
])
def test_random_groups_against_the_plain_walker(spark, n, p, fill, rule, options):
    o = Overlay(from_rects(spark, random_groups(n * 7 + p, 40, n, p)))
    n_shapes, n_holes = compare(o.masked_segments(FillRule(fill)), OverlayRule(rule), options, flat=options.min_output_area > 0)
    assert n_shapes > 40 and n_holes > 0


def test_single_cells_full_of_touching_corners(spark):
    r = random.Random(9)
    cells = [(g, "subject", x, y, x + 1, y + 1, False) for g in range(40) for x in range(12) for y in range(12) if r.random() < 0.3 + g / 100]
    n_shapes, n_holes = compare(Overlay(from_rects(spark, cells)).masked_segments(), OverlayRule.SUBJECT, flat=True)
    assert n_shapes > 500 and n_holes > 40


def test_every_workload_in_one_group(spark):
    for name, rule in (("checkerboard", "xor"), ("nested", "union")):
        compare(Overlay(GENERATORS[name](spark, 5)).masked_segments(), OverlayRule(rule))


def test_a_hole_without_a_floor_is_an_error(spark):
    schema = "group_id long, orient string, ax int, ay int, bx int, by int, fill int"
    around = [("H", 0, 0, 4, 0, 2), ("V", 0, 0, 0, 4, 1), ("H", 0, 4, 4, 4, 1), ("V", 4, 0, 4, 4, 2)]  # the result lies outside only
    with pytest.raises(Exception, match="no shape below the hole"):
        rings.shapes(spark.createDataFrame([(0, *r) for r in around], schema), OverlayRule.SUBJECT).collect()


def test_cycles_of_many_lengths(spark):
    r = random.Random(2)
    ids = r.sample(range(-(10**12), 10**12), 3000)
    want, rows, at = {}, [], 0
    for length in [1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 33, 64, 700, 1500]:
        part, at = ids[at : at + length], at + length
        least = part.index(min(part))
        for k, i in enumerate(part):
            rows.append((i, part[(k + 1) % length]))
            want[i] = (min(part), (least - k) % length)
    got = graph.cycles(spark.createDataFrame(rows, "id long, next long")).collect()
    assert {g["id"]: (g["ring"], g["ahead"]) for g in got} == want and len(got) == len(rows)


def test_components_and_numbers(spark):
    r = random.Random(3)
    pairs = [(k, k + 1) for k in range(0, 300)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(140)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: find(k) for k in parent if any(k in p and p[0] != p[1] for p in pairs)}
    rows = spark.createDataFrame([(r.choice([1, 1, 1, 2, 3]), r.random()) for _ in range(500)], "g long, v double")
    laid = graph.numbered(graph.ordered_ids(rows, ["g", "v"], "numbers"), "g", "k").orderBy("g", "v").collect()
    for g in (1, 2, 3):
        assert [x["k"] for x in laid if x["g"] == g] == list(range(sum(x["g"] == g for x in laid)))
