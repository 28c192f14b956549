"""Columns by count against a plain walk over the sorted coordinates."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrille.operators import layout

SCHEMA = "group_id long, orient string, pos int, lo int, hi int, subj long, clip long"


def plain_columns(segs, power):
    """{group: [(x0, n)]}"""
    out = {}
    for g in {s[0] for s in segs}:
        n = Counter(s[2] for s in segs if s[0] == g and s[1] == "V")
        xs = sorted(set(n) | {x for s in segs if s[0] == g and s[1] == "H" for x in s[3:5]})
        total, before, cols = sum(n.values()), 0, []
        depth = max(2**power, math.ceil(4 * math.sqrt(total)))
        for x in xs:
            share = max(0, min(before, total - 1)) // depth
            if not cols or cols[-1][0] != share:
                cols.append([share, x, 0])
            cols[-1][2] += n[x]
            before += n[x]
        out[g] = [(x, k) for _, x, k in cols]
    return out


def crowded(seed, m=400):
    """Half of all coordinates within 300 of the origin, the others anywhere; one x with many verticals."""
    r = random.Random(seed)
    x = lambda: r.randint(-150, 150) if r.random() < 0.5 else r.randint(-(2**31), 2**31 - 1)
    segs = set()
    for g in range(3):
        for _ in range(m):
            lo, hi = sorted((x(), x()))
            if lo < hi:
                segs.add((g, "H", r.randint(0, 50), lo, hi, 1, 0))
            y = r.randint(0, 50)
            segs.add((g, "V", 7 if r.random() < 0.2 else x(), y, y + r.randint(1, 9), 0, 1))
    segs.add((3, "H", 0, 0, 5, 1, 0))  # without a vertical
    segs.add((4, "V", 3, 0, 5, 1, 0))  # without a horizontal
    return sorted(segs)


@pytest.mark.parametrize("power", [2, 6])
def test_columns_follow_the_count(spark, power):
    segs = crowded(power)
    want = plain_columns(segs, power)
    got = {}
    for r in layout.columns(spark.createDataFrame(segs, SCHEMA), power).orderBy("group_id", "column_no").collect():
        own = got.setdefault(r["group_id"], [])
        assert r["column_no"] == len(own)
        own.append(r)
    assert {g: [(r["x0"], r["n"]) for r in rows] for g, rows in got.items()} == want
    for g, rows in got.items():
        assert [r["x1"] for r in rows] == [r["x0"] for r in rows[1:]] + [None]
        heaviest = max(Counter(s[2] for s in segs if s[0] == g and s[1] == "V").values(), default=0)
        total = sum(r["n"] for r in rows)
        assert max(r["n"] for r in rows) <= max(2**power, math.ceil(4 * math.sqrt(total))) + heaviest


@pytest.mark.parametrize("power", [2, 6])
def test_horizontals_are_cut_at_borders(spark, power):
    segs = crowded(10 + power)
    cols = plain_columns(segs, power)
    want = []
    for g, o, pos, lo, hi, s, c in segs:
        borders = [x for x, _ in cols[g]] + [2**31]
        for k in range(len(borders) - 1):
            a, b = borders[k], borders[k + 1]
            if o == "V" and a <= pos < b:
                want.append((g, o, pos, lo, hi, s, c, k))
            if o == "H" and max(lo, a) < min(hi, b):
                want.append((g, o, pos, max(lo, a), min(hi, b), s, c, k))
    got = [tuple(r) for r in layout.in_columns(spark.createDataFrame(segs, SCHEMA), power).collect()]
    assert sorted(got) == sorted(want)


def test_layout_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert layout.columns(none).count() == 0 and layout.in_columns(none).count() == 0


def test_no_column_of_lineitem_is_crowded(spark):
    from quadrille.plans.catalogue import column_layout

    per = column_layout(spark, "/root/testdata/sf0.01").groupBy("group_id").agg((F.max("n") / F.avg("n")).alias("over"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 16 and all(r["over"] < 4 and r["n"] > 4 for r in per)
