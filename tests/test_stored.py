"""Slabs stored by strip: equal results, and plans that don't shuffle slabs again."""

import os

import pytest

from quadrille.model import FillRule, OverlayRule
from quadrille.operators.overlay import Overlay
from quadrille.sources.contours import lineitem_contours


@pytest.fixture(scope="module")
def overlays(spark):
    contours = lineitem_contours(spark, "/root/testdata/sf0.001")
    return Overlay(contours), Overlay(contours).stored(buckets=3)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("rule", [OverlayRule.UNION, OverlayRule.INVERSE_DIFFERENCE])
def test_rules_read_the_table(overlays, rule):
    plain, stored = overlays
    for fill in (FillRule.NON_ZERO, FillRule.EVEN_ODD):
        assert rows(stored.area(rule, fill)) == rows(plain.area(rule, fill))
    assert rows(stored.links(rule)) == rows(plain.links(rule))
    assert rows(stored.region(rule)) == rows(plain.region(rule))


def test_slabs_are_not_shuffled_again(overlays):
    plain, stored = overlays
    assert exchanges(stored._kept(OverlayRule.XOR, FillRule.NON_ZERO)) == 0
    per_strip = stored._kept(OverlayRule.XOR, FillRule.NON_ZERO).groupBy("group_id", "x0").count()
    assert exchanges(per_strip) == 0
    assert exchanges(stored.links(OverlayRule.XOR)) <= 2 < exchanges(plain.links(OverlayRule.XOR))
    assert "hashpartitioning(group_id" in stored.links(OverlayRule.XOR)._jdf.queryExecution().executedPlan().toString()
    plan = stored.links(OverlayRule.XOR)._jdf.queryExecution().executedPlan().toString()
    assert "x0" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_reopened_and_dropped(spark):
    contours = lineitem_contours(spark, "/root/testdata/sf0.001")
    first = Overlay(contours).stored(buckets=2, name="slabs_kept")
    again = Overlay.reopened(spark, "slabs_kept")
    want = rows(first.area(OverlayRule.UNION))
    assert rows(again.area(OverlayRule.UNION)) == want
    files = {f.removeprefix("file://") for f in spark.table("slabs_kept").inputFiles()}
    assert files and all(os.path.exists(f) for f in files)
    first.dropped()
    assert not spark.catalog.tableExists("slabs_kept") and not any(os.path.exists(f) for f in files)
    assert rows(first.area(OverlayRule.UNION)) == want  # swept anew
    none = Overlay(contours.where("false")).stored(buckets=2)
    assert none.area(OverlayRule.UNION).count() == 0
    none.dropped()
