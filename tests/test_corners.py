"""Rings from corners: pieces of any size against the plain walker, and nothing doubled over the whole table where rings are short."""

from __future__ import annotations

import os
import random

import pytest

from plain_rings import plain_shapes
from quadrille import tables
from quadrille.model import FillRule, Options, OverlayRule
from quadrille.operators import corners
from quadrille.operators.overlay import Overlay
from quadrille.sources.contours import from_rects
from quadrille.sources.generators import windows


@pytest.mark.parametrize("piece", [1 << 17, 5])
def test_pieces_of_any_size_give_the_same_shapes(spark, monkeypatch, piece):
    monkeypatch.setattr(corners, "PIECE", piece)
    rng, rects = random.Random(piece), []
    for g in range(3):
        for _ in range(60):
            x, y = rng.randrange(24), rng.randrange(24)
            rects.append((g, "subject" if rng.random() < 0.6 else "clip", x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9), rng.random() < 0.5))
    o = Overlay(from_rects(spark, rects))
    links = {}
    for r in o.masked_segments(FillRule.NON_ZERO).collect():
        links.setdefault(r["group_id"], []).append(r)
    want = {g: plain_shapes(rows, OverlayRule.XOR)[0] for g, rows in links.items()}
    got = {}
    for r in o.shapes(OverlayRule.XOR).orderBy("group_id", "shape_id").collect():
        got.setdefault(r["group_id"], []).append([[(p["x"], p["y"]) for p in ring] for ring in r["contours"]])
    assert got == want


def test_short_rings_are_not_doubled(spark, tmp_path, monkeypatch):
    """Tables of all open edges per round of doubling once filled the disk."""
    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path))
    assert Overlay(windows(spark, 8)).shapes(OverlayRule.DIFFERENCE).count() == 64
    assert not [n for n in os.listdir(tmp_path / "quadrille") if n.startswith("ring-left")]


@pytest.mark.parametrize("least", [0, 101])
def test_shapes_are_whole_where_their_corners_lie(spark, tmp_path, monkeypatch, least):
    """Rings across pieces, and the rings of every shape, once went through joins over the whole table."""
    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(corners, "PIECE", 50)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = Overlay(windows(spark, 12), Options(min_output_area=least)).shapes(OverlayRule.DIFFERENCE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert sorted(r["shape_id"] for r in got) == list(range(144))
    assert {len(r["contours"]) for r in got} == {1 if least else 2}
    assert not [n for n in os.listdir(tmp_path / "quadrille") if n.startswith(("ring-ends", "ring-rest", "ring-shapes", "rings"))]
