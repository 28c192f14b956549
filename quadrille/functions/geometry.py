"""Scalar geometry as Columns, in 64-bit integers throughout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def cross(a: Column, b: Column, c: Column) -> Column:
    """Cross product of b->a and b->c."""
    return (a["x"].cast("long") - b["x"]) * (c["y"].cast("long") - b["y"]) - (a["y"].cast("long") - b["y"]) * (c["x"].cast("long") - b["x"])


def turns(a: Column, b: Column, c: Column) -> Column:
    """cross(a, b, c) != 0, also where the products leave 64 bits. Where an edge runs along an axis one product is 0, and differences tell."""
    far = lambda p, q: (F.abs(p["x"].cast("long") - q["x"]) > 2**30) | (F.abs(p["y"].cast("long") - q["y"]) > 2**30)
    wide = lambda p: F.struct(p["x"].cast("decimal(18,0)").alias("x"), p["y"].cast("decimal(18,0)").alias("y"))
    d = lambda p, q, k: wide(p)[k] - wide(q)[k]
    upright, level = F.when(a["x"] == b["x"], (a["y"] != b["y"]) & (c["x"] != b["x"])), a["y"] == b["y"]
    return upright.when(level, c["y"] != b["y"]).when(far(a, b) | far(c, b), d(a, b, "x") * d(c, b, "y") != d(a, b, "y") * d(c, b, "x")).otherwise(cross(a, b, c) != 0)


def dot(a: Column, b: Column, c: Column) -> Column:
    """Dot product of b->a and b->c."""
    return (a["x"].cast("long") - b["x"]) * (c["x"].cast("long") - b["x"]) + (a["y"].cast("long") - b["y"]) * (c["y"].cast("long") - b["y"])


def orientation(p: Column, q: Column) -> Column:
    """'V', 'H', or null for a diagonal or an empty edge."""
    return F.when((p["x"] == q["x"]) & (p["y"] != q["y"]), "V").when((p["y"] == q["y"]) & (p["x"] != q["x"]), "H")


def invert_orientation(o: Column) -> Column:
    return F.when(o == "V", "H").when(o == "H", "V")


def following(points: Column) -> Column:
    """The ring's points moved on by one: at each place the point after it."""
    return F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))


def preceding(points: Column) -> Column:
    """The ring's points moved back by one: at each place the point before it."""
    return F.concat(F.slice(points, -1, 1), F.slice(points, F.lit(1), F.size(points) - 1))


def ring_edges(points: Column) -> Column:
    """The edges of a closed ring as structs (p, q); none for fewer than 3 points. Pass a plain column: it is read several times."""
    edges = F.arrays_zip(points.alias("p"), following(points).alias("q"))
    kind = "array<struct<p:struct<x:int,y:int>,q:struct<x:int,y:int>>>"
    return F.when(F.size(points) >= 3, edges.cast(kind)).otherwise(F.array().cast(kind))


def _turning(points: pa.Array, straight: bool) -> pa.Array:
    """Rings without points at which they don't turn, or, if straight, without spikes alone; rings of fewer than 3 points as they are. All points of a
    batch at once; equal products modulo 2**64 are equal if their doubles are near."""
    if isinstance(points, pa.ChunkedArray):
        points = points.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = points.flatten()
    n, stops = len(flat), np.cumsum(sizes)
    begins, short = stops - sizes, np.repeat(sizes < 3, sizes)
    at = np.arange(n)
    before, after = at - 1, at + 1
    some = sizes > 0
    before[begins[some]], after[stops[some] - 1] = stops[some] - 1, begins[some]
    known = np.ones(n, bool)
    xy = []
    for c in ("x", "y"):
        v = pc.struct_field(flat, c)
        known &= v.is_valid().to_numpy(zero_copy_only=False)
        xy.append(pc.fill_null(v, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    (ax, ay), (cx, cy) = ([v[k] - v for v in xy] for k in (before, after))
    with np.errstate(over="ignore"):
        p, q = ax * cy, ay * cx
        keep = (p != q) | (np.abs(ax.astype(float) * cy - ay.astype(float) * cx) > 2.0**62)
        if straight:
            far = ax.astype(float) * cx + ay.astype(float) * cy
            keep |= np.where(np.abs(far) > 2.0**61, far < 0, ax * cx + ay * cy < 0)
    keep = (keep & known & known[before] & known[after]) | short
    lengths = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(begins, n)) * some if len(sizes) else sizes
    offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32(), mask=np.append(~points.is_valid().to_numpy(zero_copy_only=False), False) if points.null_count else None)
    return pa.ListArray.from_arrays(offsets, flat.filter(pa.array(keep)))


_RING = "array<struct<x:int,y:int>>"


def drop_collinear(points: Column) -> Column:
    """The ring without points at which it doesn't turn: straight ones and spikes."""

    @F.arrow_udf(_RING)
    def turning(rings: pa.Array) -> pa.Array:
        return _turning(rings, False)

    return turning(points)


def drop_opposite_collinear(points: Column) -> Column:
    """The ring without spikes; straight points stay."""

    @F.arrow_udf(_RING)
    def turning(rings: pa.Array) -> pa.Array:
        return _turning(rings, True)

    return turning(points)


def ring_area2(points: Column) -> Column:
    """Twice the signed area of a ring, positive when counter-clockwise."""
    terms = F.transform(ring_edges(points), lambda e: e["p"]["x"].cast("long") * e["q"]["y"] - e["q"]["x"].cast("long") * e["p"]["y"])
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + t)


def leftmost_lowest(points: Column) -> Column:
    return F.array_min(points)


def rotated_to_smallest(points: Column) -> Column:
    """The ring begun at its smallest point."""
    at = F.array_position(points, F.array_min(points)).cast("int")
    return F.concat(F.slice(points, at, F.size(points)), F.slice(points, F.lit(1), at - 1))


def floor_log2(n: Column) -> Column:
    return (F.char_length(F.bin(n)) - 1).cast("int")


def ceil_log2(n: Column) -> Column:
    return F.when(n <= 1, F.lit(0)).otherwise(F.char_length(F.bin(n - 1)).cast("int"))
