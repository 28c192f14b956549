"""Fill rules and overlay rules as predicates over winding numbers and over masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CLIP_BOTTOM, CLIP_TOP, SUBJECT_BOTTOM, SUBJECT_TOP, FillRule, OverlayRule


def filled(winding: Column, fill: FillRule) -> Column:
    fill = FillRule(fill)
    if fill is FillRule.EVEN_ODD:
        return winding % 2 != 0
    return {FillRule.NON_ZERO: winding != 0, FillRule.POSITIVE: winding > 0, FillRule.NEGATIVE: winding < 0}[fill]


def inside(s: Column, c: Column, rule: OverlayRule) -> Column:
    """Whether a place belongs to the result, given that it is in the subject (s) and in the clip (c)."""
    return {
        OverlayRule.SUBJECT: s, OverlayRule.CLIP: c, OverlayRule.INTERSECT: s & c, OverlayRule.UNION: s | c,
        OverlayRule.DIFFERENCE: s & ~c, OverlayRule.INVERSE_DIFFERENCE: c & ~s, OverlayRule.XOR: s != c,
    }[OverlayRule(rule)]


def mask_of(s_top: Column, s_bottom: Column, c_top: Column, c_bottom: Column) -> Column:
    bits = ((s_top, SUBJECT_TOP), (s_bottom, SUBJECT_BOTTOM), (c_top, CLIP_TOP), (c_bottom, CLIP_BOTTOM))
    return sum((F.when(b, v).otherwise(0) for b, v in bits[1:]), F.when(bits[0][0], bits[0][1]).otherwise(0))


def _bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


def top_inside(mask: Column, rule: OverlayRule) -> Column:
    """Whether the side above (of a vertical: left) is in the result."""
    return inside(_bit(mask, SUBJECT_TOP), _bit(mask, CLIP_TOP), rule)


def included(mask: Column, rule: OverlayRule) -> Column:
    """Whether a segment with this mask bounds the result: exactly one of its sides is inside."""
    return top_inside(mask, rule) != inside(_bit(mask, SUBJECT_BOTTOM), _bit(mask, CLIP_BOTTOM), rule)
