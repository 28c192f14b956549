"""Data model: enums, options and table schemas."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class ShapeType(str, Enum):
    SUBJECT = "subject"
    CLIP = "clip"


class FillRule(str, Enum):
    EVEN_ODD = "evenodd"
    NON_ZERO = "nonzero"
    POSITIVE = "positive"
    NEGATIVE = "negative"


class OverlayRule(str, Enum):
    SUBJECT = "subject"
    CLIP = "clip"
    INTERSECT = "intersect"
    UNION = "union"
    DIFFERENCE = "difference"
    INVERSE_DIFFERENCE = "inverse_difference"
    XOR = "xor"


class ContourDirection(str, Enum):
    COUNTER_CLOCKWISE = "ccw"
    CLOCKWISE = "cw"


@dataclass(frozen=True)
class Options:
    """preserve_input_collinear is accepted and has no effect: winding does not depend on it. bucket_power is the least log2 of
    the width and height of a cell in the intersection join, which grows with the segments; results do not depend on it.
    min_count_per_column_power is the least log2 of the verticals in a column of the layout."""

    preserve_input_collinear: bool = False
    output_direction: ContourDirection = ContourDirection.COUNTER_CLOCKWISE
    preserve_output_collinear: bool = False
    min_output_area: int = 0
    bucket_power: int = 3
    min_count_per_column_power: int = 6

    @classmethod
    def keep_all_points(cls) -> "Options":
        return cls(preserve_input_collinear=True, preserve_output_collinear=True)

    @classmethod
    def keep_output_points(cls) -> "Options":
        return cls(preserve_output_collinear=True)


POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
RING = T.ArrayType(POINT)
CONTOURS = T.StructType(
    [T.StructField("group_id", T.LongType()), T.StructField("shape_type", T.StringType()), T.StructField("contour_id", T.LongType()), T.StructField("points", RING)]
)
SHAPES = T.StructType([T.StructField("group_id", T.LongType()), T.StructField("shape_id", T.IntegerType()), T.StructField("contours", T.ArrayType(RING))])

#: bits of a segment's mask: subject and clip above (of a vertical: to its left) and below (right)
SUBJECT_TOP, SUBJECT_BOTTOM, CLIP_TOP, CLIP_BOTTOM = 1, 2, 4, 8
