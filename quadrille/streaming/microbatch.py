"""Overlays of a stream of contours: one overlay per micro-batch, of groups gathered over micro-batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..model import RING, FillRule, Options, OverlayRule
from ..operators.overlay import Overlay

END = "end"  # shape_type of the row that closes a group
_FLAT = "group_id long, shape_type string, contour_id long, points string"


def _gather(key, frames, state):
    kinds, ids, points = (list(v) for v in state.get) if state.exists else ([], [], [])
    closed = False
    for f in frames:
        closed |= bool((f["shape_type"] == END).any())
        own = f[f["shape_type"] != END]
        kinds += own["shape_type"].tolist()
        ids += [None if pd.isna(i) else int(i) for i in own["contour_id"]]
        points += own["points"].tolist()
    if not closed:
        state.update((kinds, ids, points))
        return
    if state.exists:
        state.remove()
    yield pd.DataFrame({"group_id": pd.Series([key[0]] * len(ids), dtype="int64"), "shape_type": kinds, "contour_id": pd.Series(ids, dtype="Int64"), "points": points})


def gathered(contours: DataFrame) -> DataFrame:
    """A stream of contours, held back by group until the group's end marker arrives, a row with shape_type `end`: then all of the group at once.

    The contours of an open group are the state of its key, so a group must fit one task, and one that is never closed stays. Contours
    that follow the marker begin the group anew. Rows without a group are ignored.
    """
    flat = contours.where("group_id is not null").select("group_id", "shape_type", "contour_id", F.to_json("points").alias("points"))
    whole = flat.groupBy("group_id").applyInPandasWithState(_gather, _FLAT, "kinds array<string>, ids array<long>, points array<string>", "append", GroupStateTimeout.NoTimeout)
    return whole.select("group_id", "shape_type", "contour_id", F.from_json("points", RING).alias("points"))


def overlay_stream(contours: DataFrame, rule: OverlayRule, fill: FillRule, sink: Callable[[DataFrame, int], None], options: Options = Options(), **writer):
    """Starts a query that hands the shapes of every micro-batch to sink(shapes, batch id).

    Groups must arrive whole within a micro-batch, as from gathered(): the operation has no incremental form.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(Overlay(batch, options).shapes(rule, fill), number)

    stream = contours.writeStream.foreachBatch(each)
    for k, v in writer.items():
        stream = stream.option(k, v)
    return stream.start()
