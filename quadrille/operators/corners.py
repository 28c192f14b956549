"""Rings out of the corners of a region. Verticals alone make the edges: at each end of one a horizontal leads to the next on its line.

A corner is a point where the sides to the right and to the left change by different amounts upwards: dr and dl. Corners are dealt by ranges of x, so
that most rings lie within one range: `near` goes through its lines in pieces, closes rings as soon as their last vertical is there, and gives them
their holes. Verticals of rings that cross ranges, and of those with touching corners, are left for joins over the whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import filled, included, inside, top_inside
from ..model import FillRule, OverlayRule

PIECE = 1 << 17  # verticals that are searched for rings at once
SWEPT = 1 << 15  # horizontals of blocks that are swept at once, each times the strips that it crosses
ROWS = 1 << 20  # corners for each partition, where there are more partitions than usual
_POINT = pa.struct([("x", pa.int32()), ("y", pa.int32())])
_LOOSE = ("y0", "y1", "top", "r0", "t0", "r1", "t1")
_PART = "id long, group_id long, x int, floor int, y0 int, y1 int, top boolean, r0 boolean, t0 boolean, r1 boolean, t1 boolean"
_SCHEMA = {"id": pa.int64(), "group_id": pa.int64(), "x": pa.int32(), "floor": pa.int32(), "y0": pa.int32(), "y1": pa.int32(), **{c: pa.bool_() for c in _LOOSE[2:]}}
_SCHEMA.update({"hole": pa.bool_(), "points": pa.list_(_POINT), "owner": pa.int64(), "ids": pa.list_(pa.int64()), "contours": pa.list_(pa.list_(_POINT))})
_NONE = -(1 << 31) - 1  # below all coordinates


def of_slabs(slabs: DataFrame, rule: OverlayRule, fill: FillRule) -> DataFrame:
    """(group_id, x, y, dr, dl, floor): corners, some in two parts, out of slabs; floor: where the run of the right strip begins that ends there."""
    kept = slabs.where(inside(filled(F.col("ws"), fill), filled(F.col("wc"), fill), rule)).select("group_id", "x0", "x1", "y0", "y1")
    up = Window.partitionBy("group_id", "x0").orderBy("y0")
    begun = kept.withColumn("begin", F.when(F.coalesce(F.lag("y1").over(up) == F.col("y0"), F.lit(False)), F.lit(None)).otherwise(F.col("y0")))
    runs = begun.withColumn("floor", F.last("begin", ignorenulls=True).over(up))
    nothing = F.lit(None).cast("int")
    event = lambda x, y, dr, dl, floor: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(dr).alias("dr"), F.lit(dl).alias("dl"), floor.alias("floor"))
    four = F.array(event("x0", "y0", 1, 0, nothing), event("x0", "y1", -1, 0, F.col("floor")), event("x1", "y0", 0, 1, nothing), event("x1", "y1", 0, -1, nothing))
    events = runs.select("group_id", F.explode(four).alias("e")).select("group_id", "e.*")
    return _summed(events)


def of_horizontals(sent: DataFrame, rule: OverlayRule, fill: FillRule) -> DataFrame:
    """The same out of horizontals cut to blocks of strips, dealt by block and sorted upwards (sweep.in_order). A block is swept in pieces; from one to the
    next go the windings of its strips."""
    piece = min(PIECE, SWEPT)

    def run(batches):
        held, rows, rest, state = [], 0, None, None
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows >= piece:
                done, rest, state = _swept(held, rest, state, rule, fill, False)
                held, rows = [], 0
                yield from done
        yield from _swept(held, rest, state, rule, fill, True)[0]

    return sent.select("group_id", "block", "y", "lo", "hi", "subj", "clip").mapInArrow(run, "group_id long, x int, y int, dr int, dl int, floor int")


def _swept(held: list, c: dict | None, state: dict | None, rule: OverlayRule, fill: FillRule, last: bool) -> tuple[list, dict | None, dict | None]:
    """Corners below the last y, in batches; the rows that are kept for the next call; and, of the block that goes on, its windings there as rows."""
    new = _arrays(held, {}) if held else None
    if c is None or new is None:
        c = new if c is None else c
    else:
        c = {k: np.concatenate([c[k], new[k]]) for k in c}
    if c is None or not len(c["y"]):
        return [], c, state
    n, rest, goes_on = len(c["y"]), None, False
    if not last:
        same = (c["group_id"] == c["group_id"][-1]) & (c["block"] == c["block"][-1])
        n = int(np.argmax(same & (c["y"] == c["y"][-1])))
        if n == 0:
            return [], c, state
        rest, goes_on = {k: v[n:] for k, v in c.items()}, bool(same[n - 1])
        c = {k: v[:n] for k, v in c.items()}
    c = {k: v.astype(np.int64) for k, v in c.items()}
    olds = 0
    if state is not None:
        olds = len(state["lo"])
        fixed = {"y": _NONE, "group_id": c["group_id"][0], "block": c["block"][0]}
        c = {k: np.concatenate([np.full(olds, fixed[k]) if k in fixed else state[k], v]) for k, v in c.items()}
    g, y = c["group_id"], c["y"]
    starts = np.append(True, (g[1:] != g[:-1]) | (c["block"][1:] != c["block"][:-1]))
    block, groups = (np.cumsum(starts) - 1) << 32, g[starts]

    # strips between all ends in a block, and the windings on each, upwards
    borders, at = np.unique(np.concatenate([block + c["lo"], block + c["hi"]]) + (1 << 31), return_inverse=True)
    low, high = at[: len(y)], at[len(y) :]
    wide = high - low
    row = np.repeat(np.arange(len(y)), wide)
    strip = np.repeat(low - np.cumsum(wide) + wide, wide) + np.arange(len(row))
    begun = np.zeros(len(borders), np.int64)
    olds = int(wide[:olds].sum())
    if olds:
        begun[strip[:olds]] = state["begin"][row[:olds]]
    key = (strip << 33) + (y[row] - _NONE)
    order = np.argsort(key)
    key, row = key[order], row[order]
    final = np.append(key[1:] != key[:-1], True)
    key = key[final]
    strip = key >> 33
    firsts = np.flatnonzero(np.append(True, strip[1:] != strip[:-1]))
    lengths = np.diff(np.append(firsts, len(strip)))

    def winding(role):
        w = np.cumsum(c[role][row])[final]
        return w - np.repeat(np.where(firsts > 0, w[firsts - 1], 0), lengths)

    ws, wc = winding("subj"), winding("clip")
    within = inside(filled(ws, fill), filled(wc, fill), rule)
    before = np.append(False, within[:-1])
    before[firsts] = False

    # the sides turn inside or outside; each turn is at both borders of its strip
    turn = np.flatnonzero(within != before)
    to, strips = np.where(within[turn], 1, -1), strip[turn]
    ty = (key[turn] & ((1 << 33) - 1)) + _NONE
    begin = np.where(ty == _NONE, begun[strips], ty)
    floor = np.where(to < 0, np.append(_NONE, begin[:-1]), _NONE)
    now = ty != _NONE
    event = np.concatenate([(strips[now] << 33) + (ty[now] - _NONE), ((strips[now] + 1) << 33) + (ty[now] - _NONE)])
    order, k = np.argsort(event), int(now.sum())
    event = event[order]
    done = []
    if k:
        point = np.flatnonzero(np.append(True, event[1:] != event[:-1]))
        none = np.zeros(k, np.int64)
        dr = np.add.reduceat(np.concatenate([to[now], none])[order], point)
        dl = np.add.reduceat(np.concatenate([none, to[now]])[order], point)
        floor = np.maximum.reduceat(np.concatenate([floor[now], none + _NONE])[order], point)
        keep = dr != dl
        border = borders[event[point][keep] >> 33]
        floor = floor[keep]
        col = {"group_id": groups[border >> 32], "x": (border & ((1 << 32) - 1)) - (1 << 31), "y": (event[point][keep] & ((1 << 33) - 1)) + _NONE, "dr": dr[keep], "dl": dl[keep]}
        col = [pa.array(v, pa.int64() if name == "group_id" else pa.int32()) for name, v in col.items()]
        col.append(pa.array(np.where(floor == _NONE, 0, floor), pa.int32(), mask=floor == _NONE))
        done = [pa.RecordBatch.from_arrays(col, names=["group_id", "x", "y", "dr", "dl", "floor"])]
    state = None
    if goes_on:
        begun[strips] = begin  # the last of each, as they ascend
        ends = firsts + lengths - 1
        ends = ends[((borders[strip[ends]] >> 32) == len(groups) - 1) & ((ws[ends] != 0) | (wc[ends] != 0))]
        x = lambda b: (borders[b] & ((1 << 32) - 1)) - (1 << 31)
        state = {"lo": x(strip[ends]), "hi": x(strip[ends] + 1), "subj": ws[ends], "clip": wc[ends], "begin": begun[strip[ends]]}
    return done, rest, state


def of_links(masked: DataFrame, rule: OverlayRule) -> DataFrame:
    """The same out of boundary links, which are cut at every strip: horizontals tell all corners."""
    level = masked.where((F.col("orient") == "H") & included(F.col("fill"), rule)).withColumn("d", F.when(top_inside(F.col("fill"), rule), 1).otherwise(-1))
    level = level.withColumn("floor", F.when(F.col("d") < 0, F.lag("ay").over(Window.partitionBy("group_id", "ax").orderBy("ay"))))
    event = lambda x, dr, dl, floor: F.struct(F.col(x).alias("x"), dr.alias("dr"), dl.alias("dl"), floor.alias("floor"))
    two = F.array(event("ax", F.col("d"), F.lit(0), F.col("floor")), event("bx", F.lit(0), F.col("d"), F.lit(None).cast("int")))
    return _summed(level.select("group_id", F.col("ay").alias("y"), F.explode(two).alias("e")).select("group_id", "y", "e.*"))


def _summed(events: DataFrame) -> DataFrame:
    sums = events.groupBy("group_id", "x", "y").agg(*[F.sum(c).cast("int").alias(c) for c in ("dr", "dl")], F.max("floor").alias("floor"))
    return sums.where("dr <> dl").select("group_id", "x", "y", "dr", "dl", "floor")


def near(corners: DataFrame, least: int = 0) -> DataFrame:
    """Out of corners, three kinds of rows. With contours (and ids, of their least verticals): shapes that are whole, without rings whose doubled area is
    under least. With points: other rings that a range of corners holds whole; owner: the outer ring of the shape, null where the range doesn't tell. With
    neither: the verticals of all other rings.

    A vertical is (id, group_id, x, y0, y1, top, r0, t0, r1, t1, floor); ids ascend with (group_id, x, y0). top: the left side is inside. r0 and r1:
    whether the horizontal at the lower and at the upper end leads to the right; t0 and t1: whether two corners touch there, which then are told apart by
    turning left, where by turning right each would take the other's horizontal."""
    piece, parts = PIECE, max(int(corners.sparkSession.conf.get("spark.sql.shuffle.partitions")), corners.count() // ROWS)

    def run(batches):
        first, open_, touched = TaskContext.get().partitionId() << 33, None, np.zeros(0, np.int64)
        for c in _verticals(batches, piece):
            n = len(c["x"])
            c["id"], first = np.arange(first, first + n), first + n
            c = c if open_ is None else {k: np.concatenate([open_[k], v]) for k, v in c.items()}
            done, open_, touched = _closed(c, touched, least, piece)
            yield from done
        if open_ is not None:
            yield from _closed(open_, touched, least, 0)[0]

    laid = corners.select("group_id", "x", "y", "dr", "dl", "floor").repartitionByRange(parts, "group_id", "x").sortWithinPartitions("group_id", "x", "y")
    return laid.mapInArrow(run, f"{_PART}, hole boolean, points array<struct<x:int,y:int>>, owner long, ids array<long>, contours array<array<struct<x:int,y:int>>>")


def _arrays(batches: list, fill: dict) -> dict:
    t = pa.Table.from_batches(batches)
    return {c: (t.column(c).cast(pa.int64()).fill_null(fill[c]) if c in fill else t.column(c)).to_numpy() for c in t.column_names}


def _verticals(batches, piece: int):
    """Verticals in the order of their corners, a piece after the other."""
    held, rows, rest, net = [], 0, None, 0
    for b in batches:
        held, rows = [*held, b], rows + b.num_rows
        if rows >= 2 * piece:
            done, rest, net = _on_lines(held, rest, net, False)
            held, rows = [], 0
            if done is not None:
                yield done
    done = _on_lines(held, rest, net, True)[0]
    if done is not None:
        yield done


def _on_lines(held: list, rest: dict | None, net: int, last: bool) -> tuple[dict | None, dict | None, int]:
    """Verticals between neighbouring corners; the corners that are kept for the next call; and by how much the sides differ below these."""
    c = _arrays(held, {"floor": _NONE}) if held else None
    if rest is not None:
        c = rest if c is None else {k: np.concatenate([rest[k], c[k]]) for k in c}
    if c is None or not len(c["x"]):
        return None, c, net
    g, x, y = c["group_id"], c["x"], c["y"]
    at = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    dr, dl = (np.add.reduceat(c[k].astype(np.int64), at) for k in ("dr", "dl"))
    floor = np.maximum.reduceat(c["floor"], at)
    turns = dr != dl
    if not last:
        turns[-1] = False  # more of it may follow
    at, dr, dl, floor = at[turns], dr[turns], dl[turns], floor[turns]
    if len(at) < 2:
        return None, c, net
    step = dr - dl
    upto = net + np.cumsum(step)
    up = np.flatnonzero(upto[:-1] != 0)
    beyond = up + 1
    top, low, high = upto[up] < 0, upto[up] != step[up], upto[up] + step[beyond] != 0
    keep = {k: v[at[-1] :] for k, v in c.items()}
    out = {"group_id": g[at[up]], "x": x[at[up]], "y0": y[at[up]], "y1": y[at[beyond]], "top": top, "t0": low, "t1": high}
    out["r0"], out["r1"] = np.where(low, ~top, dr[up] != 0), np.where(high, ~top, dr[beyond] != 0)
    out["floor"] = np.where(dr[up] < 0, floor[up], _NONE)
    return out, keep, int(upto[-2])


def _next_of(c: dict, order: np.ndarray) -> np.ndarray:
    """Per vertical the one that follows it, -1 where the piece doesn't hold it. order: ends (twice the vertical, and one more if upper) along lines. The
    next end after one that leads to the right is its partner: lines of x between the two are whole."""
    a, b = order[:-1], order[1:]
    pair = c["right"][a] & ~c["right"][b] & (c["g"][a] == c["g"][b]) & (c["y"][a] == c["y"][b])
    a, b = a[pair], b[pair]
    ahead = (a & 1) == c["top"][a >> 1]  # the vertical of a arrives there
    follows = np.full(len(c["top"]), -1)
    follows[np.where(ahead, a, b) >> 1] = np.where(ahead, b, a) >> 1
    return follows


def _rings_in(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vertical: the least one of its cycle, -1 on open paths; and how many steps ahead that is."""
    n = len(follows)
    jump = np.append(np.where(follows < 0, n, follows), n)
    for _ in range(n.bit_length() + 1):
        jump = jump[jump]
    shut = np.flatnonzero(jump[:n] < n)
    place = np.full(n, -1)
    place[shut] = np.arange(len(shut))
    after = place[follows[shut]]
    least, jump = np.arange(len(shut)), after
    while not np.array_equal(least, least[after]):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    first = least == np.arange(len(shut))
    steps, jump = np.where(first, 0, 1), np.where(first, least, after)
    while not np.array_equal(jump, least):
        steps, jump = steps + steps[jump], jump[jump]
    ring, ahead = np.full(n, -1), np.zeros(n, np.int64)
    ring[shut], ahead[shut] = shut[least], steps
    return ring, ahead


def _closed(c: dict, touched: np.ndarray, least: int, room: int) -> tuple[list, dict | None, np.ndarray]:
    """What is settled of these verticals, in batches; those that later ones may add to, up to room; and the ids of those with touching corners."""
    n, both = len(c["id"]), lambda a, b: np.stack([c[a], c[b]], 1).ravel()
    ends = {"g": np.repeat(c["group_id"], 2), "x": np.repeat(c["x"], 2), "y": both("y0", "y1"), "right": both("r0", "r1"), "top": c["top"]}
    follows = _next_of(ends, np.lexsort((ends["right"], ends["x"], ends["y"], ends["g"])))
    ring, ahead = _rings_in(follows)
    hit = np.bincount(ring[ring >= 0], (c["t0"] | c["t1"])[ring >= 0], n) > 0
    hit = (ring >= 0) & hit[ring]
    ring[hit] = -2
    touched = np.union1d(touched, c["id"][hit])

    # holes: the last end at or before their smallest point on the line of the floor there; it leads to the right, or this range lacks its line.
    # owner: -1 of an open ring, -2 if this range will not tell
    heads = np.flatnonzero(ring == np.arange(n))
    floor = c["floor"]
    based = heads[c["top"][heads] & (floor[heads] != _NONE)]
    kind = np.concatenate([ends["right"].astype(np.int8), np.full(len(based), 2, np.int8)])
    g, y, x = (np.concatenate(p) for p in ((ends["g"], c["group_id"][based]), (ends["y"], floor[based]), (ends["x"], c["x"][based])))
    order = np.lexsort((kind, x, y, g))
    before = np.maximum.accumulate(np.where(kind[order] < 2, np.arange(len(order)), 0))
    at = np.flatnonzero(kind[order] == 2)
    below, hole = order[before[at]], based[order[at] - 2 * n]
    good = (kind[below] == 1) & (g[below] == c["group_id"][hole]) & (y[below] == floor[hole])
    below, hole = below[good] >> 1, hole[good]
    owner = np.full(n, -2)
    owner[heads] = np.where(c["top"][heads], -2, heads)
    owner[hole] = ring[below]
    while len(far := np.flatnonzero((owner >= 0) & (owner[np.maximum(owner, 0)] != owner))):
        owner[far] = owner[owner[far]]

    later = (ring == -1) | ((ring >= 0) & (owner[np.maximum(ring, 0)] == -1))
    if later.sum() > room:
        later[:] = False
    wait = {k: v[later] for k, v in c.items()}
    loose = np.flatnonzero((ring < 0) & ~later)
    heads = heads[~later[heads]]

    # a shape is whole if no ring of its range of verticals touches another: holes lie between the first and the last vertical of their outer ring
    inner = np.flatnonzero((ring >= 0) & ~later)
    last = np.zeros(n, np.int64)
    last[ring[inner]] = inner  # the greatest, as they ascend
    outer = heads[~c["top"][heads]]
    whole = np.zeros(n, bool)
    whole[outer] = np.searchsorted(touched, c["id"][outer]) == np.searchsorted(touched, c["id"][last[outer]])
    shown = np.ones(n, bool)
    if least:
        width = (c["x"][inner] - c["x"][ring[inner]].astype(np.int64)) * np.where(c["top"][inner], 2, -2)
        tall = c["y1"][inner].astype(np.int64) - c["y0"][inner]
        about = np.abs(np.bincount(ring[inner], width.astype(float) * tall, n))
        total = np.zeros(n, np.int64)
        with np.errstate(over="ignore"):
            np.add.at(total, ring[inner], width * tall)
        wide = heads[about[heads] >= 2.0**60]
        whole[owner[wide][owner[wide] >= 0]] = False  # left to 64 bits with an error
        shown = np.abs(total) >= least
    in_whole = (owner[heads] >= 0) & whole[np.maximum(owner[heads], 0)]
    single, bound = heads[~in_whole], heads[in_whole]
    bound = bound[shown[bound] & shown[owner[bound]]]
    bound = bound[np.lexsort((bound, c["top"][bound], owner[bound]))]

    # points: two to a vertical, rings one after the other
    drawn = np.concatenate([bound, single])
    size = np.bincount(ring[inner], minlength=n)
    stops = np.cumsum(2 * size[drawn])
    begins = np.zeros(n, np.int64)
    begins[drawn] = stops - 2 * size[drawn]
    out = np.zeros(n, bool)
    out[drawn] = True
    inner = inner[out[ring[inner]]]
    head = ring[inner]
    up = c["top"][inner]
    turn = np.where(c["top"][head], 0, 2 * size[head] - 1)  # an outer ring's least vertical runs down to the smallest point: it is moved on by one
    spot = 2 * np.where(ahead[inner] > 0, size[head] - ahead[inner], 0) + turn
    px, py = (np.zeros(stops[-1] if len(stops) else 0, np.int32) for _ in range(2))
    for k, ys in ((0, np.where(up, c["y0"][inner], c["y1"][inner])), (1, np.where(up, c["y1"][inner], c["y0"][inner]))):
        to = begins[head] + (spot + k) % (2 * size[head])
        px[to], py[to] = c["x"][inner], ys
    values = pa.StructArray.from_arrays([pa.array(px), pa.array(py)], fields=list(_POINT))
    points = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), values)
    firsts = np.flatnonzero(~c["top"][bound])
    shapes, edges = bound[firsts], pa.array(np.append(firsts, len(bound)), pa.int32())
    lists = {"ids": pa.ListArray.from_arrays(edges, pa.array(c["id"][bound])), "contours": pa.ListArray.from_arrays(edges, points.slice(0, len(bound)))}
    has = owner[single] >= 0
    rings = {"hole": c["top"][single], "points": points.slice(len(bound)), "owner": pa.array(c["id"][np.maximum(owner[single], 0)], mask=~has)}
    done = [_batch(c, shapes, (), lists), _batch(c, single, ("x", "floor"), rings), _batch(c, loose, ("x", "floor", *_LOOSE), {})]
    touched = touched[touched > wait["id"][0]] if later.any() else touched[:0]
    return [b for b in done if b.num_rows], wait if later.any() else None, touched


def _batch(c: dict, rows: np.ndarray, own: tuple, more: dict) -> pa.RecordBatch:
    col = {k: c[k][rows] for k in ("id", "group_id", *own)}
    if "floor" in col:
        none = col["floor"] == _NONE
        col["floor"] = pa.array(np.where(none, 0, col["floor"]), pa.int32(), mask=none)
    col.update(more)
    return pa.RecordBatch.from_arrays([pa.nulls(len(rows), t) if k not in col else pa.array(col[k], t) if isinstance(col[k], np.ndarray) else col[k].cast(t) for k, t in _SCHEMA.items()], names=list(_SCHEMA))


def ends_of(loose: DataFrame) -> DataFrame:
    """(id, group_id, x, y, arrives, left, right, touch): both ends of verticals; left and right: whether the horizontal leads to the right, by the
    way that touching corners are told apart."""
    end = lambda y, r, t, arrives: F.struct(F.col(y).alias("y"), arrives.alias("arrives"), F.col(r).alias("left"), (F.col(r) != F.col(t)).alias("right"), F.col(t).alias("touch"))
    two = F.array(end("y0", "r0", "t0", ~F.col("top")), end("y1", "r1", "t1", F.col("top")))
    return loose.select("id", "group_id", "x", F.explode(two).alias("e")).select("id", "group_id", "x", "e.*")


def linked(ends: DataFrame, way: str) -> DataFrame:
    """(id, next): the vertical that follows each; a window along each line."""
    line = Window.partitionBy("group_id", "y").orderBy("x", way)
    pairs = ends.select("id", "arrives", F.col(way).alias("leads"), F.lead("id").over(line).alias("other")).where("leads")
    return pairs.select(F.when(F.col("arrives"), F.col("id")).otherwise(F.col("other")).alias("id"), F.when(F.col("arrives"), F.col("other")).otherwise(F.col("id")).alias("next"))
