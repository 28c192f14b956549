"""Closed rings out of boundary links, and holes given to their shapes: joins, windows and pointer doubling, no group in one task.

1. Pieces of links in a row become edges; an edge runs with the result on its left. Edges are numbered in ascending order of their ends.
2. Successor map: at every node each edge that arrives is given one that leaves. Where two corners of the result touch there are two of each,
   and two ways to pair them: turning left keeps the two filled quadrants apart, turning right the two empty ones.
3. Cycles of the map that turns left are ranked by pointer doubling. A cycle is a hole if the result is above or left of its least edge.
   Cycles that meet at touching corners form clusters; in a cluster that has a hole, all touching corners turn right instead, so
   that holes come apart at them and an island that touches the wall becomes part of it. Only its cycles are ranked again.
4. A hole belongs to the owner of the nearest edge below its smallest point that has the result above: an as-of window per strip. If a
   hole owns that edge, it belongs to the same shape as that hole: pointer jumping.

Intermediate tables are written to the shared folder while a call builds its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import following, ring_area2, rotated_to_smallest
from ..functions.rules import included, top_inside
from ..model import ContourDirection, Options, OverlayRule
from ..tables import forget, saved
from . import corners
from .graph import components, cycles, numbered, ordered_ids

_POINTS = "array<struct<x:int,y:int>>"


def pieces(masked: DataFrame, rule: OverlayRule, options: Options = Options()) -> DataFrame:
    """(group_id, orient, pos, lo, hi, top, start): links of a rule; start is where the straight run of links begins that a link is part of.

    A run goes on through points where only links of its own direction meet. With preserve_output_collinear it ends wherever a
    vertical of the graph ends, be that in the result or not.
    """
    marked = masked.withColumn("inc", included(F.col("fill"), rule)).withColumn("top", top_inside(F.col("fill"), rule))
    if not options.preserve_output_collinear:
        marked = marked.where("inc")
    point = lambda x, y, first: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(first).alias("first"))
    ends = marked.select("*", F.explode(F.array(point("ax", "ay", True), point("bx", "by", False))).alias("end")).select(*marked.columns, "end.*")
    node = Window.partitionBy("group_id", "x", "y")
    meets = lambda o, only: F.max((F.col("orient") == o) & only).over(node)
    corner = meets("H", F.col("inc")) & meets("V", F.col("inc"))
    if options.preserve_output_collinear:
        corner = corner | meets("V", F.lit(True))
    level = F.col("orient") == "H"
    along = ends.select("*", corner.alias("corner")).where("first and inc").select(
        "group_id", "orient", F.when(level, F.col("ay")).otherwise(F.col("ax")).alias("pos"), F.when(level, F.col("ax")).otherwise(F.col("ay")).alias("lo"),
        F.when(level, F.col("bx")).otherwise(F.col("by")).alias("hi"), "top", "corner",
    )
    line = Window.partitionBy("group_id", "orient", "pos").orderBy("lo")
    goes_on = (F.lag("hi").over(line) == F.col("lo")) & (F.lag("top").over(line) == F.col("top")) & ~F.col("corner")
    begun = along.withColumn("begin", F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.col("lo")))
    return begun.withColumn("start", F.last("begin", ignorenulls=True).over(line)).drop("begin", "corner")


def edges_of(piece_table: DataFrame) -> DataFrame:
    """(id, group_id, orient, ax, ay, bx, by, top): runs of pieces, a before b; ids ascend with (group_id, a, b)."""
    runs = piece_table.groupBy("group_id", "orient", "pos", "start").agg(F.max("hi").alias("hi"), F.first("top").alias("top"))
    level = F.col("orient") == "H"
    pick = lambda h, v, name: F.when(level, F.col(h)).otherwise(F.col(v)).alias(name)
    ends = runs.select("group_id", "orient", pick("start", "pos", "ax"), pick("pos", "start", "ay"), pick("hi", "pos", "bx"), pick("pos", "hi", "by"), "top")
    return ordered_ids(ends, ["group_id", "ax", "ay", "bx", "by"], "ring-edges")


def heading() -> Column:
    """0, 1, 2, 3: to the right, up, to the left, down. To the right the left side is above; upwards it is the smaller x, a vertical's top."""
    return F.when(F.col("orient") == "H", F.when(F.col("top"), 0).otherwise(2)).otherwise(F.when(F.col("top"), 1).otherwise(3))


def successors(edge_table: DataFrame) -> DataFrame:
    """(id, left, right, other): the edge that follows each edge. `left` is the only one that leaves the node where id arrives or, where two corners
    touch, the one on the left; there `right` is the one on the right, and `other` the second edge that arrives. Each of left
    and right is a permutation of the ids."""
    end = lambda leaves, x, y: F.struct(F.lit(leaves).alias("leaves"), F.col(x).alias("x"), F.col(y).alias("y"))
    forward, backward = (F.array(end(first, "ax", "ay"), end(not first, "bx", "by")) for first in (True, False))
    ends = edge_table.select("group_id", "id", heading().alias("heading"), F.explode(F.when(F.col("top"), forward).otherwise(backward)).alias("e")).select("group_id", "id", "heading", "e.*")
    at = lambda leaves: F.collect_list(F.when(F.col("leaves") == leaves, F.struct("id", "heading")))
    nodes = ends.groupBy("group_id", "x", "y").agg(at(False).alias("ins"), at(True).alias("outs"))  # two of each at most
    ways = nodes.select("ins", "outs", F.explode("ins").alias("way"))
    turned = lambda by: F.element_at(F.filter("outs", lambda o: o["heading"] == (F.col("way.heading") + by) % 4), 1)["id"]
    touch = F.size("outs") > 1
    return ways.select(
        F.col("way.id").alias("id"), F.when(touch, turned(1)).otherwise(F.col("outs")[0]["id"]).alias("left"), F.when(touch, turned(3)).alias("right"),
        F.when(touch, F.element_at(F.filter("ins", lambda i: i["id"] != F.col("way.id")), 1)["id"]).alias("other"),
    )


def ranked_rings(edge_table: DataFrame) -> DataFrame:
    """(id, ring, ahead): every edge's ring, by the ring's least edge, and how many steps ahead that edge is."""
    after = saved(successors(edge_table), "ring-successors")
    left = saved(cycles(after.select("id", F.col("left").alias("next")), "ring-left"), "ring-cycles")
    touching = after.where("right is not null")
    if not touching.take(1):
        return left
    own = left.select("id", F.col("ring").alias("ra"))
    met = touching.select("id", "other").join(own, "id").join(left.select(F.col("id").alias("other"), F.col("ring").alias("rb")), "other")
    met = saved(met.select("id", "ra", "rb"), "ring-touches")
    roots = components(met.where("ra <> rb").select(F.col("ra").alias("u"), F.col("rb").alias("v")), "ring-clusters")
    kind = edge_table.select(F.col("id").alias("ra"), F.col("top").alias("hole"))
    members = met.select("ra").distinct().join(roots, F.col("ra") == F.col("node"), "left").select("ra", F.coalesce("root", "ra").alias("root")).join(kind, "ra")
    holed = members.groupBy("root").agg(F.max("hole").alias("hole")).where("hole").select("root")
    changed = saved(members.join(holed, "root").select("ra"), "ring-changed")
    if not changed.take(1):
        return left
    apart = left.join(changed.select(F.col("ra").alias("ring")), "ring", "left_semi").select("id").join(after, "id")
    again = cycles(apart.select("id", F.coalesce("right", "left").alias("next")), "ring-right")
    return left.join(changed.select(F.col("ra").alias("ring")), "ring", "left_anti").select("id", "ring", "ahead").unionByName(again)


def owners(piece_table: DataFrame, edge_table: DataFrame, ranks: DataFrame) -> DataFrame:
    """(hole, owner): every hole's outer ring."""
    heads = edge_table.join(ranks.where("ahead = 0").select("id"), "id").select("id", "group_id", "ax", "ay", "top")
    anchors = heads.where("top").select("group_id", F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(0).alias("kind"), F.col("id").alias("hole"), F.lit(None).cast("int").alias("start"))
    floors = piece_table.where("orient = 'H' and top").select("group_id", F.col("lo").alias("x"), F.col("pos").alias("y"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("hole"), "start")
    # every link across the x of a hole's smallest point is cut there; one as high as the point comes after it
    below = Window.partitionBy("group_id", "x").orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.last(F.when(F.col("kind") == 1, F.struct("y", "start")), ignorenulls=True).over(below)
    found = anchors.unionByName(floors).withColumn("floor", floor).where("kind = 0").select("group_id", "hole", "x", "y", "floor")
    found = saved(found, "ring-floors")
    lost = found.where("floor is null").first()
    if lost is not None:
        raise ValueError(f"no shape below the hole at {(lost['x'], lost['y'])}")
    found = found.select("group_id", "hole", F.col("floor.y").alias("ay"), F.col("floor.start").alias("ax"))
    edge = edge_table.where("orient = 'H'").select("group_id", "ax", "ay", "id")
    ups = found.join(edge, ["group_id", "ax", "ay"]).select("hole", "id").join(ranks.select("id", "ring"), "id")
    ups = ups.join(heads.select(F.col("id").alias("ring"), F.col("top").alias("open")), "ring").select("hole", F.col("ring").alias("owner"), "open")
    ups, turn = saved(ups, "ring-owners"), 0
    while ups.where("open").take(1):
        over = ups.select(F.col("hole").alias("owner"), F.col("owner").alias("next"), F.col("open").alias("still"))
        far = ups.where("open").join(over, "owner").select("hole", F.col("next").alias("owner"), F.col("still").alias("open"))
        ups, turn = saved(ups.where("not open").unionByName(far), f"ring-owners-{turn}"), turn + 1
    return ups.select("hole", "owner")


def _rings(edge_table: DataFrame, ranks: DataFrame, options: Options) -> DataFrame:
    """(id, group_id, hole, points) of the rings that are shown, each begun at its smallest point; id is that of its least edge."""
    x, y = F.when(F.col("top"), F.col("ax")).otherwise(F.col("bx")), F.when(F.col("top"), F.col("ay")).otherwise(F.col("by"))
    steps = edge_table.join(ranks, "id").select("ring", "group_id", F.struct(F.when(F.col("ahead") > 0, -F.col("ahead")).otherwise(F.lit(-(1 << 62))).alias("k"), x.alias("x"), y.alias("y")).alias("p"), F.when(F.col("ahead") == 0, F.col("top")).alias("hole"))
    whole = steps.groupBy("ring", "group_id").agg(F.max("hole").alias("hole"), F.sort_array(F.collect_list("p")).alias("p"))
    points = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).cast(_POINTS)
    if ContourDirection(options.output_direction) is ContourDirection.CLOCKWISE:
        points = F.reverse(points)
    out = whole.select(F.col("ring").alias("id"), "group_id", "hole", F.explode(F.array(points)).alias("points"))
    out = out.select("id", "group_id", "hole", rotated_to_smallest(F.col("points")).alias("points"))
    if options.min_output_area:
        out = out.where(F.abs(ring_area2(F.col("points"))) >= 2 * options.min_output_area)
    return out


def traced_links(masked: DataFrame, rule: OverlayRule, options: Options = Options()) -> DataFrame:
    """(id, group_id, hole, points, owner): the rings that are shown, with the outer ring of their shape, out of pieces of links."""
    piece_table = saved(pieces(masked, rule, options), "ring-pieces")
    edge_table = edges_of(piece_table)
    ranks = saved(ranked_rings(edge_table), "ring-ranks")
    each = saved(_rings(edge_table, ranks, options), "rings")
    parents = owners(piece_table, edge_table, ranks).select(F.col("hole").alias("id"), "owner")
    outer = each.where("not hole").withColumn("owner", F.col("id"))
    return outer.unionByName(each.where("hole").join(parents, "id").select(*outer.columns))


def traced(corner_table: DataFrame, options: Options = Options(), bind: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Out of corners (id, group_id, ids, contours), the shapes that are found whole nearby, and (id, group_id, hole, points, owner), the rings of the
    others, if any: by links along lines and pointer doubling. Unless bind, owners of the latter's holes may be null."""
    laid = saved(corner_table, "ring-corners")
    parts = saved(corners.near(laid, 2 * options.min_output_area), "ring-parts")
    forget(laid)
    turned = lambda p: p
    if ContourDirection(options.output_direction) is ContourDirection.CLOCKWISE:
        turned = lambda p: F.concat(F.slice(F.reverse(p), -1, 1), F.slice(F.reverse(p), F.lit(1), F.size(p) - 1))  # noqa: E731  begun at the smallest again
    whole = parts.where("x is null").select("id", "group_id", "ids", "contours")
    if ContourDirection(options.output_direction) is ContourDirection.CLOCKWISE:
        whole = whole.withColumn("contours", F.transform("contours", turned))
    if not parts.where("x is not null").take(1):
        return whole, None
    each = parts.where("hole is not null").select("id", "group_id", "hole", "points", "owner", "x", "floor")
    loose = parts.where("y0 is not null").select("id", "group_id", "x", "y0", "y1", "top", "r0", "t0", "r1", "t1", "floor")
    if loose.take(1):
        each = each.unionByName(saved(_linked_rings(loose), "ring-rest"))
    lost = each.where("owner is null").select("id", "group_id", "x", "floor")
    if bind and lost.take(1):
        found = saved(_owners(each, lost), "ring-owners-all")
        each = each.join(found.withColumnRenamed("owner", "_owner"), "id", "left").withColumn("owner", F.coalesce("owner", "_owner"))
    out = each.select("id", "group_id", "hole", F.explode(F.array(turned(F.col("points")))).alias("points"), "owner")
    if options.min_output_area:
        out = out.where(F.abs(ring_area2(F.col("points"))) >= 2 * options.min_output_area)
    return whole, out


def _linked_rings(loose: DataFrame) -> DataFrame:
    """(id, group_id, hole, points, owner, x, floor): rings of verticals that no piece holds whole, or with touching corners; owner is that of outer rings."""
    ends = saved(corners.ends_of(loose), "ring-ends")
    left = saved(cycles(corners.linked(ends, "left"), "ring-left"), "ring-cycles")
    ranks = left
    touching = ends.where("touch").groupBy("group_id", "x", "y").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    own = lambda k, r: left.select(F.col("id").alias(k), F.col("ring").alias(r))
    met = saved(touching.join(own("a", "ra"), "a").join(own("b", "rb"), "b").select("ra", "rb"), "ring-touches")
    if met.take(1):
        roots = components(met.where("ra <> rb").select(F.col("ra").alias("u"), F.col("rb").alias("v")), "ring-clusters")
        both = met.select(F.explode(F.array("ra", "rb")).alias("ra")).distinct()
        members = both.join(roots, F.col("ra") == F.col("node"), "left").select("ra", F.coalesce("root", "ra").alias("root"))
        members = members.join(loose.select(F.col("id").alias("ra"), F.col("top").alias("hole")), "ra")
        holed = members.groupBy("root").agg(F.max("hole").alias("hole")).where("hole").select("root")
        changed = saved(members.join(holed, "root").select(F.col("ra").alias("ring")), "ring-changed")
        if changed.take(1):
            apart = left.join(changed, "ring", "left_semi").select("id")
            again = cycles(corners.linked(ends, "right").join(apart, "id", "left_semi"), "ring-right")
            ranks = left.join(changed, "ring", "left_anti").select("id", "ring", "ahead").unionByName(again)
    point = lambda y: F.struct("x", F.col(y).alias("y"))
    way = F.when(F.col("top"), F.array(point("y0"), point("y1"))).otherwise(F.array(point("y1"), point("y0")))
    first = F.col("ahead") == 0
    steps = loose.join(ranks, "id").select("ring", "group_id", F.struct(F.when(first, F.lit(-(1 << 62))).otherwise(-F.col("ahead")).alias("k"), way.alias("way")).alias("p"), *[F.when(first, F.col(c)).alias(c) for c in ("top", "x", "floor")])
    whole = steps.groupBy("ring", "group_id").agg(F.sort_array(F.collect_list("p")).alias("p"), *[F.max(c).alias(c) for c in ("top", "x", "floor")])
    out = whole.select(F.col("ring").alias("id"), "group_id", F.col("top").alias("hole"), F.explode(F.array(F.flatten(F.col("p.way")).cast(_POINTS))).alias("points"), F.when(~F.col("top"), F.col("ring")).alias("owner"), "x", "floor")
    return out.withColumn("points", rotated_to_smallest(F.col("points")))


def _owners(each: DataFrame, lost: DataFrame) -> DataFrame:
    """(id, owner): the outer rings of the shapes of lost holes: the last edge with the result above that begins on the floor's line up to the hole's smallest point."""
    nowhere = lost.where("floor is null").first()
    if nowhere is not None:
        raise ValueError(f"no shape below the hole at x = {nowhere['x']} of group {nowhere['group_id']}")
    lost = saved(lost.select("group_id", F.col("floor").alias("y"), "x", "id"), "ring-lost")
    around = F.explode(F.arrays_zip(F.col("points").alias("p"), following(F.col("points")).alias("q")))
    tops = each.select("id", "hole", "owner", "group_id", around.alias("e")).where("e.p.y = e.q.y and e.p.x < e.q.x")
    tops = tops.select("group_id", F.col("e.p.y").alias("y"), F.col("e.p.x").alias("x"), F.struct("id", "owner").alias("floor")).join(lost.select("group_id", "y").distinct(), ["group_id", "y"], "left_semi")
    nothing = F.lit(None).cast("struct<id:long,owner:long>")
    line = Window.partitionBy("group_id", "y").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = tops.select("*", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("hole")).unionByName(lost.select("group_id", "y", "x", nothing.alias("floor"), F.lit(1).alias("kind"), F.col("id").alias("hole")))
    found = rows.withColumn("floor", F.last("floor", ignorenulls=True).over(line)).where("kind = 1")
    ups = saved(found.select("hole", F.coalesce("floor.owner", "floor.id").alias("owner"), F.col("floor.owner").isNull().alias("open")), "ring-owners")
    turn = 0
    while ups.where("open").take(1):
        over = ups.select(F.col("hole").alias("owner"), F.col("owner").alias("next"), F.col("open").alias("still"))
        far = ups.where("open").join(over, "owner").select("hole", F.col("next").alias("owner"), F.col("still").alias("open"))
        ups, turn = saved(ups.where("not open").unionByName(far), f"ring-owners-{turn}"), turn + 1
    return ups.select(F.col("hole").alias("id"), "owner")


def _bound(shown: DataFrame) -> DataFrame:
    """shown without the holes of outer rings that aren't shown."""
    outer = shown.where("not hole")
    return outer.unionByName(shown.where("hole").join(outer.select(F.col("id").alias("owner")), "owner", "left_semi").select(*outer.columns))


def shapes(masked: DataFrame, rule: OverlayRule, options: Options = Options()) -> DataFrame:
    """(group_id, shape_id, contours) out of boundary links, as shapes_of."""
    if options.preserve_output_collinear:
        return shapes_of(None, traced_links(masked, rule, options), options)
    return shapes_of(*traced(corners.of_links(masked, rule), options), options)


def shapes_of(whole: DataFrame | None, rings: DataFrame | None, options: Options = Options()) -> DataFrame:
    """(group_id, shape_id, contours): contour 0 is the outer ring, the rest are its holes; each begun at its smallest point. Shapes
    count from 0 within a group, in ascending order of the least edge of their outer ring, as the holes of a shape. Out of whole shapes and rings of others."""
    each = None if whole is None else whole.select("id", "group_id", "contours")
    if rings is not None:
        shown = _bound(saved(rings, "rings")) if options.min_output_area else rings
        contour = F.sort_array(F.collect_list(F.struct("hole", "id", "points")))
        bound = shown.groupBy("owner", "group_id").agg(contour.alias("c")).select(F.col("owner").alias("id"), "group_id", F.col("c.points").alias("contours"))
        bound = saved(bound, "ring-shapes")
        each = bound if each is None else each.unionByName(bound)
    return numbered(each, "group_id", "shape_id").select("group_id", F.col("shape_id").cast("int").alias("shape_id"), "contours")


def flat_contours(masked: DataFrame, rule: OverlayRule, options: Options = Options()) -> DataFrame:
    """(group_id, contour_id, is_hole, points) out of boundary links, as flat_contours_of."""
    if options.preserve_output_collinear:
        return flat_contours_of(None, traced_links(masked, rule, options), options)
    return flat_contours_of(*traced(corners.of_links(masked, rule), options, bool(options.min_output_area)), options)


def flat_contours_of(whole: DataFrame | None, rings: DataFrame | None, options: Options = Options()) -> DataFrame:
    """(group_id, contour_id, is_hole, points): rings alone. Outer rings count from 0 within a group, in ascending order of their least edge;
    holes follow them."""
    shown = None
    if rings is not None:
        shown = saved(_bound(saved(rings, "rings")) if options.min_output_area else rings, "rings")  # the holes of dropped outer rings go with them
        shown = shown.select("id", "group_id", "hole", "points")
    if whole is not None:
        apart = whole.select("group_id", F.posexplode(F.arrays_zip("ids", "contours")).alias("k", "c"))
        apart = apart.select(F.col("c.ids").alias("id"), "group_id", (F.col("k") > 0).alias("hole"), F.col("c.contours").alias("points"))
        shown = apart if shown is None else shown.unionByName(apart)
    each = [numbered(shown.where(F.col("hole") == h).select("id", "group_id", "points"), "group_id", "k").withColumn("is_hole", F.lit(h)) for h in (False, True)]
    outers = shown.where("not hole").groupBy("group_id").agg(F.count(F.lit(1)).alias("outers"))
    holes = each[1].join(outers, "group_id").withColumn("k", F.col("k") + F.col("outers")).drop("outers")
    return each[0].unionByName(holes.select(*each[0].columns)).select("group_id", F.col("k").cast("int").alias("contour_id"), "is_hole", "points")
