"""Named queries over the lineitem-derived rectangles and the generated workloads, and their SQL oracles.

The oracles count unit cells, and label connected runs of them, so they share nothing with the strip sweep and the tracing of rings but
the input rectangles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cross, drop_collinear, drop_opposite_collinear, following, invert_orientation, preceding, ring_area2
from ..model import ContourDirection, FillRule, Options, OverlayRule
from ..operators import boundary, edges, layout, rings, split
from ..operators.overlay import Overlay
from ..sources.contours import lineitem_contours, lineitem_rects
from ..sources.generators import table_checkerboard, table_lines_net, table_nested, table_not_overlap, table_windmill, table_windows

RECTS = """
rects AS (
  SELECT CAST(l_suppkey % 16 AS BIGINT) AS g, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS clip, CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END AS w,
         CAST(l_partkey % 509 AS INT) AS x0, CAST((l_orderkey*31 + l_linenumber*17) % 503 AS INT) AS y0,
         CAST(l_partkey % 509 + 1 + CAST(floor(l_quantity) AS BIGINT) % 13 AS INT) AS x1,
         CAST((l_orderkey*31 + l_linenumber*17) % 503 + 1 + CAST(floor(l_extendedprice) AS BIGINT) % 11 AS INT) AS y1
  FROM lineitem)"""
CELLS = RECTS + """,
columns_ AS (SELECT g, clip, w, y0, y1, unnest(range(x0, x1)) AS x FROM rects),
unit AS (SELECT g, clip, w, x, unnest(range(y0, y1)) AS y FROM columns_),
cells AS (SELECT g, x, y, CAST(sum(w * (1 - clip)) AS BIGINT) AS ws, CAST(sum(w * clip) AS BIGINT) AS wc FROM unit GROUP BY ALL)"""
SEGS = RECTS + """,
raw AS (
  SELECT g, 'H' AS o, y0 AS pos, x0 AS lo, x1 AS hi, w, clip FROM rects UNION ALL SELECT g, 'H', y1, x0, x1, -w, clip FROM rects
  UNION ALL SELECT g, 'V', x1, y0, y1, w, clip FROM rects UNION ALL SELECT g, 'V', x0, y0, y1, -w, clip FROM rects),
segs AS (
  SELECT g, o, pos, lo, hi, CAST(sum(w * (1 - clip)) AS BIGINT) AS subj, CAST(sum(w * clip) AS BIGINT) AS clip
  FROM raw GROUP BY g, o, pos, lo, hi HAVING sum(w * (1 - clip)) <> 0 OR sum(w * clip) <> 0)"""
COLUMNS = SEGS + """,
xs AS (SELECT g, x, sum(n) AS n FROM (SELECT g, pos AS x, 1 AS n FROM segs WHERE o = 'V' UNION ALL SELECT g, unnest([lo, hi]), 0 FROM segs WHERE o = 'H') GROUP BY g, x),
before AS (SELECT g, x, n, coalesce(sum(n) OVER (PARTITION BY g ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER (PARTITION BY g) AS t FROM xs),
dealt AS (SELECT g, x, n, CAST(least(b, t - 1) AS BIGINT) // CAST(greatest(64, ceil(4 * sqrt(CAST(t AS DOUBLE)))) AS BIGINT) AS share FROM before),
shares AS (SELECT g, share, min(x) AS x0, CAST(sum(n) AS BIGINT) AS n FROM dealt GROUP BY g, share),
cols AS (SELECT g, row_number() OVER w - 1 AS c, x0, coalesce(lead(x0) OVER w, 2147483647) AS x1, n FROM shares WINDOW w AS (PARTITION BY g ORDER BY share))"""
FILL_SQL = {FillRule.EVEN_ODD: "{w} % 2 <> 0", FillRule.NON_ZERO: "{w} <> 0", FillRule.POSITIVE: "{w} > 0", FillRule.NEGATIVE: "{w} < 0"}
RULE_SQL = {
    OverlayRule.SUBJECT: "({s})", OverlayRule.CLIP: "({c})", OverlayRule.INTERSECT: "(({s}) AND ({c}))", OverlayRule.UNION: "(({s}) OR ({c}))",
    OverlayRule.DIFFERENCE: "(({s}) AND NOT ({c}))", OverlayRule.INVERSE_DIFFERENCE: "(({c}) AND NOT ({s}))", OverlayRule.XOR: "(({s}) <> ({c}))",
}


def _inside_sql(rule: OverlayRule, fill: FillRule, s: str = "ws", c: str = "wc") -> str:
    return RULE_SQL[rule].format(s=FILL_SQL[fill].format(w=s), c=FILL_SQL[fill].format(w=c))


def _overlay(spark: SparkSession, d: str, options: Options = Options()) -> Overlay:
    return Overlay(lineitem_contours(spark, d), options)


def ring_edges(spark: SparkSession, d: str) -> DataFrame:
    e = edges.edges(lineitem_contours(spark, d), simplify=False)
    return e.groupBy("group_id", "shape_type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("p.x").cast("long") * 3 + F.col("q.y")).alias("checksum"))


def drop_collinear_points(spark: SparkSession, d: str) -> DataFrame:
    """Points left of rings with points along their lower side and a spike beyond their upper right corner, without all points at which they
    don't turn and without spikes alone; and the area of what is left."""
    p = lambda x, y: F.struct(F.expr(x).cast("int").alias("x"), F.expr(y).cast("int").alias("y"))
    xs = F.expr("sequence(x0, x1)")
    along = F.arrays_zip(xs.alias("x"), F.array_repeat("y0", F.col("x1") - F.col("x0") + 1).alias("y"))
    ring = F.concat(along, F.array(p("x1", "y1 + 2"), p("x1", "y1"), p("x0", "y1")))
    c = lineitem_rects(spark, d).select("group_id", F.explode(F.array(ring)).alias("points"))
    c = c.select("group_id", F.size("points").alias("before"), drop_collinear(F.col("points")).alias("kept"), F.size(drop_opposite_collinear(F.col("points"))).alias("no_spikes"))
    total = lambda x, name: F.sum(x).cast("long").alias(name)
    return c.groupBy("group_id").agg(total("before", "n_before"), total(F.size("kept"), "n_points"), total("no_spikes", "n_without_spikes"), total(F.abs(ring_area2(F.col("kept"))) / 2, "gross_area"))


def signed_segments(spark: SparkSession, d: str) -> DataFrame:
    s = edges.segments(lineitem_contours(spark, d))
    return s.groupBy("group_id", "orient").agg(F.count(F.lit(1)).alias("n"), F.sum("subj").alias("subj"), F.sum("clip").alias("clip"), F.sum((F.col("hi").cast("long") - F.col("lo")) * (F.col("subj") + 2 * F.col("clip")) * F.col("pos")).alias("moment"))


def orientation_counts(spark: SparkSession, d: str) -> DataFrame:
    s = edges.segments(lineitem_contours(spark, d))
    return s.groupBy("orient", invert_orientation(F.col("orient")).alias("across")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hi").cast("long") - F.col("lo")).alias("length"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return edges.merge(edges.segments(lineitem_contours(spark, d)))


def merge_segments(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


def bbox(spark: SparkSession, d: str) -> DataFrame:
    return edges.bounds(lineitem_contours(spark, d))


def bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    return split.bucketed(_merged(spark, d), Options().bucket_power).groupBy("group_id", "bucket", "orient").agg(F.count(F.lit(1)).alias("n"))


def column_layout(spark: SparkSession, d: str) -> DataFrame:
    """The columns that hold equally many verticals: where each begins, and how many it holds."""
    return layout.columns(_merged(spark, d), Options().min_count_per_column_power).select("group_id", "column_no", "x0", "n")


def column_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Pieces, their length and their windings per column of that layout."""
    at = layout.in_columns(_merged(spark, d), Options().min_count_per_column_power)
    length = F.col("hi").cast("long") - F.col("lo")
    return at.groupBy("group_id", "column_no", "orient").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length"), F.sum((F.col("subj") + 2 * F.col("clip")) * length * F.col("pos")).alias("moment"))


def hv_intersections(spark: SparkSession, d: str) -> DataFrame:
    at = split.meetings(_merged(spark, d), Options().bucket_power)
    return at.groupBy("group_id").agg(F.sum(F.col("v") * F.col("h")).alias("meetings"), F.sum(F.col("v_inside") * F.col("h_inside")).alias("crossings"))


def split_segments(spark: SparkSession, d: str) -> DataFrame:
    return split.split(_merged(spark, d), Options().bucket_power)


def winding_slabs(spark: SparkSession, d: str) -> DataFrame:
    """Cells by winding: the slabs' sizes summed per pair of winding numbers."""
    size = (F.col("x1").cast("long") - F.col("x0")) * (F.col("y1").cast("long") - F.col("y0"))
    return _overlay(spark, d).slabs.where("ws <> 0 or wc <> 0").groupBy("group_id", "ws", "wc").agg(F.sum(size).alias("cells"))


def area_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _overlay(spark, d).area_matrix()


def boundary_links(spark: SparkSession, d: str) -> DataFrame:
    m = _overlay(spark, d).masked_segments(FillRule.NON_ZERO)
    return m.groupBy("group_id", "orient", "fill").agg(F.sum(F.col("bx").cast("long") - F.col("ax") + F.col("by") - F.col("ay")).alias("length"))


STORED_RULES = (OverlayRule.INTERSECT, OverlayRule.UNION, OverlayRule.XOR)


def rules_of_stored(spark: SparkSession, d: str) -> DataFrame:
    """Area and boundary of several rules, each read from slabs that are swept and stored once."""
    overlay, out = _overlay(spark, d).stored(), None
    for rule in STORED_RULES:
        length = F.sum(F.col("bx").cast("long") - F.col("ax") + F.col("by") - F.col("ay")).alias("boundary")
        both = overlay.area(rule).join(overlay.links(rule).groupBy("group_id").agg(length), "group_id").select("group_id", F.lit(rule.value).alias("rule"), "area", "boundary")
        out = both if out is None else out.unionByName(both)
    return out


def perimeter(spark: SparkSession, d: str) -> DataFrame:
    links = _overlay(spark, d).links(OverlayRule.UNION)
    return links.groupBy("group_id").agg(F.sum(F.col("bx").cast("long") - F.col("ax") + F.col("by") - F.col("ay")).alias("perimeter"))


def node_degree(spark: SparkSession, d: str) -> DataFrame:
    n = boundary.nodes(_overlay(spark, d).links(OverlayRule.XOR)).where("h > 0 and v > 0")
    return n.groupBy("group_id", "degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def shape_rings(spark: SparkSession, d: str) -> DataFrame:
    """Net area of the traced shapes: outer rings less their holes."""
    s = _overlay(spark, d).shapes(OverlayRule.UNION)
    net = F.aggregate(F.transform("contours", lambda r: ring_area2(r)), F.lit(0).cast("long"), lambda a, b: a + b)
    return s.groupBy("group_id").agg((F.sum(net) / 2).cast("long").alias("area"))


def hole_binding(spark: SparkSession, d: str) -> DataFrame:
    s = _overlay(spark, d).shapes(OverlayRule.SUBJECT)
    return s.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_shapes"), F.sum(F.size("contours") - 1).alias("n_holes"))


def shape_table(spark: SparkSession, d: str) -> DataFrame:
    """Every shape: its number, the point it begins at, its holes, its net area."""
    s = _overlay(spark, d).shapes(OverlayRule.SUBJECT)
    net = F.aggregate(F.transform("contours", lambda r: ring_area2(r)), F.lit(0).cast("long"), lambda a, b: a + b)
    first = F.col("contours")[0][0]
    return s.select("group_id", F.col("shape_id").cast("long").alias("shape_id"), first["x"].alias("x"), first["y"].alias("y"), (F.size("contours") - 1).cast("long").alias("n_holes"), (net / 2).cast("long").alias("area"))


def ring_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Every point of every ring, and how often a ring turns left or right there."""
    c = _overlay(spark, d).flat_contours(OverlayRule.SUBJECT)
    around = F.arrays_zip(preceding(F.col("points")).alias("a"), F.col("points").alias("b"), following(F.col("points")).alias("c"))
    at = c.select("group_id", "is_hole", F.explode(around).alias("p")).select("group_id", "is_hole", F.col("p.b.x").alias("x"), F.col("p.b.y").alias("y"), cross(F.col("p.a"), F.col("p.b"), F.col("p.c")).alias("k"))
    return at.groupBy("group_id", "is_hole", "x", "y").agg(F.count(F.when(F.col("k") < 0, 1)).alias("n_left"), F.count(F.when(F.col("k") > 0, 1)).alias("n_right"))


def ring_successors(spark: SparkSession, d: str) -> DataFrame:
    """The successor map: at every corner each edge that arrives, the one that follows it on the left and, where two corners touch, on the right."""
    links = _overlay(spark, d).masked_segments(FillRule.NON_ZERO)
    e = rings.edges_of(rings.pieces(links, OverlayRule.XOR))
    head = lambda x: F.when(F.col("top"), F.col(f"b{x}")).otherwise(F.col(f"a{x}")).alias(x)
    known = e.select("group_id", "id", head("x"), head("y"), rings.heading().alias("heading"))
    way = lambda name: known.select(F.col("id").alias(name), F.col("heading").alias(f"{name}_heading"))
    s = rings.successors(e).join(known, "id").join(way("left"), "left").join(way("right"), "right", "left")
    return s.select("group_id", "x", "y", F.col("heading").alias("arrives"), F.col("left_heading").alias("leaves"), F.col("right_heading").alias("leaves_right"))


def flat_contours(spark: SparkSession, d: str) -> DataFrame:
    c = _overlay(spark, d).flat_contours(OverlayRule.INTERSECT)
    return c.groupBy("group_id").agg((F.sum(ring_area2(F.col("points"))) / 2).cast("long").alias("area"))


def min_area(spark: SparkSession, d: str) -> DataFrame:
    s = _overlay(spark, d, Options(min_output_area=40)).shapes(OverlayRule.XOR)
    return s.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_shapes"), F.sum(F.size("contours")).alias("n_rings"))


def cw_output(spark: SparkSession, d: str) -> DataFrame:
    s = _overlay(spark, d, Options(output_direction=ContourDirection.CLOCKWISE)).flat_contours(OverlayRule.INTERSECT)
    return s.groupBy("group_id").agg((F.sum(ring_area2(F.col("points"))) / 2).cast("long").alias("area"))


def quarantined(spark: SparkSession, d: str) -> DataFrame:
    """Rings set aside, of a windmill with four triangles for every line item."""
    return Overlay(table_windmill(spark, d)).rejects.groupBy("group_id", "shape_type", "reason").agg(F.count(F.lit(1)).alias("n"))


def windows_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes and holes of framed windows, one for every cell that a line item falls into: one hole to a shape."""
    s = Overlay(table_windows(spark, d)).shapes(OverlayRule.DIFFERENCE)
    return s.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_shapes"), F.sum(F.size("contours") - 1).alias("n_holes"), F.max(F.size("contours")).alias("most_rings"))


def windows_min_area(spark: SparkSession, d: str) -> DataFrame:
    """The same with rings under 101 dropped: the holes, of area 100, go."""
    s = Overlay(table_windows(spark, d), Options(min_output_area=101)).shapes(OverlayRule.DIFFERENCE)
    return s.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_shapes"), F.sum(F.size("contours")).alias("n_rings"))


QUERIES: dict = {
    f.__name__: f
    for f in (
        ring_edges, drop_collinear_points, signed_segments, orientation_counts, merge_segments, bbox, bucket_histogram, column_layout, column_histogram, hv_intersections, split_segments, winding_slabs,
        area_matrix, boundary_links, rules_of_stored, perimeter, node_degree, ring_successors, shape_rings, shape_table, ring_vertices, hole_binding, flat_contours, min_area, cw_output, quarantined,
        windows_shapes, windows_min_area,
    )
}
#: runs of cells of a column, filled (f) or not; `joint` are neighbours of one kind that share a side or, side being false, a corner (x, y) alone.
#: Filled runs hang together by their sides, empty ones by corners as well; `lab` is each run's component.
_RUNS = """,
filled AS (SELECT g, x, y FROM cells WHERE {where}),
box AS (SELECT g, min(x) - 1 AS xa, max(x) + 1 AS xb, min(y) - 1 AS ya, max(y) + 2 AS yb FROM filled GROUP BY g),
frun AS (SELECT g, x, min(y) AS y0, max(y) + 1 AS y1 FROM (SELECT g, x, y, y - row_number() OVER (PARTITION BY g, x ORDER BY y) AS k FROM filled) GROUP BY g, x, k),
stops AS (SELECT g, x, y0 AS e, y1 AS s FROM frun UNION ALL SELECT g, x, yb, NULL FROM (SELECT g, yb, unnest(range(xa, xb + 1)) AS x FROM box)),
gaps AS (SELECT c.g, x, coalesce(lag(s) OVER (PARTITION BY c.g, x ORDER BY e), ya) AS y0, e AS y1 FROM stops c JOIN box ON box.g = c.g),
run AS MATERIALIZED (SELECT row_number() OVER (ORDER BY g, x, y0) AS id, * FROM (SELECT g, x, y0, y1, TRUE AS f FROM frun UNION ALL SELECT g, x, y0, y1, FALSE FROM gaps WHERE y0 < y1)),
joint AS MATERIALIZED (
  SELECT a.id AS u, b.id AS v, a.f, a.y0 < b.y1 AND b.y0 < a.y1 AS side, a.g, b.x, CASE WHEN a.y1 = b.y0 THEN a.y1 ELSE a.y0 END AS y
  FROM run a JOIN run b ON b.g = a.g AND b.x = a.x + 1 AND b.f = a.f AND a.y0 <= b.y1 AND b.y0 <= a.y1)"""
#: labels `name` over the pairs `near` by hooking and shortcuts
_LABELS = """,
{name}_both AS MATERIALIZED (SELECT u, v FROM {near} UNION ALL SELECT v, u FROM {near}),
{name}(id, c) USING KEY (id) AS (
  SELECT id, id FROM run UNION
  SELECT id, min(n.c) FROM (
    SELECT e.v AS id, l.c FROM {name} l JOIN {name}_both e ON e.u = l.id JOIN recurring.{name} o ON o.id = e.v WHERE l.c < o.c
    UNION ALL SELECT o.c, l.c FROM {name} l JOIN {name}_both e ON e.u = l.id JOIN recurring.{name} o ON o.id = e.v WHERE l.c < o.c
    UNION ALL SELECT p.id, l.c FROM {name} l JOIN recurring.{name} p ON p.c = l.id WHERE l.c < p.c) n JOIN recurring.{name} q USING (id) GROUP BY id HAVING min(n.c) < min(q.c))"""
#: touch: corners (x, y) that two filled components a, b (maybe one) share across the empty component k. wall: the component w that
#: encloses k. reach: the wall and the islands that hang on it by corners; those are part of the wall's shape. top: a component's shape.
_SHAPES = _RUNS + _LABELS.format(name="lab", near="(SELECT u, v FROM joint WHERE side OR NOT f)") + """,
part AS MATERIALIZED (SELECT r.*, l.c FROM run r JOIN lab l USING (id)),
touch AS MATERIALIZED (
  SELECT i.g, i.x, i.y, a.c AS a, b.c AS b, k.c AS k FROM joint i JOIN lab a ON a.id = i.u JOIN lab b ON b.id = i.v JOIN joint j ON j.g = i.g AND j.x = i.x AND j.y = i.y AND NOT j.side AND NOT j.f JOIN lab k ON k.id = j.u
  WHERE i.f AND NOT i.side),
hollow AS (SELECT c AS k, g, min(struct_pack(x := x, y := y0)) AS m FROM part WHERE NOT f GROUP BY c, g),
wall AS (SELECT h.k, p.c AS w, h.g FROM hollow h JOIN part p ON p.f AND p.g = h.g AND p.x = h.m.x - 1 AND p.y0 <= h.m.y AND h.m.y < p.y1),
steps AS (SELECT k, a, b FROM touch UNION SELECT k, b, a FROM touch),
reach AS (SELECT k, w AS c FROM wall UNION SELECT s.k, s.b FROM reach r JOIN steps s ON s.k = r.k AND s.a = r.c),
absorbed AS (SELECT r.c, w.w FROM reach r JOIN wall w ON w.k = r.k WHERE r.c <> w.w),
top AS (SELECT DISTINCT c, c AS root FROM part WHERE f AND c NOT IN (SELECT c FROM absorbed) UNION SELECT a.c, t.root FROM absorbed a JOIN top t ON t.c = a.w),
outline AS (SELECT t.root, p.g, CAST(sum(p.y1 - p.y0) AS BIGINT) AS area FROM part p JOIN top t ON t.c = p.c WHERE p.f GROUP BY ALL),
start AS (SELECT c AS root, min(struct_pack(x := x, y := y0)) AS m FROM part WHERE f GROUP BY c),
spots AS (SELECT t.k, count(*) AS n FROM touch t JOIN reach r ON r.k = t.k AND r.c = t.a GROUP BY t.k),
islands AS (SELECT k, count(*) - 1 AS n FROM reach GROUP BY k),
holes AS (SELECT t.root, CAST(sum(1 + coalesce(s.n, 0) - i.n) AS BIGINT) AS n FROM wall w JOIN top t ON t.c = w.w JOIN islands i ON i.k = w.k LEFT JOIN spots s ON s.k = w.k GROUP BY t.root),
shape AS (SELECT o.g, row_number() OVER (PARTITION BY o.g ORDER BY s.m) - 1 AS shape_id, o.root, s.m.x AS x, s.m.y AS y, coalesce(h.n, 0) AS n_holes, o.area
  FROM outline o JOIN start s ON s.root = o.root LEFT JOIN holes h ON h.root = o.root)"""
#: hollow2: the empty components that rings enclose, which come apart at the corners of a shape with itself
_HOLES = _SHAPES + """,
apart AS (SELECT t.g, t.x, t.y FROM touch t JOIN reach r ON r.k = t.k AND r.c = t.a)""" + _LABELS.format(
    name="own", near="(SELECT u, v FROM joint WHERE NOT f AND (side OR (g, x, y) NOT IN (SELECT g, x, y FROM apart)))"
) + """,
room AS MATERIALIZED (SELECT p.g, p.x, p.y0, p.y1, p.c AS k, o.c AS room, w.w FROM part p JOIN own o USING (id) JOIN wall w ON w.k = p.c WHERE NOT p.f),
sides AS (
  SELECT m.room, m.w, CASE WHEN p.x < m.x THEN -m.x ELSE p.x END * (least(m.y1, p.y1) - greatest(m.y0, p.y0)) AS s
  FROM room m JOIN part p ON p.f AND p.g = m.g AND (p.x = m.x - 1 OR p.x = m.x + 1) AND p.y0 < m.y1 AND m.y0 < p.y1 JOIN reach r ON r.k = m.k AND r.c = p.c),
hole AS (SELECT room, t.root, CAST(sum(s) AS BIGINT) AS area FROM sides JOIN top t ON t.c = sides.w GROUP BY ALL)"""


def _traced_sql(tables: str, rule: OverlayRule) -> str:
    return "WITH RECURSIVE " + CELLS + tables.format(where=_inside_sql(rule, FillRule.NON_ZERO))


_CORNERS = """,
i AS (SELECT g, x, y FROM cells WHERE {where}),
p AS (SELECT g, x, y FROM i UNION SELECT g, x + 1, y FROM i UNION SELECT g, x, y + 1 FROM i UNION SELECT g, x + 1, y + 1 FROM i),
q AS (SELECT p.*, a.g IS NOT NULL AS ne, b.g IS NOT NULL AS nw, c.g IS NOT NULL AS se, d.g IS NOT NULL AS sw FROM p
  LEFT JOIN i a ON a.g = p.g AND a.x = p.x AND a.y = p.y LEFT JOIN i b ON b.g = p.g AND b.x = p.x - 1 AND b.y = p.y
  LEFT JOIN i c ON c.g = p.g AND c.x = p.x AND c.y = p.y - 1 LEFT JOIN i d ON d.g = p.g AND d.x = p.x - 1 AND d.y = p.y - 1),
corner AS (SELECT *, ne::INT + nw::INT + se::INT + sw::INT AS n FROM q WHERE (ne::INT + nw::INT + se::INT + sw::INT) % 2 = 1 OR (ne = sw AND ne <> nw))"""
CELL_SQL = "WITH spots AS (SELECT DISTINCT CAST(l_suppkey % 16 AS BIGINT) AS g, CAST(l_partkey % 20011 AS INT) AS i, CAST(l_orderkey % 50021 AS INT) AS j FROM lineitem) "
AREA_SQL = "WITH " + CELLS + " SELECT g AS group_id, CAST(count(*) AS BIGINT) AS area FROM cells WHERE {where} GROUP BY g"
_EDGE = """,
known AS (SELECT g, x, y, {s} AS s, {c} AS c FROM cells),
inner_ AS (SELECT * FROM known WHERE s OR c),
around AS (SELECT g, x, y FROM inner_ UNION SELECT g, x, y + 1 FROM inner_ UNION SELECT g, x + 1, y FROM inner_),
h AS (SELECT a.g, 'H' AS orient, coalesce(t.s, FALSE)::INT + 2 * coalesce(b.s, FALSE)::INT + 4 * coalesce(t.c, FALSE)::INT + 8 * coalesce(b.c, FALSE)::INT AS fill
      FROM around a LEFT JOIN inner_ t ON t.g = a.g AND t.x = a.x AND t.y = a.y LEFT JOIN inner_ b ON b.g = a.g AND b.x = a.x AND b.y = a.y - 1),
v AS (SELECT a.g, 'V' AS orient, coalesce(l.s, FALSE)::INT + 2 * coalesce(r.s, FALSE)::INT + 4 * coalesce(l.c, FALSE)::INT + 8 * coalesce(r.c, FALSE)::INT AS fill
      FROM around a LEFT JOIN inner_ r ON r.g = a.g AND r.x = a.x AND r.y = a.y LEFT JOIN inner_ l ON l.g = a.g AND l.x = a.x - 1 AND l.y = a.y),
e AS (SELECT * FROM h UNION ALL SELECT * FROM v)""".format(s="ws <> 0", c="wc <> 0")
ORACLES: dict = {
    "ring_edges": "WITH " + RECTS + """, corners AS (
  SELECT g, clip, unnest([struct_pack(px := x0, qy := CASE WHEN w > 0 THEN y0 ELSE y1 END), struct_pack(px := CASE WHEN w > 0 THEN x1 ELSE x0 END, qy := CASE WHEN w > 0 THEN y1 ELSE y1 END),
         struct_pack(px := x1, qy := CASE WHEN w > 0 THEN y1 ELSE y0 END), struct_pack(px := CASE WHEN w > 0 THEN x0 ELSE x1 END, qy := y0)]) AS e FROM rects)
SELECT g AS group_id, CASE WHEN clip = 1 THEN 'clip' ELSE 'subject' END AS shape_type, count(*) AS n_edges, CAST(sum(CAST(e.px AS BIGINT) * 3 + e.qy) AS BIGINT) AS checksum FROM corners GROUP BY ALL""",
    "drop_collinear_points": "WITH " + RECTS + " SELECT g AS group_id, CAST(sum(x1 - x0 + 4) AS BIGINT) AS n_before, CAST(count(*) * 4 AS BIGINT) AS n_points, CAST(sum(x1 - x0 + 3) AS BIGINT) AS n_without_spikes, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS gross_area FROM rects GROUP BY g",
    "signed_segments": "WITH " + SEGS + """ SELECT g AS group_id, o AS orient, count(*) AS n, CAST(sum(w * (1 - clip)) AS BIGINT) AS subj, CAST(sum(w * clip) AS BIGINT) AS clip,
  CAST(sum(CAST(hi - lo AS BIGINT) * (w * (1 - raw.clip) + 2 * w * raw.clip) * pos) AS BIGINT) AS moment FROM raw GROUP BY g, o""",
    "orientation_counts": "WITH " + SEGS + " SELECT o AS orient, CASE WHEN o = 'H' THEN 'V' ELSE 'H' END AS across, count(*) AS n, CAST(sum(hi - lo) AS BIGINT) AS length FROM raw GROUP BY o",
    "merge_segments": "WITH " + SEGS + " SELECT g AS group_id, o AS orient, pos, lo, hi, subj, clip FROM segs",
    "bbox": "WITH " + RECTS + " SELECT g AS group_id, min(x0) AS min_x, max(x1) AS max_x, min(y0) AS min_y, max(y1) AS max_y, CAST(4 * count(*) AS BIGINT) AS n_points FROM rects GROUP BY g",
    "column_layout": "WITH " + COLUMNS + " SELECT g AS group_id, c AS column_no, x0, n FROM cols",
    "column_histogram": "WITH " + COLUMNS + """, parts AS (
  SELECT s.g, c, o, pos, lo, hi, subj, clip FROM segs s JOIN cols k ON s.g = k.g AND o = 'V' AND pos >= x0 AND pos < x1
  UNION ALL SELECT s.g, c, o, pos, greatest(lo, x0), least(hi, x1), subj, clip FROM segs s JOIN cols k ON s.g = k.g AND o = 'H' AND lo < x1 AND hi > x0)
SELECT g AS group_id, c AS column_no, o AS orient, count(*) AS n, CAST(sum(CAST(hi AS BIGINT) - lo) AS BIGINT) AS length, CAST(sum((subj + 2 * clip) * (hi - lo) * pos) AS BIGINT) AS moment
FROM parts GROUP BY ALL""",
    "bucket_histogram": "WITH " + SEGS + """, b AS (SELECT g, o, CASE WHEN o = 'V' THEN pos ELSE lo END // 8 AS b0, CASE WHEN o = 'V' THEN pos ELSE hi END // 8 AS b1 FROM segs),
u AS (SELECT g, o, unnest(range(b0, b1 + 1)) AS bucket FROM b) SELECT g AS group_id, CAST(bucket AS BIGINT) AS bucket, o AS orient, count(*) AS n FROM u GROUP BY ALL""",
    "hv_intersections": "WITH " + SEGS + """, hs AS (SELECT *, unnest(range(lo // 16, hi // 16 + 1)) AS b FROM segs WHERE o = 'H')
SELECT v.g AS group_id, count(*) AS meetings, count(*) FILTER (WHERE h.pos > v.lo AND h.pos < v.hi AND v.pos > h.lo AND v.pos < h.hi) AS crossings
FROM segs v JOIN hs h ON v.g = h.g AND h.b = v.pos // 16 AND h.pos BETWEEN v.lo AND v.hi AND v.pos BETWEEN h.lo AND h.hi WHERE v.o = 'V' GROUP BY v.g""",
    "split_segments": "WITH " + SEGS + """, hs AS (SELECT *, unnest(range(lo // 16, hi // 16 + 1)) AS b FROM segs WHERE o = 'H'),
met AS (SELECT v.g, v.pos AS x, h.pos AS y, v.lo AS vlo, v.hi AS vhi, h.lo AS hlo, h.hi AS hhi FROM segs v JOIN hs h ON v.g = h.g AND h.b = v.pos // 16 AND h.pos BETWEEN v.lo AND v.hi AND v.pos BETWEEN h.lo AND h.hi WHERE v.o = 'V'),
pts AS (SELECT g, o, pos, lo, hi, unnest([lo, hi]) AS p FROM segs UNION SELECT g, 'V', x, vlo, vhi, y FROM met WHERE y > vlo AND y < vhi UNION SELECT g, 'H', y, hlo, hhi, x FROM met WHERE x > hlo AND x < hhi),
pieces AS (SELECT *, lead(p) OVER (PARTITION BY g, o, pos, lo, hi ORDER BY p) AS q FROM pts)
SELECT p.g AS group_id, p.o AS orient, p.pos, p.p AS lo, p.q AS hi, CAST(sum(s.subj) AS BIGINT) AS subj, CAST(sum(s.clip) AS BIGINT) AS clip
FROM pieces p JOIN segs s ON s.g = p.g AND s.o = p.o AND s.pos = p.pos AND s.lo = p.lo AND s.hi = p.hi WHERE q IS NOT NULL GROUP BY ALL HAVING sum(s.subj) <> 0 OR sum(s.clip) <> 0""",
    "winding_slabs": "WITH " + CELLS + " SELECT g AS group_id, ws, wc, CAST(count(*) AS BIGINT) AS cells FROM cells WHERE ws <> 0 OR wc <> 0 GROUP BY ALL",
    "area_matrix": "WITH " + CELLS + " SELECT g AS group_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE {_inside_sql(r, f)}) AS BIGINT) AS {f.value}_{r.value}" for f in FillRule for r in OverlayRule) + " FROM cells GROUP BY g",
    "boundary_links": "WITH " + CELLS + _EDGE + " SELECT g AS group_id, orient, CAST(fill AS INT) AS fill, CAST(count(*) AS BIGINT) AS length FROM e WHERE (fill & 1) <> (fill & 2) // 2 OR (fill & 4) // 4 <> (fill & 8) // 8 GROUP BY ALL",
    "rules_of_stored": "WITH " + CELLS + _EDGE + ", " + ", ".join(
        f"a{k} AS (SELECT g, count(*) AS n FROM cells WHERE {_inside_sql(r, FillRule.NON_ZERO)} GROUP BY g), "
        f"b{k} AS (SELECT g, count(*) AS n FROM e WHERE {_inside_sql(r, FillRule.NON_ZERO, '(fill & 1)', '(fill & 4)')} <> {_inside_sql(r, FillRule.NON_ZERO, '(fill & 2)', '(fill & 8)')} GROUP BY g)"
        for k, r in enumerate(STORED_RULES)
    ) + " UNION ALL ".join(f" SELECT a{k}.g AS group_id, '{r.value}' AS rule, a{k}.n AS area, b{k}.n AS boundary FROM a{k} JOIN b{k} ON a{k}.g = b{k}.g" for k, r in enumerate(STORED_RULES)),
    "perimeter": "WITH " + CELLS + _EDGE + " SELECT g AS group_id, CAST(count(*) AS BIGINT) AS perimeter FROM e WHERE ((fill & 5) <> 0) <> ((fill & 10) <> 0) GROUP BY g",
    "node_degree": "WITH " + CELLS + """, i AS (SELECT g, x, y FROM cells WHERE (ws <> 0) <> (wc <> 0)),
p AS (SELECT g, x, y FROM i UNION SELECT g, x + 1, y FROM i UNION SELECT g, x, y + 1 FROM i UNION SELECT g, x + 1, y + 1 FROM i),
q AS (SELECT p.g, (a.g IS NOT NULL)::INT AS ne, (b.g IS NOT NULL)::INT AS nw, (c.g IS NOT NULL)::INT AS se, (d.g IS NOT NULL)::INT AS sw FROM p
  LEFT JOIN i a ON a.g = p.g AND a.x = p.x AND a.y = p.y LEFT JOIN i b ON b.g = p.g AND b.x = p.x - 1 AND b.y = p.y
  LEFT JOIN i c ON c.g = p.g AND c.x = p.x AND c.y = p.y - 1 LEFT JOIN i d ON d.g = p.g AND d.x = p.x - 1 AND d.y = p.y - 1),
n AS (SELECT g, (ne <> nw)::INT AS n, (se <> sw)::INT AS s, (ne <> se)::INT AS e, (nw <> sw)::INT AS w FROM q)
SELECT g AS group_id, CAST(n + s + e + w AS BIGINT) AS degree, count(*) AS n_nodes FROM n WHERE n + s > 0 AND e + w > 0 GROUP BY ALL""",
    "ring_successors": "WITH " + CELLS + _CORNERS.format(where=_inside_sql(OverlayRule.XOR, FillRule.NON_ZERO)) + """,
ways AS (
  SELECT g, x, y, n, CASE WHEN ne AND NOT se THEN 0 ELSE 2 END AS h, ne AND NOT se AS leaves FROM corner WHERE ne <> se UNION ALL SELECT g, x, y, n, CASE WHEN nw AND NOT ne THEN 1 ELSE 3 END, nw AND NOT ne FROM corner WHERE ne <> nw
  UNION ALL SELECT g, x, y, n, CASE WHEN nw THEN 0 ELSE 2 END, sw FROM corner WHERE nw <> sw UNION ALL SELECT g, x, y, n, CASE WHEN sw THEN 1 ELSE 3 END, se FROM corner WHERE sw <> se)
SELECT a.g AS group_id, a.x, a.y, CAST(a.h AS INT) AS arrives, CAST(b.h AS INT) AS leaves, CASE WHEN a.n = 2 THEN CAST((a.h + 3) % 4 AS INT) END AS leaves_right
FROM ways a JOIN ways b ON b.g = a.g AND b.x = a.x AND b.y = a.y AND NOT a.leaves AND b.leaves WHERE a.n <> 2 OR b.h = (a.h + 1) % 4""",
    "shape_table": _traced_sql(_SHAPES, OverlayRule.SUBJECT) + " SELECT g AS group_id, shape_id, x, y, n_holes, area FROM shape",
    "hole_binding": _traced_sql(_SHAPES, OverlayRule.SUBJECT) + " SELECT g AS group_id, count(*) AS n_shapes, CAST(sum(n_holes) AS BIGINT) AS n_holes FROM shape GROUP BY g",
    "ring_vertices": _traced_sql(_SHAPES + _CORNERS, OverlayRule.SUBJECT) + """,
sized AS (SELECT c.*, CASE WHEN n < 3 THEN CASE WHEN ne THEN 0 WHEN nw THEN 1 WHEN sw THEN 2 ELSE 3 END ELSE CASE WHEN NOT ne THEN 2 WHEN NOT nw THEN 3 WHEN NOT sw THEN 0 ELSE 1 END END AS full_,
  CASE WHEN NOT ne THEN 0 WHEN NOT nw THEN 1 WHEN NOT sw THEN 2 ELSE 3 END AS void_ FROM corner c),
cell AS (SELECT *, x - (full_ IN (1, 2))::INT AS fx, y - (full_ IN (2, 3))::INT AS fy, x - (void_ IN (1, 2))::INT AS vx, y - (void_ IN (2, 3))::INT AS vy FROM sized),
placed AS (SELECT s.g, s.x, s.y, s.n, a.c, b.c AS k FROM cell s
  JOIN part a ON a.f AND a.g = s.g AND a.x = s.fx AND a.y0 <= s.fy AND s.fy < a.y1 JOIN part b ON NOT b.f AND b.g = s.g AND b.x = s.vx AND b.y0 <= s.vy AND s.vy < b.y1),
known AS (SELECT p.*, r.k IS NOT NULL AS is_hole FROM placed p LEFT JOIN reach r ON r.k = p.k AND r.c = p.c)
SELECT g AS group_id, is_hole, x, y, CAST(CASE WHEN n = 1 THEN 1 WHEN n = 2 AND NOT is_hole THEN 2 ELSE 0 END AS BIGINT) AS n_left, CAST(CASE WHEN n = 3 THEN 1 WHEN n = 2 AND is_hole THEN 2 ELSE 0 END AS BIGINT) AS n_right FROM known""",
    "min_area": _traced_sql(_HOLES, OverlayRule.XOR) + """,
whole AS (SELECT s.g, s.root, s.area + coalesce(h.area, 0) AS area, coalesce(h.n, 0) AS n FROM shape s LEFT JOIN (SELECT root, sum(area) AS area, count(*) FILTER (WHERE area >= 40) AS n FROM hole GROUP BY root) h ON h.root = s.root)
SELECT g AS group_id, count(*) AS n_shapes, CAST(sum(1 + n) AS BIGINT) AS n_rings FROM whole WHERE area >= 40 GROUP BY g""",
    "shape_rings": AREA_SQL.format(where=_inside_sql(OverlayRule.UNION, FillRule.NON_ZERO)),
    "flat_contours": AREA_SQL.format(where=_inside_sql(OverlayRule.INTERSECT, FillRule.NON_ZERO)),
    "cw_output": "WITH " + CELLS + f" SELECT g AS group_id, CAST(-count(*) AS BIGINT) AS area FROM cells WHERE {_inside_sql(OverlayRule.INTERSECT, FillRule.NON_ZERO)} GROUP BY g",
    "windows_shapes": CELL_SQL + "SELECT g AS group_id, count(*) AS n_shapes, count(*) AS n_holes, CAST(2 AS INT) AS most_rings FROM spots GROUP BY g",
    "windows_min_area": CELL_SQL + "SELECT g AS group_id, count(*) AS n_shapes, count(*) AS n_rings FROM spots GROUP BY g",
    "quarantined": "SELECT CAST(l_suppkey % 16 AS BIGINT) AS group_id, 'subject' AS shape_type, 'diagonal edge' AS reason, 4 * count(*) AS n FROM lineitem GROUP BY 1",
}
for _f in FillRule:
    QUERIES[f"fill_{_f.value}"] = lambda s, d, f=_f: _overlay(s, d).area(OverlayRule.UNION, f)
    ORACLES[f"fill_{_f.value}"] = AREA_SQL.format(where=_inside_sql(OverlayRule.UNION, _f))
for _r in OverlayRule:
    QUERIES[f"rule_{_r.value}"] = lambda s, d, r=_r: _overlay(s, d).area(r, FillRule.NON_ZERO)
    ORACLES[f"rule_{_r.value}"] = AREA_SQL.format(where=_inside_sql(_r, FillRule.NON_ZERO))
#: workload, rule, area per group by formula over the cells that line items fall into
BENCH = (
    # a clip overlaps the subjects of its own cell and of those to the right and above by 25 each
    ("checkerboard", table_checkerboard, OverlayRule.XOR, """SELECT g AS group_id, CAST(sum(800 - 50 * n) AS BIGINT) AS area FROM (SELECT c.g, c.i, c.j, count(s.g) AS n
      FROM (SELECT *, unnest([0, 1, 0, 1]) AS di, unnest([0, 0, 1, 1]) AS dj FROM spots) c LEFT JOIN spots s ON s.g = c.g AND s.i = c.i + c.di AND s.j = c.j + c.dj GROUP BY ALL) GROUP BY g"""),
    ("not_overlap", table_not_overlap, OverlayRule.UNION, "SELECT g AS group_id, CAST(200 * count(*) AS BIGINT) AS area FROM spots GROUP BY g"),
    ("lines_net", table_lines_net, OverlayRule.INTERSECT, "SELECT g AS group_id, CAST(100 * count(DISTINCT i % 509) * count(DISTINCT j % 503) AS BIGINT) AS area FROM spots GROUP BY g"),
    ("windows", table_windows, OverlayRule.DIFFERENCE, "SELECT g AS group_id, CAST(300 * count(*) AS BIGINT) AS area FROM spots GROUP BY g"),
    ("nested", table_nested, OverlayRule.XOR, "SELECT g AS group_id, CAST(sum(256 * (k + 1) - 128) AS BIGINT) AS area FROM (SELECT DISTINCT g, i % 101 AS k FROM spots) GROUP BY g"),
)
for _name, _table, _r, _sql in BENCH:
    QUERIES[f"bench_{_name}"] = lambda s, d, t=_table, r=_r: Overlay(t(s, d)).area(r)
    ORACLES[f"bench_{_name}"] = CELL_SQL + _sql
