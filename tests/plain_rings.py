"""A plain walker over the links of one group, against which the distributed rings are held."""

from __future__ import annotations

from bisect import bisect_left

from quadrille.model import ContourDirection, Options

Point = tuple[int, int]


def _turns(ring: list[Point]) -> list[Point]:
    """The ring without the points at which it runs straight on."""
    out = ring
    while True:
        n = len(out)
        kept = [b for a, b, c in ((out[i - 1], out[i], out[(i + 1) % n]) for i in range(n)) if (a[0] - b[0]) * (c[1] - b[1]) != (a[1] - b[1]) * (c[0] - b[0])]
        if len(kept) == n or len(kept) < 3:
            return kept if len(kept) >= 3 else []
        out = kept


def _area(ring: list[Point]) -> int:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) // 2


def _from_smallest(ring: list[Point]) -> list[Point]:
    at = ring.index(min(ring))
    return ring[at:] + ring[:at]


class _Walk:
    """Links directed so that the result lies on their left; every node has as many ways in as out."""

    def __init__(self, links: list[tuple[Point, Point, bool]]):
        self.links = links
        self.out: dict[Point, list[int]] = {}
        for k, (a, b, top) in enumerate(links):
            # along +x the left is above; along +y the left is the smaller x, which counts as the top of a vertical
            self.out.setdefault(a if top else b, []).append(k)
        self.seen = [False] * len(links)

    def ends(self, k: int) -> tuple[Point, Point]:
        a, b, top = self.links[k]
        return (a, b) if top else (b, a)

    def ring(self, start: int, hole: bool) -> list[tuple[int, Point]]:
        """Links and their first points, from `start` to the first return to where it begins."""
        out, k = [], start
        first, at = self.ends(start)
        self.seen[start] = True
        out.append((start, first))
        heading = (at[0] - first[0], at[1] - first[1])
        while at != first:
            ways = [w for w in self.out[at] if not self.seen[w]]
            if len(ways) > 1:
                # at a touching corner an outer ring turns left, round the filled quadrant, a hole right, round the empty one
                def side(w: int) -> int:
                    p, q = self.ends(w)
                    return heading[0] * (q[1] - p[1]) - heading[1] * (q[0] - p[0])

                k = (min if hole else max)(ways, key=side)
            else:
                k = ways[0]
            p, q = self.ends(k)
            self.seen[k] = True
            out.append((k, p))
            heading, at = (q[0] - p[0], q[1] - p[1]), q
        return out


def trace(links: list[tuple[Point, Point, bool]], options: Options, corners: set[Point] | None = None):
    """links: (a, b, inside above or left), a before b, in any order. Returns (outers, holes, owners): rings, and per hole its outer.

    Rings begin in ascending order of links; the first link at a node is the steepest one left. A ring is a hole if the result is above or
    left of it. A hole belongs to the owner of the nearest link below its smallest point that has the result above; if a hole owns
    that link, to the same shape as that hole. Rings smaller than min_output_area are dropped, shapes with their holes.
    """
    links = sorted(links)
    walk, kinds, rings, owner = _Walk(links), [], [], [0] * len(links)
    leaving: dict[Point, list[int]] = {}
    for k, (a, _, _) in enumerate(links):
        leaving.setdefault(a, []).append(k)
    for k, (a, _, _) in enumerate(links):
        if walk.seen[k]:
            continue
        free = [w for w in leaving[a] if not walk.seen[w]]
        start = next((w for w in free if links[w][1][0] == a[0]), free[0])
        hole = links[start][2]
        steps = walk.ring(start, hole)
        for w, _ in steps:
            owner[w] = len(rings)
        rings.append([p for _, p in steps])
        kinds.append(hole)
    above: dict[int, tuple[list[int], list[int]]] = {}
    for k, (a, b, top) in enumerate(links):
        if top and a[1] == b[1]:
            ys, ks = above.setdefault(a[0], ([], []))
            ys.append(a[1])
            ks.append(k)  # sorted: links are in (x, y) order
    parent: dict[int, int] = {}
    for r in sorted((r for r, h in enumerate(kinds) if h), key=lambda r: min(rings[r])):
        x, y = min(rings[r])
        ys, ks = above.get(x, ([], []))
        at = bisect_left(ys, y) - 1
        if at < 0:
            raise ValueError(f"no shape below the hole at {(x, y)}")
        below = owner[ks[at]]
        parent[r] = parent[below] if kinds[below] else below
    shown, order = {}, []
    for r, ring in enumerate(rings):
        keep = _turns(ring)
        if options.preserve_output_collinear and corners is not None:
            turning = set(keep)
            keep = [p for p in ring if p in turning or p in corners]
        if len(keep) < 3 or abs(_area(keep)) < options.min_output_area:
            continue
        if options.output_direction is ContourDirection.CLOCKWISE:
            keep = keep[::-1]
        shown[r] = _from_smallest(keep)
        order.append(r)
    outers = [r for r in order if not kinds[r]]
    number = {r: k for k, r in enumerate(outers)}
    holes = [r for r in order if kinds[r] and parent[r] in number]
    return [shown[r] for r in outers], [shown[r] for r in holes], [number[parent[r]] for r in holes]


def plain_shapes(rows, rule, options: Options = Options()):
    """rows: masked segments of one group. Shapes as lists of rings, in order, and the flat list of rings: outer ones, then holes."""
    sides = {"subject": lambda s, c: s, "clip": lambda s, c: c, "intersect": lambda s, c: s and c, "union": lambda s, c: s or c, "difference": lambda s, c: s and not c, "inverse_difference": lambda s, c: c and not s, "xor": lambda s, c: s != c}
    inside = sides[rule.value]
    links, corners = [], set()
    for r in rows:
        above, below = (bool(inside(bool(r["fill"] & s), bool(r["fill"] & c))) for s, c in ((1, 4), (2, 8)))
        ends = (r["ax"], r["ay"]), (r["bx"], r["by"])
        if above != below:
            links.append((*ends, above))
        if r["orient"] == "V":
            corners.update(ends)
    outers, holes, owner = trace(links, options, corners if options.preserve_output_collinear else None)
    whole = [[ring] for ring in outers]
    for ring, k in zip(holes, owner):
        whole[k].append(ring)
    return whole, outers + holes
