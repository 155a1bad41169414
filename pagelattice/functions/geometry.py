"""Geometry as column expressions.

Points are arrays of struct(x, y); boxes are given by x0, y0, x1, y1 or x, y, w, h.
The y axis points down.  Everything here stays inside code generation or the JVM's
higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# -- points and polygons -------------------------------------------------------------------------------------
def points(text: Column) -> Column:
    """``"x,y x,y"`` as an array of points; null if any part is malformed."""
    part = lambda p, k: F.get(F.split(p, ","), k).try_cast("int")
    got = F.transform(F.split(F.trim(text), " +"), lambda p: F.struct(part(p, 0).alias("x"), part(p, 1).alias("y")))
    bad = F.exists(got, lambda p: p["x"].isNull() | p["y"].isNull()) | F.exists(F.split(F.trim(text), " +"), lambda p: F.size(F.split(p, ",")) != 2)
    return F.when(~bad, got)


def points_text(pts: Column, outer: str = " ", inner: str = ",") -> Column:
    """Points as text, the inverse of points; with ``;`` the polygon notation."""
    return F.array_join(F.transform(pts, lambda p: F.concat_ws(inner, p["x"].cast("string"), p["y"].cast("string"))), outer)


def polygon(text: Column) -> Column:
    """``"x,y;x,y"`` as points; fewer than two points give null."""
    got = points(F.replace(text, F.lit(";"), F.lit(" ")))
    return F.when(F.size(got) >= 2, got)


def xs(pts: Column) -> Column:
    return F.transform(pts, lambda p: p["x"])


def ys(pts: Column) -> Column:
    return F.transform(pts, lambda p: p["y"])


def from_xy(x: Column, y: Column) -> Column:
    """Two coordinate arrays as points."""
    return F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))


def bounding_box(pts: Column) -> Column:
    """struct(x0, y0, x1, y1)."""
    return F.struct(F.array_min(xs(pts)).alias("x0"), F.array_min(ys(pts)).alias("y0"), F.array_max(xs(pts)).alias("x1"), F.array_max(ys(pts)).alias("y1"))


def bounds(pts: Column) -> Column:
    """struct(x, y, w, h) of a polygon's pixels: both ends count, so sizes are one larger than differences."""
    b = bounding_box(pts)
    return F.struct(b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"] + 1).alias("w"), (b["y1"] - b["y0"] + 1).alias("h"))


def rescale(pts: Column, scale: Column | float) -> Column:
    """Scaled points, truncated to integers."""
    s = scale if isinstance(scale, Column) else F.lit(scale)
    return F.transform(pts, lambda p: F.struct((p["x"] * s).cast("int").alias("x"), (p["y"] * s).cast("int").alias("y")))


def translate(pts: Column, dx: Column, dy: Column) -> Column:
    return F.transform(pts, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def edges(pts: Column) -> Column:
    """A polygon's edges as struct(a, b), the last back to the first."""
    turned = F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1))
    return F.zip_with(pts, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains_point(pts: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of edges is crossed to the right."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when((a["y"] > y) != (b["y"] > y), x < at).otherwise(F.lit(False))

    return F.size(F.filter(edges(pts), crosses)) % 2 == 1


def twice_area(pts: Column) -> Column:
    """Twice the signed area (shoelace)."""
    return F.aggregate(edges(pts), F.lit(0).cast("long"), lambda s, e: s + e["a"]["x"].cast("long") * e["b"]["y"] - e["b"]["x"].cast("long") * e["a"]["y"])


# -- segments ------------------------------------------------------------------------------------------------
def segment_intersection(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """struct(kind, x, y) of segments ab and cd: ``point`` with the point, ``overlap``, or ``none``."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    det = rx * sy - ry * sx
    t, u = ((cx - ax) * sy - (cy - ay) * sx) / det, ((cx - ax) * ry - (cy - ay) * rx) / det
    in_line = (cx - ax) * ry - (cy - ay) * rx == 0
    touch = (F.greatest(F.least(ax, bx), F.least(cx, dx)) <= F.least(F.greatest(ax, bx), F.greatest(cx, dx))) & (F.greatest(F.least(ay, by), F.least(cy, dy)) <= F.least(F.greatest(ay, by), F.greatest(cy, dy)))
    hit = (det != 0) & t.between(0, 1) & u.between(0, 1)
    kind = F.when(hit, "point").when((det == 0) & in_line & touch, "overlap").otherwise("none")
    return F.struct(kind.alias("kind"), F.when(hit, ax + t * rx).alias("x"), F.when(hit, ay + t * ry).alias("y"))


def mostly_horizontal(dx: Column, dy: Column) -> Column:
    return F.abs(dx) >= F.abs(dy)


# -- boxes (x, y, w, h) ----------------------------------------------------------------------------------------
def box_intersection(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """struct(x, y, w, h) of the overlap; negative sizes tell that the boxes are apart."""
    x, y = F.greatest(ax, bx), F.greatest(ay, by)
    return F.struct(x.alias("x"), y.alias("y"), (F.least(ax + aw, bx + bw) - x).alias("w"), (F.least(ay + ah, by + bh) - y).alias("h"))


def gap(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """struct(x, y, w, h) of the box between two: across what they share on one axis, or from corner to corner; all 0 if they overlap."""
    i = box_intersection(ax, ay, aw, ah, bx, by, bw, bh)
    apart = lambda n: i[n] <= 0
    side = lambda at, n: (F.when(apart(n), i[at] + i[n]).otherwise(i[at]).alias(at), F.abs(i[n]).alias(n))
    (x, w), (y, h) = side("x", "w"), side("y", "h")
    zero = F.lit(0).cast("long")
    none = F.struct(*[zero.alias(n) for n in "xywh"])
    return F.when(apart("w") | apart("h"), F.struct(*[c.cast("long").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])).otherwise(none)


def box_contains_point(x, y, w, h, px, py) -> Column:
    """Strictly inside."""
    return (px > x) & (px < x + w) & (py > y) & (py < y + h)


def box_contains_box(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Every corner of b strictly inside a or on a corner of a."""
    corner = lambda px, py: ((px == ax) | (px == ax + aw)) & ((py == ay) | (py == ay + ah))
    held = lambda px, py: box_contains_point(ax, ay, aw, ah, px, py) | corner(px, py)
    return held(bx, by) & held(bx + bw, by) & held(bx, by + bh) & held(bx + bw, by + bh)


def lies_above(ay, ah, by) -> Column:
    return ay + ah < by


def lies_below(ay, by, bh) -> Column:
    return ay > by + bh


def lies_left(ax, aw, bx) -> Column:
    return ax + aw < bx


def lies_right(ax, bx, bw) -> Column:
    return ax > bx + bw


def corners(x, y, w, h) -> Column:
    """The four corners, clockwise from the upper left."""
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))


def orientation_rectangles(x, y, dims: tuple[int, int, int, int] = (600, 300, 600, 300), offset: int = 0) -> dict[str, Column]:
    """Boxes (x, y, w, h) to the north, east, south and west of a point, moved back towards it by the offset; dims: length and width of the upright ones, height and width of the others."""
    long, wide, high, broad = dims
    box = lambda a, b, w, h: F.struct(a.alias("x"), b.alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    return {"n": box(x - wide // 2, y - long + offset, wide, long), "s": box(x - wide // 2, y - offset, wide, long), "e": box(x - offset, y - high // 2, broad, high), "w": box(x - broad + offset, y - high // 2, broad, high)}


def orientation_cones(x, y, dims: tuple[int, int, int, int] = (600, 300, 600, 300), offset: int = 0) -> dict[str, Column]:
    """Triangles of two base points at the point and a tip, in the same four directions."""
    long, wide, far, broad = dims
    ring = lambda *ps: F.array(*[F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")) for a, b in ps])
    upright = lambda s: ring((x - wide // 2, y - s * offset), (x + wide // 2, y - s * offset), (x, y + s * (long - offset)))
    level = lambda s: ring((x - s * offset, y + broad // 2), (x - s * offset, y - broad // 2), (x + s * (far - offset), y))
    return {"n": upright(-1), "s": upright(1), "e": level(1), "w": level(-1)}


def box_rescale(w, h, scale: float) -> Column:
    """Truncated scaled sizes; null (no change) if a side would vanish."""
    sw, sh = (w * F.lit(scale)).cast("int"), (h * F.lit(scale)).cast("int")
    return F.when((sw >= 1) & (sh >= 1), F.struct(sw.alias("w"), sh.alias("h")))


def vertically_aligned(a0, a1, b0, b1, margin: int = 20) -> Column:
    """Whether one x range lies in the other, its outer ends at most the margin beyond, or both begin or end nearer than the margin."""
    within = lambda l0, l1, r0, r1: (l0 >= r0 - margin) & (l0 <= r1) & (l1 >= r0) & (l1 <= r1 + margin)
    return within(a0, a1, b0, b1) | within(b0, b1, a0, a1) | (F.abs(a0 - b0) < margin) | (F.abs(a1 - b1) < margin)


def point_box_distance(px, py, x0, y0, x1, y1) -> Column:
    """City-block distance of a point from a box, 0 inside."""
    zero = F.lit(0)
    return F.greatest(zero, x0 - px, px - x1) + F.greatest(zero, y0 - py, py - y1)


def along(dx, dy, angle) -> Column:
    """The part of a difference along an orientation (y down)."""
    return dx * F.cos(angle) - dy * F.sin(angle)


def across(dx, dy, angle) -> Column:
    """The part across it."""
    return dx * F.sin(angle) + dy * F.cos(angle)


def orientation(pts: Column) -> Column:
    """Angle in [0, 2 pi) of the least-squares line through points, pointing from the first to the last; steep ones upright."""
    n = F.size(pts)
    total = lambda f: F.aggregate(pts, F.lit(0.0), lambda s, p: s + f(p).cast("double"))
    sx, sy = total(lambda p: p["x"]), total(lambda p: p["y"])
    sxx, sxy = total(lambda p: p["x"].cast("double") * p["x"]), total(lambda p: p["x"].cast("double") * p["y"])
    det = n * sxx - sx * sx
    dx = F.element_at(pts, -1)["x"] - F.element_at(pts, 1)["x"]
    dy = F.element_at(pts, -1)["y"] - F.element_at(pts, 1)["y"]
    flat = F.atan(-(n * sxy - sx * sy) / det)
    steep = F.array_max(xs(pts)) - F.array_min(xs(pts)) < 2
    raw = F.when(steep, F.when(dy > 0, F.lit(1.5 * 3.141592653589793)).otherwise(F.lit(0.5 * 3.141592653589793))).when(dx < 0, flat + F.lit(3.141592653589793)).otherwise(flat)
    return F.when(raw < 0, raw + F.lit(2 * 3.141592653589793)).otherwise(raw)


def blow_up(pts: Column) -> Column:
    """Every pixel of a polyline along each segment's dominant axis, half-up rounded; the first point of all comes first."""
    ends = F.zip_with(F.slice(pts, 1, F.size(pts) - 1), F.slice(pts, 2, F.size(pts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def fill(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        n = F.greatest(F.abs(dx), F.abs(dy))
        at = lambda k, d, a: F.floor(a + d * k / n + F.lit(0.5)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(at(k, dx, e["a"]["x"]).alias("x"), at(k, dy, e["a"]["y"]).alias("y")))).otherwise(F.slice(F.array(e["a"]), 1, 0))

    return F.concat(F.slice(pts, 1, 1), F.flatten(F.transform(ends, fill)))


def _tick_count(pixels: Column, distance: int, least: int) -> Column:
    return F.greatest(F.lit(least), F.floor((pixels - 1) / F.lit(distance)).cast("int") + 1)


def thin_out(pts: Column, distance: int = 5, least: int = 20) -> Column:
    """Evenly spaced points of a blown-up line, ``distance`` apart at most or ``least`` of them; the last is kept, and so are all of a short line's."""
    n = F.size(pts)
    k = _tick_count(n, distance, least)
    index = F.transform(F.sequence(F.lit(0), k - 2), lambda i: F.floor(i * ((n - 1) / (k - 1))).cast("int"))
    return F.when(n <= least, pts).otherwise(F.transform(F.concat(index, F.array(n - 1)), lambda i: F.get(pts, i)))


#: A line whose box is larger than this on a side is taken for the point (0, 0).
HUGE = 100_000


def ticks(pts: Column, distance: int = 5, least: int = 20) -> Column:
    """``thin_out(blow_up(pts))`` without the pixels in between: each tick's place along the line gives its segment and its point."""
    step = lambda a, b: F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"]))
    segment = lambda a, b: F.struct(a.alias("a"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"), step(a, b).alias("n"))
    parts = F.filter(F.zip_with(F.slice(pts, 1, F.size(pts) - 1), F.slice(pts, 2, F.size(pts) - 1), segment), lambda s: s["n"] > 0)
    length = lambda s: F.aggregate(s, F.lit(0), lambda t, x: t + x["n"])
    # every segment with the pixels before it
    based = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("s"), length(F.slice(s, 1, i)).alias("from")))

    def of(box: Column) -> Column:
        n = length(box["parts"]) + 1
        k = F.when(n <= least, n).otherwise(_tick_count(n, distance, least))
        index = F.concat(F.transform(F.sequence(F.lit(0), k - 2), lambda i: F.floor(i * ((n - 1) / (k - 1))).cast("int")), F.array(n - 1))

        def at(p: Column) -> Column:
            own = F.element_at(F.filter(box["based"], lambda b: (b["from"] < p) | (b["from"] == 0)), -1)
            place = lambda c: F.floor(own["s"]["a"][c] + own["s"]["d" + c].cast("long") * (p - own["from"]) / own["s"]["n"] + F.lit(0.5)).cast("int")
            return F.struct(place("x").alias("x"), place("y").alias("y"))

        return F.when(n == 1, F.slice(pts, 1, 1)).otherwise(F.transform(index, at))

    whole = lambda s: F.element_at(F.transform(F.array(F.struct(s.alias("parts"), based(s).alias("based"))), of), 1)
    origin = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    wide = lambda v: F.array_max(v) - F.array_min(v) + 1 > HUGE
    return F.when(wide(xs(pts)) | wide(ys(pts)), origin).otherwise(F.element_at(F.transform(F.array(parts), whole), 1))
