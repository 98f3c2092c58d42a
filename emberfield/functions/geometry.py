"""Planar geometry in closed form, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions.bands import _c

# WGS84 ellipsoid and transverse Mercator series (third flattening n, semi-major axis a, scale k0).
_N = 1.6792203863837047e-3
_A = 6378137.0
_K0 = 0.9996


def to_utm(lon, lat, zone: int = 43) -> tuple[Column, Column]:
    """(easting, northing) in metres on the northern hemisphere, third-order Krueger series."""
    n = _N
    k = 2 * n**0.5 / (1 + n)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    phi = F.radians(_c(lat))
    lam = F.radians(_c(lon) - F.lit(float(zone * 6 - 183)))
    sin_phi = F.sin(phi)
    t = F.sinh(F.atanh(sin_phi) - F.lit(k) * F.atanh(F.lit(k) * sin_phi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        north = north + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    scale = F.lit(_K0 * radius)
    return F.lit(500000.0) + scale * east, scale * north


def segment_distance_sq(px, py, ax, ay, bx, by) -> Column:
    """Squared distance of a point from a segment (a point if both ends agree)."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    along = (px - ax) * dx + (py - ay) * dy
    t = F.when(length > 0, F.least(F.greatest(F.try_divide(along, length), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def segment_position(px, py, ax, ay, bx, by) -> Column:
    """Where along the segment (0 to 1) its nearest place to the point lies."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / length
    return F.when(length > 0, F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def segment_disk_length(px, py, ax, ay, bx, by, r: float) -> Column:
    """Length of the part of a segment inside the disk of radius ``r`` around the point."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    sx, sy = ax - px, ay - py
    a = dx * dx + dy * dy
    b = F.lit(2.0) * (sx * dx + sy * dy)
    disc = b * b - F.lit(4.0) * a * (sx * sx + sy * sy - F.lit(r * r))
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    t1 = F.try_divide(-b - root, F.lit(2.0) * a)
    t2 = F.try_divide(-b + root, F.lit(2.0) * a)
    part = F.least(F.lit(1.0), t2) - F.greatest(F.lit(0.0), t1)
    return F.when((a > 0) & (disc > 0), F.sqrt(a) * F.greatest(part, F.lit(0.0))).otherwise(0.0)


def _edges(ring: Column) -> Column:
    """(a, b) pairs of consecutive ring points; the ring is closed if its last point differs from the first."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    closed = F.when((first.x == last.x) & (first.y == last.y), ring).otherwise(F.concat(ring, F.array(first)))
    n = F.size(closed)
    return F.zip_with(
        F.slice(closed, F.lit(1), n - 1),
        F.slice(closed, F.lit(2), n - 1),
        lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")),
    )


def ring_edges(parts) -> Column:
    """All edges of all rings of a polygon (outer rings, holes, further parts alike)."""
    usable = F.filter(_c(parts), lambda r: F.size(r) >= 3)
    return F.flatten(F.transform(usable, _edges))


def line_segments(parts) -> Column:
    """Segments of open lines; a single point becomes a segment of no length."""

    def pairs(line: Column) -> Column:
        n = F.size(line)
        p = F.element_at(line, 1)
        dot = F.array(F.struct(p.x.alias("ax"), p.y.alias("ay"), p.x.alias("bx"), p.y.alias("by")))
        run = F.zip_with(
            F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))),
            F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")),
        )
        return F.when(n == 1, dot).otherwise(run)

    usable = F.filter(_c(parts), lambda r: F.size(r) >= 1)
    return F.flatten(F.transform(usable, pairs))


def ring_area(ring) -> Column:
    """Signed area (counter-clockwise positive)."""
    return F.aggregate(
        _edges(_c(ring)), F.lit(0.0), lambda s, e: s + (e.ax * e.by - e.bx * e.ay) / F.lit(2.0)
    )


def signed_area(parts) -> Column:
    """Sum of the signed ring areas: outlines one way, holes the other."""
    return F.aggregate(_c(parts), F.lit(0.0), lambda s, r: s + ring_area(r))


def parts_area(parts) -> Column:
    """Area of a polygon whose holes are wound opposite to its outlines."""
    return F.abs(signed_area(parts))


def normalise_rings(polygons: Column) -> Column:
    """Flatten polygons (arrays of rings, outline first) so that outlines run counter-clockwise and holes clockwise."""

    def wound(ring: Column, i: Column) -> Column:
        area = ring_area(ring)
        wrong = ((i == 0) & (area < 0)) | ((i > 0) & (area > 0))
        return F.when(wrong, F.reverse(ring)).otherwise(ring)

    return F.flatten(F.transform(polygons, lambda rings: F.transform(rings, wound)))


def on_edge(px, py, edges) -> Column:
    """The point lies exactly on one of the edges."""
    px, py = _c(px), _c(py)

    def hit(e: Column) -> Column:
        cross = (e.bx - e.ax) * (py - e.ay) - (e.by - e.ay) * (px - e.ax)
        inside_x = px.between(F.least(e.ax, e.bx), F.greatest(e.ax, e.bx))
        inside_y = py.between(F.least(e.ay, e.by), F.greatest(e.ay, e.by))
        return (cross == 0) & inside_x & inside_y

    return F.exists(_c(edges), hit)


def crossings(px, py, edges) -> Column:
    """Number of edges crossed by the ray from the point toward +x."""
    px, py = _c(px), _c(py)

    def crossed(e: Column) -> Column:
        spans = (e.ay > py) != (e.by > py)
        at = F.try_divide((e.bx - e.ax) * (py - e.ay), e.by - e.ay) + e.ax
        return F.when(spans, px < at).otherwise(False)

    return F.size(F.filter(_c(edges), crossed))


def point_in_edges(px, py, edges, predicate: str = "intersects") -> Column:
    """Even-odd test; a point on the boundary counts for ``intersects`` and not for ``within``."""
    odd = crossings(px, py, edges) % 2 == 1
    edge = on_edge(px, py, edges)
    return (edge | odd) if predicate == "intersects" else (~edge & odd)


def with_edge_disk_share(df: DataFrame, r: float, out: str = "share") -> DataFrame:
    """Add the signed share of the boundary edge (ax, ay, bx, by) in the area common to its polygon and the disk
    of radius ``r`` around (px, py); null for rows without an edge.

    The edge contributes its circular sectors outside the disk and its triangle inside; summed over the closed
    boundary this is the common area, positive for outlines wound counter-clockwise (holes subtract). Intermediate
    values are columns of their own, so that each is computed once and the generated code stays small.
    """
    c = F.col
    dot = lambda a, b: c(f"{a}x") * c(f"{b}x") + c(f"{a}y") * c(f"{b}y")
    cross = lambda a, b: c(f"{a}x") * c(f"{b}y") - c(f"{a}y") * c(f"{b}x")
    kept = df.columns
    local = df.withColumns(
        {"_sx": c("ax") - c("px"), "_sy": c("ay") - c("py"), "_tx": c("bx") - c("px"), "_ty": c("by") - c("py"),
         "_dx": c("bx") - c("ax"), "_dy": c("by") - c("ay")}
    )
    quad = local.withColumns({"_a": dot("_d", "_d"), "_b": dot("_s", "_d"), "_c": dot("_s", "_s") - F.lit(r * r)})
    disc = quad.withColumn("_disc", c("_b") * c("_b") - c("_a") * c("_c"))
    live = (c("_a") > 0) & (c("_disc") > 0)
    roots = disc.withColumn("_q", F.when(live, F.sqrt("_disc")))

    def inside(t: Column) -> Column:
        return F.coalesce(F.least(F.greatest(t / c("_a"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))

    cut = roots.withColumns(
        {
            "_s1": F.when(c("_q").isNotNull(), inside(-c("_b") - c("_q"))).otherwise(0.0),
            "_s2": F.when(c("_q").isNotNull(), inside(-c("_b") + c("_q"))).otherwise(0.0),
        }
    )
    ends = cut.withColumns(
        {
            "_ux": c("_sx") + c("_s1") * c("_dx"), "_uy": c("_sy") + c("_s1") * c("_dy"),
            "_vx": c("_sx") + c("_s2") * c("_dx"), "_vy": c("_sy") + c("_s2") * c("_dy"),
        }
    )
    sectors = F.atan2(cross("_s", "_u"), dot("_s", "_u")) + F.atan2(cross("_v", "_t"), dot("_v", "_t"))
    share = F.lit(r * r / 2.0) * sectors + cross("_u", "_v") / F.lit(2.0)
    return ends.select(*kept, share.alias(out))
