"""Spatial joins: point in polygon, nearest feature, densities in a disk, nearest cell, bounds."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from emberfield.functions.geometry import (
    line_segments,
    point_in_edges,
    ring_edges,
    segment_disk_length,  # noqa: F401  the disk sums of a box tree are made with it
    segment_position,
    signed_area,
    with_edge_disk_share,
)
from emberfield.operators.point_index import PointIndex, nearest_by_passes, numbered_queries
from emberfield.operators.regions import SEGMENT, deal, finite, inside_strips, length_in_disk, meet, nearest_segment
from emberfield.operators.spatial_index import (
    BoxTree,
    box_far_sq,
    build_tree,
    candidates,
    disk_parts,
    full_squares,
    in_full_square,
    nearest,
)
from emberfield.scale import BROADCAST_ROWS, as_large, cut_lineage, scalar_struct, ship_if_small, work_partitions

EDGES_PER_STRIP = 32
# Queries that are answered in passes over the cells; strips that each row is tested against without a join.
FEW_QUERIES = 2_000
ROW_STRIPS = 4_096
POLYGONS = ["Polygon", "MultiPolygon"]


def placed(c: str) -> Column:
    """The coordinate is there: neither null nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(c)


def _points(points: DataFrame, pid: str, x: str, y: str) -> DataFrame:
    return points.select(pid, F.col(x).alias("px"), F.col(y).alias("py")).filter(placed("px") & placed("py"))


def polygon_strips(polygons: DataFrame, keep: list[str], parts: str = "rings") -> DataFrame:
    """Cut polygons into horizontal strips that carry only the edges touching the strip, with the strip's box.

    The even-odd test needs no other edges, so its cost does not grow with the outline of a detailed polygon.
    """
    whole = polygons.select(*keep, ring_edges(parts).alias("_e"))
    lo = F.array_min(F.transform("_e", lambda e: F.least(e.ay, e.by)))
    hi = F.array_max(F.transform("_e", lambda e: F.greatest(e.ay, e.by)))
    # no edges, no strip; a filter on the edges would be moved down to the scan of the polygons, into its few tasks
    count = F.when(F.size("_e") > 0, F.greatest(F.ceil(F.size("_e") / F.lit(EDGES_PER_STRIP)), F.lit(1)).cast("int"))
    cut = (
        whole.withColumns({"_lo": lo, "_hi": hi, "_k": count})
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("_h", (F.col("_hi") - F.col("_lo")) / F.col("_k"))
        .withColumns(
            {
                "y0": F.when(F.col("_i") == 0, F.col("_lo")).otherwise(F.col("_lo") + F.col("_i") * F.col("_h")),
                "y1": F.when(F.col("_i") == F.col("_k") - 1, F.col("_hi")).otherwise(
                    F.col("_lo") + (F.col("_i") + 1) * F.col("_h")
                ),
            }
        )
    )
    y0, y1 = F.col("y0"), F.col("y1")
    edges = F.filter("_e", lambda e: (F.least(e.ay, e.by) <= y1) & (F.greatest(e.ay, e.by) >= y0))
    return (
        cut.withColumn("edges", edges)
        .filter(F.size("edges") > 0)
        .withColumns(
            {
                "x0": F.array_min(F.transform("edges", lambda e: F.least(e.ax, e.bx))),
                "x1": F.array_max(F.transform("edges", lambda e: F.greatest(e.ax, e.bx))),
            }
        )
        .select(*keep, "edges", "x0", "y0", "x1", "y1")
    )


def _containing(points: DataFrame, tree: BoxTree, predicate: str) -> DataFrame:
    px, py = F.col("px"), F.col("py")

    def holds(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return px.between(x0, x1) & py.between(y0, y1)

    start = points.repartition(work_partitions(points.sparkSession), points.columns[0])
    found = candidates(start, tree, holds)
    found = found.filter(holds(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    return found.filter(point_in_edges("px", "py", "edges", predicate))


def _first_containing(points: DataFrame, tree: BoxTree, x: str, y: str, predicate: str, order: str, keep: tuple[str, ...]) -> DataFrame:
    """The points with a struct ``_w`` of the first containing polygon's columns, found in each row by itself.

    The tree's leaves and their strips are one constant array: a row tests the leaves' boxes, opens those that hold it
    and takes the least of the strips that contain it. Nothing is joined or shuffled.
    """
    px, py = F.col(x), F.col(y)

    def holds(b: Column) -> Column:
        return px.between(b["x0"], b["x1"]) & py.between(b["y0"], b["y1"])

    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    strips = F.collect_list(F.struct(order, *keep, "edges", "x0", "y0", "x1", "y1")).alias("strips")
    leaves = tree.items.groupBy("_leaf").agg(*box, strips).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "strips"))).scalar()
    # a subquery may not stand inside an array function, so it is a column first
    opened = F.flatten(F.transform(F.filter("_leaves", holds), lambda b: b["strips"]))
    inside = F.filter(opened, lambda s: holds(s) & point_in_edges(px, py, s["edges"], predicate))
    first = F.array_min(F.transform(inside, lambda s: F.struct(s[order].alias(order), *[s[c].alias(c) for c in keep])))
    return points.withColumn("_leaves", leaves).withColumn("_w", first).drop("_leaves")


def within_join(
    points: DataFrame,
    wards: DataFrame,
    pid: str,
    x: str = "lon",
    y: str = "lat",
    predicate: str = "intersects",
    ward_cols: tuple[str, ...] = ("ward_id", "ward_name"),
    order: str = "ward_ord",
    row_strips: int = ROW_STRIPS,
) -> DataFrame:
    """Left outer point-in-polygon join, one row per point; where polygons overlap the first ward wins.

    While the wards' strips are few (``row_strips``, and a broadcast's worth of edges), every row finds its ward by
    itself; beyond that, points and strips meet through the tree's joins.
    """
    strips = cut_lineage(polygon_strips(wards, [order, *ward_cols]))
    count, edges = strips.agg(F.count(F.lit(1)), F.sum(F.size("edges"))).first()
    tree = build_tree(strips, [order], size=F.size("edges"))
    if tree.tops is None:
        kinds = dict(wards.dtypes)
        return points.withColumns({c: F.lit(None).cast(kinds[c]) for c in ward_cols})
    if count <= row_strips and edges <= BROADCAST_ROWS:
        found = _first_containing(points, tree, x, y, predicate, order, ward_cols)
        return found.select(*points.columns, *[F.col("_w")[c].alias(c) for c in ward_cols])
    # rows are told apart by a number of their own, so that repeated point ids stay apart
    held = cut_lineage(points.withColumn("_own", F.monotonically_increasing_id()))
    hits = _containing(_points(held, "_own", x, y), tree, predicate)
    first = hits.groupBy("_own").agg(F.min(F.struct(order, *ward_cols)).alias("_w"))
    return held.join(first, "_own", "left").select(*points.columns, *[F.col(f"_w.{c}").alias(c) for c in ward_cols])


def feature_segments(features: DataFrame, fid: str = "feature_id", parts: str = "parts") -> DataFrame:
    """One row per segment of the features' lines, outlines and points, with its box."""
    lines = F.when(F.col("geom_type").isin(*POLYGONS), ring_edges(parts)).otherwise(line_segments(parts))
    return features.select(fid, F.inline(lines)).withColumns(
        {
            "x0": F.least("ax", "bx"), "y0": F.least("ay", "by"),
            "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by"),
        }
    )


def segment_boxes(segments: DataFrame) -> DataFrame:
    return segments.withColumns(
        {
            "x0": F.least("ax", "bx"), "y0": F.least("ay", "by"),
            "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by"),
        }
    )


def with_segment_distance(df: DataFrame) -> DataFrame:
    """Add ``_d``, the squared distance of (px, py) from the segment.

    The position along the segment goes through a one-element explode: a later filter on the distance can then
    not be pushed below it, which would repeat the position's formula inside join conditions.
    """
    at = df.withColumn("_t", F.explode(F.array(segment_position("px", "py", "ax", "ay", "bx", "by"))))
    ex = F.col("px") - (F.col("ax") + F.col("_t") * (F.col("bx") - F.col("ax")))
    ey = F.col("py") - (F.col("ay") + F.col("_t") * (F.col("by") - F.col("ay")))
    return at.withColumn("_d", ex * ex + ey * ey)


def segment_pieces(segments: DataFrame) -> DataFrame:
    """The segments, a long one once per piece with the piece's box: where many lie in little space, boxes of whole
    segments overlap so much that a point would meet a number of them that grows with the table.

    Pieces are about two mean spacings long, and at least an eighth of the mean length: at most nine rows a segment on
    the average. Each carries the whole segment, so distances are those of the segment.
    """
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    n, total, w, e, s, t = segments.agg(
        F.count(length), F.sum(length), F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")
    ).first()
    if not n or not total or not math.isfinite(total) or not all(map(math.isfinite, (w, e, s, t))):
        return segments
    longest = max(2 * math.sqrt((e - w) * (t - s) / n), total / n / 8)
    k = F.greatest(F.ceil(length / F.lit(longest)), F.lit(1)).cast("int")
    # rounding may put a piece's end beside the segment
    pad = (F.abs("ax") + F.abs("ay") + F.abs("bx") + F.abs("by")) * F.lit(1e-12)
    rows = segments.withColumn("_k", F.coalesce(k, F.lit(1)))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))

    def end(a: str, b: str, i: Column) -> Column:
        return F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_k"))

    boxes = {}
    for a, b, low, high in (("ax", "bx", "x0", "x1"), ("ay", "by", "y0", "y1")):
        here, there = end(a, b, F.col("_i")), end(a, b, F.col("_i") + 1)
        boxes[low] = F.when(F.col("_k") == 1, F.col(low)).otherwise(F.least(here, there) - pad)
        boxes[high] = F.when(F.col("_k") == 1, F.col(high)).otherwise(F.greatest(here, there) + pad)
    return rows.withColumns(boxes).drop("_k", "_i")


def _crosses(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The segment (ax, ay, bx, by) meets the box: their extents do, and the box isn't on one side of the line."""
    ax, ay, bx, by = (F.col(c) for c in SEGMENT)
    over = (F.least(ax, bx) <= x1) & (F.greatest(ax, bx) >= x0) & (F.least(ay, by) <= y1) & (F.greatest(ay, by) >= y0)
    dx, dy, wide, high = F.abs(bx - ax), F.abs(by - ay), x1 / 2 - x0 / 2, y1 / 2 - y0 / 2
    sx, sy = x0 / 2 + x1 / 2 - ax, y0 / 2 + y1 / 2 - ay
    reach = dx * (high + F.abs(sy) * F.lit(1e-9)) + dy * (wide + F.abs(sx) * F.lit(1e-9))
    return over & (F.abs((bx - ax) * sy - (by - ay) * sx) <= reach)


def _array(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in names], axis=1)


def _measured(places: DataFrame, *more: Column) -> Row:
    """Number and extent of the places ``_x``, ``_y`` that are not null."""
    ends = [F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y")]
    return places.agg(F.count("_x"), *ends, *more).first()


def nearest_segments(points: DataFrame, segments: DataFrame, pid: str, fid: str) -> DataFrame:
    """``pid``, ``dist_m`` and the nearest feature's id (smallest id on a tie), for points with px, py, one row per id.

    Points without coordinates are left out. The points are read twice, and have to be the same then.
    """
    points = points.select(pid, *[F.col(c).cast("double").alias(c) for c in ("px", "py")])
    kind = dict(segments.dtypes)[fid]
    held = segments.filter(finite(*SEGMENT)).select(*SEGMENT, F.col(fid).alias("_fid"))
    known, *extent, least = _measured(held.withColumnsRenamed({"ax": "_x", "ay": "_y"}), F.min("_fid"))
    if not known:
        none = points.select(pid, F.lit(None).cast("double").alias("dist_m"), F.lit(None).cast(kind).alias(fid))
        return none if segments.isEmpty() else none.limit(0)
    regions = deal(points, "px", "py", held.select(F.col("ax").alias("_x"), F.col("ay").alias("_y")), tuple(extent))

    def nearest(px: np.ndarray, py: np.ndarray, items: pa.Table) -> dict[str, pa.Array]:
        items = items.take(pc.sort_indices(items, sort_keys=[("_fid", "ascending")], null_placement="at_start"))
        near, at = nearest_segment(px, py, _array(items, SEGMENT))
        none = at < 0
        return {"_d": pa.array(near, mask=none), "_fid": items["_fid"].combine_chunks().take(pa.array(at, mask=none))}

    found = meet(points, "px", "py", held, _crosses, regions, nearest, {"_d": DoubleType(), "_fid": segments.schema[fid].dataType})
    # nothing is nearer to a point at infinity
    beyond = F.col("_d").isNull()
    found = found.filter(placed("px") & placed("py")).select(
        pid, F.coalesce("_d", F.lit(float("inf"))).alias("_d"), F.when(beyond, F.lit(least).cast(kind)).otherwise(F.col("_fid")).alias("_fid")
    )
    best = found.groupBy(pid).agg(F.min(F.struct("_d", "_fid")).alias("_m"))
    return best.select(pid, F.sqrt("_m._d").alias("dist_m"), F.col("_m._fid").alias(fid))


def _feature_items(features: DataFrame) -> DataFrame:
    """What distances are measured to: segments of lines (``_c`` null) and strips of polygons with their edges (``_c``, four
    numbers an edge); ax to by is the first edge, ``_x0`` to ``_y1`` the box and ``_fill`` whether it has an inside."""
    polygon = F.coalesce(F.col("geom_type").isin(*POLYGONS), F.lit(False))
    box = ["x0", "y0", "x1", "y1"]
    strips = polygon_strips(features.filter(polygon), [], "parts")
    strips = strips.withColumn("edges", F.filter("edges", lambda e: finite(e.ax, e.ay, e.bx, e.by))).filter(F.size("edges") > 0)
    whole = finite(*box)

    def bound(c: str, end: Callable[[Column], Column], pick: Callable[[Column, Column], Column], a: str, b: str) -> Column:
        rest = end(F.transform("edges", lambda e: pick(e[a], e[b])))
        return F.when(whole, F.col(c)).otherwise(rest).alias(f"_{c}")

    low, high = (F.array_min, F.least), (F.array_max, F.greatest)
    bounds = [bound(c, *how, *ends) for c, how, ends in zip(box, (low, low, high, high), (("ax", "bx"), ("ay", "by")) * 2)]
    numbers = F.flatten(F.transform("edges", lambda e: F.array(e.ax, e.ay, e.bx, e.by)))
    filled = strips.select(*[F.col("edges")[0][c].alias(c) for c in SEGMENT], numbers.alias("_c"), whole.alias("_fill"), *bounds)
    lines = features.filter(~polygon).select(F.inline(line_segments("parts"))).filter(finite(*SEGMENT))
    lines = segment_boxes(lines).select(
        *SEGMENT, F.lit(None).cast("array<double>").alias("_c"), F.lit(False).alias("_fill"), *[F.col(c).alias(f"_{c}") for c in box]
    )
    return filled.unionByName(lines)


def _feature_places(features: DataFrame) -> DataFrame:
    """One place ``_x``, ``_y`` on each feature: the start of its first edge, or of the first whole one; null without any."""
    polygon = F.coalesce(F.col("geom_type").isin(*POLYGONS), F.lit(False))
    run = F.get(F.filter("parts", lambda r: F.size(r) >= F.when(polygon, 3).otherwise(1)), F.lit(0))
    a, b = F.get(run, F.lit(0)), F.get(run, F.lit(1))
    simple = finite(a.x, a.y) & (finite(b.x, b.y) | (F.size(run) == 1))
    edges = F.when(polygon, ring_edges("parts")).otherwise(line_segments("parts"))
    first = F.get(F.filter(edges, lambda e: finite(e.ax, e.ay, e.bx, e.by)), F.lit(0))
    at = F.when(simple, F.struct(a.x.alias("_x"), a.y.alias("_y"))).otherwise(F.struct(first.ax.alias("_x"), first.ay.alias("_y")))
    return features.select(at.alias("_at")).select("_at._x", "_at._y")


def _feature_distance_sq(px: np.ndarray, py: np.ndarray, items: pa.Table) -> dict[str, pa.Array]:
    """``_d``: 0 in a polygon, or the squared distance from the nearest outline or line; null where there is none."""
    line = items["_c"].is_null().combine_chunks()
    segments = _array(items.filter(line), SEGMENT)
    strips = items.filter(pc.invert(line))
    lists = strips["_c"].combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // 4
    edges = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    first = np.cumsum(size) - size
    box = _array(strips, ["_x0", "_y0", "_x1", "_y1"])
    box[~strips["_fill"].combine_chunks().to_numpy(zero_copy_only=False)] = np.nan  # holds no point
    near = np.zeros(len(px))
    outside = np.flatnonzero(~inside_strips(px, py, box, edges, first))
    near[outside], _ = nearest_segment(px[outside], py[outside], np.concatenate([segments, edges]))
    return {"_d": pa.array(near, mask=np.isinf(near))}


def nearest_join(
    points: DataFrame,
    features: DataFrame,
    pid: str,
    out: str = "dist_m",
    x: str = "x_m",
    y: str = "y_m",
    max_dist: float | None = None,
    fid: str = "feature_id",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left outer nearest join: planar distance to the nearest feature, 0 inside a polygon, null for no feature
    (or none within ``max_dist``). ``features``: feature id, geom_type, parts.

    Every row keeps its columns and is moved once. The points' places are read once before that, from ``counted`` where
    the same points are at hand in a cheaper form.
    """
    items = _feature_items(features)
    dist = F.sqrt("_d")
    at = _feature_places(features)
    known, *extent = _measured(at)
    if not known:
        return points.withColumn(out, F.lit(None).cast("double"))
    regions = deal(points if counted is None else counted, x, y, at, tuple(extent), most=max_dist)

    def near(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        over = (F.col("_x0") <= x1) & (F.col("_x1") >= x0) & (F.col("_y0") <= y1) & (F.col("_y1") >= y0)
        return over & (F.col("_c").isNotNull() | _crosses(x0, y0, x1, y1))

    found = meet(points, x, y, items, near, regions, _feature_distance_sq, {"_d": DoubleType()})
    # nothing is nearer to a point at infinity
    dist = F.when(placed(x) & placed(y) & ~finite(x, y), F.lit(float("inf"))).otherwise(dist)
    if max_dist is not None:
        dist = F.when(dist <= F.lit(max_dist), dist)
    return found.select(*points.columns, dist.alias(out))


def within_areas(points: DataFrame, areas: DataFrame, buffer_m: float, key: str = "area_id", x: str = "x_m", y: str = "y_m", rings: str = "rings") -> DataFrame:
    """The points inside any of the polygons or within the buffer of an outline, with the least ``key`` of those.

    Outlines and strips are two box trees; a point goes down only where the inflated boxes hold it, so any number of
    polygons may be given and none is attached to a row. Repeated points stay apart; unplaced points are left out.
    """
    held = cut_lineage(points.withColumn("_own", F.monotonically_increasing_id()))
    pts = _points(held, "_own", x, y)
    px, py, reach = F.col("px"), F.col("py"), F.lit(float(buffer_m))
    outlines = build_tree(segment_boxes(areas.select(key, F.inline(ring_edges(rings)))), [key], costly=True)
    if outlines.tops is None:
        return points.limit(0).withColumn(key, F.lit(None).cast(dict(areas.dtypes)[key]))

    def near(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return px.between(x0 - reach, x1 + reach) & py.between(y0 - reach, y1 + reach)

    start = pts.repartition(work_partitions(points.sparkSession), "_own")
    close = with_segment_distance(candidates(start, outlines, near)).filter(F.col("_d") <= reach * reach).select("_own", key)
    strips = build_tree(polygon_strips(areas, [key], rings), [key], size=F.size("edges"), costly=True)
    found = close.unionByName(_containing(pts, strips, "intersects").select("_own", key)).groupBy("_own").agg(F.min(key).alias(key))
    return held.join(found, "_own").select(*points.columns, key)


def with_disk_length(
    points: DataFrame, segments: DataFrame, r: float, out: str, x: str = "px", y: str = "py", counted: DataFrame | None = None
) -> DataFrame:
    """The points with ``out``, the length of all segments inside their disk; null if there are no segments at all.

    Every row keeps its columns and is moved once; ``counted`` as in ``nearest_join``.
    """
    held = segments.filter(finite(*SEGMENT)).select(*SEGMENT)
    at = held.select(F.col("ax").alias("_x"), F.col("ay").alias("_y"))
    known, *extent = _measured(at)
    if not known:
        return points.withColumn(out, F.lit(None if segments.isEmpty() else 0.0).cast("double"))
    regions = deal(points if counted is None else counted, x, y, at, tuple(extent), reach=r)

    def lengths(px: np.ndarray, py: np.ndarray, items: pa.Table) -> dict[str, pa.Array]:
        return {out: pa.array(length_in_disk(px, py, _array(items, SEGMENT), r))}

    return meet(points, x, y, held, _crosses, regions, lengths, {out: DoubleType()})


def density_of_length(length: Column, r: float) -> Column:
    """Kilometres per square kilometre of the disk, from metres inside it."""
    return length / F.lit(1000.0) / F.lit(math.pi * r * r / 1e6)


def line_density(points: DataFrame, segments: DataFrame, pid: str, r: float, empty: float | None = None) -> DataFrame:
    """Kilometres of line per square kilometre inside the disk: ``pid``, ``line_density``; lengths of rows with the same
    id are added up.

    Segments: ax, ay, bx, by (+ an id). With no segments at all the result is ``empty``. The points are read twice, and
    have to be the same then.
    """
    points = points.select(pid, *[F.col(c).cast("double").alias(c) for c in ("px", "py")])
    if segments.isEmpty():
        return points.select(pid, F.lit(empty).cast("double").alias("line_density"))
    sums = with_disk_length(points, segments, r, "_length").groupBy(pid).agg(F.sum("_length").alias("_length"))
    return sums.select(pid, density_of_length(F.col("_length"), r).alias("line_density"))


def area_density(points: DataFrame, polygons: DataFrame, pid: str, r: float, empty: float | None = None) -> DataFrame:
    """Share of the disk covered by polygons, overlaps counted twice, at most 1: ``pid``, ``area_density``.

    Polygons: ``parts`` wound consistently (outlines one way, holes the other) + an id. Only polygons cut by the
    circle are opened into edges; the edge formula then runs in generated code.

    Where polygons wholly inside the disk already add up to its area, the share is 1 and the rest isn't looked at. So a
    point meets no more polygons than fill about a disk, however many lie on one another.
    """
    turned = F.transform(
        "edges", lambda e: F.struct(e.bx.alias("ax"), e.by.alias("ay"), e.ax.alias("bx"), e.ay.alias("by"))
    )
    items = polygons.select(ring_edges("parts").alias("edges"), signed_area("parts").alias("_signed"))
    items = items.filter(F.size("edges") > 0).select(
        F.when(F.col("_signed") < 0, turned).otherwise(F.col("edges")).alias("edges"), F.abs("_signed").alias("area")
    )
    items = items.withColumns(
        {
            "x0": F.array_min(F.transform("edges", lambda e: F.least(e.ax, e.bx))),
            "y0": F.array_min(F.transform("edges", lambda e: F.least(e.ay, e.by))),
            "x1": F.array_max(F.transform("edges", lambda e: F.greatest(e.ax, e.bx))),
            "y1": F.array_max(F.transform("edges", lambda e: F.greatest(e.ay, e.by))),
        }
    )
    tree = build_tree(items, ["x0", "y0", "x1", "y1", "area"], sums=["area"], size=F.size("edges"), costly=True)
    if tree.tops is None:
        return points.select(pid, F.lit(empty).cast("double").alias("area_density"))
    px, py, box = F.col("px"), F.col("py"), [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    limit, disk = F.lit(r * r), math.pi * r * r
    full = full_squares(tree, r, "area", disk * (1 + 1e-9))
    known = None
    if full is not None:
        points, known = in_full_square(points.select(pid, "px", "py"), full, r), F.when(F.col("_full"), F.lit(disk))
    inside = box_far_sq(px, py, *box) <= limit
    cut = F.col("_sum").isNull() & ~inside
    parts = disk_parts(points, tree, pid, r, "area", known).select(
        pid, "px", "py",
        F.coalesce(F.col("_sum"), F.when(inside, F.col("area")), F.lit(0.0)).alias("_whole"),
        F.when(cut, F.col("edges")).alias("_edges"),
    )
    # an uncut entry stays one row; a cut polygon becomes one row per edge
    rows = parts.select(pid, "px", "py", "_whole", F.expr("inline_outer(_edges)"))
    shares = with_edge_disk_share(rows, r)
    sums = shares.groupBy(pid).agg(F.sum(F.coalesce("share", "_whole")).alias("value"))
    value = F.greatest(F.col("value") / F.lit(disk), F.lit(0.0))
    return sums.select(pid, F.least(value, F.lit(1.0)).alias("area_density"))


def nearest_cell(
    queries: DataFrame, cells: DataFrame | PointIndex, qid: str = "qid", cell_id: str = "cell_id", carry: tuple[str, ...] = (),
    few: int = FEW_QUERIES,
) -> DataFrame:
    """For each query the cell at the smallest squared degree distance; lowest cell id on a tie; cells without
    coordinates (null or NaN) are skipped. Output, one row per placed query: ``qid``, ``cell_id``, ``d2`` and the carried
    cell columns.

    A kept index is read only in the nodes that can hold an answer. Up to ``few`` queries are answered in passes over
    the cells without moving them; for more, the cells are put into a box tree.
    """
    asked = numbered_queries(queries, qid)
    if isinstance(cells, PointIndex):
        near = cells.nearest(asked, carry)
    elif (rows := asked.count()) <= few:
        near = nearest_by_passes(asked, cells, cell_id, carry)
    else:
        held = cells.filter(placed("lat") & placed("lon")).select(
            cell_id, F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.col("lon").alias("x1"),
            F.col("lat").alias("y1"),
        )
        tree = build_tree(held, [cell_id])
        dx, dy = F.col("x0") - F.col("px"), F.col("y0") - F.col("py")
        points = asked.select("_own", F.col("qx").alias("px"), F.col("qy").alias("py"))
        near = nearest(points, tree, "_own", lambda df: df.withColumn("_d", dy * dy + dx * dx), tie=[cell_id], rows=rows)
        near = near.withColumnRenamed("dist_sq", "d2")
        near = ship_if_small(near, rows).join(cells.select(cell_id, *carry), cell_id) if carry else near
    return asked.select("_own", qid).join(near, "_own").select(qid, cell_id, "d2", *[c for c in carry if c not in (qid, cell_id, "d2")])


def bbox_filter(df: DataFrame | PointIndex, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows inside the closed rectangle. A kept index reads only the files and row groups that can hold them."""
    if isinstance(df, PointIndex):
        return df.in_box(west, south, east, north)
    return df.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def study_bounds(df: DataFrame, pad: str = "module") -> DataFrame:
    """Padded extent in one row. ``buffer``: 0.02 degrees; ``module``: 0.01; ``viewport``: 4 % of the span, at
    least 0.01."""
    g = df.agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")
    )
    if pad == "viewport":
        px = F.greatest((F.col("e") - F.col("w")) * F.lit(0.04), F.lit(0.01))
        py = F.greatest((F.col("n") - F.col("s")) * F.lit(0.04), F.lit(0.01))
    else:
        px = py = F.lit(0.02 if pad == "buffer" else 0.01)
    return g.select(
        (F.col("w") - px).alias("min_lon"), (F.col("s") - py).alias("min_lat"),
        (F.col("e") + px).alias("max_lon"), (F.col("n") + py).alias("max_lat"),
    )


def study_bounds_columns(df: DataFrame, pad: str = "viewport") -> dict[str, Column]:
    """The same bounds as scalar columns, to be used in row expressions."""
    names = ["min_lon", "min_lat", "max_lon", "max_lat"]
    g = scalar_struct(study_bounds(df, pad), {n: F.first(n) for n in names})
    return {n: g[n] for n in names}
