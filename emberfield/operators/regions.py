"""Points dealt into compact regions, each met by the items in its reach: a join that moves every point once.

Points and items are counted in the cells of a quadtree, and full cells are counted again in smaller ones. Runs of
neighbouring cells along the Hilbert curve are regions of bounded numbers of points and items. Points and the items that
can matter to a region go to one task, where numpy halves the points again and again and keeps, for each half, only the
items near it. So what is moved grows with points and items, not with the pairs of them that are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from emberfield.operators.spatial_index import build_tree, candidates, with_curve
from emberfield.scale import ship_package, work_partitions

LEVELS = 20
# Levels of the first cells, and by which full cells are cut. Inside the items' extent there are 4^(FIRST_LEVEL - 1).
FIRST_LEVEL = 9
STEP = 3
# Least bounds of points and items in a cell; they grow with the table, so that there are at most some CELLS full cells.
CELL_POINTS = 1_024
CELL_ITEMS = 1_024
CELLS = 16_384
REGION_POINTS = 16_384
REGION_ITEMS = 32_768
# Points (or pairs of points and items) that are compared without halving the points; most pairs at a time.
LEAF = 32
LEAF_PAIRS = 16_384
PAIRS = 1 << 20
LOST = -(1 << 62)
SEGMENT = ["ax", "ay", "bx", "by"]


def finite(*cols: str | Column) -> Column:
    """None of the values is null, NaN or infinite."""
    known = F.lit(True)
    for c in cols:
        known = known & F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))
    return known


# --------------------------------------------------------------------------------------------------
# regions
# --------------------------------------------------------------------------------------------------


@dataclass
class Regions:
    """Which region the points of a cell belong to, and the regions' boxes, plain and with the points' reach around them."""

    extent: tuple[float, float, float, float]
    tables: list[tuple[int, pa.Table]]  # level; cell, its (first) region, number of regions
    plain: np.ndarray
    reached: np.ndarray


def _on_curve(df: DataFrame, x: str, y: str, extent: tuple[float, float, float, float]) -> DataFrame:
    """Add ``_curve``. The extent has the inner half of each axis; what lies beyond is squeezed into the outer halves, so
    that places at any distance can be told apart."""
    w, s, e, n = extent

    def squeezed(v: str, low: float, high: float) -> Column:
        half = (high / 2 - low / 2) or 1.0
        t = (F.col(v) - F.lit(low / 2 + high / 2)) / F.lit(half)
        return F.when(F.abs(t) <= 1, t / 2).when(finite(v), F.signum(t) * (F.lit(1.0) - F.lit(0.5) / F.abs(t)))

    return with_curve(df, squeezed(x, w, e), squeezed(y, s, n), -1.0, 1.0, -1.0, 1.0, LEVELS)


def _cell(level: int) -> Column:
    return F.shiftright("_curve", 2 * (LEVELS - level))


def _counted(coded: DataFrame, level: int, full: tuple[int, np.ndarray] | None) -> dict[str, np.ndarray]:
    """Cells in order with their rows, bounds and one of their places; only those inside ``full`` cells of a level above."""
    if full is not None:
        inside = coded.sparkSession.createDataFrame(pa.table({"_full": full[1]}))
        coded = coded.join(F.broadcast(inside), _cell(full[0]) == F.col("_full"), "left_semi")
    x, y = F.col("_x"), F.col("_y")
    # places that are null are left out at the end: a filter would be moved down to the scan, and run in its few tasks
    table = coded.groupBy(F.when(x.isNotNull(), _cell(level)).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"),
        F.first(x).alias("x"), F.first(y).alias("y"),
    )
    table = table.toArrow().filter(pc.field("cell").is_valid()).sort_by("cell")
    return {c: table[c].to_numpy() for c in table.column_names}


def deal(
    points: DataFrame, x: str, y: str, items: DataFrame, extent: tuple[float, float, float, float],
    reach: float | None = None, most: float | None = None, region_points: int = REGION_POINTS,
    region_items: int = REGION_ITEMS, cell_points: int = CELL_POINTS, cell_items: int = CELL_ITEMS,
) -> Regions:
    """Regions of the finite points. ``items``: one place ``_x``, ``_y`` on each (or null), inside ``extent`` (west, south,
    east, north). Points reach ``reach`` far or, without it, to the nearest item (``most`` at most)."""
    placed = points.filter(finite(x, y)).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    asked, known = _on_curve(placed, "_x", "_y", extent), _on_curve(items, "_x", "_y", extent)
    done, anchors, start, spots = [], [], [], []
    level, full = FIRST_LEVEL, None
    while True:
        p, i = _counted(asked, level, full), _counted(known, level, full)
        anchors.append(np.stack([i["x"], i["y"]], 1))
        at = np.searchsorted(i["cell"], p["cell"])
        at[at == len(i["cell"])] = 0
        beside = np.where(i["cell"][at] == p["cell"], i["n"][at], 0) if len(i["cell"]) else np.zeros(len(at), np.int64)
        if full is None:
            total = int(p["n"].sum())
            bounds = max(cell_points, total // CELLS), max(cell_items, int(i["n"].sum()) // CELLS)
            # enough regions for all tasks
            region_points = min(region_points, max(1_024, total // (2 * work_partitions(points.sparkSession))))
        heavy = ((p["n"] > bounds[0]) | (beside > bounds[1])) & (level < LEVELS)
        done.append((level, {c: v[~heavy] for c, v in p.items()}))
        # each item is counted in one cell only: the smallest that was counted
        light = ~np.isin(i["cell"], p["cell"][heavy])
        start.append(i["cell"][light] << 2 * (LEVELS - level))
        spots.append(i["n"][light])
        if not heavy.any():
            break
        full, level = (level, p["cell"][heavy]), min(level + STEP, LEVELS)
    cells = {c: np.concatenate([d[c] for _, d in done]) for c in ("n", "x0", "y0", "x1", "y1")}
    levels = np.concatenate([np.full(len(d["cell"]), lv) for lv, d in done])
    first = np.concatenate([d["cell"] << 2 * (LEVELS - lv) for lv, d in done])
    order = np.argsort(first, kind="stable")
    start, spots = np.concatenate(start), np.concatenate(spots)
    along = np.argsort(start, kind="stable")
    upto = np.concatenate([[0], np.cumsum(spots[along])])
    ends = first + (np.int64(1) << 2 * (LEVELS - levels))
    low, high = upto[np.searchsorted(start[along], first)], upto[np.searchsorted(start[along], ends)]
    region, parts, last = np.zeros(len(order), np.int64), np.ones(len(order), np.int64), -1
    held, since = region_points + 1, 0
    for c in order.tolist():
        n = int(cells["n"][c])
        if held + n > region_points or high[c] - since > region_items:
            last, held, since = last + 1, 0, low[c]
        region[c] = last
        held += n
        if n > region_points:  # many points in one place
            parts[c] = -(-n // region_points)
            last += parts[c] - 1
    box = np.stack([cells[c] for c in ("x0", "y0", "x1", "y1")], 1)
    far = np.full(len(box), reach) if reach is not None else _reach(box, np.concatenate(anchors), most)
    away = far[:, None] * np.array([-1, -1, 1, 1])
    # rounding may put an item that is just in reach beside the box
    away *= 1 + 1e-9
    away += np.abs(box) * 1e-12 * np.array([-1, -1, 1, 1])
    plain, reached = np.full((last + 1, 4), np.nan), np.full((last + 1, 4), np.nan)
    for j, least in enumerate((True, True, False, False)):
        for out, value in ((plain, box[:, j]), (reached, box[:, j] + away[:, j])):
            out[:, j] = np.inf if least else -np.inf
            (np.minimum if least else np.maximum).at(out[:, j], region, value)
    for c in np.flatnonzero(parts > 1):
        plain[region[c] : region[c] + parts[c]], reached[region[c] : region[c] + parts[c]] = plain[region[c]], reached[region[c]]
    tables, upper = [], 0
    for lv, d in done:
        mine = slice(upper, upper + len(d["cell"]))
        upper = mine.stop
        tables.append((lv, pa.table({f"_c{lv}": d["cell"], f"_r{lv}": region[mine], f"_k{lv}": parts[mine]})))
    return Regions(extent, tables, plain, reached)


def _reach(box: np.ndarray, anchors: np.ndarray, most: float | None) -> np.ndarray:
    """How far any point of each box is from an item at most: from the centre to an anchor, and half the diagonal."""
    centre = box[:, :2] / 2 + box[:, 2:] / 2
    half = np.hypot(box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]) / 2
    near, _ = nearest_segment(centre[:, 0], centre[:, 1], np.concatenate([anchors, anchors], 1))
    far = np.sqrt(near) + half
    return far if most is None else np.minimum(far, most)


def meet(
    points: DataFrame, x: str, y: str, items: DataFrame, keep: Callable[..., Column], regions: Regions,
    kernel: Callable[[np.ndarray, np.ndarray, pa.Table], dict[str, pa.Array]], added: dict[str, DataType],
) -> DataFrame:
    """The points with the columns ``added`` (name, type) that ``kernel(x, y, items of the region)`` gives them.

    ``keep(x0, y0, x1, y1)`` says whether an item can matter to points whose reach is in a box. Points that are not finite
    are given to the kernel without items.
    """
    spark = points.sparkSession
    names, kinds = points.columns, {f.name: f.dataType for f in points.schema.fields}
    tasks, plain = work_partitions(spark), regions.plain
    place = _place(points, x, y)
    dealt = _dealt(points, x, y, regions, spark).repartition(tasks, "_region")
    held = items.columns
    found = _regions_of(items, keep, regions, spark).select("_region", *held).repartition(tasks, "_region")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        px, py = (_doubles(left[c]) for c in place)
        region = left["_region"][0].as_py() if len(px) else -1
        if region >= 0:
            w, s, e, n = plain[region]
            if not ((px >= w) & (px <= e) & (py >= s) & (py <= n)).all():
                region = LOST
        if region == LOST:
            raise RuntimeError("the points were not the same when they were read again")
        got = kernel(px, py, right)
        return pa.table([*[left[c] for c in names], *[got[c] for c in added]], names=[*names, *added])

    schema = StructType([*[StructField(n, kinds[n]) for n in names], *[StructField(n, k) for n, k in added.items()]])
    ship_package(spark)
    return dealt.groupBy("_region").cogroup(found.groupBy("_region")).applyInArrow(work, schema)


def _place(points: DataFrame, x: str, y: str) -> list[str]:
    """Where the coordinates are found as doubles: the columns themselves or, of another type, copies."""
    return [v if dict(points.dtypes)[v] == "double" else c for v, c in ((x, "_px"), (y, "_py"))]


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy()


def _dealt(points: DataFrame, x: str, y: str, regions: Regions, spark: SparkSession) -> DataFrame:
    """The points with ``_region`` (and their place as doubles)."""
    place = _place(points, x, y)
    rows = points.withColumns({c: F.col(v).cast("double") for v, c in zip((x, y), place) if v != c})
    coded = _on_curve(rows, *place, regions.extent)
    number, found = F.monotonically_increasing_id(), F.lit(None).cast("long")
    for level, table in regions.tables:
        coded = coded.join(F.broadcast(spark.createDataFrame(table)), _cell(level) == F.col(f"_c{level}"), "left")
        many = F.when(F.col(f"_k{level}") > 1, F.pmod(number, F.col(f"_k{level}"))).otherwise(0)
        found = F.coalesce(found, F.col(f"_r{level}") + many)
    unplaced = F.lit(-1).cast("long") - F.shiftright(number, 12)
    region = F.when(finite(*place), F.coalesce(found, F.lit(LOST).cast("long"))).otherwise(unplaced)
    return coded.select(*rows.columns, region.alias("_region"))


def _regions_of(items: DataFrame, keep: Callable[..., Column], regions: Regions, spark: SparkSession) -> DataFrame:
    """The items once for each region that they can matter to. The regions' boxes are few, and are sent to the items."""
    columns = {"_region": np.arange(len(regions.reached))} | dict(zip(("x0", "y0", "x1", "y1"), regions.reached.T))
    tree = build_tree(spark.createDataFrame(pa.table(columns)), ["_region"])
    if tree.tops is None:
        return items.limit(0).withColumn("_region", F.lit(None).cast("long"))
    return candidates(items, tree, keep)


# --------------------------------------------------------------------------------------------------
# kernels
# --------------------------------------------------------------------------------------------------


def _halves(px: np.ndarray, py: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = px[p], py[p]
    v = x if np.ptp(x) >= np.ptp(y) else y
    cut = np.argpartition(v, len(v) // 2)
    return p[cut[: len(v) // 2]], p[cut[len(v) // 2 :]]


def _centre(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Centre and half the diagonal of the points' box."""
    w, e, s, n = x.min(), x.max(), y.min(), y.max()
    cx, cy = w / 2 + e / 2, s / 2 + n / 2
    return cx, cy, math.hypot(max(e - cx, cx - w), max(n - cy, cy - s)) * (1 + 1e-12)


def distance_sq(px, py, seg: np.ndarray) -> np.ndarray:
    """Squared distances of places from segments (rows ax, ay, bx, by), in the order of ``with_segment_distance``."""
    ax, ay, dx, dy = seg[:, 0], seg[:, 1], seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1]
    length = dx * dx + dy * dy
    some = length > 0
    t = ((px - ax) * dx + (py - ay) * dy) / np.where(some, length, 1.0)
    t = np.where(some, np.minimum(np.maximum(t, 0.0), 1.0), 0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def nearest_segment(px: np.ndarray, py: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and number of the nearest segment of each point; the first on a tie; infinite and -1 for none."""
    best, number = np.full(len(px), np.inf), np.full(len(px), -1, np.int64)
    todo = [(np.arange(len(px)), np.arange(len(seg)))] if len(px) and len(seg) else []
    while todo:
        p, s = todo.pop()
        if len(s) > 1 and (len(p) > 1 or len(s) > PAIRS):
            cx, cy, half = _centre(px[p], py[p])
            apart = np.sqrt(distance_sq(cx, cy, seg[s]))
            # the nearest to a point of the box is at most this far from the centre
            s = s[apart <= (apart.min() + 2 * half) * (1 + 1e-9) + (abs(cx) + abs(cy)) * 1e-12]
        if len(p) > LEAF and len(p) * len(s) > LEAF_PAIRS or len(p) > 1 and len(p) * len(s) > PAIRS:
            todo += [(h, s) for h in _halves(px, py, p)]
            continue
        d = distance_sq(px[p][:, None], py[p][:, None], seg[s])
        at = d.argmin(axis=1)
        best[p], number[p] = d[np.arange(len(p)), at], s[at]
    return best, number


def inside_strips(px: np.ndarray, py: np.ndarray, box: np.ndarray, edges: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each point is in or on a polygon: ``polygon_strips`` with their boxes and edges, strip i from ``first[i]`` on."""
    found = np.zeros(len(px), bool)
    size = np.diff(np.append(first, len(edges)))
    todo = [(np.arange(len(px)), np.flatnonzero(size > 0))] if len(px) and len(box) else []
    while todo:
        p, s = todo.pop()
        x, y, b = px[p], py[p], box[s]
        s = s[(b[:, 0] <= x.max()) & (b[:, 2] >= x.min()) & (b[:, 1] <= y.max()) & (b[:, 3] >= y.min())]
        if not len(s):
            continue
        if len(p) > LEAF and len(p) * len(s) > LEAF_PAIRS or len(p) > 1 and len(p) * int(size[s].sum()) > PAIRS:
            todo += [(h, s) for h in _halves(px, py, p)]
            continue
        b = box[s]
        held = (x[:, None] >= b[:, 0]) & (x[:, None] <= b[:, 2]) & (y[:, None] >= b[:, 1]) & (y[:, None] <= b[:, 3])
        point, strip = np.nonzero(held)
        if not len(point):
            continue
        strip = s[strip]
        count = size[strip]
        heads = np.cumsum(count) - count
        ax, ay, bx, by = edges[np.arange(count.sum()) + np.repeat(first[strip] - heads, count)].T
        x, y = np.repeat(x[point], count), np.repeat(y[point], count)
        spans = (ay > y) != (by > y)
        rise = np.where(by == ay, 1.0, by - ay)
        odd = np.add.reduceat(spans & (x < (bx - ax) * (y - ay) / rise + ax), heads, dtype=np.int64) % 2 == 1
        on = (bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0
        on &= (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))
        odd |= np.logical_or.reduceat(on, heads)
        found[p[point[odd]]] = True
    return found


def length_in_disk(px: np.ndarray, py: np.ndarray, seg: np.ndarray, r: float) -> np.ndarray:
    """Length of all segments inside the disk of radius ``r`` around each point. A segment that is wholly inside the disks
    of a group of points is added to all of them at once."""
    out = np.zeros(len(px))
    square = (seg[:, 2] - seg[:, 0]) ** 2 + (seg[:, 3] - seg[:, 1]) ** 2
    length = np.sqrt(square)
    todo = [(np.arange(len(px)), np.flatnonzero(square > 0))] if len(px) else []
    while todo:
        p, s = todo.pop()
        cx, cy, half = _centre(px[p], py[p])
        slack = (abs(cx) + abs(cy) + r) * 1e-12
        s = s[np.sqrt(distance_sq(cx, cy, seg[s])) <= r + half + slack]
        e = seg[s]
        ends = np.maximum(np.hypot(e[:, 0] - cx, e[:, 1] - cy), np.hypot(e[:, 2] - cx, e[:, 3] - cy))
        whole = ends + half + slack <= r
        out[p] += length[s[whole]].sum()
        s = s[~whole]
        if not len(s):
            continue
        if len(p) > LEAF and len(p) * len(s) > LEAF_PAIRS or len(p) > 1 and len(p) * len(s) > PAIRS:
            todo += [(h, s) for h in _halves(px, py, p)]
            continue
        # along each segment's line, the disk has h to either side of the point's foot
        e, run = seg[s], length[s]
        ux, uy = (e[:, 2] - e[:, 0]) / run, (e[:, 3] - e[:, 1]) / run
        sx, sy = px[p][:, None] - e[:, 0], py[p][:, None] - e[:, 1]
        foot = sx * ux
        foot += sy * uy
        sx *= sx
        sy *= sy
        h = np.subtract(r * r, sx, out=sx)
        h -= sy
        h += np.multiply(foot, foot, out=sy)
        np.maximum(h, 0.0, out=h)
        np.sqrt(h, out=h)
        last = np.minimum(np.add(foot, h, out=sy), run, out=sy)
        foot -= h
        last -= np.maximum(foot, 0.0, out=foot)
        out[p] += np.maximum(last, 0.0, out=last).sum(axis=1)
    return out
