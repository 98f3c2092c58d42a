"""A packed box tree held in DataFrames, for spatial joins that do not depend on the density of the data.

Items are sorted along a Hilbert curve by one range shuffle and numbered; 16 neighbours form a leaf, 32 leaves
a node, and so on: the parent of a number is the number shifted by a few bits. Dense places simply get more,
smaller leaves, so no bucket can hold a third of the data. A search is a chain of equi-joins on the node number
with a box test after each; what it produces per point is bounded by the answer, not by the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.scale import BROADCAST_ROWS, as_large, cut_lineage, ship_if_small, work_partitions

LEAF_BITS = 4  # items per leaf: 16
FAN_BITS = 5  # children per node: 32
ROWS_PER_PARTITION = 500_000
LEVELS_A_STEP = 4  # of the curve
SQUARES = 8  # squares to a disk's radius
BOX = ["x0", "y0", "x1", "y1"]


def _hilbert_table() -> int:
    """The curve's turns as 16 entries of four bits in one long: entry (turn, x bit, y bit) has the place among the four
    quarters, then the turn inside it (bit 0: axes swapped, bit 1: both turned round)."""
    table = 0
    for entry in range(16):
        turn, x, y = entry >> 2, entry >> 1 & 1, entry & 1
        if turn & 2:
            x, y = 1 - x, 1 - y
        if turn & 1:
            x, y = y, x
        inside = turn if y else turn ^ 1 ^ (2 * x)
        table |= ((3 * x ^ y) << 2 | inside) << 4 * entry
    return table - 2**64 if table >= 2**63 else table


HILBERT = _hilbert_table()


@dataclass
class BoxTree:
    items: DataFrame  # item columns + _leaf
    levels: list[DataFrame]  # top-down: _up, _node, box, sums
    tops: Column | None  # array of at most 64 top nodes; None when there are no items
    sums: list[str]
    shipped: list[bool] = field(default_factory=list)  # which levels, and last the items, are sent to every executor


def with_curve(
    df: DataFrame, x: Column, y: Column, x_lo: float, x_hi: float, y_lo: float, y_hi: float, levels: int = 20, name: str = "_curve"
) -> DataFrame:
    """Add the position of a place along the Hilbert curve over the extent. Neighbours on the curve are neighbours in the
    plane (the curve never jumps), so runs of items have compact boxes.

    One table look-up per level, in generated code; a few levels a step, since each look-up names the one before it.
    """
    side = 2**levels

    def cell(v: Column, lo: float, hi: float) -> Column:
        share = (v - F.lit(lo)) / F.lit(max(hi - lo, 1e-12))
        return F.coalesce((share * F.lit(float(side - 1))).cast("long"), F.lit(0).cast("long"))

    zero = F.lit(0).cast("long")
    out = df.withColumns({"_hx": cell(x, x_lo, x_hi), "_hy": cell(y, y_lo, y_hi), "_turn": zero, name: zero})
    todo = list(reversed(range(levels)))
    for at in range(0, levels, LEVELS_A_STEP):
        turn, place = F.col("_turn"), F.col(name)
        for k in todo[at : at + LEVELS_A_STEP]:
            quarter = F.shiftleft(F.shiftright("_hx", k).bitwiseAND(1), 1).bitwiseOR(F.shiftright("_hy", k).bitwiseAND(1))
            entry = F.shiftleft(F.shiftleft(turn, 2).bitwiseOR(quarter), 2).cast("int")
            met = F.call_function("shiftrightunsigned", F.lit(HILBERT), entry).bitwiseAND(15)
            place = place + F.shiftleft(F.shiftright(met, 2), 2 * k)
            turn = met.bitwiseAND(3)
        out = out.withColumns({"_turn": turn, name: place})
    return out.drop("_hx", "_hy", "_turn")


def build_tree(
    items: DataFrame,
    id_cols: Sequence[str],
    sums: Sequence[str] = (),
    size: Column | None = None,
    costly: bool = False,
    partition_rows: int = ROWS_PER_PARTITION,
    broadcast_rows: int = BROADCAST_ROWS,
) -> BoxTree:
    """Index ``items`` (with box columns x0, y0, x1, y1). ``sums`` are additive columns totalled per node.

    ``size`` says how many narrow rows an item weighs (e.g. its number of edges) for the broadcast check;
    ``costly`` items (built by array functions) are kept before they are measured, so that they are built once.
    """
    if costly:
        items = cut_lineage(items)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    n, x_lo, x_hi, y_lo, y_hi, weight = items.agg(
        F.count(F.lit(1)), F.min(cx), F.max(cx), F.min(cy), F.max(cy),
        F.sum(F.lit(1) if size is None else size),
    ).first()
    if not n:
        return BoxTree(items.withColumn("_leaf", F.lit(0).cast("long")), [], None, list(sums))
    coded = with_curve(items, cx, cy, x_lo, x_hi, y_lo, y_hi)
    parts = min(math.ceil(n / partition_rows), 20_000)
    spread = coded.repartition(1) if parts == 1 else coded.repartitionByRange(parts, "_curve", *id_cols)
    placed = cut_lineage(
        spread.sortWithinPartitions("_curve", *id_cols).withColumn("_at", F.monotonically_increasing_id()).drop("_curve")
    )
    if parts == 1:
        longest = n
    else:
        longest = (
            placed.groupBy(F.shiftright("_at", 33)).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0]
        )
    shifts = [LEAF_BITS]
    while parts * math.ceil(longest / 2 ** shifts[-1]) > 64 and 2 ** shifts[-1] < longest:
        shifts.append(shifts[-1] + FAN_BITS)
    if parts > 64:
        shifts.append(33)
        while math.ceil(parts / 2 ** (shifts[-1] - 33)) > 64:
            shifts.append(shifts[-1] + FAN_BITS)

    box = [
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        *[F.sum(s).alias(s) for s in sums],
    ]
    leaves = placed.groupBy(F.shiftright("_at", LEAF_BITS).alias("_node")).agg(*box)
    many = n > broadcast_rows * 2**LEAF_BITS
    if many:
        leaves = cut_lineage(leaves)
    stages = [leaves]
    for low, high in zip(shifts, shifts[1:]):
        stages.append(stages[-1].groupBy(F.shiftright("_node", high - low).alias("_node")).agg(*box))
    tops = stages[-1].agg(F.collect_list(F.struct("_node", *BOX, *sums))).scalar()
    levels, shipped = [], []
    for stage, low, high in reversed(list(zip(stages, shifts, shifts[1:]))):
        level = stage.withColumn("_up", F.shiftright("_node", high - low))
        bound = parts * math.ceil(longest / 2**low) if low < 33 else math.ceil(parts / 2 ** (low - 33))
        shipped.append(bound <= broadcast_rows)
        levels.append(F.broadcast(level) if shipped[-1] else as_large(level))
    held = placed.withColumn("_leaf", F.shiftright("_at", LEAF_BITS)).drop("_at")
    shipped.append(weight <= broadcast_rows)
    return BoxTree(F.broadcast(held) if shipped[-1] else as_large(held), levels, tops, list(sums), shipped)


def box_far_sq(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Squared distance of a point from the farthest corner of a box."""
    dx = F.greatest(F.abs(px - x0), F.abs(px - x1))
    dy = F.greatest(F.abs(py - y0), F.abs(py - y1))
    return dx * dx + dy * dy


def _tops(points: DataFrame, tree: BoxTree) -> DataFrame:
    opened = points.select("*", F.explode(tree.tops).alias("_t"))
    return opened.select(*points.columns, F.col("_t._node").alias("_node"), *[F.col(f"_t.{c}").alias(c) for c in [*BOX, *tree.sums]])


def _box_cols() -> list[Column]:
    return [F.col(c) for c in BOX]


def candidates(points: DataFrame, tree: BoxTree, keep: Callable[..., Column], few: bool = False) -> DataFrame:
    """Points joined with every item whose box passes ``keep(x0, y0, x1, y1)``, tested on the whole way down. ``few``
    points go to large levels and items, as long as their rows are few there; others meet them in a shuffle."""
    cols = points.columns

    def sent(rows: DataFrame, shipped: bool) -> DataFrame:
        return ship_if_small(cut_lineage(rows)) if few and not shipped else rows

    front = _tops(points, tree).filter(keep(*_box_cols())).select(*cols, "_node")
    for level, shipped in zip(tree.levels, tree.shipped):
        front = sent(front.withColumnRenamed("_node", "_up"), shipped).join(level, "_up")
        front = front.filter(keep(*_box_cols())).select(*cols, "_node")
    found = sent(front.withColumnRenamed("_node", "_leaf"), tree.shipped[-1]).join(tree.items, "_leaf").drop("_leaf")
    return found.filter(keep(*_box_cols()))


def nearest(
    points: DataFrame,
    tree: BoxTree,
    pid: str,
    measure: Callable[[DataFrame], DataFrame],
    tie: Sequence[str],
    rows: int | None = None,
) -> DataFrame:
    """For each point (``pid``, ``px``, ``py``) its nearest item: ``pid``, ``dist_sq`` and the ``tie`` columns.

    ``measure`` adds the squared distance ``_d`` to rows of a point and an item. First a greedy walk down the tree
    (one child per level: the nearest box, of several the one with the nearest centre) gives an upper bound close
    to the answer; then the tree is searched again with that bound, and only items within it reach the final
    aggregate. Box tests are plain comparisons, so the whole walk stays in small generated methods. Where ``rows``, the
    known number of points, is small, they are sent to a large tree's levels and items, which then stay where they are.
    """
    few = rows is not None and rows <= BROADCAST_ROWS
    px, py = F.col("px"), F.col("py")
    x0, y0, x1, y1 = _box_cols()
    base = [pid, "px", "py"]
    zero = F.lit(0.0)
    apart = F.greatest(x0 - px, px - x1, zero) + F.greatest(y0 - py, py - y1, zero)
    choice = apart * F.lit(1e3) + F.abs(px + px - x0 - x1) + F.abs(py + py - y0 - y1)

    def best_child(front: DataFrame) -> DataFrame:
        return front.groupBy(pid).agg(
            F.first("px").alias("px"), F.first("py").alias("py"), F.min_by("_node", choice).alias("_node")
        )

    start = points.select(*base).repartition(work_partitions(points.sparkSession), pid)
    def sent(front: DataFrame, shipped: bool) -> DataFrame:
        return F.broadcast(front) if few and not shipped else front  # one row per point

    front = best_child(_tops(start, tree))
    for level, shipped in zip(tree.levels, tree.shipped):
        front = best_child(sent(front.withColumnRenamed("_node", "_up"), shipped).join(level, "_up"))
    bounded = (
        measure(sent(front.withColumnRenamed("_node", "_leaf"), tree.shipped[-1]).join(tree.items, "_leaf"))
        .groupBy(pid)
        .agg(F.first("px").alias("px"), F.first("py").alias("py"), F.min("_d").alias("_ub"))
        .withColumn("_reach", F.sqrt("_ub") * F.lit(1.0 + 1e-9))
    )
    reach = F.col("_reach")
    if few:
        bounded = cut_lineage(bounded)

    def near(bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
        return (bx0 - reach <= px) & (px <= bx1 + reach) & (by0 - reach <= py) & (py <= by1 + reach)

    return (
        measure(candidates(bounded, tree, near, few))
        .filter(F.col("_d") <= F.col("_ub"))
        .groupBy(pid)
        .agg(F.min(F.struct(F.col("_d").alias("dist_sq"), *tie)).alias("_m"))
        .select(pid, "_m.*")
    )


def full_squares(tree: BoxTree, r: float, total: str, limit: float) -> DataFrame | None:
    """Squares of the plane whose every point has items of ``limit`` or more in ``total`` wholly inside its disk of radius
    ``r``, 64 to a row: ``_bx``, ``_by`` and the bits ``_mask``. None where there is no such square.

    An item counts for the squares that lie within reach of all of its box, a hundred or so, whatever the density.
    The items come in curve order, so that a task's partial sums are of few squares.
    """
    side, reach, bound = r / SQUARES, r * (1 - 1e-6), r * 1e9
    x0, y0, x1, y1 = _box_cols()
    near = (F.abs(x0) <= bound) & (F.abs(x1) <= bound) & (F.abs(y0) <= bound) & (F.abs(y1) <= bound)

    def squares(low: Column, high: Column, out: str) -> list[Column]:
        return [F.ceil(low / F.lit(side)).alias(f"{out}0"), (F.floor(high / F.lit(side)) - 1).alias(f"{out}1")]

    rows = tree.items.filter(near & (F.col(total) > 0)).select(*BOX, total, *squares(x1 - reach, x0 + reach, "_i"))
    rows = rows.filter("_i0 <= _i1").select(*BOX, total, F.explode(F.sequence("_i0", "_i1")).alias("_tx"))
    left = F.col("_tx") * F.lit(side)
    across = F.greatest(x1 - left, left + F.lit(side) - x0)
    rows = rows.withColumn("_h", F.sqrt(F.greatest(F.lit(reach * reach) - across * across, F.lit(0.0))))
    rows = rows.select("_tx", total, *squares(y1 - F.col("_h"), y0 + F.col("_h"), "_j"))
    rows = rows.filter("_j0 <= _j1").select("_tx", total, F.explode(F.sequence("_j0", "_j1")).alias("_ty"))
    full = rows.groupBy("_tx", "_ty").agg(F.sum(total).alias("_s")).filter(F.col("_s") >= F.lit(limit))
    block, place = square_block()
    masks = full.select(*block, place.alias("_p")).groupBy("_bx", "_by").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_p"))).alias("_mask")
    )
    masks = cut_lineage(masks)
    n = masks.count()
    return (ship_if_small(masks, n) if n <= BROADCAST_ROWS else as_large(masks)) if n else None


def square_block() -> tuple[list[Column], Column]:
    """Of the square ``_tx``, ``_ty``: the block of 8 by 8 squares that holds it, and its bit there."""
    block = [F.shiftright("_tx", 3).alias("_bx"), F.shiftright("_ty", 3).alias("_by")]
    place = F.shiftleft(F.col("_tx").bitwiseAND(7), 3).bitwiseOR(F.col("_ty").bitwiseAND(7)).cast("int")
    return block, place


def in_full_square(points: DataFrame, squares: DataFrame, r: float) -> DataFrame:
    """The points with ``_full``, true where the square of (``px``, ``py``) is one of ``full_squares``."""
    known = ~(F.isnan("px") | F.isnan("py"))
    square = {f"_t{a}": F.when(known, F.floor(F.col(f"p{a}") / F.lit(r / SQUARES))) for a in "xy"}
    block, place = square_block()
    met = points.withColumns(square).select(*points.columns, *block, place.alias("_p")).join(squares, ["_bx", "_by"], "left")
    return met.select(*points.columns, F.coalesce(F.call_function("getbit", "_mask", "_p") == 1, F.lit(False)).alias("_full"))


def disk_parts(points: DataFrame, tree: BoxTree, pid: str, r: float, total: str, known: Column | None = None) -> DataFrame:
    """What each point's disk of radius ``r`` takes from the tree: rows of ``pid``, ``px``, ``py``, ``_sum`` and the
    item columns.

    A node that lies wholly inside the disk counts with its total (``_sum``, item columns null) and is not opened;
    a node outside is dropped; the items of leaves cut by the circle come one by one with ``_sum`` null. Every
    point has at least one row. All rows of a point stay in the partition of its id. Points whose ``known`` sum is not
    null are not searched: it is their one row.
    """
    px, py = F.col("px"), F.col("py")
    base = [pid, "px", "py"]
    limit, reach = F.lit(r * r), F.lit(float(r))
    x0, y0, x1, y1 = _box_cols()
    near = (x0 - reach <= px) & (px <= x1 + reach) & (y0 - reach <= py) & (py <= y1 + reach)
    # Closed nodes keep a negative number, spread out so that they do not meet in one shuffle partition.
    closed = -F.lit(1).cast("long") - F.pmod(F.hash(pid), F.lit(1 << 20)).cast("long")

    def settle(front: DataFrame, done: Column) -> DataFrame:
        inside = ~done & (box_far_sq(px, py, *_box_cols()) <= limit)
        return front.filter(done | near).select(
            *base,
            F.when(done | inside, closed).otherwise(F.col("_node")).alias("_node"),
            F.when(done, F.col("_sum")).when(inside, F.col(total)).otherwise(F.lit(0.0)).alias("_sum"),
        )

    given = [] if known is None else [known.alias("_known")]
    start = points.select(*base, *given).repartition(work_partitions(points.sparkSession), pid)
    # one empty entry next to the top nodes, so that points with nothing near still come out
    far = float("inf")
    empty = F.struct(
        F.lit(-1).cast("long").alias("_node"), *[F.lit(far).alias(c) for c in BOX], *[F.lit(0.0).alias(c) for c in tree.sums]
    )
    entries, first = F.concat(tree.tops, F.array(empty)), F.lit(0.0)
    if given:
        entries = F.when(F.col("_known").isNull(), entries).otherwise(F.array(empty))
        first = F.coalesce("_known", first)
    opened = start.select("*", F.explode(entries).alias("_t")).select(
        *base, F.col("_t._node").alias("_node"), *[F.col(f"_t.{c}").alias(c) for c in [*BOX, *tree.sums]],
        first.alias("_sum"),
    )
    front = settle(opened, F.col("_node") < 0)
    for level in tree.levels:
        step = front.withColumnRenamed("_node", "_up").join(level, "_up", "left")
        step = step.withColumn("_node", F.coalesce("_node", "_up"))
        front = settle(step, F.col("_up") < 0)
    held = front.withColumnRenamed("_node", "_leaf").join(tree.items, "_leaf", "left")
    held = held.filter((F.col("_leaf") < 0) | near)
    return held.withColumn("_sum", F.when(F.col("_leaf") < 0, F.col("_sum"))).drop("_leaf")


def disk_sums(points: DataFrame, tree: BoxTree, pid: str, r: float, total: str, share: Column) -> DataFrame:
    """Per point, the sum over items of their ``share`` inside the disk: ``pid``, ``value`` (0 without items)."""
    if tree.tops is None:
        return points.select(pid, F.lit(0.0).alias("value"))
    parts = disk_parts(points, tree, pid, r, total)
    return parts.groupBy(pid).agg(F.sum(F.coalesce(F.col("_sum"), share)).alias("value"))
