"""Nearest points by boxes of points: in passes over an unshuffled table, or on an index kept as files.

Both ways cut the points into boxes and know each box's bounds. A query's answer is no farther than the farthest corner
of any box, which gives it a reach; only boxes within that reach can hold the answer, and only their points are compared.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.operators.spatial_index import box_far_sq, with_curve
from emberfield.scale import cut_lineage, ship_if_small, work_partitions

# Most squares of the passing grid on each side; rows of a kept node; nodes that an index has at most (nodes grow beyond).
GRID = 128
NODE_ROWS = 100_000
NODES = 16_384
# Visited nodes that are named to the reader one by one.
NAMED_NODES = 10_000


def placed_points(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points whose coordinates are neither null nor NaN."""
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in (lon, lat)]
    return points.filter(known[0] & known[1])


def _near_sq(x: Column, y: Column, box: Column) -> Column:
    dx = F.greatest(box["x0"] - x, x - box["x1"], F.lit(0.0))
    dy = F.greatest(box["y0"] - y, y - box["y1"], F.lit(0.0))
    return dx * dx + dy * dy


def _wanted(queries: DataFrame, boxes: DataFrame, bucket: Sequence[str]) -> DataFrame:
    """(_own, qx, qy, _ub, bucket columns): the boxes that may hold the answer of each query."""
    all_boxes = boxes.agg(F.collect_list(F.struct(*bucket, "x0", "y0", "x1", "y1"))).scalar()
    x, y, box = F.col("qx"), F.col("qy"), F.col("_box")
    spread = queries.repartition(work_partitions(queries.sparkSession), "_own")
    met = spread.withColumn("_box", F.explode(all_boxes))
    reach = met.groupBy("_own").agg(F.min(box_far_sq(x, y, box["x0"], box["y0"], box["x1"], box["y1"])).alias("_ub"))
    near = met.join(reach, "_own").filter(_near_sq(x, y, box) <= F.col("_ub") * F.lit(1.0 + 1e-9))
    return near.select("_own", "qx", "qy", "_ub", *[box[c].alias(c) for c in bucket])


def _answers(wanted: DataFrame, cells: DataFrame, bucket: Sequence[str], cell_id: str, carry: Sequence[str]) -> DataFrame:
    """(_own, cell_id, d2, carried columns): first the least distance (a plain aggregate), then the rows that have it."""
    dx, dy = F.col("lon") - F.col("qx"), F.col("lat") - F.col("qy")
    rows = wanted.count()
    met = cells.join(ship_if_small(wanted, rows), list(bucket)).withColumn("_d2", dy * dy + dx * dx)
    least = cut_lineage(met.filter(F.col("_d2") <= F.col("_ub") * F.lit(1.0 + 1e-9)).groupBy("_own").agg(F.min("_d2").alias("_ub")))
    exact = wanted.drop("_ub").join(F.broadcast(least), "_own")  # one row per query
    found = cells.join(ship_if_small(exact, rows), list(bucket)).withColumn("_d2", dy * dy + dx * dx).filter(F.col("_d2") <= F.col("_ub"))
    first = F.min(F.struct(F.col("_d2").alias("d2"), cell_id, *[c for c in carry if c not in (cell_id, "d2")]))
    return found.groupBy("_own").agg(first.alias("_m")).select("_own", "_m.*")


def numbered_queries(queries: DataFrame, qid: str) -> DataFrame:
    """Placed queries with a number of their own, so that repeated ids stay apart."""
    rows = placed_points(queries).select(qid, F.col("lon").alias("qx"), F.col("lat").alias("qy"))
    return cut_lineage(rows.withColumn("_own", F.monotonically_increasing_id()))


def nearest_by_passes(queries: DataFrame, cells: DataFrame, cell_id: str, carry: Sequence[str] = ()) -> DataFrame:
    """Answers of few queries in three passes over the cells, none of which shuffles a cell: extent and occupied grid
    squares with their bounds, least distances, rows that have them. ``queries`` come from ``numbered_queries``."""
    held = placed_points(cells).select(*dict.fromkeys([cell_id, "lon", "lat", *carry]))
    count, w, e, s, n = held.agg(F.count(F.lit(1)), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    # about as many squares as cells in the few squares that a query opens
    side = min(GRID, max(8, math.ceil((4 * count) ** 0.25)))
    if w is None:
        kinds = dict(cells.dtypes)
        return queries.limit(0).select("_own", *[F.lit(None).cast(k).alias(c) for c, k in {"d2": "double", **{c: kinds[c] for c in (cell_id, *carry)}}.items()])

    def square(v: str, low: float, high: float) -> Column:
        return F.least(F.floor((F.col(v) - F.lit(low)) / F.lit(max(high - low, 1e-12)) * F.lit(float(side))), F.lit(side - 1)).cast("int")

    held = held.withColumns({"_cx": square("lon", w, e), "_cy": square("lat", s, n)})
    bounds = [F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1")]
    boxes = held.groupBy("_cx", "_cy").agg(*bounds)
    wanted = cut_lineage(_wanted(queries, boxes, ["_cx", "_cy"]))
    return _answers(wanted, held, ["_cx", "_cy"], cell_id, carry)


@dataclass
class PointIndex:
    """A kept index: points in folders by node, in curve order, and the nodes' bounds beside them."""

    spark: SparkSession
    folder: str
    cell_id: str

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/nodes")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/cells")

    def visited(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the boxes wanted by each query, the cells of these boxes): no other node's files are read."""
        wanted = cut_lineage(_wanted(queries, self.nodes, ["node"]))
        return wanted, self._cells_of(wanted.select("node").distinct())

    def _cells_of(self, nodes: DataFrame) -> DataFrame:
        names = [r["node"] for r in nodes.limit(NAMED_NODES + 1).collect()]
        if len(names) <= NAMED_NODES:
            return self.cells.filter(F.col("node").isin(names))
        return self.cells.join(nodes, "node", "left_semi")

    def in_box(self, west: float, south: float, east: float, north: float) -> DataFrame:
        """The cells of a closed rectangle: only files of nodes whose bounds meet it are opened, and in these only row
        groups whose coordinates can lie inside (cells are in curve order)."""
        meets = (F.col("x1") >= west) & (F.col("x0") <= east) & (F.col("y1") >= south) & (F.col("y0") <= north)
        near = self._cells_of(self.nodes.filter(meets).select("node"))
        return near.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north)).drop("node")

    def nearest(self, queries: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        wanted, cells = self.visited(queries)
        return _answers(wanted, cells, ["node"], self.cell_id, carry)


def write_point_index(cells: DataFrame, folder: str, cell_id: str = "cell_id", node_rows: int = NODE_ROWS) -> PointIndex:
    """Write the placed cells (all columns) in curve order under ``folder``, one folder per node, and the nodes' bounds.

    One range shuffle along the Hilbert curve; a node is a run of ``node_rows`` neighbours on it (more in very large
    tables, so that there are at most NODES or so). A table without placed cells gives an index without nodes.
    """
    spark = cells.sparkSession
    held = placed_points(cells)
    count, w, e, s, n = held.agg(F.count(F.lit(1)), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    each = max(node_rows, math.ceil(count / NODES))
    parts = max(1, math.ceil(count / (8 * each)))
    coded = with_curve(held, F.col("lon"), F.col("lat"), w or 0.0, e or 0.0, s or 0.0, n or 0.0)
    spread = coded.repartition(1) if parts == 1 else coded.repartitionByRange(parts, "_curve", cell_id)
    at = F.monotonically_increasing_id()
    placed = spread.sortWithinPartitions("_curve", cell_id).withColumn("_at", at).withColumn(
        "node", F.shiftright("_at", 33) * F.lit(1_000_000) + F.floor(F.col("_at").bitwiseAND(2**33 - 1) / F.lit(each))
    )
    placed.drop("_at", "_curve").write.partitionBy("node").parquet(f"{folder}/cells")
    index = PointIndex(spark, folder, cell_id)
    bounds = [F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"), F.count(F.lit(1)).alias("rows")]
    known = index.cells if count else spark.createDataFrame([], "node long, lon double, lat double")
    known.groupBy("node").agg(*bounds).write.parquet(f"{folder}/nodes")
    return index


def open_point_index(spark: SparkSession, folder: str, cell_id: str = "cell_id") -> PointIndex:
    """An index that was written before."""
    return PointIndex(spark, folder, cell_id)
