"""Point queries on passes, tree and kept index; rows with repeated ids; points near several areas."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.operators import point_index, spatial, wards

SQUARE = "rings array<array<struct<x double, y double>>>"


def square(x, y, half):
    x, y, half = float(x), float(y), float(half)
    return [[(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half), (x - half, y - half)]]


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    spread, dense = rng.uniform(0, 10, (900, 2)), rng.normal(4, 0.001, (600, 2))
    xy = np.concatenate([spread, dense, np.repeat([[2.0, 2.0]], 500, axis=0)])  # copies: the lowest id wins
    frame = pd.DataFrame({"cell_id": range(len(xy)), "lon": xy[:, 0], "lat": xy[:, 1], "note": [f"n{i}" for i in range(len(xy))]})
    frame.loc[len(frame)] = [len(xy), float("nan"), 1.0, "unplaced"]
    return spark.createDataFrame(frame).withColumn("cell_id", F.col("cell_id").cast("long")), xy


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.uniform(-3, 13, (60, 2)), rng.normal(4, 0.001, (20, 2)), [[2.0, 2.0], [500.0, -500.0]]])
    rows = [(int(i % 50), float(x), float(y)) for i, (x, y) in enumerate(xy)]  # repeated ids
    return spark.createDataFrame([*rows, (99, None, 1.0), (98, float("nan"), 1.0)], "qid long, lon double, lat double"), xy


def wanted(xy, at):
    d = (at[:, None, 1] - xy[None, :, 1]) ** 2 + (at[:, None, 0] - xy[None, :, 0]) ** 2
    return sorted((int(i % 50), int(r.argmin())) for i, r in enumerate(d))


@pytest.mark.parametrize("few", [1000, 0])
def test_nearest_cell_with_and_without_a_tree(cells, queries, few):
    got = spatial.nearest_cell(queries[0], cells[0], carry=("note",), few=few).collect()
    assert sorted((r["qid"], r["cell_id"]) for r in got) == wanted(cells[1], queries[1])
    assert all(r["note"] == f"n{r['cell_id']}" for r in got)


def test_kept_index_reads_the_visited_nodes_only(spark, cells, queries, tmp_path):
    folder = str(tmp_path / "index")
    point_index.write_point_index(cells[0], folder, node_rows=50)
    index = point_index.open_point_index(spark, folder)
    got = spatial.nearest_cell(queries[0], index, carry=("note",)).collect()
    assert sorted((r["qid"], r["cell_id"]) for r in got) == wanted(cells[1], queries[1])
    one = point_index.numbered_queries(spark.createDataFrame([(1, 9.0, 9.0)], "qid long, lon double, lat double"), "qid")
    asked, read = index.visited(one)
    nodes = {r["node"] for r in asked.collect()}
    # what the scan lists are the files of these nodes: the others can be gone
    assert len(nodes) < index.nodes.count() / 4
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "node" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for other in glob.glob(f"{folder}/cells/node=*/*.parquet"):
        if int(other.split("node=")[1].split("/")[0]) not in nodes:
            with open(other, "r+b") as f:
                f.truncate(3)  # no reader could open it
            crc = os.path.join(os.path.dirname(other), f".{os.path.basename(other)}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    schema = cells[0].select("cell_id", "lon", "lat", "note").schema
    kept = spark.read.schema(schema.add("node", "long")).parquet(f"{folder}/cells").filter(F.col("node").isin(list(nodes)))
    answer = point_index._answers(asked, kept, ["node"], "cell_id", ())
    xy = cells[1]
    assert answer.first()["cell_id"] == int(((xy - [9.0, 9.0]) ** 2).sum(1).argmin())


def test_index_and_passes_without_cells(spark, cells, queries, tmp_path):
    none = cells[0].filter("cell_id < 0")
    assert spatial.nearest_cell(queries[0], none, carry=("note",)).count() == 0
    index = point_index.write_point_index(none, str(tmp_path / "none"))
    assert index.nodes.count() == 0


@pytest.mark.parametrize("rows", [4096, 0])
def test_first_ward_in_the_row_or_by_join(spark, rows):
    boxes = [(2, "b", square(0, 0, 2)), (1, "a", square(1, 1, 2)), (3, "c", square(9, 9, 1))]
    polygons = spark.createDataFrame([(o, str(o), n, r) for o, n, r in boxes], f"ward_ord long, ward_id string, ward_name string, {SQUARE}")
    at = [(0.0, 0.0), (-1.5, -1.5), (9.0, 9.0), (5.0, 5.0), (3.0, 3.0), (float("nan"), 0.0), (None, 0.0)]
    points = spark.createDataFrame([(7, x, y) for x, y in at], "pid int, lon double, lat double")
    out = spatial.within_join(points, polygons, "pid", row_strips=rows)
    got = sorted((str(r["lon"]), r["ward_name"]) for r in out.collect())
    assert got == sorted([("0.0", "a"), ("-1.5", "b"), ("9.0", "c"), ("5.0", None), ("3.0", "a"), ("nan", None), ("None", None)])
    if rows:
        plan = out._jdf.queryExecution().optimizedPlan().toString().split("scalar-subquery")[0]
        assert "Join" not in plan and "Aggregate" not in plan


def test_nearest_join_keeps_repeated_ids_apart(spark):
    features = spark.createDataFrame([(1, "Point", [[(0.0, 0.0)]])], "feature_id int, geom_type string, parts array<array<struct<x double, y double>>>")
    points = spark.createDataFrame([(1, 10.0, 0.0), (1, 500.0, 0.0), (None, 0.0, 3.0)], "pid int, x_m double, y_m double")
    got = sorted((r["x_m"], r["dist_m"]) for r in spatial.nearest_join(points, features, "pid").collect())
    assert got == [(0.0, 3.0), (10.0, 10.0), (500.0, 500.0)]


def test_ward_join_keeps_repeated_ids_apart(spark):
    polygons = spark.createDataFrame([(1, "1", "a", square(0, 0, 1)), (2, "2", "b", square(10, 0, 1))], f"ward_ord long, ward_id string, ward_name string, {SQUARE}")
    points = spark.createDataFrame([(1, 2.0, 0.0), (1, 8.0, 0.0), (1, 0.0, 0.0)], "pid int, lon double, lat double")
    got = sorted((r["lon"], r["ward_name"], r["ward_join_method"], r["ward_distance_m"]) for r in wards.ward_join(points, polygons, "pid", lambda x, y: (x, y)).collect())
    assert got == [(0.0, "a", "within", 0.0), (2.0, "a", "nearest", 1.0), (8.0, "b", "nearest", 1.0)]
    none = wards.ward_join(points, None, "pid", lambda x, y: (x, y), without="none").first()
    assert (none["ward_id"], none["ward_join_method"]) == (None, "none")


def test_points_near_several_areas(spark):
    areas = spark.createDataFrame([(2, square(0, 0, 1)), (1, square(5, 0, 1)), (3, square(100, 100, 1))], f"area_id int, {SQUARE}")
    at = [(0.0, 0.0), (1.9, 0.0), (2.5, 0.0), (4.0, 0.0), (3.05, 0.0), (100.0, 103.0), (50.0, 50.0), (float("nan"), 0.0)]
    points = spark.createDataFrame([(9, x, y) for x, y in at], "pid int, x_m double, y_m double")
    got = sorted((r["x_m"], r["area_id"]) for r in spatial.within_areas(points, areas, 1.0).collect())
    assert got == [(0.0, 2), (1.9, 2), (3.05, 1), (4.0, 1)]
    assert spatial.within_areas(points, areas.limit(0), 1.0).count() == 0


def test_rectangle_opens_the_files_of_its_nodes_only(spark, cells, tmp_path):
    folder = str(tmp_path / "index")
    point_index.write_point_index(cells[0], folder, node_rows=50)
    index = point_index.open_point_index(spark, folder)
    lo, hi = np.quantile(cells[1], [0.3, 0.45], axis=0)
    met = {r["node"] for r in index.nodes.collect() if r["x1"] >= lo[0] and r["x0"] <= hi[0] and r["y1"] >= lo[1] and r["y0"] <= hi[1]}
    assert 0 < len(met) < index.nodes.count() / 2
    box = spatial.bbox_filter(index, lo[0], lo[1], hi[0], hi[1])
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lon" in plan.split("PushedFilters: [")[1]  # down to the row groups
    for other in glob.glob(f"{folder}/cells/node=*/*.parquet"):
        if int(other.split("node=")[1].split("/")[0]) not in met:
            with open(other, "r+b") as f:
                f.truncate(3)  # no reader could open it
    got = {r["cell_id"] for r in box.select("cell_id", "note").collect()}
    inside = ((cells[1] >= lo) & (cells[1] <= hi)).all(1)
    assert got == {int(i) for i in np.flatnonzero(inside)} and got
    assert spatial.bbox_filter(index, 1e6, 1e6, 2e6, 2e6).count() == 0
