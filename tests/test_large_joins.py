"""Joins of tables that grow with the input: no stale size estimate may send them to every executor."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.checks import fixtures
from emberfield.operators import spatial, spatial_index
from emberfield.plans import planning


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_budget_repair_sends_no_plan_to_the_executors(spark):
    n = F.col("id")
    plan = spark.range(100).select(
        (n / 5).cast("long").alias("plan_id"), (n % 5).cast("string").alias("ward_id"), (n % 5).cast("int").alias("intervention_type"), F.lit(0.5).alias("frac")
    )
    out = planning.repair_budget(plan, 1e7)
    assert "SortMergeJoin" in _plan(out) and "BroadcastHashJoin" not in _plan(out)
    costs = out.groupBy("plan_id").agg(F.sum(F.col("cost") * F.col("frac_repaired") / F.col("frac")).alias("c")).collect()
    assert len(costs) == 20 and all(r["c"] == pytest.approx(1e7) for r in costs)


@pytest.fixture(scope="module")
def streets(spark):
    """Long segments crossing a small place, some without length, and points among them."""
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 1000, size=(600, 2))
    b = a + rng.uniform(-400, 400, size=a.shape)
    b[:20] = a[:20]
    points = rng.uniform(-50, 1050, size=(200, 2))
    points[0] = (a[30] + b[30]) / 2
    segs = spark.createDataFrame(pd.DataFrame({"fid": range(600), "ax": a[:, 0], "ay": a[:, 1], "bx": b[:, 0], "by": b[:, 1]}))
    pts = spark.createDataFrame(pd.DataFrame({"pid": range(200), "px": points[:, 0], "py": points[:, 1]}))
    want = []
    for p in points:
        d = b - a
        t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        want.append(np.sqrt(((p - (a + t[:, None] * d)) ** 2).sum(1)).min())
    return pts, segs, np.array(want)


def test_pieces_keep_the_distance_of_the_whole_segment(streets):
    pts, segs, want = streets
    boxes = spatial.segment_boxes(segs)
    pieces = spatial.segment_pieces(boxes)
    assert 600 < pieces.count() <= 9 * 600
    area = lambda df: df.agg(F.avg((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).first()[0]
    assert area(pieces) < area(boxes) / 4
    got = spatial.nearest_segments(pts, boxes, "pid", "fid").orderBy("pid").toPandas()
    assert len(got) == 200 and np.allclose(got["dist_m"], want, atol=1e-6)


@pytest.mark.parametrize("rows", [None, 200])
def test_large_trees_are_not_sent_whole(streets, rows):
    pts, segs, want = streets
    tree = spatial_index.build_tree(spatial.segment_boxes(segs), ["fid"], partition_rows=50, broadcast_rows=0)
    assert not any(tree.shipped)
    got = spatial_index.nearest(pts, tree, "pid", spatial.with_segment_distance, ["fid"], rows)
    if rows is None:
        assert "BroadcastHashJoin" not in _plan(got)
    found = got.orderBy("pid").toPandas()
    assert np.allclose(np.sqrt(found["dist_sq"]), want, atol=1e-6)


def test_the_curve_visits_every_square_and_never_jumps(spark):
    side = 16
    squares = spark.range(side * side).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    placed = spatial_index.with_curve(squares, F.col("x"), F.col("y"), 0.0, side - 1.0, 0.0, side - 1.0, levels=4)
    path = placed.orderBy("_curve").collect()
    assert [r["_curve"] for r in path] == list(range(side * side))
    assert all(abs(p["x"] - q["x"]) + abs(p["y"] - q["y"]) == 1 for p, q in zip(path, path[1:]))


def test_points_inside_a_polygon_stay_beside_those_outside(spark):
    ring = lambda *c: [[{"x": x, "y": y} for x, y in c]]
    kinds = "feature_id long, geom_type string, parts array<array<struct<x:double,y:double>>>"
    square = ring((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0))
    feats = spark.createDataFrame([(1, "Polygon", square), (2, "LineString", ring((4.0, 4.0), (6.0, 6.0)))], kinds)
    rows = [(1, 5.0, 5.0), (1, 13.0, 14.0), (2, 2.0, 3.0), (3, None, 1.0)]
    got = spatial.nearest_join(spark.createDataFrame(rows, "pid long, x_m double, y_m double"), feats, "pid").collect()
    assert sorted((r["pid"], r["x_m"] or 0.0, r["dist_m"]) for r in got if r["dist_m"] is not None) == [(1, 5.0, 0.0), (1, 13.0, 5.0), (2, 2.0, 0.0)]
    assert len(got) == 4


def test_tasks_of_source_tables_are_bounded_in_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    spark.range(5000).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    orders = fixtures.wide(spark, str(tmp_path), "orders")
    assert orders.count() == 5000 and orders.rdd.getNumPartitions() == math.ceil(5000 / 100)


def test_disks_full_of_polygons_are_not_searched(spark, monkeypatch):
    """Points among piled polygons have one row each, and the same shares as when all polygons are looked at."""
    rng = np.random.default_rng(8)
    half, at = rng.uniform(5, 30, 4000), rng.uniform(-600, 600, (4000, 2))

    def ring(x, y, h, turned):
        corners = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]
        return [[{"x": float(a), "y": float(b)} for a, b in (corners[::-1] if turned else corners)]]

    rows = [(i, ring(*at[i], half[i], i % 2 == 1)) for i in range(4000)]
    rows += [(4000, ring(5e3, 0.0, 200.0, False)), (4001, ring(1e300, 0.0, 10.0, False))]
    polys = spark.createDataFrame(rows, "fid long, parts array<array<struct<x:double,y:double>>>")
    inner = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-200, 200, (100, 2)))]
    edge = [(100 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-900, 900, (200, 2)))]
    odd = [(0, 5e3, 0.0), (300, 5e3, 0.0), (301, None, 0.0), (302, float("nan"), 0.0), (303, float("inf"), 0.0), (304, 1e300, 0.0), (None, 0.0, 0.0)]
    pts = spark.createDataFrame(inner + edge + odd, "pid long, px double, py double")
    taken, disk_parts = [], spatial.disk_parts
    monkeypatch.setattr(spatial, "disk_parts", lambda *a, **k: taken.append(disk_parts(*a, **k)) or taken[-1])
    got = {r["pid"]: r["area_density"] for r in spatial.area_density(pts, polys, "pid", 250.0).collect()}
    assert len(got) == 306 and all(got[i] == 1.0 for i in range(100))
    per_point = taken[0].filter("pid between 1 and 99").groupBy("pid").count().agg(F.max("count")).first()[0]
    assert per_point == 1
    assert got[300] == pytest.approx(400.0**2 / (math.pi * 250**2), abs=0.05) and got[None] == 1.0
    assert got[301] == got[302] == got[303] == 0.0
    monkeypatch.setattr(spatial, "full_squares", lambda *a: None)
    whole = {r["pid"]: r["area_density"] for r in spatial.area_density(pts, polys, "pid", 250.0).collect()}
    assert whole.keys() == got.keys() and all(got[p] == pytest.approx(whole[p], abs=1e-12) for p in got)
    assert any(0.1 < got[p] < 0.9 for p in range(100, 300))
