"""Tree searches against brute force, with a third of the data in one place."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.operators import spatial, spatial_index


def _clustered(rng, n, lo=-5000.0, hi=5000.0):
    third = n // 3
    spread = rng.uniform(lo, hi, size=(n - 2 * third, 2))
    dense = rng.normal(0, 3, size=(third, 2))
    copies = np.repeat([[123.0, 456.0]], third, axis=0)
    return np.concatenate([spread, dense, copies])


@pytest.fixture(scope="module")
def layers(spark):
    rng = np.random.default_rng(7)
    pts = _clustered(rng, 300)
    a = _clustered(rng, 900)
    b = a + rng.uniform(-200, 200, size=a.shape)
    points = spark.createDataFrame(pd.DataFrame({"pid": range(len(pts)), "px": pts[:, 0], "py": pts[:, 1]}))
    segs = spark.createDataFrame(
        pd.DataFrame({"fid": range(len(a)), "ax": a[:, 0], "ay": a[:, 1], "bx": b[:, 0], "by": b[:, 1]})
    )
    return points, segs, pts, a, b


def _seg_dist(p, a, b):
    d = b - a
    t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.sqrt(((p - (a + t[:, None] * d)) ** 2).sum(1))


def _disk_len(p, a, b, r):
    d, s = b - a, a - p
    qa, qb = (d * d).sum(1), 2 * (s * d).sum(1)
    disc = qb * qb - 4 * qa * ((s * s).sum(1) - r * r)
    root = np.sqrt(np.maximum(disc, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.minimum(1, (-qb + root) / (2 * qa)) - np.maximum(0, (-qb - root) / (2 * qa))
    return np.where((qa > 0) & (disc > 0), np.sqrt(qa) * np.maximum(part, 0), 0)


@pytest.mark.parametrize("rows,limit", [(500_000, 200_000), (10, 0)])
def test_nearest_equals_brute_force(layers, rows, limit):
    points, segs, pts, a, b = layers
    tree = spatial_index.build_tree(spatial.segment_boxes(segs), ["fid"], partition_rows=rows, broadcast_rows=limit)
    got = spatial_index.nearest(points, tree, "pid", spatial.with_segment_distance, ["fid"]).toPandas().set_index("pid").sort_index()
    want = np.array([_seg_dist(p, a, b).min() for p in pts])
    assert len(got) == len(pts)
    assert np.allclose(np.sqrt(got["dist_sq"].to_numpy()), want, atol=1e-6)


@pytest.mark.parametrize("rows,limit", [(500_000, 200_000), (10, 0)])
def test_line_density_equals_brute_force(layers, rows, limit):
    points, segs, pts, a, b = layers
    items = spatial.segment_boxes(segs).withColumn("len", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2))
    tree = spatial_index.build_tree(items, ["fid"], ["len"], partition_rows=rows, broadcast_rows=limit)
    share = spatial.segment_disk_length("px", "py", "ax", "ay", "bx", "by", 250.0)
    got = spatial_index.disk_sums(points, tree, "pid", 250.0, "len", F.coalesce(share, F.lit(0.0)))
    got = got.toPandas().set_index("pid").sort_index()["value"].to_numpy()
    want = np.array([_disk_len(p, a, b, 250.0).sum() for p in pts])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-6)


def test_nearest_cell_takes_the_first_on_a_tie(spark):
    cells = spark.createDataFrame([(2, 0.0, 1.0), (1, 0.0, -1.0), (3, None, 0.0)], "cell_id long, lon double, lat double")
    q = spark.createDataFrame([(9, 0.0, 0.0)], "qid long, lon double, lat double")
    assert spatial.nearest_cell(q, cells).first()["cell_id"] == 1


def _square(x, y, h):
    return [[(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]]


def test_polygon_predicates_holes_and_overlap(spark):
    schema = "ward_ord long, ward_id string, ward_name string, rings array<array<struct<x:double,y:double>>>"
    donut = _square(0.0, 0.0, 4.0) + [list(reversed(_square(0.0, 0.0, 1.0)[0]))]
    wards = spark.createDataFrame(
        [(1, "a", "A", donut), (2, "b", "B", _square(4.0, 0.0, 2.0))], schema
    )
    pts = spark.createDataFrame(
        [(1, 2.0, 2.0), (2, 0.0, 0.0), (3, 3.0, 0.0), (4, 5.0, 1.0), (5, 4.0, 3.0), (6, 9.0, 9.0)],
        "pid long, lon double, lat double",
    )
    got = {r["pid"]: r["ward_id"] for r in spatial.within_join(pts, wards, "pid").collect()}
    assert got == {1: "a", 2: None, 3: "a", 4: "b", 5: "a", 6: None}
    strict = {r["pid"]: r["ward_id"] for r in spatial.within_join(pts, wards, "pid", predicate="within").collect()}
    assert strict == {1: "a", 2: None, 3: "a", 4: "b", 5: None, 6: None}


def test_detailed_polygon_in_strips(spark):
    k = 400
    ring = [(math.cos(2 * math.pi * i / k) * (1 + 0.3 * (i % 2)), math.sin(2 * math.pi * i / k) * (1 + 0.3 * (i % 2))) for i in range(k)]
    ring.append(ring[0])
    wards = spark.createDataFrame(
        [(1, "star", "Star", [ring])],
        "ward_ord long, ward_id string, ward_name string, rings array<array<struct<x:double,y:double>>>",
    )
    rng = np.random.default_rng(1)
    p = rng.uniform(-1.5, 1.5, size=(500, 2))
    pts = spark.createDataFrame(pd.DataFrame({"pid": range(500), "lon": p[:, 0], "lat": p[:, 1]}))
    got = {r["pid"]: r["ward_id"] is not None for r in spatial.within_join(pts, wards, "pid").collect()}

    def inside(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    assert got == {i: inside(*p[i]) for i in range(500)}


def test_area_density_covers_the_disk(spark):
    schema = "fid long, parts array<array<struct<x:double,y:double>>>"
    polys = spark.createDataFrame([(1, _square(0.0, 0.0, 1000.0)), (2, _square(5000.0, 0.0, 10.0))], schema)
    pts = spark.createDataFrame(
        [(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 5000.0, 0.0), (4, 3000.0, 0.0)], "pid long, px double, py double"
    )
    got = {r["pid"]: r["area_density"] for r in spatial.area_density(pts, polys, "pid", 250.0).collect()}
    assert got[1] == pytest.approx(1.0, abs=1e-9)
    assert got[2] == pytest.approx(0.5, abs=1e-9)
    assert got[3] == pytest.approx(400.0 / (math.pi * 250**2), abs=1e-9)
    assert got[4] == 0.0


def test_nearest_join_is_zero_inside_and_capped(spark):
    schema = "feature_id long, geom_type string, parts array<array<struct<x:double,y:double>>>"
    feats = spark.createDataFrame(
        [(1, "Polygon", _square(0.0, 0.0, 10.0)), (2, "Point", [[(100.0, 0.0)]]), (3, "LineString", [[(0.0, 50.0), (50.0, 50.0)]])],
        schema,
    )
    pts = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 95.0, 0.0), (3, 20.0, 45.0), (4, 1000.0, 0.0)], "pid long, x_m double, y_m double"
    )
    got = {r["pid"]: r["dist_m"] for r in spatial.nearest_join(pts, feats, "pid", max_dist=500.0).collect()}
    assert got == {1: 0.0, 2: 5.0, 3: 5.0, 4: None}
    none = spatial.nearest_join(pts, feats.filter("feature_id < 0"), "pid")
    assert [r["dist_m"] for r in none.collect()] == [None] * 4
