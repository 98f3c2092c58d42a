"""Joins by regions: results against brute force, and how much is moved, kept or opened."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberfield.operators import regions, spatial
from emberfield.plans import batch

FEATURES = "feature_id long, geom_type string, parts array<array<struct<x:double,y:double>>>"


def ring(x, y, h):
    return [[(float(x + a * h), float(y + b * h)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]]


def segment_distance(p, a, b):
    d = b - a
    t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.sqrt(((p - (a + t[:, None] * d)) ** 2).sum(1))


def length_inside(p, a, b, r):
    d, s = b - a, a - p
    qa, qb = (d * d).sum(1), 2 * (s * d).sum(1)
    disc = qb * qb - 4 * qa * ((s * s).sum(1) - r * r)
    root = np.sqrt(np.maximum(disc, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.minimum(1, (-qb + root) / (2 * qa)) - np.maximum(0, (-qb - root) / (2 * qa))
    return np.where((qa > 0) & (disc > 0), np.sqrt(qa) * np.maximum(part, 0), 0)


@pytest.fixture(scope="module")
def town():
    """A dense place, a wide surrounding, copies in one spot and a few places far away; short, long and dot segments."""
    rng = np.random.default_rng(5)
    places = lambda n: np.concatenate([rng.normal(300, 2, (n, 2)), rng.uniform(-2000, 2000, (n, 2)), np.repeat([[50.0, 60.0]], n // 4, axis=0)])
    points = np.concatenate([places(600), [[9e5, -9e5], [0.0, 1e7]]])
    a = places(300)
    b = a + rng.uniform(-30, 30, a.shape)
    b[:40] = a[:40]
    b[400:410] = a[400:410] + rng.uniform(-5000, 5000, (10, 2))
    return points, a, b


@pytest.fixture()
def small_regions(monkeypatch):
    """Cells and regions so small that cells are cut again and copies in one spot are shared out."""
    monkeypatch.setattr(regions, "FIRST_LEVEL", 4)
    monkeypatch.setattr(regions, "STEP", 8)
    whole = regions.deal
    small = {"region_points": 100, "region_items": 80, "cell_points": 20, "cell_items": 15}
    monkeypatch.setattr(spatial, "deal", lambda *a, **k: whole(*a, **k, **small))


def frames(spark, town):
    points, a, b = town
    pts = spark.createDataFrame(pd.DataFrame({"pid": range(len(points)), "px": points[:, 0], "py": points[:, 1]}))
    segs = spark.createDataFrame(pd.DataFrame({"fid": range(len(a)), "ax": a[:, 0], "ay": a[:, 1], "bx": b[:, 0], "by": b[:, 1]}))
    return pts, segs


def test_nearest_segments_by_regions(spark, town, small_regions):
    points, a, b = town
    pts, segs = frames(spark, town)
    odd = spark.createDataFrame([(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, float("inf"), 1.0), (0, *map(float, points[0]))], pts.schema)
    hole = spark.createDataFrame([(-9, None, 0.0, 1.0, 1.0), (-8, float("nan"), 0.0, 1.0, 1.0)], segs.schema)
    got = {r["pid"]: r for r in spatial.nearest_segments(pts.union(odd), segs.union(hole), "pid", "fid").collect()}
    assert got.keys() == {-3, *range(len(points))} and got[-3]["dist_m"] == math.inf
    for i, p in enumerate(points):
        d = segment_distance(p, a, b)
        assert got[i]["dist_m"] == pytest.approx(d.min(), rel=1e-12, abs=1e-9)
        assert d[got[i]["fid"]] == pytest.approx(d.min(), rel=1e-12, abs=1e-9)
    # of copies in one spot the lowest id wins
    dots = spark.createDataFrame([(7, 1.0, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 1.0, 1.0), (5, 9.0, 9.0, 9.0, 9.0)], segs.schema)
    assert {r["fid"] for r in spatial.nearest_segments(pts.filter("pid < 9").selectExpr("pid", "1d px", "1d py"), dots, "pid", "fid").collect()} == {3}
    assert [r["dist_m"] for r in spatial.nearest_segments(pts.limit(2), segs.limit(0), "pid", "fid").collect()] == [None] * 2


def test_points_of_roads_are_moved_once_and_nothing_of_them_is_kept(spark, town):
    """Each point goes to its region and each result to its id; no join on tree levels, no checkpoint of points."""
    pts, segs = frames(spark, town)
    plan = spatial.nearest_segments(pts, segs, "pid", "fid")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan
    assert plan.count("REPARTITION_BY_NUM") == 2  # points and segments


def test_line_density_by_regions(spark, town, small_regions):
    points, a, b = town
    pts, segs = frames(spark, town)
    odd = [(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, float("inf"), 1.0), (0, *map(float, points[0])), (None, *map(float, points[1]))]
    got = spatial.line_density(pts.union(spark.createDataFrame(odd, pts.schema)), segs, "pid", 250.0).collect()
    got = {r["pid"]: r["line_density"] * math.pi * 0.25**2 * 1000 for r in got}
    want = [length_inside(p, a, b, 250.0).sum() for p in points]
    assert len(got) == len(points) + 4 and got[-1] == got[-2] == got[-3] == 0.0
    assert got[0] == pytest.approx(2 * want[0]) and got[None] == pytest.approx(want[1])
    assert np.allclose([got[i] for i in range(1, len(points))], want[1:], rtol=1e-9, atol=1e-6)
    none = spatial.line_density(pts.limit(3), segs.limit(0), "pid", 250.0, empty=7.0)
    assert [r["line_density"] for r in none.collect()] == [7.0] * 3


def test_line_density_moves_no_point_along_a_tree(spark, town):
    pts, segs = frames(spark, town)
    plan = spatial.line_density(pts, segs, "pid", 250.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_segments_inside_all_disks_of_a_group_are_not_opened(monkeypatch):
    """Segments near the middle of the disk of all points are added as totals; no pair of point and segment is made."""
    rng = np.random.default_rng(2)
    p, a = rng.uniform(-10, 10, (4000, 2)), rng.uniform(-50, 50, (3000, 2))
    seg = np.concatenate([a, a + rng.uniform(-20, 20, a.shape)], 1)
    monkeypatch.setattr(regions, "_halves", lambda *_: pytest.fail("opened"))
    length = np.hypot(seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1])
    assert np.allclose(regions.length_in_disk(p[:, 0], p[:, 1], seg, 250.0), length.sum())


def test_nearest_join_by_regions(spark, town, small_regions):
    """Squares, a donut, a ring of many corners, one with a corner missing, lines and dots; rows keep all their columns."""
    points, a, b = town
    rng = np.random.default_rng(6)
    at, half = rng.uniform(-2000, 2000, (80, 2)), rng.uniform(5, 150, 80)
    rows = [(i, "Polygon", ring(*at[i], half[i])) for i in range(80)]
    rows.append((100, "Polygon", ring(300.0, 300.0, 40.0) + [list(reversed(ring(300.0, 300.0, 5.0)[0]))]))
    many = [(1500 + 300 * math.cos(k / 100 * math.pi), 300 * math.sin(k / 100 * math.pi)) for k in range(200)]
    rows.append((101, "Polygon", [many]))
    rows.append((102, "Polygon", [[(-5000.0, 0.0), (-5000.0, 9.0), (None, 9.0), (-4990.0, 0.0)]]))
    rows.append((103, "Polygon", [[(1.0, 1.0), (2.0, 2.0)]]))
    rows += [(200 + i, "LineString", [[tuple(map(float, a[i])), tuple(map(float, b[i]))]]) for i in range(0, 700, 50)]
    rows.append((300, "Point", [[(-1900.0, 1900.0)]]))
    feats = spark.createDataFrame(rows, FEATURES)

    def polygon_distance(p, corners):
        c = np.array(corners)
        n = np.roll(c, -1, axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            odd = (((c[:, 1] > p[1]) != (n[:, 1] > p[1])) & (p[0] < (n[:, 0] - c[:, 0]) * (p[1] - c[:, 1]) / (n[:, 1] - c[:, 1]) + c[:, 0])).sum() % 2
        return 0.0 if odd else segment_distance(p, c, n).min()

    def distance(p):
        d = [max(abs(p[0] - x) - h, 0.0) ** 2 + max(abs(p[1] - y) - h, 0.0) ** 2 for (x, y), h in zip(at, half)]
        out, deep = max(abs(p[0] - 300), abs(p[1] - 300)), np.maximum(np.abs(p - 300) - 40, 0)
        best = [math.sqrt(min(d)), float(np.hypot(*deep)) if out >= 5 else 5 - out, polygon_distance(p, many)]
        missing = np.array([[(-5000.0, 0.0), (-5000.0, 9.0)], [(-4990.0, 0.0), (-5000.0, 0.0)]])
        best.append(segment_distance(p, missing[:, 0], missing[:, 1]).min())
        some = slice(0, 700, 50)
        return min(*best, segment_distance(p, a[some], b[some]).min(), math.hypot(p[0] + 1900, p[1] - 1900))

    named = [(f"n{i % 50}", float(x), float(y)) for i, (x, y) in enumerate(points)]
    odd = [("odd", None, 1.0), ("odd", 1.0, float("nan"))]
    pts = spark.createDataFrame([*named, *odd], "name string, x_m double, y_m double")
    for most in (None, 100.0):
        got = spatial.nearest_join(pts, feats, "name", max_dist=most)
        assert got.columns == ["name", "x_m", "y_m", "dist_m"]
        want = [(n, x, y, distance(np.array([x, y]))) for n, x, y in named]
        want = sorted((n, x, y, -1.0 if most and d > most else d) for n, x, y, d in want)
        found = got.collect()
        placed = sorted((r[0], r[1], r[2], -1.0 if r[3] is None else r[3]) for r in found if r[0] != "odd")
        assert [r[:3] for r in placed] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in placed], [r[3] for r in want], rtol=1e-12, atol=1e-9)
        assert [r["dist_m"] for r in found if r[0] == "odd"] == [None, None]


def test_rows_of_the_nearest_join_are_moved_once(spark, town, tmp_path):
    """No copy of the rows is kept, and no result is joined back to them."""
    pts, _ = frames(spark, town)
    feats = spark.createDataFrame([(i, "Polygon", ring(100 * i, 0, 30)) for i in range(50)], FEATURES)
    sizes, cut = [], spatial.cut_lineage
    with pytest.MonkeyPatch.context() as m:
        m.setattr(spatial, "cut_lineage", lambda df: sizes.append(df.count()) or cut(df))
        got = spatial.nearest_join(pts, feats, "pid", x="px", y="py")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not sizes and plan.count("REPARTITION_BY_NUM") == 2 and "SortMergeJoin" not in plan


def test_batch_rows_go_from_step_to_step(spark, town):
    """One kept copy of the cells; distances and road lengths ride along, only the area density is joined."""
    points, a, b = town
    cells = spark.createDataFrame(pd.DataFrame({"cell_id": [i // 2 for i in range(len(points))], "x_m": points[:, 0], "y_m": points[:, 1]}))
    roads = spark.createDataFrame([(i, "LineString", [[tuple(map(float, a[i])), tuple(map(float, b[i]))]]) for i in range(len(a))], FEATURES)
    houses = spark.createDataFrame([(i, "Polygon", ring(100 * i - 2000, 10, 30)) for i in range(40)], FEATURES)
    water = spark.createDataFrame([(1, "Point", [[(0.0, 0.0)]])], FEATURES)
    kept, cut = [], batch.cut_lineage
    with pytest.MonkeyPatch.context() as m:
        m.setattr(spatial, "cut_lineage", lambda df: kept.append(df.count()) or cut(df))
        out = batch.add_map_features(cells, "cell_id", roads, houses, houses, water)
    assert not kept and out._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") == 4
    assert out.columns == ["cell_id", "x_m", "y_m", "road_density", "building_density", "dist_road_m", "dist_park_m", "dist_water_m", "impervious_ratio"]
    got = {(r["cell_id"], r["x_m"], r["y_m"]): r for r in out.collect()}
    for i in range(0, len(points), 7):
        p, r = points[i], got[i // 2, points[i, 0], points[i, 1]]
        assert r["dist_road_m"] == pytest.approx(segment_distance(p, a, b).min(), rel=1e-9, abs=1e-9)
        assert r["dist_water_m"] == pytest.approx(math.hypot(*p), rel=1e-9)
        assert r["road_density"] == pytest.approx(length_inside(p, a, b, 250.0).sum() / 1000 / (math.pi * 0.0625), rel=1e-9, abs=1e-9)
    assert len(got) == len(np.unique(np.c_[np.arange(len(points)) // 2, points], axis=0)) and out.count() == len(points)


def test_few_points_among_many_items_do_not_bring_all_of_them_to_one_task(spark):
    """Regions are bounded in items too, so that sparse points are not one region over the whole plane."""
    rng = np.random.default_rng(4)
    items = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 1000, (20_000, 2)), columns=["_x", "_y"]))
    pts = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 1000, (60, 2)), columns=["px", "py"]))
    dealt = regions.deal(pts, "px", "py", items, (0.0, 0.0, 1000.0, 1000.0), region_items=1_000)
    assert len(dealt.plain) >= 10
    at = np.array([(r["_x"], r["_y"]) for r in items.collect()])
    w, s, e, n = dealt.reached.T[:, :, None]
    assert ((at[:, 0] >= w) & (at[:, 0] <= e) & (at[:, 1] >= s) & (at[:, 1] <= n)).sum(1).max() < 8_000


def test_points_that_change_between_readings_are_an_error(spark, town):
    _, segs = frames(spark, town)
    pts = spark.range(2000).select(F.col("id").alias("pid"), (F.rand() * 4000 - 2000).alias("px"), F.lit(0.0).alias("py"))
    seen = spark.sparkContext.accumulator(0)

    def shifted(batches):
        for t in batches:
            seen.add(1)
            yield t.assign(px=np.random.default_rng().uniform(-2000, 2000, len(t)))

    with pytest.raises(Exception, match="not the same"):
        spatial.nearest_segments(pts.mapInPandas(shifted, pts.schema), segs, "pid", "fid").collect()
