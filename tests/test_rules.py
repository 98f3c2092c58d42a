"""Boundaries, null paths and orders that the large checks do not single out."""

import math

import pytest
from pyspark.sql import functions as F

from emberfield.functions import bands, scalars
from emberfield.operators import actions, columns, impute, raster, wards
from emberfield.sources import files, geojson


def _one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "lst,want",
    [(42.0, "very_high"), (41.999, "high"), (38.0, "high"), (34.0, "moderate"), (33.9, "low"), (None, "unknown"),
     (float("nan"), "unknown"), (float("inf"), "unknown")],
)
def test_risk_class(spark, lst, want):
    assert _one(spark, scalars.classify_heat(F.lit(lst).cast("double"))) == want


def test_half_values_round_up_like_the_display(spark):
    assert _one(spark, scalars.co2_tonnes(F.lit(0.5), F.lit("trees"))) == 6.3


def test_heat_index_is_null_for_missing_input(spark):
    assert _one(spark, scalars.heat_index(F.lit(None).cast("double"), F.lit(50.0))) is None
    assert _one(spark, scalars.heat_index(F.lit(20.0), F.lit(50.0))) == 20.0


def test_hvi_class_bins_are_closed_on_the_right(spark):
    got = [_one(spark, scalars.hvi_class(F.lit(x))) for x in (0.0, 0.25, 0.2501, 0.75, 0.76)]
    assert got == ["Low", "Low", "Medium", "High", "Very High"]


def test_clip_keeps_null(spark):
    assert _one(spark, bands.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None


def test_align_is_idempotent_and_never_overwrites(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "longitude double, lon double, RH_pct double")
    once = columns.align_columns(df)
    assert once.columns == ["longitude", "lon", "humidity_pct"]
    assert columns.align_columns(once).columns == once.columns


def test_imputation_leaves_known_values(spark):
    df = spark.createDataFrame(
        [(1, 10, 1.0), (2, 10, None), (3, 10, 3.0), (4, 20, None), (5, None, None)], "id int, LULC_ESA long, ntl double"
    )
    got = {r["id"]: r["ntl"] for r in impute.impute_grouped_median(df, ["ntl"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0, 4: 2.0, 5: 2.0}


def test_mode_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([(20,), (10,), (20,), (10,), (None,)], "LULC_ESA long")
    assert sorted(r[0] for r in impute.fill_mode(df).collect()) == [10, 10, 10, 20, 20]


def test_rules_in_order(spark):
    rows = [(1, 0.8, 43.0, 0.5, 0.1, 1.0, 1.0), (2, 0.75, 43.0, 0.1, 0.3, 1.0, 1.0), (3, 0.1, 30.0, 0.5, 0.6, 20.0, 1.0),
            (4, 0.1, 30.0, 0.5, 0.5, 16.0, 1.0), (5, 0.1, 30.0, 0.5, 0.5, 15.0, 1501.0), (6, 0.1, 30.0, 0.5, 0.5, 15.0, 1500.0)]
    df = spark.createDataFrame(rows, "id int, HVI double, lst_celsius double, NDVI_L double, building_density double, road_density double, dist_water_m double")
    got = [r["intervention"] for r in actions.rule_recommend(df).orderBy("id").collect()]
    assert got == ["combined", "trees", "cool_roofs", "reflective_pavement", "blue_green", "trees"]


def test_hvi_of_a_constant_and_of_absent_columns(spark):
    df = spark.createDataFrame([(30.0, None), (30.0, 5.0)], "lst_celsius double, pop_density double")
    rows = wards.hvi(df).collect()
    assert all(r["H_norm"] == 0.0 and r["A_norm"] == r["G_norm"] == r["I_norm"] == 0.5 for r in rows)
    assert sorted(r["P_norm"] for r in rows) == [0.0, 0.5]


def test_tiles_meet_without_a_seam(spark):
    side = 12
    dem = spark.createDataFrame([(x + 250, y + 250, float(x * y)) for x in range(side) for y in range(side)], "px long, py long, elevation double")
    got = {(r["px"], r["py"]): r for r in raster.slope_aspect(dem, 1.0).collect()}
    assert len(got) == side * side
    assert got[(255, 256)]["slope_deg"] == pytest.approx(math.degrees(math.atan((5**2 + 6**2) ** 0.5)))
    assert got[(250, 250)]["slope_deg"] is None
    tpi = {(r["px"], r["py"]): r["tpi"] for r in raster.terrain_tpi(dem, 2.0, 1.0).collect()}
    assert tpi[(256, 256)] == pytest.approx(0.0)


def test_optional_and_required_files(spark, tmp_path):
    assert files.read_cells_csv(spark, str(tmp_path / "no.csv"), required=False) is None
    with pytest.raises(FileNotFoundError):
        files.read_cells(spark, str(tmp_path / "no.parquet"))
    (tmp_path / "a.csv").write_text("lon,lat,v\n1.0,2.0,NaN\n3.0,,5.0\n")
    rows = files.read_cells_csv(spark, str(tmp_path / "a.csv")).collect()
    assert rows[0]["v"] is None and rows[1]["lat"] is None


def test_wards_without_id_get_numbers_and_holes_are_kept(spark, tmp_path):
    doc = (
        '{"type":"FeatureCollection","features":['
        '{"type":"Feature","properties":{"x":"1"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[0,4],[4,4],[4,0],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}},'
        '{"type":"Feature","properties":{"x":"2"},"geometry":null},'
        '{"type":"Feature","properties":{"x":"3"},"geometry":{"type":"MultiPolygon","coordinates":[[[[9,9],[10,9],[10,10],[9,9]]]]}}]}'
    )
    (tmp_path / "w.geojson").write_text(doc)
    from emberfield.functions.geometry import parts_area

    w = geojson.read_wards_geojson(spark, str(tmp_path / "w.geojson")).withColumn("a", parts_area("rings"))
    assert [(r["ward_id"], r["ward_name"], r["a"]) for r in w.orderBy("ward_ord").collect()] == [("1", "1", 15.0), ("2", "2", 0.5)]


def test_scene_filter_reaches_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spark.sql("select 1 as px, 1 as py, timestamp'2020-05-01' as ts, 10 as cloud_cover, 5 as band").write.parquet(str(tmp_path / "o"))
    obs = raster.scene_filter(spark.read.parquet(str(tmp_path / "o")), "2020-01-01", "2021-01-01", 20, (0, 0, 2, 2)).select("px")
    plan = obs._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(cloud_cover" in plan and "band" not in plan.split("ReadSchema")[1]


def test_no_cartesian_product_in_spatial_plans(spark):
    from emberfield.checks import load_all

    plan = load_all()[0]["j2_nearest_road"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_full_size_trainers():
    from emberfield.models import trees

    assert [(p.rounds, p.depth, p.rate) for p in (trees.FULL_MAIN, trees.FULL_MODULE)] == [(800, 6, 0.03), (1000, 7, 0.05)]
