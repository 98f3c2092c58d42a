"""Sizes that once met a limit, and rows that once went missing."""

import json

import pytest
from pyspark.sql import functions as F

from emberfield.functions import scalars
from emberfield.operators import columns, temporal
from emberfield.plans import planning
from emberfield.sources import files, geojson


def feature(i, **properties):
    ring = [[i, 0], [i + 1, 0], [i + 1, 1], [i, 1], [i, 0]]
    return json.dumps({"type": "Feature", "properties": properties, "geometry": {"type": "Polygon", "coordinates": [ring]}})


def test_wards_with_many_property_keys(spark):
    lines = spark.createDataFrame([(feature(i, **{f"key_{i}": 1, "Ward_ID": f"W{i}"}),) for i in range(1500)], "value string")
    wards = geojson.wards_from_features(geojson.parse_features(lines))
    got = {r["ward_ord"]: r["ward_id"] for r in wards.collect()}
    assert got == {i + 1: f"W{i}" for i in range(1500)}


def test_wards_without_names_are_numbered(spark):
    lines = spark.createDataFrame([(feature(i, other=i),) for i in range(5)], "value string")
    assert sorted(r["ward_id"] for r in geojson.wards_from_features(geojson.parse_features(lines)).collect()) == ["1", "2", "3", "4", "5"]


def test_large_collection_is_one_document(spark, tmp_path):
    lines = spark.createDataFrame([(feature(i, n=i),) for i in range(50)], "value string").crossJoin(spark.range(400)).drop("id")
    polys = geojson.parse_features(lines).select(F.col("properties")["n"].alias("n"), F.col("parts").alias("rings"))
    path = str(tmp_path / "layer")
    geojson.write_geojson(polys, path, properties=["n"], collection=True)
    assert geojson.read_features(spark, path).count() == 20_000


def test_stratified_split_of_many_classes(spark):
    df = spark.range(15_000).select("id", F.when(F.col("id") % 1501 < 1500, F.col("id") % 1501).alias("g"))
    out = temporal.train_val_test_split(df, ["id"], stratify="g")
    sizes = out.groupBy("g").pivot("split", ["train", "val", "test"]).count().fillna(0).collect()
    assert len(sizes) == 1501
    for r in sizes:
        n = r["train"] + r["val"] + r["test"]
        assert r["train"] == int(n * 0.8 + 1e-9) and r["train"] + r["val"] == int(n * 0.9 + 1e-9)


def test_relative_bar_keeps_rows_without_location(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 1.0), (None, 4.0)], "loc string, v double")
    assert sorted(r["bar"] for r in scalars.with_relative_bar(rows, "v", "loc").collect()) == [50.0, 100.0, 100.0]


def test_plan_rows_without_a_drop_stop_the_job(spark):
    plan = spark.createDataFrame([(1, "w1", 1, 0.5), (1, "w2", 1, 0.5)], "plan_id long, ward_id string, intervention_type int, frac double")
    deltas = spark.createDataFrame([("w1", 1, 2.0, 10.0, 5.0, 0.5)], "ward_id string, intervention_type int, delta_T double, area_m2 double, population double, hvi double")
    for scored in (planning.score_plans, planning.plan_objectives):
        with pytest.raises(Exception, match="no temperature drop for ward w2"):
            scored(plan, deltas).collect()


def test_front_keeps_columns_and_refuses_nulls(spark):
    rows = spark.createDataFrame([("x", 1.0, 2.0), ("y", 2.0, 1.0), ("z", 2.0, 2.0)], "name string, a double, b double")
    front = planning.pareto_front(rows, ["b", "a"])
    assert front.columns == rows.columns and sorted(r["name"] for r in front.collect()) == ["x", "y"]
    with pytest.raises(Exception, match="null objective a"):
        planning.pareto_front(rows.unionByName(spark.createDataFrame([("n", None, 1.0)], rows.schema)), ["a", "b"]).collect()


def test_only_a_missing_path_is_missing(spark, tmp_path):
    assert files.read_cells(spark, str(tmp_path / "none"), required=False) is None
    with pytest.raises(FileNotFoundError):
        files.read_cells_csv(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception) as error:
        files.read_cells(spark, str(tmp_path / "empty"), required=False)
    assert not isinstance(error.value, FileNotFoundError)


def test_unknown_intervention_counts_as_combined(spark):
    row = spark.createDataFrame([("other", None), ("other", 2.0)], "n string, d double").select(scalars.co2_tonnes("d", "n").alias("c"), scalars.energy_saving_pct("d", "n").alias("e"), scalars.time_to_effect("n").alias("t"))
    assert sorted((r["c"], r["e"], r["t"]) for r in row.collect()) == [(0.0, 0.0, "3-7 yrs"), (52.8, 23.0, "3-7 yrs")]


def test_points_without_place_and_with_repeated_ids(spark):
    from emberfield.operators import spatial

    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]
    wards = spark.createDataFrame([(1, "w", "n", ring)], "ward_ord long, ward_id string, ward_name string, rings array<array<struct<x:double,y:double>>>")
    nan = float("nan")
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 9.0, 9.0), (2, nan, 0.5), (3, None, 0.5)], "id long, lon double, lat double")
    got = sorted((r["id"], r["ward_id"]) for r in spatial.within_join(points, wards, "id").collect() if r["ward_id"])
    assert got == [(1, "w")]
    cells = spark.createDataFrame([(7, nan, 0.0), (8, 1.0, 1.0), (9, None, 0.0)], "cell_id long, lon double, lat double")
    near = spatial.nearest_cell(spark.createDataFrame([(1, 0.0, 0.0)], "qid long, lon double, lat double"), cells).collect()
    assert [(r["qid"], r["cell_id"]) for r in near] == [(1, 8)]


def test_one_document_from_many_tasks(spark, tmp_path):
    lines = spark.createDataFrame([(feature(i, n=i),) for i in range(50)], "value string")
    polys = geojson.parse_features(lines).select(F.col("properties")["n"].alias("n"), F.col("parts").alias("rings"))
    for rows, files in ((7, 8), (50, 1), (100, 1)):
        path = tmp_path / f"layer{rows}"
        geojson.write_geojson(polys.repartition(5), str(path), properties=["n"], collection=True, file_rows=rows)
        parts = sorted(path.glob("part-*"))
        assert sum(p.stat().st_size > 0 for p in parts) == files
        document = json.loads("".join(p.read_text() for p in parts))
        assert document["type"] == "FeatureCollection" and sorted(int(f["properties"]["n"]) for f in document["features"]) == list(range(50))
    geojson.write_geojson(polys.limit(0), str(tmp_path / "none"), properties=["n"], collection=True)
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*")))["features"] == []


def test_mapped_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5.0), (3, None, None), (3, "c", None)], "id int, k string, v double")
    mapping = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 1.5), (None, 9.0)], "key string, value double")
    got = sorted((r["id"], str(r["v"])) for r in columns.map_values(df, "k", mapping, "v", only_missing=True).collect())
    assert got == [(1, "1.0"), (2, "5.0"), (3, "None"), (3, "None")]
    assert {r["k"]: r["v"] for r in columns.map_values(df, "k", mapping, "v").collect()} == {"a": 1.0, "b": 1.5, None: None, "c": None}
