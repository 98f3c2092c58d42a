"""Checks of sources, schema operations, audits, predicates and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield import schema as S
from emberfield.checks import fixtures as X
from emberfield.checks.registry import check, q, r6, rounded, scratch
from emberfield.operators import columns as C
from emberfield.operators import impute as I
from emberfield.operators import stats as ST
from emberfield.sources import files, geojson
from emberfield.sources.weather import parse_weather

RAW = f"with {X.RAW_CTE} "
CELLS = f"with {X.CELLS_CTE} "


# ---- sources and sinks ---------------------------------------------------------------------------


@check("s1_read_cells_csv", RAW + "select cell_id, longitude, latitude, LST_Corrected_C, LULC_ESA_2021, WorldPop_2020 from raw")
def s1(spark, d):
    raw = X.cells_raw(spark, d).select("cell_id", "longitude", "latitude", "LST_Corrected_C", "LULC_ESA_2021", "WorldPop_2020")
    path = scratch(spark, "csv")
    files.write_csv(raw, path)
    return files.read_cells_csv(spark, path, raw.schema)


@check("s2_parquet_round_trip", CELLS + "select cell_id, lon, lat, lst_celsius, LULC_ESA, NDVI_L from cells")
def s2(spark, d):
    path = scratch(spark, "cells")
    files.write_cells(X.cells(spark, d), path)
    return files.read_cells(spark, path).select("cell_id", "lon", "lat", "lst_celsius", "LULC_ESA", "NDVI_L")


def _ward_lines(spark, d):
    w = X.wards(spark, d).withColumnsRenamed({"ward_id": "prabhag_no", "ward_name": "Name"})
    path = scratch(spark, "wards")
    geojson.write_geojson(w.orderBy("ward_ord"), path, properties=["prabhag_no", "Name"], collection=True)
    return path


@check(
    "s3_read_wards_geojson",
    f"""with {X.WARDS_CTE} select ward_id, ward_name, cast(5 as int) as points,
      {q('sum(ax*byy - bx*ay)/2', 'area', 9)} from ward_edge group by ward_id, ward_name""",
)
def s3(spark, d):
    from emberfield.functions.geometry import parts_area

    w = geojson.read_wards_geojson(spark, _ward_lines(spark, d))
    return w.select(
        "ward_id", "ward_name", F.size(F.flatten("rings")).alias("points"), r6(parts_area("rings"), 9).alias("area")
    )


def _layer_lines(spark, d):
    """Roads as lines and buildings as polygons, one GeoJSON Feature per line."""
    p = X.table(spark, d, "part")
    b = X.view(spark, d, X.BUILDINGS)
    roads = X.view(spark, d, X.ROADS).join(p, F.col("road_id") == F.col("p_partkey")).select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.col("road_id").alias("key"), F.col("p_brand").alias("highway")).alias("properties"),
                F.struct(
                    F.lit("LineString").alias("type"),
                    F.array(F.array("ax", "ay"), F.array(F.col("bx"), F.col("byy"))).alias("coordinates"),
                ).alias("geometry"),
            )
        ).alias("value")
    )
    c = lambda sx, sy: F.array(F.col("cx") + sx * F.col("half"), F.col("cy") + sy * F.col("half"))
    houses = b.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.col("building_id").alias("key"), F.lit("yes").alias("building")).alias("properties"),
                F.struct(
                    F.lit("Polygon").alias("type"),
                    F.array(F.array(c(-1, -1), c(1, -1), c(1, 1), c(-1, 1), c(-1, -1))).alias("coordinates"),
                ).alias("geometry"),
            )
        ).alias("value")
    )
    path = scratch(spark, "layer")
    roads.unionByName(houses).write.text(path)
    return path


@check(
    "s4_read_feature_layer",
    f"""with b as ({X.oracle(X.BUILDINGS)}), r as ({X.oracle(X.ROADS)})
    select 'buildings' as layer, cast(building_id as varchar) as key, {q('4*half*half', 'size', 3)} from b
    union all select 'roads', cast(road_id as varchar), {q('sqrt((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay))', None, 3)} from r""",
)
def s4(spark, d):
    from emberfield.functions.geometry import line_segments, parts_area

    path = _layer_lines(spark, d)
    houses = geojson.read_feature_layer(spark, path, "buildings", lines=True)
    roads = geojson.read_feature_layer(spark, path, "roads", lines=True)
    length = F.aggregate(
        line_segments("parts"), F.lit(0.0),
        lambda s, e: s + F.sqrt((e.bx - e.ax) * (e.bx - e.ax) + (e.by - e.ay) * (e.by - e.ay)),
    )
    key = F.col("tags")["key"].alias("key")
    return houses.select("layer", key, r6(parts_area("parts"), 3).alias("size")).unionByName(
        roads.select("layer", key, r6(length, 3).alias("size"))
    )


@check(
    "s5_filter_tags",
    """select p_partkey as feature_id, 'parks' as tag_set from part
      where p_size % 6 in (0, 1) or p_partkey % 5 = 0
    union all select p_partkey, 'water' from part where p_partkey % 7 = 0 or p_partkey % 11 = 0""",
)
def s5(spark, d):
    f = X.table(spark, d, "part").select(
        F.col("p_partkey").alias("feature_id"),
        F.map_from_entries(
            F.filter(
                F.array(
                    F.struct(
                        F.lit("leisure").alias("k"),
                        F.element_at(F.array(*[F.lit(x) for x in ("park", "garden", "pitch", "track", "marina", "plaza")]), (F.col("p_size") % 6 + 1).cast("int")).alias("v"),
                    ),
                    F.struct(F.lit("landuse").alias("k"), F.when(F.col("p_partkey") % 5 == 0, "grass").otherwise("retail").alias("v")),
                    F.struct(F.lit("natural").alias("k"), F.when(F.col("p_partkey") % 7 == 0, "water").alias("v")),
                    F.struct(F.lit("waterway").alias("k"), F.when(F.col("p_partkey") % 11 == 0, "canal").alias("v")),
                ),
                lambda e: e.v.isNotNull(),
            )
        ).alias("tags"),
    )
    parks = geojson.filter_tags(f, S.PARK_TAGS).select("feature_id", F.lit("parks").alias("tag_set"))
    water = geojson.filter_tags(f, S.WATER_TAGS_WIDE).select("feature_id", F.lit("water").alias("tag_set"))
    return parks.unionByName(water)


@check(
    "s6_write_geojson",
    f"""with wards as ({X.oracle(X.WARDS)}) select 'Feature' as kind, ward_name, ward_id, 'Polygon' as geom_type,
      x0 as first_x, y01 + h as third_y, 5 as points from wards""",
)
def s6(spark, d):
    path = scratch(spark, "geojson")
    geojson.write_geojson(X.wards(spark, d), path, properties=["ward_id", "ward_name"])
    t = spark.read.text(path)
    g = lambda p, n: F.get_json_object("value", p).alias(n)
    return t.select(
        g("$.type", "kind"), g("$.properties.ward_name", "ward_name"), g("$.properties.ward_id", "ward_id"),
        g("$.geometry.type", "geom_type"), g("$.geometry.coordinates[0][0][0]", "first_x").cast("double").alias("first_x"),
        g("$.geometry.coordinates[0][2][1]", "third_y").cast("double").alias("third_y"),
        F.size(F.from_json(F.get_json_object("value", "$.geometry.coordinates[0]"), "array<array<double>>")).alias("points"),
    )


@check(
    "s7_plan_csv_round_trip",
    f"""with {X.PLANS_CTE} select ward_id, intervention_type, case intervention_type when 0 then 'No Action'
      when 1 then 'Tree Cover / Urban Forest' when 2 then 'Cool Roofs' when 3 then 'Reflective / Permeable Pavement'
      else 'Blue-Green Infrastructure' end as intervention_label, frac as intervention_frac from plans""",
)
def s7(spark, d):
    from emberfield.functions.scalars import intervention_label

    p = X.plans(spark, d).withColumn("intervention_label", intervention_label("intervention_type"))
    path = scratch(spark, "plan")
    files.write_plan_csv(p.withColumnRenamed("frac", "intervention_frac"), path)
    return files.read_plan_csv(spark, path)


SPLIT_SQL = """select c_custkey, c_nationkey % 3 as g, c_acctbal as actual, c_acctbal + (c_custkey % 17) - 8 as predicted from customer"""


@check(
    "s8_write_metrics_json",
    f"""with p as ({SPLIT_SQL}) select g as split, count(*) as n, {q('avg(abs(actual-predicted))', 'mae')}, cast(2 as int) as features from p group by g""",
)
def s8(spark, d):
    p = X.view(spark, d, SPLIT_SQL.replace("customer", "{customer}")).withColumnRenamed("g", "split")
    path = scratch(spark, "metrics")
    files.write_metrics_json(ST.regression_metrics(p), ["NDVI_L", "albedo"], path)
    doc = spark.read.schema(
        "metrics map<string, struct<rows: bigint, mae: double, rmse: double, r2: double>>, features array<string>"
    ).json(path)
    return doc.select(F.explode("metrics").alias("split", "m"), F.size("features").alias("features")).select(
        F.col("split").cast("int").alias("split"), F.col("m.rows").alias("n"), r6("m.mae").alias("mae"), "features"
    )


@check(
    "s9_write_samples_csv",
    f"""with {X.OBS_CTE}, img as (select px, py, {q('median(t2m_k)', 't2m_k', 9)} from obs group by px, py)
    select px, py, t2m_k from img order by md5(concat(px, '|', py, '|42')) limit 200""",
)
def s9(spark, d):
    from emberfield.operators.raster import composite, sample_pixels

    img = rounded(composite(X.view(spark, d, X.PIXEL_OBS), ["t2m_k"]), 9)
    path = scratch(spark, "samples")
    files.write_samples_csv(sample_pixels(img, 200, 42), path)
    return files.read_cells_csv(spark, path, img.schema)


WEATHER_CASE = "case weather_code " + " ".join(f"when {k} then '{v}'" for k, v in S.WEATHER_TEXT.items()) + " else 'Current weather' end"
WEATHER_SQL = f"""with w as (select event_id, event_id % 29 <> 0 as ok from events), v as (select event_id, ok,
  case when ok then cast(20 + event_id % 20 as double) end as temperature_C,
  case when ok and event_id % 5 <> 0 then cast(21 + event_id % 23 as double) end as feels_like_C,
  case when ok then cast(30 + event_id % 60 as double) end as humidity_pct,
  case when ok then cast(event_id % 12 as double) end as wind_speed_m_s,
  case when ok then cast(event_id % 360 as double) end as wind_direction_deg,
  case when ok then cast(event_id % 25 as double) end as wind_gust_m_s,
  case when ok then cast(940 + event_id % 30 as double) end as pressure_hpa,
  case when ok then cast(event_id % 101 as double) end as cloud_cover_pct,
  case when ok then cast(event_id % 9 as double) end as precipitation_mm,
  case when ok then cast(event_id % 7 as double) end as rain_mm,
  case when ok then '2024-01-01T00:00' end as "time",
  case when ok then cast((event_id*3) % 100 as int) end as weather_code from w)
select * exclude (ok), case when ok then {WEATHER_CASE} end as condition,
  case when ok then 'ok' else 'unavailable' end as status from v"""


@check("s10_parse_weather", WEATHER_SQL)
def s10(spark, d):
    return parse_weather(X.view(spark, d, X.WEATHER_JSON)).drop("payload")


# ---- projections, schema, audits -----------------------------------------------------------------


@check(
    "p1_align_columns",
    RAW + """select cell_id, longitude as lon, latitude as lat, LST_Corrected_C as lst_celsius, Temp_C_mean as air_temp_C,
      RH_pct as humidity_pct, WorldPop_2020 as pop_density, LULC_ESA_2021 as LULC_ESA, avg_rad as ntl_radiance from raw""",
)
def p1(spark, d):
    return C.align_columns(X.cells_raw(spark, d)).select(
        "cell_id", "lon", "lat", "lst_celsius", "air_temp_C", "humidity_pct", "pop_density", "LULC_ESA", "ntl_radiance"
    )


@check("p2_cast_types", CELLS + "select cell_id, LULC_ESA, cast(cell_id as varchar) as grid_id from cells")
def p2(spark, d):
    raw = C.align_columns(X.cells_raw(spark, d)).withColumn("grid_id", F.col("cell_id"))
    return C.cast_types(raw).select("cell_id", "LULC_ESA", "grid_id")


@check("p3_require_columns", CELLS + "select count(*) as n from cells")
def p3(spark, d):
    cells = X.cells(spark, d)
    try:
        C.require_columns(X.cells_raw(spark, d))
        raise AssertionError("the raw table must not pass")
    except C.SchemaError:
        pass
    return C.require_columns(cells).agg(F.count(F.lit(1)).alias("n"))


# written out apart from the library's lists: what the raw table lacks and what nobody asked for
_MISSING = """lst_celsius emissivity NDVI_L NDWI_L MNDWI_L NDBI_L EVI_L SAVI_L NBI_L NDVI_S2 NDWI_S2 MNDWI_S2 NDBI_S2 EVI_S2 SAVI_S2
  NBI_S2 air_temp_C air_temp_C_max air_temp_C_min rainfall_mm wind_speed humidity_pct pop_density GHSL_Pop_2020 GPW_PopDensity
  S2_Green BuiltUp_m2 Elevation_m Slope_deg Aspect_deg TPI_500m LULC_ESA solar_rad_W_m2 ntl_radiance""".split()
_KNOWN_SQL = ", ".join(f"'{c}'" for c in """L_Blue L_Green L_Red L_NIR L_SWIR1 L_SWIR2 albedo S2_Blue S2_Green S2_Red S2_NIR S2_SWIR1
  S2_SWIR2 children_ratio elderly_ratio grid_id lon lat year season longitude latitude system:index .geo""".split())


@check(
    "p4_schema_audit",
    RAW + f""", have as (select column_name as c from (describe select * from raw)),
    filled as (select name, count(value) as n from (unpivot (select columns(*)::varchar from raw) on columns(*) into name name value value) group by name),
    known(c) as (values {", ".join(f"('{c}')" for c in _MISSING)})
    select c as "column", 'missing' as status, 0::bigint as n_filled from known where c not in (select c from have)
    union all select c, 'extra', coalesce(n, 0) from have left join filled on name = c where c not in (select c from known) and c not in ({_KNOWN_SQL})""",
)
def p4(spark, d):
    return C.schema_audit(X.cells_raw(spark, d))


_NULLABLE = ["LST_Corrected_C", "L_SWIR2", "S2_SWIR2", "albedo", "LULC_ESA_2021", "WorldPop_2020", "avg_rad"]


@check(
    "p5_null_report",
    RAW + "select * from (" + " union all ".join(
        f"""select '{c}' as "column", count(*) - count({c}) as null_count,
        {q(f'(count(*) - count({c})) * 100e0 / count(*)', 'null_pct', 4)} from raw""" for c in _NULLABLE
    ) + ") where null_count > 0",
)
def p5(spark, d):
    return C.null_report(X.cells_raw(spark, d))


@check("p6_drop_missing_target", CELLS + "select cell_id, lst_celsius from cells where lst_celsius is not null")
def p6(spark, d):
    return C.drop_missing_target(X.cells(spark, d)).select("cell_id", "lst_celsius")


@check(
    "p7_validate_coords",
    "select count(*) as rows, count(*) filter (where try_cast(case when o_orderkey % 50 = 0 then 'n/a' else '73.8' end as double) is null) as invalid_rows from orders",
)
def p7(spark, d):
    C.validate_coords(X.cells(spark, d))
    bad = X.table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise("73.8").alias("lon"), F.lit("18.5").alias("lat")
    )
    return C.coord_counts(bad)


@check(
    "p8_pick_column",
    """select n_nationkey, cast(n_nationkey + 1 as varchar) as ward_id, n_name as ward_name from nation""",
)
def p8(spark, d):
    w = X.wards(spark, d).withColumnsRenamed({"ward_id": "PRABHAG_NO", "ward_name": "WARD_NAME"})
    wid = C.pick_column(w.columns, S.WARD_ID_CANDIDATES)
    name = C.pick_column(w.columns, S.WARD_NAME_CANDIDATES)
    return w.select((F.col("ward_ord") - 1).cast("int").alias("n_nationkey"), F.col(wid).alias("ward_id"), F.col(name).alias("ward_name"))


_HAVE = ["NDVI_L", "NDBI_L", "MNDWI_L", "EVI_L", "SAVI_L", "albedo", "air_temp_C", "humidity_pct", "pop_density",
         "ntl_radiance", "children_ratio", "elderly_ratio", "road_density", "building_density", "impervious_ratio"]


@check(
    "p9_select_features",
    CELLS + "select * from (" + " union all ".join(
        [f"select '{c}' as feature, case when count({c}) > 0 then 'used' else 'all_null' end as status from cells" for c in _HAVE]
        + ["select 'wind_speed', case when count(nullif(air_temp_C, air_temp_C)) > 0 then 'used' else 'all_null' end from cells"]
        + [f"select '{c}', 'unavailable'" for c in S.MODEL_FEATURES if c not in (*_HAVE, "wind_speed", "Elevation_m")]
        + ["select 'Elevation_m', 'not_numeric'"]
        + [f"select '{c}', 'excluded'" for c in ("dist_water_m", "grid_id", "lst_celsius")]
    ) + ")",
)
def p9(spark, d):
    cells = X.cells(spark, d).withColumns(
        {"wind_speed": F.when(F.col("air_temp_C") != F.col("air_temp_C"), F.lit(1.0)), "Elevation_m": F.col("grid_id")}
    )
    return C.feature_status(cells)


@check("p10_assert_dataset", CELLS + "select count(*) as rows, count(*) - count(lst_celsius) as null_targets from cells")
def p10(spark, d):
    cells = X.cells(spark, d)
    kept = C.drop_missing_target(cells)
    C.assert_dataset(kept, expected_rows=None)
    return C.dataset_check(cells)


@check("p11_with_grid_id", CELLS + "select cell_id, grid_id from cells")
def p11(spark, d):
    return C.with_grid_id(C.align_columns(X.cells_raw(spark, d))).select("cell_id", "grid_id")


@check(
    "p12_filter_strict",
    """with t as (select o_orderkey as cell_id, case when o_orderkey % 3 = 0 then 'within' else 'nearest' end as m from orders),
      w as (select o_orderkey as cell_id, case when o_orderkey % 4 = 0 then null else 'w' end as ward_id from orders)
    select 'some_within' as input, cell_id from t where m = 'within'
    union all select 'none_within', cell_id from w where ward_id is not null""",
)
def p12(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"))
    a = o.withColumns(
        {"ward_id": F.lit("w"), "ward_join_method": F.when(F.col("cell_id") % 3 == 0, "within").otherwise("nearest")}
    )
    b = o.withColumns(
        {"ward_id": F.when(F.col("cell_id") % 4 != 0, "w"), "ward_join_method": F.lit("nearest")}
    )
    pick = lambda df, n: C.filter_strict(df).select(F.lit(n).alias("input"), "cell_id")
    return pick(a, "some_within").unionByName(pick(b, "none_within"))


@check(
    "p13_not_null_filter",
    CELLS + "select cell_id from cells where albedo is not null and pop_density is not null and LULC_ESA is not null",
)
def p13(spark, d):
    return C.not_null_filter(X.cells(spark, d), ["albedo", "pop_density", "LULC_ESA"]).select("cell_id")


@check(
    "p14_bbox_filter",
    CELLS + "select cell_id from cells where lon between 73.75e0 and 73.9e0 and lat between 18.45e0 and 18.6e0",
)
def p14a(spark, d):
    from emberfield.operators.spatial import bbox_filter

    return bbox_filter(X.cells(spark, d), 73.75, 18.45, 73.9, 18.6).select("cell_id")


@check(
    "p14_bbox_kept",
    CELLS + f"select cell_id, {q('lst_celsius', 'lst_celsius')} from cells where lon between 73.75e0 and 73.9e0 and lat between 18.45e0 and 18.6e0",
)
def p14_kept(spark, d):
    from emberfield.operators.point_index import open_point_index, write_point_index
    from emberfield.operators.spatial import bbox_filter

    folder = scratch(spark, "place")
    write_point_index(X.cells(spark, d).select("cell_id", "lon", "lat", "lst_celsius"), folder, node_rows=2_000)
    return rounded(bbox_filter(open_point_index(spark, folder), 73.75, 18.45, 73.9, 18.6).select("cell_id", "lst_celsius"))


@check(
    "p14_study_bounds",
    CELLS + f""", g as (select min(lon) as w, max(lon) as e, min(lat) as s, max(lat) as n from cells)
    select 'buffer' as pad, {q('w-0.02e0','min_lon')}, {q('s-0.02e0','min_lat')}, {q('e+0.02e0','max_lon')}, {q('n+0.02e0','max_lat')} from g
    union all select 'module', {q('w-0.01e0')}, {q('s-0.01e0')}, {q('e+0.01e0')}, {q('n+0.01e0')} from g
    union all select 'viewport', {q('w-greatest((e-w)*0.04e0, 0.01e0)')}, {q('s-greatest((n-s)*0.04e0, 0.01e0)')},
      {q('e+greatest((e-w)*0.04e0, 0.01e0)')}, {q('n+greatest((n-s)*0.04e0, 0.01e0)')} from g""",
)
def p14b(spark, d):
    from emberfield.operators.spatial import study_bounds

    cells = X.cells(spark, d)
    one = lambda p: rounded(study_bounds(cells, p)).withColumn("pad", F.lit(p))
    return one("buffer").unionByName(one("module")).unionByName(one("viewport"))


# ---- imputation ----------------------------------------------------------------------------------

_ALB = "least(greatest(0.356e0*{b}_Blue + 0.13e0*{b}_Red + 0.373e0*{b}_NIR + 0.085e0*{b}_SWIR1 + 0.072e0*{b}_SWIR2 - 0.0018e0, 0e0), 1e0)"
_TIER = lambda b: f"case when {b}_SWIR2 is not null then {_ALB.format(b=b)} end"
ALBEDO_CTE = f"""alb as (select * replace (coalesce(albedo, {_TIER('L')}, {_TIER('S2')}) as albedo) from cells),
  alb_med as (select LULC_ESA as k, median(albedo) as m from alb where LULC_ESA is not null group by LULC_ESA),
  alb3 as (select a.* replace (coalesce(a.albedo, m.m) as albedo) from alb a left join alb_med m on a.LULC_ESA = m.k),
  alb4 as (select * replace (coalesce(albedo, (select median(albedo) from alb3)) as albedo) from alb3)"""


@check("i1_fill_albedo", CELLS + f", {ALBEDO_CTE} select cell_id, {q('albedo', 'albedo', 9)} from alb4")
def i1(spark, d):
    return I.fill_albedo(X.cells(spark, d)).select("cell_id", r6("albedo", 9).alias("albedo"))


@check(
    "i2_fill_mode",
    CELLS + """, mode as (select LULC_ESA as v from cells where LULC_ESA is not null group by LULC_ESA order by count(*) desc, LULC_ESA limit 1)
    select cell_id, coalesce(LULC_ESA, (select v from mode)) as LULC_ESA from cells""",
)
def i2(spark, d):
    return I.fill_mode(X.cells(spark, d)).select("cell_id", "LULC_ESA")


_GM = ["L_SWIR2", "S2_SWIR2", "pop_density", "ntl_radiance", "albedo"]
GROUPED_CTE = f"""gm as (select LULC_ESA as k, {', '.join(f'median({c}) as {c}' for c in _GM)} from cells where LULC_ESA is not null group by LULC_ESA),
  g1 as (select c.* replace ({', '.join(f'coalesce(c.{c}, gm.{c}) as {c}' for c in _GM)}) from cells c left join gm on c.LULC_ESA = gm.k),
  g2 as (select * replace ({', '.join(f'coalesce({c}, (select median({c}) from g1)) as {c}' for c in _GM)}) from g1)"""


@check("i3_impute_grouped_median", CELLS + f", {GROUPED_CTE} select cell_id, {', '.join(q(c, c) for c in _GM)} from g2")
def i3(spark, d):
    return rounded(I.impute_grouped_median(X.cells(spark, d)).select("cell_id", *_GM))


@check(
    "i4_median_imputer",
    CELLS + f""", m as (select median(pop_density) as p, median(ntl_radiance) as n from cells where cell_id % 5 <> 0)
    select cell_id, {q('coalesce(pop_density, (select p from m))', 'pop_density')}, {q('coalesce(ntl_radiance, (select n from m))', 'ntl_radiance')} from cells""",
)
def i4(spark, d):
    cells = X.cells(spark, d)
    medians = I.fit_medians(cells.filter(F.col("cell_id") % 5 != 0), ["pop_density", "ntl_radiance"])
    return rounded(I.apply_medians(cells, medians).select("cell_id", *medians))


@check("i5_fill_component", CELLS + "select cell_id, coalesce(albedo, 5e-1) as albedo from cells")
def i5(spark, d):
    return I.fill_component(X.cells(spark, d), ["albedo"]).select("cell_id", "albedo")


@check(
    "batch_clean_cells",
    CELLS + f""", {ALBEDO_CTE}, tgt as (select * from alb4 where lst_celsius is not null),
    mode as (select LULC_ESA as v from tgt where LULC_ESA is not null group by LULC_ESA order by count(*) desc, LULC_ESA limit 1),
    md as (select * replace (coalesce(LULC_ESA, (select v from mode)) as LULC_ESA) from tgt),
    gm as (select LULC_ESA as k, {', '.join(f'median({c}) as {c}' for c in _GM[:-1])} from md group by LULC_ESA)
    select cell_id, LULC_ESA, {q('lst_celsius', 'lst_celsius')}, {q('albedo', 'albedo')},
      {', '.join(q(f'coalesce(md.{c}, gm.{c})', c) for c in _GM[:-1])} from md left join gm on md.LULC_ESA = gm.k""",
)
def batch_clean(spark, d):
    from emberfield.plans.batch import clean_cells

    cols = ["cell_id", "LULC_ESA", "lst_celsius", "albedo", *_GM[:-1]]
    return rounded(clean_cells(X.cells_raw(spark, d)).select(*cols))
