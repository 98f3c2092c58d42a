"""Input tables of the checks, derived from the given tables with exact arithmetic.

Each text runs unchanged on Spark and on the oracle engine; ``{orders}`` and the like stand for a source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS_RAW = """
select o_orderkey as cell_id,
  73.65e0 + ((o_orderkey*7919) % 4500)/1e4 as longitude,
  18.35e0 + ((o_orderkey*6007 + o_custkey*31) % 4000)/1e4 as latitude,
  case when o_orderkey % 101 = 0 then null else
    24e0 + 24e0*(((o_orderkey*101)%2400)/2400e0)*(((o_orderkey*101)%2400)/2400e0)*(((o_orderkey*101)%2400)/2400e0)*(((o_orderkey*101)%2400)/2400e0)
  end as LST_Corrected_C,
  3e-2 + ((o_orderkey*13) % 97)/1e3 as L_Blue,
  5e-2 + ((o_orderkey*17) % 101)/1e3 as L_Green,
  4e-2 + ((o_orderkey*29) % 149)/1e3 as L_Red,
  1e-1 + ((o_orderkey*37) % 307)/1e3 as L_NIR,
  8e-2 + ((o_orderkey*41) % 263)/1e3 as L_SWIR1,
  case when o_orderkey % 11 = 0 then null else 6e-2 + ((o_orderkey*43) % 211)/1e3 end as L_SWIR2,
  4e-2 + ((o_orderkey*19) % 97)/1e3 as S2_Blue,
  5e-2 + ((o_orderkey*31) % 149)/1e3 as S2_Red,
  1e-1 + ((o_orderkey*47) % 307)/1e3 as S2_NIR,
  8e-2 + ((o_orderkey*59) % 263)/1e3 as S2_SWIR1,
  case when o_orderkey % 7 = 0 then null else 6e-2 + ((o_orderkey*67) % 211)/1e3 end as S2_SWIR2,
  case when o_orderkey % 3 = 0 then null else 1e-1 + ((o_orderkey*71) % 250)/1e3 end as albedo,
  case when o_orderkey % 23 = 0 then null
       when o_custkey % 7 = 0 then '10' when o_custkey % 7 = 1 then '20' when o_custkey % 7 = 2 then '30.0'
       when o_custkey % 7 = 3 then '40' when o_custkey % 7 = 4 then '50' when o_custkey % 7 = 5 then '60' else 'x' end as LULC_ESA_2021,
  22e0 + ((o_orderkey*73) % 140)/1e1 as Temp_C_mean,
  30e0 + ((o_orderkey*79) % 650)/1e1 as RH_pct,
  case when o_orderkey % 13 = 0 then null else ((o_orderkey*61) % 9000)/1e0 end as WorldPop_2020,
  case when o_orderkey % 17 = 0 then null else ((o_orderkey*83) % 800)/1e1 end as avg_rad,
  ((o_orderkey*89) % 350)/1e3 as children_ratio,
  ((o_orderkey*97) % 250)/1e3 as elderly_ratio,
  ((o_orderkey*103) % 100)/1e2 as building_density,
  ((o_orderkey*107) % 300)/1e1 as road_density,
  ((o_orderkey*109) % 3000)/1e0 as dist_water_m
from {orders}
"""

WARDS = """
select cast(n_nationkey + 1 as bigint) as ward_ord,
  cast(n_nationkey + 1 as varchar(10)) as ward_id, n_name as ward_name,
  73.70e0 + (n_nationkey % 5)*7e-2 as x0, 73.70e0 + (n_nationkey % 5 + 1)*7e-2 as x1,
  18.40e0 + floor(n_nationkey/5e0)*6e-2 + (n_nationkey % 5)*4e-3 as y00,
  18.40e0 + floor(n_nationkey/5e0)*6e-2 + (n_nationkey % 5 + 1)*4e-3 as y01,
  6e-2 as h
from {nation}
"""

ROADS = """
select p_partkey as road_id,
  ((p_partkey*7907) % 47000)/1e0 - 23500e0 as ax, ((p_partkey*6011) % 44000)/1e0 - 22000e0 as ay,
  ((p_partkey*7907) % 47000)/1e0 - 23500e0 + ((p_partkey*17) % 400) - 200 as bx,
  ((p_partkey*6011) % 44000)/1e0 - 22000e0 + ((p_partkey*23) % 400) - 200 as byy
from {part}
"""

BUILDINGS = """
select p_partkey as building_id,
  ((p_partkey*5003) % 47000)/1e0 - 23500e0 as cx, ((p_partkey*9001) % 44000)/1e0 - 22000e0 as cy,
  1e1 + p_size as half
from {part}
"""

WATER = """
select s_suppkey as water_id,
  ((s_suppkey*3571) % 47000)/1e0 - 23500e0 as x_m, ((s_suppkey*4513) % 44000)/1e0 - 22000e0 as y_m
from {supplier}
"""

PIXEL_OBS = """
select l_partkey % 40 as px, l_suppkey % 25 as py, l_shipdate as ts,
  7000 + ((l_orderkey*13) % 6000) as dn_red, 7500 + ((l_orderkey*17) % 14000) as dn_nir,
  7600 + ((l_orderkey*19) % 9000) as dn_swir1, 7100 + ((l_orderkey*61) % 5000) as dn_blue,
  7200 + ((l_orderkey*67) % 6000) as dn_green, 7300 + ((l_orderkey*71) % 8000) as dn_swir2,
  l_orderkey*8 + l_linenumber as scene_id, l_linenumber + 2 as scene_class, 40000 + ((l_orderkey*29) % 9000) as dn_st,
  cast(l_quantity as int) as qa, (l_orderkey*7) % 40 as cloud_cover,
  280e0 + ((l_orderkey*31) % 250)/1e1 as t2m_k, 275e0 + ((l_orderkey*37) % 150)/1e1 as td_k,
  ((l_orderkey*41) % 80)/1e1 - 4e0 as u10, ((l_orderkey*43) % 80)/1e1 - 4e0 as v10,
  ((l_orderkey*47) % 90)/1e4 as rain_m, 1e7 + ((l_orderkey*53) % 900)*1e4 as solar_j,
  case when l_partkey % 9 = 0 then null else l_partkey % 4 end as qc,
  270e0 + ((l_orderkey*59) % 800)/1e1 as lst_k
from {lineitem}
"""

CELL_SERIES = """
select event_id, cast(user_id as varchar(20)) as grid_id, ts, cast(ts as date) as date,
  20e0 + value/1e1 as lst_celsius, ((event_id*37) % 200)/1e2 - 1e0 as NDVI, ((event_id*53) % 200)/1e2 - 1e0 as NDBI
from {events}
"""

QUERY_POINTS = """
select s_suppkey as qid, 18.35e0 + ((s_suppkey*613) % 4000)/1e4 as lat, 73.65e0 + ((s_suppkey*911) % 4500)/1e4 as lon
from {supplier}
"""

WEATHER_JSON = """
select event_id, case when event_id % 29 = 0 then 'not json' else concat(
  '{{"current":{{"time":"2024-01-01T00:00","temperature_2m":', cast(20 + event_id % 20 as varchar(10)),
  case when event_id % 5 = 0 then '' else concat(',"apparent_temperature":', cast(21 + event_id % 23 as varchar(10))) end,
  ',"relative_humidity_2m":', cast(30 + event_id % 60 as varchar(10)),
  ',"wind_speed_10m":', cast(event_id % 12 as varchar(10)), ',"wind_direction_10m":', cast(event_id % 360 as varchar(10)),
  ',"wind_gusts_10m":', cast(event_id % 25 as varchar(10)), ',"surface_pressure":', cast(940 + event_id % 30 as varchar(10)),
  ',"cloud_cover":', cast(event_id % 101 as varchar(10)), ',"precipitation":', cast(event_id % 9 as varchar(10)),
  ',"rain":', cast(event_id % 7 as varchar(10)),
  ',"weather_code":', cast((event_id*3) % 100 as varchar(10)), '}}}}') end as payload
from {events}
"""

# terrain: one pixel per customer on a 128-wide grid
DEM = """
select c_custkey % 128 as px, floor(c_custkey/128e0) as pyf, 500e0 + ((c_custkey*37) % 211)/1e1 + (c_custkey % 128)/4e0 as elevation
from {customer}
"""

TABLE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def tables_in(text: str) -> list[str]:
    return sorted(set(TABLE.findall(text)))


def oracle(text: str) -> str:
    """The text for the oracle engine, where source tables are views of their own name."""
    return text.format(**{t: t for t in tables_in(text)}).strip()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# tables whose derived views feed compute-heavy operators, with their key
SPREAD = {"orders": "o_orderkey", "part": "p_partkey", "lineitem": "l_orderkey"}


# Rows of a source table in one task: a few narrow, well packed columns become some fifty doubles a row.
TASK_ROWS = 250_000


def wide(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table over all cores, in tasks of bounded rows: a small test table is one file and would be one task, and
    files of a large one are far smaller than what is derived from them."""
    df, cores = table(spark, folder, name), spark.sparkContext.defaultParallelism
    if name not in SPREAD:
        return df
    parts = max(cores, -(-df.count() // TASK_ROWS))  # counted from the files' footers
    return df.repartition(parts, SPREAD[name]) if len(df.inputFiles()) < parts else df


def view(spark: SparkSession, folder: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: wide(spark, folder, t) for t in tables_in(text)})


# --------------------------------------------------------------------------------------------------
# Spark side of the derived tables: through the library's operators
# --------------------------------------------------------------------------------------------------


def cells_raw(spark, folder):
    return view(spark, folder, CELLS_RAW)


def cells(spark, folder):
    """Aligned, typed, with indices, impervious share, grid id and local metres."""
    from emberfield.functions.bands import impervious_ratio
    from emberfield.operators.columns import align_columns, cast_types, with_grid_id, with_indices

    out = with_grid_id(with_indices(cast_types(align_columns(cells_raw(spark, folder)))))
    return out.withColumn("impervious_ratio", impervious_ratio("building_density", "road_density"))


def metres(df: DataFrame) -> DataFrame:
    x, y = to_plane(F.col("lon"), F.col("lat"))
    return df.withColumns({"x_m": x, "y_m": y})


def to_plane(lon, lat):
    return (lon - F.lit(73.85)) * F.lit(105560.0), (lat - F.lit(18.55)) * F.lit(110650.0)


def wards(spark, folder):
    w = view(spark, folder, WARDS)
    p = lambda x, y: F.struct(F.col(x).alias("x"), y.alias("y"))
    y00, y01, h = F.col("y00"), F.col("y01"), F.col("h")
    ring = F.array(p("x0", y00), p("x1", y01), p("x1", y01 + h), p("x0", y00 + h), p("x0", y00))
    return w.select("ward_ord", "ward_id", "ward_name", F.array(ring).alias("rings"))


def plans(spark, folder):
    """Every customer is a plan over the 25 wards."""
    ward = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n")
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("c"), ward)
    return rows.select(
        F.col("c").alias("plan_id"), (F.col("n") + 1).cast("string").alias("ward_id"),
        ((F.col("c") * 7 + F.col("n") * 11) % 5).cast("int").alias("intervention_type"),
        (((F.col("c") * 13 + F.col("n") * 29) % 101) / F.lit(100.0)).alias("frac"),
    )


def dem(spark, folder):
    return view(spark, folder, DEM).select("px", F.col("pyf").cast("long").alias("py"), "elevation")


# --------------------------------------------------------------------------------------------------
# oracle side of the derived tables: independent SQL
# --------------------------------------------------------------------------------------------------

RAW_CTE = f"raw as ({oracle(CELLS_RAW)})"
CELLS_CTE = f"""{RAW_CTE}, cells as (
select cell_id, longitude as lon, latitude as lat, LST_Corrected_C as lst_celsius,
  L_Blue, L_Green, L_Red, L_NIR, L_SWIR1, L_SWIR2, S2_Blue, S2_Red, S2_NIR, S2_SWIR1, S2_SWIR2, albedo,
  cast(round_even(try_cast(LULC_ESA_2021 as double), 0) as bigint) as LULC_ESA,
  Temp_C_mean as air_temp_C, RH_pct as humidity_pct, WorldPop_2020 as pop_density, avg_rad as ntl_radiance,
  children_ratio, elderly_ratio, building_density, road_density, dist_water_m,
  format('{{:.4f}}_{{:.4f}}', latitude, longitude) as grid_id,
  (L_NIR - L_Red)/(L_NIR + L_Red + 1e-9) as NDVI_L,
  (L_Green - L_NIR)/(L_Green + L_NIR + 1e-9) as NDWI_L,
  (L_Green - L_SWIR1)/(L_Green + L_SWIR1 + 1e-9) as MNDWI_L,
  (L_SWIR1 - L_NIR)/(L_SWIR1 + L_NIR + 1e-9) as NDBI_L,
  2.5e0*(L_NIR - L_Red)/(L_NIR + 6e0*L_Red - 7.5e0*L_Blue + 1e0 + 1e-9) as EVI_L,
  1.5e0*(L_NIR - L_Red)/(L_NIR + L_Red + 5e-1 + 1e-9) as SAVI_L,
  L_Red*L_SWIR1/(L_NIR + 1e-9) as NBI_L,
  (S2_NIR - S2_Red)/(S2_NIR + S2_Red + 1e-9) as NDVI_S2,
  (S2_SWIR1 - S2_NIR)/(S2_SWIR1 + S2_NIR + 1e-9) as NDBI_S2,
  least(greatest(building_density + 3e-2*road_density, 0e0), 1e0) as impervious_ratio,
  (longitude - 73.85e0)*105560e0 as x_m, (latitude - 18.55e0)*110650e0 as y_m
from raw)"""
WARDS_CTE = f"""wards as ({oracle(WARDS)}), ward_edge as (
select ward_ord, ward_id, ward_name, x0 as ax, y00 as ay, x1 as bx, y01 as byy from wards
union all select ward_ord, ward_id, ward_name, x1, y01, x1, y01 + h from wards
union all select ward_ord, ward_id, ward_name, x1, y01 + h, x0, y00 + h from wards
union all select ward_ord, ward_id, ward_name, x0, y00 + h, x0, y00 from wards)"""
WITHIN_CTE = """hits as (
select c.cell_id, e.ward_ord, count(*) as k from cells c join ward_edge e
  on (e.ay > c.lat) <> (e.byy > c.lat) and c.lon < (e.bx - e.ax)*(c.lat - e.ay)/(e.byy - e.ay) + e.ax
group by all), edge_hits as (
select c.cell_id, e.ward_ord from cells c join ward_edge e
  on c.lon between least(e.ax, e.bx) and greatest(e.ax, e.bx) and c.lat between least(e.ay, e.byy) and greatest(e.ay, e.byy)
  and (e.bx - e.ax)*(c.lat - e.ay) - (e.byy - e.ay)*(c.lon - e.ax) = 0), inside as (
select cell_id, min(ward_ord) as ward_ord from (select cell_id, ward_ord from hits where k % 2 = 1
  union all select * from edge_hits) group by cell_id)"""
PLANS_CTE = """plans as (
select c.c_custkey as plan_id, cast(n.n_nationkey + 1 as varchar) as ward_id,
  cast((c.c_custkey*7 + n.n_nationkey*11) % 5 as int) as intervention_type,
  ((c.c_custkey*13 + n.n_nationkey*29) % 101)/1e2 as frac
from customer c cross join nation n)"""
OBS_CTE = f"obs as ({oracle(PIXEL_OBS)})"
SERIES_CTE = f"series as ({oracle(CELL_SERIES)})"
QUERIES_CTE = f"queries as ({oracle(QUERY_POINTS)})"
