"""Checks of the raster operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.checks import fixtures as X
from emberfield.checks.formulas import _EM, _LST, _NIR, _RED, _RH
from emberfield.checks.registry import check, q, r6, rounded
from emberfield.functions import bands as B
from emberfield.operators import raster as R

OBS = f"with {X.OBS_CTE} "
_CLEAR = "qa & 30 = 0"
_SW = "(dn_swir1*2.75e-5-0.2e0)"


def _obs(spark, d):
    return X.view(spark, d, X.PIXEL_OBS)


@check(
    "r1_scene_filter",
    OBS + """select px, py, count(*) as n from obs where ts >= timestamp '1996-01-01' and ts < timestamp '1997-01-01'
      and cloud_cover < 20 and px between 5 and 30 and py between 2 and 20 group by px, py""",
)
def r1(spark, d):
    return R.scene_filter(_obs(spark, d), "1996-01-01", "1997-01-01", 20, (5, 2, 30, 20)).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))


@check(
    "r2_season_filter",
    OBS + """select 'hot' as season, month(ts) as m, count(*) as n from obs where month(ts) between 3 and 5 group by m
      union all select 'monsoon', month(ts) as m, count(*) from obs where month(ts) between 6 and 9 group by m
      union all select 'winter', month(ts) as m, count(*) from obs where month(ts) >= 11 or month(ts) <= 2 group by m""".replace("month(ts) as m", "cast(month(ts) as int) as m"),
)
def r2(spark, d):
    o = _obs(spark, d)
    one = lambda a, b, n: R.season_filter(o, a, b).groupBy(F.month("ts").alias("m")).agg(F.count(F.lit(1)).alias("n")).withColumn("season", F.lit(n))
    return one(3, 5, "hot").unionByName(one(6, 9, "monsoon")).unionByName(one(11, 2, "winter"))


@check(
    "r3_merge_collections",
    OBS + "select cloud_cover, count(*) as n from (select * from obs where cloud_cover < 20 union all select * from obs where cloud_cover < 10) group by cloud_cover",
)
def r3(spark, d):
    o = _obs(spark, d)
    return R.merge_collections(o.filter("cloud_cover < 20"), o.filter("cloud_cover < 10")).groupBy("cloud_cover").agg(F.count(F.lit(1)).alias("n"))


@check(
    "r4_join_first",
    """with p as (select event_id, user_id from events), s as (select c_custkey % 700 as user_id, min(c_custkey) as first_key from customer
      where c_custkey % 3 = 0 group by 1)
    select p.event_id, s.first_key from p join s on p.user_id = s.user_id""",
)
def r4(spark, d):
    p = X.table(spark, d, "events").select("event_id", "user_id")
    s = X.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(
        (F.col("c_custkey") % 700).alias("user_id"), F.col("c_custkey").alias("t"), F.col("c_custkey").alias("first_key")
    )
    return R.join_first(p, s, "user_id", ["t"]).select("event_id", "first_key")


@check(
    "r5_mask",
    OBS + f"select px, py, count(*) as n, count(case when {_CLEAR} then dn_red end) as clear, sum(case when {_CLEAR} then dn_red end)::bigint as total from obs group by px, py",
)
def r5(spark, d):
    m = R.mask(_obs(spark, d), B.qa_mask("qa"), ["dn_red"])
    return m.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"), F.count("dn_red").alias("clear"), F.sum("dn_red").alias("total"))


_M = lambda e: f"case when {_CLEAR} then {e} end"


@check(
    "r6_composite_median",
    OBS + f"select px, py, {q(f'median({_M(_RED)})', 'red', 9)}, {q(f'median({_M(_NIR)})', 'nir', 9)}, {q(f'median({_M(_SW)})', 'swir1', 9)} from obs group by px, py",
)
def r6a(spark, d):
    return rounded(R.composite(R.with_reflectance(_obs(spark, d)), ["red", "nir", "swir1"]), 9)


@check(
    "r6_composite_reducers",
    OBS + f"""select px, py, {q(f'avg({_M(_RED)})', 'mean', 12)}, {q(f'max({_M(_RED)})', 'max', 12)}, {q(f'min({_M(_RED)})', 'min', 12)},
      {q(f'sum({_M(_RED)})', 'sum', 12)}, count({_M(_RED)}) as count from obs group by px, py""",
)
def r6b(spark, d):
    o = R.with_reflectance(_obs(spark, d))
    parts = [R.composite(o, {k: "red"}, k) for k in ("mean", "max", "min", "sum", "count")]
    return rounded(R.band_stack(*parts), 12)


@check(
    "r7_lst_stack",
    OBS + f"select px, py, {q(f'median({_M(_LST)})', 'lst_celsius')}, {q(f'median({_M(_EM)})', 'emissivity')} from obs group by px, py",
)
def r7(spark, d):
    return rounded(R.lst_stack(_obs(spark, d)))


@check(
    "r8_weather_summary",
    OBS + f"""select px, py, {q('avg(t2m_k-273.15e0)', 'air_temp_C', 9)}, {q('max(t2m_k-273.15e0)', 'air_temp_C_max', 9)},
      {q('min(t2m_k-273.15e0)', 'air_temp_C_min', 9)}, {q('avg(sqrt(u10*u10+v10*v10))', 'wind_speed', 9)}, {q(f'avg({_RH})', 'humidity_pct', 9)},
      {q('sum(rain_m*1e3)', 'rainfall_mm', 9)} from obs group by px, py""",
)
def r8(spark, d):
    return rounded(R.weather_summary(_obs(spark, d)), 9)


@check(
    "r9_solar_summary",
    OBS + f"""select px, py, {q('avg(solar_j/86400e0)', 'solar_rad_W_m2', 9)},
      {q('avg(case when month(ts) between 3 and 5 then solar_j/86400e0 end)', 'solar_hot', 9)},
      {q('avg(case when month(ts) between 6 and 9 then solar_j/86400e0 end)', 'solar_monsoon', 9)} from obs group by px, py""",
)
def r9(spark, d):
    return rounded(R.solar_summary(_obs(spark, d)), 9)


@check(
    "r10_select_first",
    OBS + """, k as (select px, py, ts, dn_red, dn_st, dn_nir from obs where qc = 1)
    select px, py, dn_red, dn_st from (select *, row_number() over (partition by px, py order by ts, dn_red, dn_st) as rn from k) where rn = 1""",
)
def r10(spark, d):
    o = _obs(spark, d).select("px", "py", "ts", F.col("dn_red").alias("red"), F.col("dn_st").alias("st"), "dn_red", "dn_st", "qc")
    return R.select_first(o, {"qc": 1}, ["ts", "red", "st"]).select("px", "py", "dn_red", "dn_st")


DEM = f"with dem as (select px, cast(pyf as bigint) as py, elevation from ({X.oracle(X.DEM)})) "


@check(
    "r11_terrain_tpi",
    DEM + f"""select a.px, a.py, {q('any_value(a.elevation)', 'elevation', 9)}, {q('any_value(a.elevation) - avg(b.elevation)', 'tpi', 9)} from dem a
      join dem b on b.px between a.px - 5 and a.px + 5 and b.py between a.py - 5 and a.py + 5
        and (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) <= 25 group by a.px, a.py""",
)
def r11(spark, d):
    return rounded(R.terrain_tpi(X.dem(spark, d)), 9)


_NB = {(dx, dy): f"n{dx + 1}{dy + 1}" for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
_JOINS = " ".join(
    f"left join dem {n} on {n}.px = a.px + ({dx}) and {n}.py = a.py + ({dy})" for (dx, dy), n in _NB.items() if (dx, dy) != (0, 0)
)
_GX = "((n20.elevation+2*n21.elevation+n22.elevation)-(n00.elevation+2*n01.elevation+n02.elevation))/800e0"
_GY = "((n02.elevation+2*n12.elevation+n22.elevation)-(n00.elevation+2*n10.elevation+n20.elevation))/800e0"


@check(
    "r12_slope_aspect",
    DEM + f""", g as (select a.px, a.py, {_GX} as p, {_GY} as qq from dem a {_JOINS}),
    f as (select *, fmod(degrees(atan2(-p, -qq)) + 360e0, 360e0) as facing, atan(sqrt(p*p+qq*qq)) as sl from g)
    select px, py, {q('degrees(sl)', 'slope_deg')}, case when p <> 0 or qq <> 0 then {q('facing')} end as aspect_deg,
      case when sl is not null then {q('greatest(0e0, cos(radians(45e0))*cos(sl) + sin(radians(45e0))*sin(sl)*cos(radians(315e0)-radians(facing)))*255e0', None, 4)} end as hillshade from f""",
)
def r12(spark, d):
    out = R.slope_aspect(X.dem(spark, d))
    return out.select("px", "py", r6("slope_deg").alias("slope_deg"), r6("aspect_deg").alias("aspect_deg"), r6("hillshade", 4).alias("hillshade"))


_YEAR = lambda y: f"(select px, py, avg(t2m_k) as v from obs where year(ts) = {y} group by px, py)"


@check("r13_change", OBS + f"select a.px, a.py, {q('a.v - b.v', 'change', 9)} from {_YEAR(1998)} a join {_YEAR(1996)} b on a.px = b.px and a.py = b.py")
def r13(spark, d):
    o = _obs(spark, d)
    img = lambda y: R.composite(R.scene_filter(o, f"{y}-01-01", f"{y + 1}-01-01"), {"v": "t2m_k"}, "mean")
    return rounded(R.change(img(1998), img(1996), "v"), 9)


@check(
    "r14_resample_bilinear",
    DEM + f""", fine as (select distinct (o_orderkey*13) % 500 as px, (o_orderkey*7) % 460 as py from orders),
    g as (select px, py, (px+0.5e0)/4e0-0.5e0 as gx, (py+0.5e0)/4e0-0.5e0 as gy from fine),
    h as (select *, cast(floor(gx) as bigint) as qx, cast(floor(gy) as bigint) as qy from g)
    select h.px, h.py, {q('a.elevation*(1-(gx-qx))*(1-(gy-qy)) + b.elevation*(gx-qx)*(1-(gy-qy)) + c.elevation*(1-(gx-qx))*(gy-qy) + e.elevation*(gx-qx)*(gy-qy)', 'elevation', 9)}
    from h left join dem a on a.px = qx and a.py = qy left join dem b on b.px = qx+1 and b.py = qy
      left join dem c on c.px = qx and c.py = qy+1 left join dem e on e.px = qx+1 and e.py = qy+1""",
)
def r14(spark, d):
    o = X.table(spark, d, "orders")
    fine = o.select((F.col("o_orderkey") * 13 % 500).alias("px"), (F.col("o_orderkey") * 7 % 460).alias("py")).distinct()
    return rounded(R.resample_bilinear(X.dem(spark, d), fine, "elevation", 4.0), 9)


@check(
    "r15_band_stack",
    OBS + f"""select px, py, {q('avg(t2m_k)', 't', 9)}, {q('max(solar_j)', 's', 9)}, {q('min(dn_red)', 'r', 0)} from obs
      where px between 3 and 35 and py between 1 and 22 group by px, py""",
)
def r15(spark, d):
    o = R.scene_filter(_obs(spark, d), "1900-01-01", "2100-01-01", None, (3, 1, 35, 22))
    a, b = R.composite(o, {"t": "t2m_k"}, "mean"), R.composite(o, {"s": "solar_j"}, "max")
    c = R.composite(o, {"r": "dn_red"}, "min").withColumn("r", F.col("r").cast("double"))
    return rounded(R.band_stack(a, b, c), 9)


@check(
    "r16_sample_pixels",
    OBS + f", img as (select px, py, avg(t2m_k) as v from obs group by px, py) select px, py, {q('v', 'v', 9)} from img order by md5(concat(px, '|', py, '|42')) limit 400",
)
def r16(spark, d):
    return rounded(R.sample_pixels(R.composite(_obs(spark, d), {"v": "t2m_k"}, "mean"), 400, 42), 9)


@check(
    "r17_attach_coords",
    OBS + """select distinct px, py, 73.7e0 + px*1e-3 as lon, 18.4e0 + py*1e-3 as lat, '2023' as year, 'hot_MAM' as season,
      '2023-03-01' as start_date, '2023-06-01' as end_date, format('{:.4f}_{:.4f}', 18.4e0 + py*1e-3, 73.7e0 + px*1e-3) as grid_id from obs""",
)
def r17(spark, d):
    pix = _obs(spark, d).select("px", "py").distinct()
    return R.attach_coords(pix, 73.7, 18.4, 1e-3, 2023, "hot_MAM", "2023-03-01", "2023-06-01")


_ND = lambda a, b: f"({a}-{b})/nullif({a}+{b}, 0)"


_SR = lambda b: f"(dn_{b}*2.75e-5-0.2e0)"
_BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
_ALBEDO = "least(greatest(0.356e0*blue + 0.130e0*red + 0.373e0*nir + 0.085e0*swir1 + 0.072e0*swir2 - 0.0018e0, 0e0), 1e0)"


def _seven(s):
    return f"""{_ND('nir', 'red')} as NDVI_{s}, {_ND('green', 'nir')} as NDWI_{s}, {_ND('green', 'swir1')} as MNDWI_{s}, {_ND('swir1', 'nir')} as NDBI_{s},
      2.5e0*(nir-red)/nullif(nir+6e0*red-7.5e0*swir1+1e0, 0) as EVI_{s}, 1.5e0*(nir-red)/nullif(nir+red+0.5e0, 0) as SAVI_{s}, red*swir1/nullif(nir, 0) as NBI_{s}"""


_SEVEN = ("NDVI", "NDWI", "MNDWI", "NDBI", "EVI", "SAVI", "NBI")
_LANDSAT = "select px, py, " + ", ".join(f"median({_M(_SR(b))}) as {b}" for b in _BANDS) + f", median({_M(_LST)}) as lst_celsius, median({_M(_EM)}) as emissivity"
_CLOUD_SQL = "select distinct l_orderkey*8 + l_linenumber as scene_id, (l_orderkey*73) % 40 as probability from lineitem where l_orderkey % 6 <> 0"
_S2_SQL = "select px, py, " + ", ".join(f"median(case when probability < 20 and scene_class not in (3, 8, 9, 10) then dn_{b}/10000e0 end) as {b}" for b in _BANDS) + " from obs join clouds using (scene_id) group by px, py"


def _clouds(spark, d):
    li = X.table(spark, d, "lineitem").filter("l_orderkey % 6 <> 0")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scene_id"), ((F.col("l_orderkey") * 73) % 40).alias("probability"))


@check(
    "r18_hot_season_table",
    OBS + f""", bands as ({_LANDSAT} from obs where month(ts) between 3 and 5 group by px, py),
    hot as (select px, py, lst_celsius, emissivity, {_ALBEDO} as albedo, {_seven('L')} from bands),
    shared as (select px, py, avg(t2m_k-273.15e0) as air_temp_C, avg(case when month(ts) between 3 and 5 then solar_j/86400e0 end) as solar_hot_W_m2 from obs group by px, py),
    img as (select px, py, lst_celsius, emissivity, NDVI_L, NDBI_L, MNDWI_L, EVI_L, albedo, air_temp_C, solar_hot_W_m2 from hot join shared using (px, py))
    select px, py, {', '.join(q(c, c) for c in ('lst_celsius', 'emissivity', 'NDVI_L', 'NDBI_L', 'MNDWI_L', 'EVI_L', 'albedo', 'air_temp_C', 'solar_hot_W_m2'))} from img
      where lst_celsius is not null and emissivity is not null and NDVI_L is not null and NDBI_L is not null and MNDWI_L is not null and EVI_L is not null and albedo is not null
        and solar_hot_W_m2 is not null order by md5(concat(px, '|', py, '|43')) limit 300""",
)
def r18(spark, d):
    o = _obs(spark, d)
    shared = o.groupBy("px", "py").agg(F.avg(B.kelvin_to_celsius("t2m_k")).alias("air_temp_C"))
    solar = R.solar_summary(o).select("px", "py", F.col("solar_hot").alias("solar_hot_W_m2"))
    return rounded(R.hot_season_table(o, R.band_stack(shared, solar), 600, 42))


@check(
    "r7_sentinel_composite",
    OBS + f""", clouds as ({_CLOUD_SQL}), s as ({_S2_SQL}), i as (select *, {_seven('S2')} from s)
    select px, py, {', '.join(q(b, n) for b, n in zip(_BANDS, ('S2_Blue', 'S2_Green', 'S2_Red', 'S2_NIR', 'S2_SWIR1', 'S2_SWIR2')))}, {', '.join(q(f'{c}_S2', f'{c}_S2') for c in _SEVEN)} from i""",
)
def r7_sentinel(spark, d):
    return rounded(R.sentinel_composite(_obs(spark, d), _clouds(spark, d)))


_STACK = ["lst_celsius", "emissivity", "L_Blue", "L_Green", "L_Red", "L_NIR", "L_SWIR1", "L_SWIR2", *[f"{c}_L" for c in _SEVEN], "albedo",
          "S2_Blue", "S2_Green", "S2_Red", "S2_NIR", "S2_SWIR1", "S2_SWIR2", *[f"{c}_S2" for c in _SEVEN], "air_temp_C"]


@check(
    "batch_base_stack",
    OBS + f""", clouds as ({_CLOUD_SQL}), lb as ({_LANDSAT} from obs group by px, py), sb as ({_S2_SQL}),
    l as (select px, py, lst_celsius, emissivity, {', '.join(f'{b} as L_{n}' for b, n in zip(_BANDS, ('Blue', 'Green', 'Red', 'NIR', 'SWIR1', 'SWIR2')))}, {_ALBEDO} as albedo, {_seven('L')} from lb),
    s as (select px, py, {', '.join(f'{b} as S2_{n}' for b, n in zip(_BANDS, ('Blue', 'Green', 'Red', 'NIR', 'SWIR1', 'SWIR2')))}, {_seven('S2')} from sb),
    a as (select px, py, avg(t2m_k-273.15e0) as air_temp_C from obs group by px, py),
    img as (select * from l join s using (px, py) join a using (px, py) where {' and '.join(f'{c} is not null' for c in _STACK)})
    select px, py, 73.7e0 + px*1e-3 as lon, 18.4e0 + py*1e-3 as lat, '2023' as year, 'annual' as season, format('{{:.4f}}_{{:.4f}}', 18.4e0 + py*1e-3, 73.7e0 + px*1e-3) as grid_id,
      {', '.join(q(c, c, 9) for c in _STACK)} from img order by md5(concat(px, '|', py, '|42')) limit 400""",
)
def base_stack(spark, d):
    o = _obs(spark, d)
    air = o.groupBy("px", "py").agg(F.avg(B.kelvin_to_celsius("t2m_k")).alias("air_temp_C"))
    out = R.base_stack(o, o, _clouds(spark, d), air, 400, (73.7, 18.4, 1e-3))
    return rounded(out, 9, skip=("lon", "lat"))


@check(
    "r19_region_stats",
    OBS + f""", img as (select px, py, avg(t2m_k) as v from obs group by px, py)
    select {q('min(v)', 'min')}, {q('max(v)', 'max')}, {q('sum(v)', 'sum', 4)}, {q('quantile_cont(v, 0.25)', 'p25')}, {q('quantile_cont(v, 0.5)', 'p50')},
      {q('quantile_cont(v, 0.75)', 'p75')}, {q('quantile_cont(v, 0.95)', 'p95')} from img""",
)
def r19(spark, d):
    out = R.region_stats(R.composite(_obs(spark, d), {"v": "t2m_k"}, "mean"), "v")
    return out.select(*[r6(c).alias(c) for c in ("min", "max", "p25", "p50", "p75", "p95")], r6("sum", 4).alias("sum"))


_CHOSEN = ("3", "13", "14", "25")


@check(
    "r20_aoi_buffer",
    f"""with {X.CELLS_CTE}, a as ({X.oracle(X.WARDS)}), w as (select * from a where ward_id in {_CHOSEN}),
    m as (select ward_ord, (x0-73.85e0)*105560e0 as x0, (x1-73.85e0)*105560e0 as x1, (y00-18.55e0)*110650e0 as y00, (y01-18.55e0)*110650e0 as y01, h*110650e0 as h from w),
    e as (select ward_ord, x0 as ax, y00 as ay, x1 as bx, y01 as byy from m union all select ward_ord, x1, y01, x1, y01+h from m
      union all select ward_ord, x1, y01+h, x0, y00+h from m union all select ward_ord, x0, y00+h, x0, y00 from m),
    p as (select cell_id, ward_ord, x_m, y_m, ax, ay, bx, byy, ((x_m-ax)*(bx-ax)+(y_m-ay)*(byy-ay))/((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay)) as t from cells, e),
    r as (select cell_id, ward_ord, sqrt(min((x_m-(ax+least(greatest(t,0),1)*(bx-ax)))**2 + (y_m-(ay+least(greatest(t,0),1)*(byy-ay)))**2)) as dist,
      count(*) filter (where (ay > y_m) <> (byy > y_m) and x_m < (bx-ax)*(y_m-ay)/nullif(byy-ay,0)+ax) % 2 = 1 as inside from p group by cell_id, ward_ord),
    f as (select cell_id, min(ward_ord) as ward_ord from r where inside or dist <= 2000 group by cell_id)
    select cell_id, f.ward_ord, {q('(x1-x0)*h/1e6', 'area_km2', 4)} from f join m on f.ward_ord = m.ward_ord""",
)
def r20(spark, d):
    from emberfield.operators.spatial import within_areas
    from emberfield.operators.wards import project_rings

    w = project_rings(X.wards(spark, d), X.to_plane).select("ward_id", "ward_ord", F.col("rings_m").alias("rings"))
    areas = R.aoi(w, {"ward_id": _CHOSEN})
    pts = X.metres(X.cells(spark, d)).select("cell_id", "x_m", "y_m")
    near = within_areas(pts, areas, 2000.0, key="ward_ord")
    return near.join(F.broadcast(areas), "ward_ord").select("cell_id", "ward_ord", r6("area_km2", 4).alias("area_km2"))


@check(
    "r21_plausible_lst",
    OBS + f"""select px, py, strftime(ts, '%Y-%m-%d') as date, {q('median(case when lst_k-273.15e0 > 5 and lst_k-273.15e0 < 65 and qc is not null then lst_k-273.15e0 end)', 'lst_celsius')}
      from obs group by all""",
)
def r21(spark, d):
    return rounded(R.plausible_lst(_obs(spark, d)))
