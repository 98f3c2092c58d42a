"""Checks of spatial joins, ward operators, statistics, temporal operators and row utilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.checks import fixtures as X
from emberfield.checks.registry import ORACLES, check, q, r6, rounded, scratch
from emberfield.checks.tables import ALBEDO_CTE
from emberfield.functions.bands import clip
from emberfield.operators import spatial as SP
from emberfield.operators import stats as ST
from emberfield.operators import temporal as TM
from emberfield.operators import wards as W
from emberfield.operators.impute import fill_albedo
from emberfield.operators.point_index import open_point_index, write_point_index
from emberfield.scale import quantile_sketches

CELLS = f"with {X.CELLS_CTE} "
PLACED = CELLS + f", {X.WARDS_CTE}, {X.WITHIN_CTE} "
SERIES = f"with {X.SERIES_CTE} "


def _points(spark, d):
    return X.metres(X.cells(spark, d)).select("cell_id", F.col("x_m").alias("px"), F.col("y_m").alias("py"))


def _square(half):
    p = lambda sx, sy: F.struct((F.col("cx") + sx * half).alias("x"), (F.col("cy") + sy * half).alias("y"))
    return F.array(F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1), p(-1, -1)))


def _buildings(spark, d):
    return X.view(spark, d, X.BUILDINGS).select(
        F.col("building_id").alias("feature_id"), F.lit("Polygon").alias("geom_type"), _square(F.col("half")).alias("parts")
    )


def _roads(spark, d):
    return X.view(spark, d, X.ROADS).withColumnRenamed("byy", "by")


# ---- joins ---------------------------------------------------------------------------------------


@check(
    "j1_within_join",
    PLACED + "select c.cell_id, w.ward_id, w.ward_name from cells c left join inside using (cell_id) left join wards w using (ward_ord)",
)
def j1(spark, d):
    return SP.within_join(X.cells(spark, d), X.wards(spark, d), "cell_id").select("cell_id", "ward_id", "ward_name")


_SEG = """least(greatest(case when (bx-ax)*(bx-ax)+(byy-ay)*(byy-ay) > 0 then ((x_m-ax)*(bx-ax)+(y_m-ay)*(byy-ay))/((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay)) else 0e0 end, 0e0), 1e0)"""


@check(
    "j2_nearest_road",
    CELLS + f""", r as ({X.oracle(X.ROADS)}), t as (select cell_id, road_id, x_m, y_m, ax, ay, bx, byy, {_SEG} as t from cells, r)
    select cell_id, {q('sqrt(min((x_m-(ax+t*(bx-ax)))*(x_m-(ax+t*(bx-ax))) + (y_m-(ay+t*(byy-ay)))*(y_m-(ay+t*(byy-ay)))))', 'dist_road_m', 4)} from t group by cell_id""",
)
def j2a(spark, d):
    near = SP.nearest_segments(_points(spark, d), SP.segment_boxes(_roads(spark, d)), "cell_id", "road_id")
    return near.select("cell_id", r6("dist_m", 4).alias("dist_road_m"))


@check(
    "j2_nearest_water",
    CELLS + f""", w as ({X.oracle(X.WATER)}) select cell_id, case when min(d2) <= 1500e0*1500e0 then {q('sqrt(min(d2))', None, 4)} end as dist_water_m
      from (select cell_id, (c.x_m-w.x_m)*(c.x_m-w.x_m)+(c.y_m-w.y_m)*(c.y_m-w.y_m) as d2 from cells c, w) group by cell_id""",
)
def j2b(spark, d):
    feats = X.view(spark, d, X.WATER).select(
        F.col("water_id").alias("feature_id"), F.lit("Point").alias("geom_type"),
        F.array(F.array(F.struct(F.col("x_m").alias("x"), F.col("y_m").alias("y")))).alias("parts"),
    )
    cells = X.metres(X.cells(spark, d)).select("cell_id", "x_m", "y_m")
    return SP.nearest_join(cells, feats, "cell_id", "dist_water_m", max_dist=1500.0).select("cell_id", r6("dist_water_m", 4).alias("dist_water_m"))


@check(
    "j2_nearest_building",
    CELLS + f""", b as ({X.oracle(X.BUILDINGS)}), t as (select cell_id, greatest(abs(x_m-cx)-half, 0e0) as dx, greatest(abs(y_m-cy)-half, 0e0) as dy from cells, b)
    select cell_id, {q('sqrt(min(dx*dx+dy*dy))', 'dist_m', 4)} from t group by cell_id""",
)
def j2c(spark, d):
    cells = X.metres(X.cells(spark, d)).select("cell_id", "x_m", "y_m")
    return SP.nearest_join(cells, _buildings(spark, d), "cell_id", "dist_m").select("cell_id", r6("dist_m", 4).alias("dist_m"))


@check(
    "j3_ward_join",
    PLACED + f""", miss as (select cell_id, x_m, y_m from cells where cell_id not in (select cell_id from inside)),
    we as (select ward_ord, (ax-73.85e0)*105560e0 as ax, (ay-18.55e0)*110650e0 as ay, (bx-73.85e0)*105560e0 as bx, (byy-18.55e0)*110650e0 as byy from ward_edge),
    t as (select cell_id, ward_ord, x_m, y_m, ax, ay, bx, byy, {_SEG} as t from miss, we),
    e as (select cell_id, ward_ord, sqrt((x_m-(ax+t*(bx-ax)))**2 + (y_m-(ay+t*(byy-ay)))**2) as dist from t),
    n as (select cell_id, min(dist) as dd, min({{'d': round(dist, 6), 'w': ward_ord}}) as m from e group by cell_id)
    select c.cell_id, w.ward_id, case when i.ward_ord is not null then 'within' else 'nearest' end as ward_join_method,
      {q('coalesce(n.dd, 0e0)', 'ward_distance_m', 3)} from cells c left join inside i using (cell_id) left join n using (cell_id)
      left join wards w on w.ward_ord = coalesce(i.ward_ord, n.m.w)""",
)
def j3(spark, d):
    out = W.ward_join(X.cells(spark, d), X.wards(spark, d), "cell_id", X.to_plane)
    return out.select("cell_id", "ward_id", "ward_join_method", r6("ward_distance_m", 3).alias("ward_distance_m"))


_A = "((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay))"
_B = "(2*((ax-x_m)*(bx-ax)+(ay-y_m)*(byy-ay)))"
_D = f"({_B}*{_B}-4*{_A}*((ax-x_m)*(ax-x_m)+(ay-y_m)*(ay-y_m)-250e0*250e0))"


@check(
    "j4_line_density",
    CELLS + f""", r as ({X.oracle(X.ROADS)}), t as (select cell_id, {_A} as a, {_B} as b, {_D} as disc from cells, r),
    s as (select cell_id, case when a > 0 and disc > 0 then sqrt(a)*greatest(least(1e0, (-b+sqrt(greatest(disc,0e0)))/(2*a)) - greatest(0e0, (-b-sqrt(greatest(disc,0e0)))/(2*a)), 0e0) else 0e0 end as len from t)
    select cell_id, {q('sum(len)/1000e0/(pi()*250e0*250e0/1e6)', 'road_density')} from s group by cell_id""",
)
def j4(spark, d):
    out = SP.line_density(_points(spark, d), _roads(spark, d).select("ax", "ay", "bx", "by"), "cell_id", 250.0)
    return out.select("cell_id", r6("line_density").alias("road_density"))


def _edge_share():
    sx, sy, tx, ty = "(ax-x_m)", "(ay-y_m)", "(bx-x_m)", "(byy-y_m)"
    return f"""select cell_id, building_id, ax, ay, bx, byy, x_m, y_m, {_A} as a, {_B} as b, {_D} as disc from k""", sx, sy, tx, ty


_K, _SX, _SY, _TX, _TY = _edge_share()


@check(
    "j5_area_density",
    CELLS + f""", bl as ({X.oracle(X.BUILDINGS)}),
    near as (select cell_id, x_m, y_m, building_id, cx, cy, half from cells join bl on abs(x_m-cx) < half+250 and abs(y_m-cy) < half+250),
    k as (select cell_id, building_id, x_m, y_m, cx-half as ax, cy-half as ay, cx+half as bx, cy-half as byy from near
      union all select cell_id, building_id, x_m, y_m, cx+half, cy-half, cx+half, cy+half from near
      union all select cell_id, building_id, x_m, y_m, cx+half, cy+half, cx-half, cy+half from near
      union all select cell_id, building_id, x_m, y_m, cx-half, cy+half, cx-half, cy-half from near),
    t as ({_K}),
    s as (select *, case when a > 0 and disc > 0 then least(greatest((-b-sqrt(greatest(disc,0e0)))/(2*a), 0e0), 1e0) else 0e0 end as s1,
      case when a > 0 and disc > 0 then least(greatest((-b+sqrt(greatest(disc,0e0)))/(2*a), 0e0), 1e0) else 0e0 end as s2 from t),
    u as (select cell_id, building_id, {_SX} as sx, {_SY} as sy, {_TX} as tx, {_TY} as ty, {_SX}+s1*(bx-ax) as ux, {_SY}+s1*(byy-ay) as uy,
      {_SX}+s2*(bx-ax) as vx, {_SY}+s2*(byy-ay) as vy from s),
    w as (select cell_id, building_id, abs(sum(250e0*250e0/2*(atan2(sx*uy-sy*ux, sx*ux+sy*uy) + atan2(vx*ty-vy*tx, vx*tx+vy*ty)) + (ux*vy-uy*vx)/2)) as area from u group by all)
    select c.cell_id, {q('least(coalesce(x.area, 0e0)/(pi()*250e0*250e0), 1e0)', 'building_density')} from cells c
      left join (select cell_id, sum(area) as area from w group by cell_id) x using (cell_id)""",
)
def j5(spark, d):
    out = SP.area_density(_points(spark, d), _buildings(spark, d), "cell_id", 250.0)
    return out.select("cell_id", r6("area_density").alias("building_density"))


@check(
    "j6_nearest_cell",
    CELLS + f""", {X.QUERIES_CTE}, n as (select qid, cell_id, (c.lat-q.lat)*(c.lat-q.lat)+(c.lon-q.lon)*(c.lon-q.lon) as d2 from queries q, cells c)
    select qid, cell_id, {q('d2', 'd2', 12)} from (select *, row_number() over (partition by qid order by d2, cell_id) as rn from n) where rn = 1""",
)
def j6(spark, d):
    out = SP.nearest_cell(X.view(spark, d, X.QUERY_POINTS), X.cells(spark, d).select("cell_id", "lon", "lat"))
    return out.select("qid", "cell_id", r6("d2", 12).alias("d2"))


@check(
    "j6_kept_index",
    CELLS + f""", {X.QUERIES_CTE}, n as (select qid, cell_id, lst_celsius, (c.lat-q.lat)*(c.lat-q.lat)+(c.lon-q.lon)*(c.lon-q.lon) as d2 from queries q, cells c)
    select qid, cell_id, lst_celsius, {q('d2', 'd2', 12)} from (select *, row_number() over (partition by qid order by d2, cell_id) as rn from n) where rn = 1""",
)
def j6_kept(spark, d):
    folder = scratch(spark, "cells")
    write_point_index(X.cells(spark, d).select("cell_id", "lon", "lat", "lst_celsius"), folder, node_rows=2_000)
    out = SP.nearest_cell(X.view(spark, d, X.QUERY_POINTS), open_point_index(spark, folder), carry=("lst_celsius",))
    return out.select("qid", "cell_id", "lst_celsius", r6("d2", 12).alias("d2"))


@check(
    "j7_join_city_stats",
    SERIES + f""", g as (select date, avg(lst_celsius) as m, stddev_samp(lst_celsius) as s from series group by date)
    select event_id, {q('m', 'city_mean')}, {q('s', 'city_std')} from series join g using (date)""",
)
def j7(spark, d):
    out = TM.join_city_stats(X.view(spark, d, X.CELL_SERIES))
    return rounded(out.select("event_id", "city_mean", "city_std"))


def _placed(spark, d, cells=None):
    """Cells with wards (containment only), albedo filled."""
    c = fill_albedo(X.cells(spark, d)) if cells is None else cells
    return SP.within_join(c, X.wards(spark, d), "cell_id").withColumn(
        "ward_join_method", F.when(F.col("ward_id").isNotNull(), "within")
    )


PLACED_ALB = CELLS + f", {ALBEDO_CTE}, {X.WARDS_CTE}, {X.WITHIN_CTE}, placed as (select a.*, w.ward_id, w.ward_name from alb4 a join inside using (cell_id) join wards w using (ward_ord)) "


@check("j8_ward_merge", PLACED_ALB + f"select ward_name, {q('sum(pop_density)', 'total_population')}, count(*) as grid_count from placed group by ward_name")
def j8(spark, d):
    return rounded(W.ward_merge(_placed(spark, d)))


@check(
    "j9_plan_map",
    f"""with {X.WARDS_CTE}, p as (select cast(n_nationkey + 1 as varchar) as ward_id, cast((n_nationkey*11) % 5 as int) as t from nation where n_regionkey <> 2)
    select ward_name, w.ward_id, coalesce(t, 0) as intervention_type, case coalesce(t, 0) when 0 then 'No Action' when 1 then 'Tree Cover / Urban Forest'
      when 2 then 'Cool Roofs' when 3 then 'Reflective / Permeable Pavement' else 'Blue-Green Infrastructure' end as intervention_label,
      case coalesce(t, 0) when 0 then '#e0e0e0' when 1 then '#2e7d32' when 2 then '#0288d1' when 3 then '#fbc02d' else '#00838f' end as map_color
    from wards w left join p using (ward_id)""",
)
def j9(spark, d):
    from emberfield.plans.planning import plan_map

    p = X.table(spark, d, "nation").filter("n_regionkey <> 2").select(
        (F.col("n_nationkey") + 1).alias("ward_id"), ((F.col("n_nationkey") * 11) % 5).alias("intervention_type")
    )
    return plan_map(X.wards(spark, d).drop("rings", "ward_ord"), p)


@check(
    "j10_catalog_cross",
    CELLS + """, cat(catalog_ord, intervention, cost, typical_delta) as (values (0, 'trees', 550e0, 2.2e0), (1, 'cool_roofs', 1050e0, 3.2e0),
      (2, 'reflective_pavement', 800e0, 1.7e0), (3, 'blue_green', 2200e0, 2.8e0), (4, 'combined', 3500e0, 4.5e0)) select cell_id, cat.* from cells, cat""",
)
def j10(spark, d):
    from emberfield.operators.actions import catalog_cross

    return catalog_cross(X.cells(spark, d).select("cell_id"))


@check(
    "j11_map_values",
    CELLS + f", m as (select LULC_ESA as k, median(albedo) as v from cells where LULC_ESA is not null group by 1) select cell_id, {q('v', 'class_median')} from cells left join m on LULC_ESA = k",
)
def j11(spark, d):
    from emberfield.operators.columns import map_values
    from emberfield.scale import exact_percentiles

    c = X.cells(spark, d).select("cell_id", "LULC_ESA", "albedo")
    m = exact_percentiles(c.filter("LULC_ESA is not null"), ["LULC_ESA"], {"class_median": ("albedo", 0.5)})
    out = map_values(c, "LULC_ESA", m, "class_median", "LULC_ESA", "class_median")
    return out.select("cell_id", r6("class_median").alias("class_median"))


# ---- aggregates ----------------------------------------------------------------------------------

_AGG = ["NDVI_L", "albedo", "pop_density", "ntl_radiance", "building_density", "LULC_ESA"]


@check(
    "a1_ward_aggregate",
    PLACED_ALB + f"""select ward_id, ward_name, {q('avg(lst_celsius)', 'lst_celsius')}, {q('max(lst_celsius)', 'lst_max')}, {q('stddev_samp(lst_celsius)', 'lst_std')},
      count(lst_celsius) as grid_count, {', '.join(q(f'avg({c})', c) for c in _AGG)} from placed group by ward_id, ward_name""",
)
def a1(spark, d):
    out = W.ward_aggregate(_placed(spark, d))
    return rounded(out.select("ward_id", "ward_name", "lst_celsius", "lst_max", "lst_std", "grid_count", *_AGG))


def _hvi_sql(src: str, keys: str, extra: str = "") -> str:
    mm = lambda e: f"case when ({e}) is null then 5e-1 when max({e}) over () = min({e}) over () then 0e0 else (({e})-min({e}) over ())/(max({e}) over ()-min({e}) over ()) end"
    h = mm("lst_celsius")
    p = mm("ln(1+greatest(pop_density, 0e0) + 0*pop_density)")
    a = mm("coalesce(elderly_ratio,0e0)+coalesce(children_ratio,0e0)")
    g = mm("1-coalesce(least(greatest(NDVI_L,-1e0),1e0),0e0)")
    i = mm("1/(greatest(ntl_radiance,0.001e0)+0.001e0 + 0*ntl_radiance)")
    return f"""comp as (select {keys}{extra}, {h} as H_norm, {p} as P_norm, {a} as A_norm, {g} as G_norm, {i} as I_norm from {src}),
    hv as (select *, least(greatest(0.35e0*H_norm+0.25e0*P_norm+0.15e0*A_norm+0.15e0*G_norm+0.10e0*I_norm, 0e0), 1e0) as HVI from comp)"""


_CLS = "case when HVI <= 0.25 then 'Low' when HVI <= 0.5 then 'Medium' when HVI <= 0.75 then 'High' else 'Very High' end"
_NORMS = ["H_norm", "P_norm", "A_norm", "G_norm", "I_norm", "HVI"]


@check("g1_hvi", CELLS + f", {_hvi_sql('cells', 'cell_id')} select cell_id, {', '.join(q(c, c) for c in _NORMS)}, {_CLS} as hvi_class from hv")
def g1(spark, d):
    return rounded(W.hvi(X.cells(spark, d)).select("cell_id", *_NORMS, "hvi_class"))


_WARD_MEANS = """, wm as (select ward_name, avg(lst_celsius) as lst_celsius, avg(pop_density) as pop_density, avg(elderly_ratio) as elderly_ratio, avg(children_ratio) as children_ratio,
  avg(NDVI_L) as NDVI_L, avg(ntl_radiance) as ntl_radiance, sum(pop_density) as total_population, count(*) as grid_count from placed group by ward_name), """
_WARD_HVI_SQL = PLACED_ALB + _WARD_MEANS + _hvi_sql("wm", "ward_name", ", lst_celsius, total_population, grid_count")


@check(
    "a2_ward_hvi",
    _WARD_HVI_SQL + f" select ward_name, {q('lst_celsius', 'lst_celsius')}, {q('total_population', 'total_population')}, grid_count, {', '.join(q(c, c) for c in _NORMS)}, {_CLS} as hvi_class from hv",
)
def a2(spark, d):
    out = W.ward_hvi(_placed(spark, d), strict=True)
    return rounded(out.select("ward_name", "lst_celsius", "total_population", "grid_count", *_NORMS, "hvi_class"))


@check("a3_ward_features", PLACED_ALB + f"select ward_id, ward_name, {q('avg(pop_density)', 'pop_density')}, {q('avg(NDVI_L)', 'NDVI_L')}, 1e4 as area_m2, 5e-1 as HVI from placed group by ward_id, ward_name")
def a3(spark, d):
    return rounded(W.ward_features(_placed(spark, d)).select("ward_id", "ward_name", "pop_density", "NDVI_L", "area_m2", "HVI"))


@check(
    "a4_describe",
    CELLS + f"""select count(lst_celsius) as count, {q('avg(lst_celsius)', 'mean')}, {q('stddev_samp(lst_celsius)', 'std')}, {q('min(lst_celsius)', 'min')}, {q('max(lst_celsius)', 'max')},
      {q('quantile_cont(lst_celsius, 0.25)', 'q25')}, {q('quantile_cont(lst_celsius, 0.5)', 'q50')}, {q('quantile_cont(lst_celsius, 0.75)', 'q75')} from cells""",
)
def a4(spark, d):
    return rounded(ST.describe(X.cells(spark, d)))


@check(
    "a4_describe_kept",
    CELLS + f"""select count(lst_celsius) as count, {q('avg(lst_celsius)', 'mean')}, {q('stddev_samp(lst_celsius)', 'std')}, {q('min(lst_celsius)', 'min')}, {q('max(lst_celsius)', 'max')},
      {q('quantile_cont(lst_celsius, 0.25)', 'q25')}, {q('quantile_cont(lst_celsius, 0.5)', 'q50')}, {q('quantile_cont(lst_celsius, 0.75)', 'q75')} from cells""",
)
def a4_kept(spark, d):
    """Sketches of each land cover's cells are written beside the table; the quartiles of all cells come through them."""
    cells, folder = X.cells(spark, d), scratch(spark, "sketches")
    quantile_sketches(cells, ["LULC_ESA"], ["lst_celsius"]).write.parquet(folder)
    return rounded(ST.describe(cells, sketches=spark.read.parquet(folder), group_rows=2_000))


@check("a5_city_summary", CELLS + f"select {q('min(lst_celsius)', 'lst_min')}, {q('max(lst_celsius)', 'lst_max')}, {q('avg(lst_celsius)', 'lst_mean')}, count(*) as total_rows from cells")
def a5(spark, d):
    return rounded(ST.city_summary(X.cells(spark, d)))


_DIST = "select o_orderkey as cell_id, case when o_orderkey % 3 = 0 then 'within' else 'nearest' end as ward_join_method, case when o_orderkey % 3 = 0 then 0e0 else ((o_orderkey*7919) % 9001)/7e0 end as ward_distance_m from {orders}"


@check(
    "a6_distance_summary",
    f"with t as ({X.oracle(_DIST)}) select count(*) as nearest_rows, {q('max(ward_distance_m)', 'max_m')}, {q('median(ward_distance_m)', 'median_m')}, {q('quantile_cont(ward_distance_m, 0.95)', 'p95_m')} from t where ward_join_method = 'nearest'",
)
def a6(spark, d):
    return rounded(ST.distance_summary(X.view(spark, d, _DIST)))


@check("a7_join_method_counts", f"with t as ({X.oracle(_DIST)}) select ward_join_method, count(*) as rows from t group by 1")
def a7(spark, d):
    return ST.join_method_counts(X.view(spark, d, _DIST))


@check("a8_hvi_distribution", CELLS + f", {_hvi_sql('cells', 'cell_id')} select {_CLS} as hvi_class, count(*) as rows, {q('avg(HVI)', 'mean_hvi')}, {q('max(HVI)', 'max_hvi')} from hv group by 1")
def a8(spark, d):
    return rounded(W.hvi_distribution(W.hvi(X.cells(spark, d))))


_PRED = "select o_orderkey as id, case o_orderkey % 3 when 0 then 'val' else 'test' end as split, 30e0 + (o_orderkey % 97)/7e0 as actual, 30e0 + (o_orderkey % 97)/7e0 + ((o_orderkey*13) % 31)/11e0 - 1.2e0 as predicted, cast(case when (o_orderkey*7) % 10 < 3 then 1 else 0 end as int) as label, cast(case when (o_orderkey*11) % 10 < 4 then 1 else 0 end as int) as guess, ((o_orderkey*7) % 10 * 3 + (o_orderkey*29) % 41)/71e0 as score from {orders}"


@check(
    "a9_regression_metrics",
    f"""with p as ({X.oracle(_PRED)}) select split, count(*) as rows, {q('avg(abs(actual-predicted))', 'mae')}, {q('sqrt(avg((actual-predicted)*(actual-predicted)))', 'rmse')},
      {q('1 - sum((actual-predicted)*(actual-predicted))/(var_pop(actual)*count(*))', 'r2')} from p group by split""",
)
def a9(spark, d):
    return rounded(ST.regression_metrics(X.view(spark, d, _PRED)))


@check(
    "a10_classification_metrics",
    f"""with p as ({X.oracle(_PRED)}), r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1)/2e0 as rk from p)
    select count(*) as rows, {q('avg(case when label = guess then 1e0 else 0e0 end)', 'accuracy')},
      {q('2e0*sum(label*guess)/(sum(label)+sum(guess))', 'f1')},
      {q('(sum(case when label = 1 then rk end) - sum(label)*(sum(label)+1)/2e0)/(sum(label)*1e0*sum(1-label))', 'auc')} from r""",
)
def a10(spark, d):
    return rounded(ST.classification_metrics(X.view(spark, d, _PRED), "label", "guess", "score"))


@check(
    "a11_gini",
    f"""with {X.PLANS_CTE}, r as (select plan_id, frac as x, row_number() over (partition by plan_id order by frac) as i, count(*) over (partition by plan_id) as n from plans)
    select plan_id, case when max(x) <= 1e-8 then 0e0 else {q('2*sum(i*x)/(any_value(n)*sum(x)) - (any_value(n)+1e0)/any_value(n)')} end as gini from r group by plan_id""",
)
def a11(spark, d):
    return rounded(ST.gini(X.plans(spark, d), ["plan_id"], F.col("frac")))


@check(
    "a12_global_attribution",
    f"""with a as (select 'f' || cast(l_linenumber as varchar) as feature, l_discount - l_tax as attribution from lineitem)
    select feature, {q('avg(abs(attribution))', 'mean_abs')} from a group by feature""",
)
def a12(spark, d):
    a = X.table(spark, d, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"), (F.col("l_discount") - F.col("l_tax")).alias("attribution")
    )
    return rounded(ST.global_attribution(a))


@check("a13_class_balance", f"with p as ({X.oracle(_PRED)}) select label as hotspot_label, count(*) as rows, true as can_stratify from p group by 1")
def a13(spark, d):
    return ST.class_balance(X.view(spark, d, _PRED).withColumnRenamed("label", "hotspot_label"))


# ---- windows -------------------------------------------------------------------------------------

_W = "over (partition by grid_id order by ts, event_id)"
_W20 = "over (partition by grid_id order by ts, event_id rows between 19 preceding and current row)"


def _temporal(spark, d):
    return TM.temporal_features(X.view(spark, d, X.CELL_SERIES), "grid_id", ("ts", "event_id"))


@check(
    "w1_lag_years",
    SERIES + "select event_id, " + ", ".join(
        f"{q(f'lag({c}, {4 * y}) {_W}', f'{n}_lag_{y}yr')}" for n, c in (("lst", "lst_celsius"), ("ndvi", "NDVI")) for y in (1, 2, 5)
    ) + " from series",
)
def w1(spark, d):
    cols = [f"{n}_lag_{y}yr" for n in ("lst", "ndvi") for y in (1, 2, 5)]
    return rounded(_temporal(spark, d).select("event_id", *cols))


@check(
    "w2_rolling_trend",
    SERIES + f""", r as (select *, row_number() {_W} as rn from series) select event_id, case when count(lst_celsius) {_W20} >= 10 then {q(f'regr_slope(lst_celsius, rn) {_W20}')} end as lst_trend_5yr,
      case when count(NDVI) {_W20} >= 10 then {q(f'regr_slope(NDVI, rn) {_W20}')} end as ndvi_trend_5yr from r""",
)
def w2(spark, d):
    return rounded(_temporal(spark, d).select("event_id", "lst_trend_5yr", "ndvi_trend_5yr"))


@check("w3_change_over", SERIES + f"select event_id, {q(f'NDBI - lag(NDBI, 20) {_W}', 'ndbi_change_5yr')} from series")
def w3(spark, d):
    return rounded(_temporal(spark, d).select("event_id", "ndbi_change_5yr"))


@check(
    "w4_hotspot_by_date",
    SERIES + """, g as (select date, avg(lst_celsius) + 2*stddev_samp(lst_celsius) as cut from series group by date)
    select event_id, cast(coalesce(lst_celsius > cut, false) as int) as hotspot_label from series join g using (date)""",
)
def w4a(spark, d):
    return TM.hotspot_label(X.view(spark, d, X.CELL_SERIES), "date").select("event_id", "hotspot_label")


@check(
    "w4_hotspot_global",
    CELLS + "select cell_id, cast(coalesce(lst_celsius > (select avg(lst_celsius) + 2*stddev_samp(lst_celsius) from cells), false) as int) as hotspot_label from cells",
)
def w4b(spark, d):
    return TM.hotspot_label(X.cells(spark, d), None).select("cell_id", "hotspot_label")


@check("w5_lst_anomaly", CELLS + f"select cell_id, {q('lst_celsius - (select avg(lst_celsius) from cells)', 'lst_anomaly')} from cells")
def w5(spark, d):
    return rounded(TM.lst_anomaly(X.cells(spark, d)).select("cell_id", "lst_anomaly"))


@check(
    "w6_proxy_lags",
    CELLS + f""", g as (select avg(lst_celsius) as m, stddev_samp(lst_celsius) as s, avg(NDVI_L) as v from cells)
    select cell_id, {q('lst_celsius - m', 'lst_anomaly')}, {q('(lst_celsius - m)*0.1e0', 'lst_trend_5yr')}, {q('(NDVI_L - v)*0.05e0', 'ndvi_trend_5yr')},
      {q('NDBI_L*0.03e0', 'ndbi_change_5yr')}, {q('lst_celsius', 'lst_lag_1yr')}, {q('NDVI_L', 'ndvi_lag_5yr')},
      cast(coalesce(lst_celsius > m + 2*s, false) as int) as hotspot_label from cells, g""",
)
def w6(spark, d):
    cols = ["lst_anomaly", "lst_trend_5yr", "ndvi_trend_5yr", "ndbi_change_5yr", "lst_lag_1yr", "ndvi_lag_5yr", "hotspot_label"]
    return rounded(TM.proxy_lags(X.cells(spark, d)).select("cell_id", *cols))


@check(
    "w7_minmax_norm",
    CELLS + f"select cell_id, {q('(pop_density - min(pop_density) over ())/(max(pop_density) over () - min(pop_density) over ())', 'p')}, 0e0 as constant from cells",
)
def w7(spark, d):
    c = X.cells(spark, d).withColumn("one", F.lit(1.0))
    return rounded(TM.minmax_norm(c, {"p": F.col("pop_density"), "constant": F.col("one")}).select("cell_id", "p", "constant"))


@check(
    "w8_split",
    """with r as (select o_orderkey as id, row_number() over (order by md5(concat(o_orderkey, '|42'))) as i, count(*) over () as n from orders)
    select id, case when i <= floor(n*0.8 + 1e-9) then 'train' when i <= floor(n*(0.8e0+0.1e0) + 1e-9) then 'val' else 'test' end as split from r""",
)
def w8a(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return TM.train_val_test_split(o, ["id"])


@check(
    "w8_split_stratified",
    """with r as (select o_orderkey as id, o_orderstatus as c, row_number() over (partition by o_orderstatus order by md5(concat(o_orderkey, '|42'))) as i, count(*) over (partition by o_orderstatus) as n from orders)
    select id, case when i <= floor(n*0.8 + 1e-9) then 'train' else 'test' end as split from r""",
)
def w8b(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("c"))
    return TM.train_val_test_split(o, ["id"], (0.8, 0.0, 0.2), 42, "c").select("id", "split")


# ---- top-k, samples, duplicates ------------------------------------------------------------------


@check(
    "k1_top_k_per_group",
    "select user_id, event_id, rank from (select user_id, event_id, cast(row_number() over (partition by user_id order by value desc, event_id) as int) as rank from events) where rank <= 3",
)
def k1(spark, d):
    e = X.table(spark, d, "events").select("user_id", "event_id", "value")
    return ST.top_k_per_group(e, ["user_id"], [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "rank")


@check(
    "k2_best_scenario",
    "select user_id, reduction, intervention from (select user_id, floor(value/40)+0e0 as reduction, event_type as intervention, row_number() over (partition by user_id order by floor(value/40) desc, event_id) as rn from events) where rn = 1",
)
def k2(spark, d):
    from emberfield.operators.actions import best_scenario

    e = X.table(spark, d, "events").select(
        "user_id", F.floor(F.col("value") / 40).cast("double").alias("reduction"), F.col("event_id").alias("catalog_ord"), F.col("event_type").alias("intervention")
    )
    return best_scenario(e, "user_id")


@check("k3_top_drivers", f"select p_brand as feature, {q('avg(p_retailprice - 1000)', 'importance')} from part group by 1 order by abs(avg(p_retailprice - 1000)) desc, feature limit 5")
def k3(spark, d):
    from emberfield.models.attribution import top_drivers

    p = X.table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg(F.col("p_retailprice") - 1000).alias("importance"))
    return rounded(top_drivers(p, 5))


@check("k4_top_vulnerable_wards", _WARD_HVI_SQL + f" select ward_name, {q('HVI', 'HVI')} from hv order by hv.HVI desc, ward_name limit 10")
def k4(spark, d):
    return rounded(W.top_vulnerable_wards(W.ward_hvi(_placed(spark, d), strict=True), 10).select("ward_name", "HVI"))


@check(
    "k5_sample_rows",
    CELLS + "select cell_id, lst_celsius from cells where lst_celsius is not null order by md5(concat(cell_id, '|42')) limit 900",
)
def k5(spark, d):
    c = X.cells(spark, d).select("cell_id", "lon", "lat", "lst_celsius").na.drop(subset=["lon", "lat", "lst_celsius"])
    return TM.sample_rows(c, ["cell_id"], 900).select("cell_id", "lst_celsius")


@check(
    "k6_first_per_key",
    "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value, event_id) as rn from events) where rn = 1",
)
def k6(spark, d):
    e = X.table(spark, d, "events").select("user_id", "event_id", "value")
    return ST.drop_duplicates_keep_first(e, "user_id", ["value", "event_id"])


@check("k7_concat", f"with p as ({X.oracle(_PRED)}) select split, id, {q('actual - predicted', 'residual')} from p")
def k7(spark, d):
    p = X.view(spark, d, _PRED).select("split", "id", (F.col("actual") - F.col("predicted")).alias("residual"))
    return rounded(ST.concat_frames(p.filter("split = 'val'"), p.filter("split = 'test'")))


@check("k8_sorted_output", SERIES + "select grid_id, event_id, lst_celsius from series")
def k8(spark, d):
    return X.view(spark, d, X.CELL_SERIES).orderBy("grid_id", "ts", "event_id").select("grid_id", "event_id", "lst_celsius")


# ---- flagship ------------------------------------------------------------------------------------


@check(
    "entry_vulnerable_wards",
    _WARD_HVI_SQL + f" select ward_name, {q('lst_celsius', 'lst_celsius')}, grid_count, {q('HVI', 'HVI')}, {_CLS} as hvi_class from hv",
)
def flagship(spark, d):
    """Which wards are most heat-vulnerable? Cells, albedo tiers, wards by containment, ward means, index, order."""
    out = W.ward_hvi(_placed(spark, d), strict=True)
    return rounded(out.select("ward_name", "lst_celsius", "grid_count", "HVI", "hvi_class"))


# ---- whole flows ---------------------------------------------------------------------------------


def _water(spark, d):
    return X.view(spark, d, X.WATER).select(
        F.col("water_id").alias("feature_id"), F.lit("Point").alias("geom_type"),
        F.array(F.array(F.struct(F.col("x_m").alias("x"), F.col("y_m").alias("y")))).alias("parts"),
    )


@check(
    "batch_map_features",
    f"""select cell_id, road_density, building_density, dist_road_m, dist_m as dist_park_m, dist_water_m,
      round(least(greatest(building_density + 3e-2*road_density, 0e0), 1e0), 9) + 0e0 as impervious_ratio
    from ({ORACLES['j4_line_density']}) join ({ORACLES['j5_area_density']}) using (cell_id) join ({ORACLES['j2_nearest_road']}) using (cell_id)
      join ({ORACLES['j2_nearest_building']}) using (cell_id) join ({CELLS} , w as ({X.oracle(X.WATER)})
      select cell_id, {q('sqrt(min((c.x_m-w.x_m)*(c.x_m-w.x_m)+(c.y_m-w.y_m)*(c.y_m-w.y_m)))', 'dist_water_m', 4)} from cells c, w group by cell_id) using (cell_id)""",
)
def batch_map_features(spark, d):
    from emberfield.plans.batch import add_map_features

    line = F.array(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    roads = _roads(spark, d).select(F.col("road_id").alias("feature_id"), F.lit("LineString").alias("geom_type"), line.alias("parts"))
    houses = _buildings(spark, d)
    # the cells already have densities, which the flow replaces
    cells = X.metres(X.cells(spark, d)).select("cell_id", "x_m", "y_m", "road_density", "building_density")
    out = add_map_features(cells, "cell_id", roads, houses, houses, _water(spark, d))
    return out.select(
        "cell_id", r6("road_density").alias("road_density"), r6("building_density").alias("building_density"),
        *[r6(c, 4).alias(c) for c in ("dist_road_m", "dist_park_m", "dist_water_m")],
        r6(clip(F.round("building_density", 6) + F.lit(0.03) * F.round("road_density", 6), 0.0, 1.0), 9).alias("impervious_ratio"),
    )


@check(
    "batch_ward_table",
    PLACED_ALB + f"select ward_id, ward_name, {q('avg(lst_celsius)', 'lst_celsius')}, {q('max(lst_celsius)', 'lst_max')}, count(lst_celsius) as grid_count, {q('avg(NDVI_L)', 'NDVI_L')} from placed group by ward_id, ward_name",
)
def batch_ward_table(spark, d):
    from emberfield.plans.batch import ward_table

    out = ward_table(X.cells(spark, d), X.wards(spark, d), "cell_id", X.to_plane)
    return rounded(out.select("ward_id", "ward_name", "lst_celsius", "lst_max", "grid_count", "NDVI_L"))
