"""Checks of interventions, scenarios, plans, attribution, models and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from emberfield import schema as S
from emberfield.checks import fixtures as X
from emberfield.checks.places import PLACED_ALB, _placed
from emberfield.checks.registry import check, q, r6, rounded, scratch
from emberfield.checks.tables import WEATHER_SQL
from emberfield.models import attribution as AT
from emberfield.operators import actions as A
from emberfield.operators import spatial as SP
from emberfield.operators.impute import fill_albedo, fit_medians
from emberfield.operators.wards import ward_features
from emberfield.plans import planning as PL
from emberfield.scale import cut_lineage
from emberfield.streaming import observations as OB
from emberfield.streaming import weather as WX

CELLS = f"with {X.CELLS_CTE} "
_SLOPES = {k: repr(v) + "e0" for k, v in S.LINEAR_SLOPES.items()}


def _model(df):
    return A.linear_score(fit_medians(df, list(S.LINEAR_SLOPES)))


MED_CTE = "med as (select " + ", ".join(f"median({f}) as m_{f}" for f in S.LINEAR_SLOPES) + " from cells)"


def _lin(changes: dict[str, str] | None = None, prefix: str = "") -> str:
    """SQL text of the linear predictor with some features replaced by other expressions."""
    terms = []
    for f, k in S.LINEAR_SLOPES.items():
        x = (changes or {}).get(f, f"{prefix}{f}")
        c = S.LINEAR_CENTRES.get(f, 0.0)
        terms.append(f"({k!r}e0)*(coalesce({x}, m_{f}) - {c!r}e0)".replace("e0e0", "e0"))
    return "(36e0 + " + " + ".join(terms) + ")"


def _clip_sql(f: str, e: str, mode: str) -> str:
    lo_hi = A.CLIP_BOUNDS[mode].get(f)
    if lo_hi is None or lo_hi[1] == float("inf"):
        return e
    return f"case when {f} is not null then least(greatest({e}, {lo_hi[0]!r}e0), {lo_hi[1]!r}e0) end"


def _changed(name: str, profile: str, mode: str) -> dict[str, str]:
    return {f: _clip_sql(f, f"({f} + ({d!r}e0))", mode) for f, d in S.DELTAS[profile].get(name, {}).items() if f in S.LINEAR_SLOPES}


_GETS = "coalesce(NDVI_L, 3e-1) as v, coalesce(building_density, 3e-1) as b, coalesce(road_density, 5e0) as r, coalesce(dist_water_m, 5e2) as w, coalesce(pop_density, 1e2) as pop"
_HV = "((cell_id*113) % 101)/1e2"
_CAT = "cat(catalog_ord, intervention, cost, d) as (values (0, 'trees', 550e0, 2.2e0), (1, 'cool_roofs', 1050e0, 3.2e0), (2, 'reflective_pavement', 800e0, 1.7e0), (3, 'blue_green', 2200e0, 2.8e0), (4, 'combined', 3500e0, 4.5e0))"
SCORE_CTE = f"""{_CAT}, gets as (select cell_id, lst_celsius, {_GETS}, {_HV} as hvi from cells),
  feas as (select *, least(greatest(case intervention when 'trees' then greatest(0e0, 1-v)*(1-b*0.5e0) when 'cool_roofs' then b
    when 'reflective_pavement' then least(1e0, r/20e0) when 'blue_green' then least(1e0, w/2000e0) else hvi end, 0e0), 1e0) as feas from gets, cat),
  sc as (select *, least(greatest(0.35e0*least(d/6e0, 1e0) + 0.20e0*hvi + 0.15e0*least(1e0, ln(1+pop)/ln(5001e0)) + 0.15e0*(1-least(cost/5000e0, 1e0)) + 0.15e0*feas, 0e0), 1e0) as score from feas)"""


def _with_hvi(spark, d):
    return X.cells(spark, d).withColumn("HVI", (F.col("cell_id") * 113) % 101 / F.lit(100.0))


@check("g2_feasibility", CELLS + f", {SCORE_CTE} select cell_id, intervention, {q('feas', 'feasibility')} from sc")
def g2(spark, d):
    c = A.catalog_cross(_with_hvi(spark, d))
    return c.select("cell_id", "intervention", r6(A.feasibility(c)).alias("feasibility"))


@check("g3_intervention_score", CELLS + f", {SCORE_CTE} select cell_id, intervention, {q('score', 'score')} from sc")
def g3(spark, d):
    c = A.catalog_cross(_with_hvi(spark, d))
    return c.select("cell_id", "intervention", r6(A.intervention_score(c, F.col("typical_delta"), F.col("cost"))).alias("score"))


_LABELS = "case intervention " + " ".join(f"when '{k}' then '{c['label']}'" for k, c in S.CATALOG.items()) + " end"
_LIFE = "case intervention " + " ".join(f"when '{k}' then {c['lifespan']}" for k, c in S.CATALOG.items()) + " end"
_COLORS = "case intervention " + " ".join(f"when '{k}' then '{c['color']}'" for k, c in S.CATALOG.items()) + " end"


@check(
    "g4_recommend",
    CELLS + f""", {SCORE_CTE}, rk as (select *, cast(round(cast(cast(score as varchar) as decimal(38,18)), 4) as double) as rs, cast(row_number() over (partition by cell_id order by round(cast(cast(score as varchar) as decimal(38,18)), 4) desc, catalog_ord) as int) as rank from sc)
    select cell_id, intervention, {q('rs', 'score')}, d as "delta_T_C", cost, cast(round(cast(cast(feas as varchar) as decimal(38,18)), 3) as double) as feasibility, rank, {_LABELS} as label, {_LIFE} as lifespan_yr, {_COLORS} as color from rk where rank <= 3""",
)
def g4(spark, d):
    return A.recommend(_with_hvi(spark, d))


@check(
    "g5_rule_recommend",
    CELLS + f""", gets as (select cell_id, coalesce(lst_celsius, 38e0) as t, {_GETS}, {_HV} as hvi from cells),
    r as (select cell_id, case when hvi > 0.75 and t > 42 then 'combined' when v < 0.2 and b < 0.4 then 'trees' when b > 0.5 then 'cool_roofs'
      when r > 15 then 'reflective_pavement' when w > 1500 then 'blue_green' else 'trees' end as intervention,
      case when hvi > 0.75 and t > 42 then 'High HVI + extreme LST → combined priority intervention' when v < 0.2 and b < 0.4 then 'Low NDVI + open land → tree cover / pocket park'
      when b > 0.5 then 'High building density → cool reflective roofs' when r > 15 then 'High road density → reflective / permeable pavement'
      when w > 1500 then 'Far from water body → blue-green infrastructure' else 'Default recommendation: urban tree planting' end as reason from gets)
    select cell_id, intervention, reason, {_LABELS} as label, {_LIFE} as lifespan_yr from r""",
)
def g5(spark, d):
    return A.rule_recommend(_with_hvi(spark, d)).select("cell_id", "intervention", "reason", "label", "lifespan_yr")


@check(
    "g6_apply_intervention",
    CELLS + f"""select cell_id, 'full' as clip_mode, {q('least(greatest(NDVI_L+0.15e0,-1e0),1e0)', 'NDVI_L')}, {q('case when albedo is not null then least(greatest(albedo+0.3e0,0e0),1e0) end', 'albedo')},
      {q('least(greatest(impervious_ratio-0.1e0,0e0),1e0)', 'impervious_ratio')}, {q('least(greatest(building_density-0.03e0,0e0),1e0)', 'building_density')}, {q('greatest(dist_water_m-80, 0)', 'dist_water_m')} from cells
    union all select cell_id, 'none', {q('NDVI_L+0.15e0')}, {q('albedo+0.3e0')}, {q('impervious_ratio-0.1e0')}, {q('building_density-0.03e0')}, {q('dist_water_m-80')} from cells
    union all select cell_id, 'unknown', {q('NDVI_L')}, {q('albedo')}, {q('impervious_ratio')}, {q('building_density')}, {q('dist_water_m')} from cells""",
)
def g6(spark, d):
    c = X.cells(spark, d)
    cols = ["NDVI_L", "albedo", "impervious_ratio", "building_density", "dist_water_m"]
    runs = [("full", "combined", "full"), ("none", "combined", "none"), ("unknown", "nothing", "full")]
    parts = [A.apply_intervention(c, n, "simulate", m).select("cell_id", F.lit(k).alias("clip_mode"), *cols) for k, n, m in runs]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


@check(
    "g7_batch_simulate",
    CELLS + f", {MED_CTE} select cell_id, {q(_lin(), 'pred_lst_baseline')}, {q(_lin(_changed('combined', 'simulate', 'batch')), 'pred_lst_combined')}, {q(_lin() + '-' + _lin(_changed('combined', 'simulate', 'batch')), 'delta_T')} from cells, med",
)
def g7(spark, d):
    c = X.cells(spark, d)
    out = A.batch_simulate(c, _model(c), "combined")
    return rounded(out.select("cell_id", "pred_lst_baseline", "pred_lst_combined", "delta_T"))


def _long_sql(profile: str, mode: str, src: str = "cells, med", cols: str = "cell_id") -> str:
    return " union all ".join(
        f"select {cols}, {i} as catalog_ord, '{n}' as intervention, {_lin()} as base, {_lin(_changed(n, profile, mode))} as after from {src}"
        for i, n in enumerate(S.INTERVENTIONS)
    )


@check(
    "g8_scenario_compare",
    CELLS + f""", {MED_CTE}, s as ({_long_sql('simulate', 'full')}),
    t as (select *, round(greatest(base - after, 0e0), 2) as red from s)
    select cell_id, intervention, {q('base', 'baseline_lst', 2)}, {q('after', 'modified_lst', 2)}, red + 0e0 as reduction,
      row_number() over (partition by cell_id order by red desc, catalog_ord) = 1 as is_best,
      case intervention when 'trees' then 550e0 when 'cool_roofs' then 1050e0 when 'reflective_pavement' then 800e0 when 'blue_green' then 2200e0 else 3500e0 end as cost_inr_per_m2,
      {_LIFE} as lifespan_years, {"case intervention " + " ".join(f"when '{k}' then '{v}'" for k, v in S.DESCRIPTIONS.items()) + " end"} as description from t""",
)
def g8(spark, d):
    c = X.cells(spark, d)
    return A.scenario_compare(c, _model(c))


_TYPES = {1: "trees", 2: "cool_roofs", 3: "reflective_pavement", 4: "blue_green"}


@check(
    "g9_delta_t",
    CELLS + f""", {MED_CTE}, t as (select *, cell_id % 7 as type_id from cells, med)
    select cell_id, {q('case type_id when 0 then 0e0 ' + ' '.join(f"when {i} then greatest(0e0, {_lin()} - {_lin(_changed(n, 'plan', 'none'))})" for i, n in _TYPES.items()) + f" else greatest(0e0, {_lin()} - {_lin(_changed('trees', 'plan', 'none'))}) end", 'delta_T')} from t""",
)
def g9(spark, d):
    c = X.cells(spark, d)
    out = A.delta_t(c, _model(c), F.col("cell_id") % 7, default="trees")
    return rounded(out.select("cell_id", "delta_T"))


AT_CTE = f"""{X.QUERIES_CTE}, nn as (select q.qid, c.cell_id, row_number() over (partition by q.qid order by (c.lat-q.lat)*(c.lat-q.lat)+(c.lon-q.lon)*(c.lon-q.lon), c.cell_id) as rn from queries q, cells c),
  nearby as (select nn.qid, c.* from nn join cells c using (cell_id) where rn = 1)"""


@check(
    "g10_scenario_at",
    CELLS + f""", {MED_CTE}, {AT_CTE}, s as ({_long_sql('serve', 'none', 'nearby, med', 'qid, cell_id')})
    select qid, cell_id, intervention, {q('base', 'lst_base')}, {q('after', 'lst_after')}, {q('base-after', 'delta_C')},
      row_number() over (partition by qid order by round(base-after, 9) desc, catalog_ord) = 1 as is_best, 5e-1 as intensity from s""",
)
def g10(spark, d):
    c = X.cells(spark, d)
    return rounded(A.scenario_at(X.view(spark, d, X.QUERY_POINTS), c, _model(c), intensity=0.5))


_RISK_P = "case when p >= 42 then 'very_high' when p >= 38 then 'high' when p >= 34 then 'moderate' else 'low' end"


_AT_WARDS = f"with {X.CELLS_CTE}, {X.WARDS_CTE}, {X.WITHIN_CTE}, {MED_CTE}, {AT_CTE}"
_ITS_WARD = "left join inside i on i.cell_id = {0}.cell_id left join wards w on w.ward_ord = i.ward_ord"


def _warded(c, spark, d):
    return SP.within_join(c, X.wards(spark, d), "cell_id")


@check(
    "g11_heat_at",
    f"""{_AT_WARDS}, p as (select *, {_lin()} as p from nearby, med)
    select p.qid, p.cell_id, {q('p', 'pred_lst_C')}, {_RISK_P} as risk_level, lat, lon, grid_id, lst_celsius, air_temp_C, humidity_pct, w.ward_id, w.ward_name
    from p {_ITS_WARD.format('p')}""",
)
def g11(spark, d):
    c = X.cells(spark, d)
    out = A.heat_at(X.view(spark, d, X.QUERY_POINTS), _warded(c, spark, d), _model(c))
    return out.withColumn("pred_lst_C", r6("pred_lst_C"))


@check(
    "g12_recommend_at",
    f"""{_AT_WARDS}, s as ({_long_sql('serve', 'none', 'nearby, med', 'qid, cell_id')}), b as (select *, base as p, row_number() over (partition by qid order by round(base-after, 9) desc, catalog_ord) as rn from s)
    select b.qid, b.intervention, {q('base-after', 'delta_C')}, {_RISK_P} as risk_level, w.ward_id, w.ward_name from b {_ITS_WARD.format('b')} where rn = 1""",
)
def g12(spark, d):
    c = X.cells(spark, d)
    return rounded(A.recommend_at(X.view(spark, d, X.QUERY_POINTS), _warded(c, spark, d), _model(c)))


# ---- plans ---------------------------------------------------------------------------------------

_PLAN = f"with {X.PLANS_CTE} "
_COST = "(case intervention_type when 0 then 0e0 when 1 then 600e0 when 2 then 1100e0 when 3 then 800e0 else 2200e0 end)"
_BUDGET = 1e8


@check("g13_plan_costs", _PLAN + f"select plan_id, ward_id, {q(f'{_COST}*10000e0*frac', 'cost', 2)} from plans")
def g13a(spark, d):
    return PL.plan_costs(X.plans(spark, d)).select("plan_id", "ward_id", r6("cost", 2).alias("cost"))


@check(
    "g13_repair_budget",
    _PLAN + f""", t as (select plan_id, sum({_COST}*10000e0*frac) as total from plans group by plan_id)
    select plan_id, ward_id, {q('least(greatest(case when total > 1e8 then frac*(1e8/total) else frac end, 0e0), 1e0)', 'frac_repaired', 9)} from plans join t using (plan_id)""",
)
def g13b(spark, d):
    return PL.repair_budget(X.plans(spark, d), _BUDGET).select("plan_id", "ward_id", r6("frac_repaired", 9).alias("frac_repaired"))


# ward features: means over the cells placed by containment; the model's medians are those of all cells
WARD_CTE = f""", {MED_CTE.replace('med as', 'med as').replace('from cells', 'from alb4')}, wf as (select ward_id, {', '.join(f'avg({f}) as {f}' for f in S.LINEAR_SLOPES)}, coalesce(avg(pop_density), 1e0) as population from placed group by ward_id),
  wd as ({' union all '.join([f"select ward_id, 0 as intervention_type, 0e0 as dt, population from wf"] + [f"select ward_id, {i}, greatest(0e0, {_lin()} - {_lin(_changed(n, 'plan', 'none'))}), population from wf, med" for i, n in _TYPES.items()])}),
  {X.PLANS_CTE}"""


def _deltas(spark, d):
    cells = cut_lineage(fill_albedo(X.cells(spark, d)))
    return PL.ward_deltas(ward_features(_placed(spark, d, cells)), _model(cells))


_SCORED = PLACED_ALB + WARD_CTE + f""", tot as (select plan_id, sum({_COST}*10000e0*frac) as total from plans group by plan_id),
  fx as (select p.*, case when total > 1e8 then frac*(1e8/total) else frac end as f from plans p join tot using (plan_id)),
  j as (select fx.*, dt, population from fx join wd using (ward_id, intervention_type)),
  sc as (select plan_id, avg(dt*f) as mean_delta_C, sum(dt*f*population) as population_benefit, sum(dt*f*0.5e0) as equity_benefit, sum({_COST}*10000e0*f) as total_cost_inr, count(*) as n from j group by plan_id),
  ft as (select *, 0.4e0*mean_delta_C + 0.25e0*population_benefit/n + 0.25e0*equity_benefit/n + 0.1e0*(1-total_cost_inr/1e8) as fitness from sc)"""


@check(
    "g14_score_plans",
    _SCORED + f" select plan_id, {q('mean_delta_C', 'mean_delta_C')}, {q('population_benefit', 'population_benefit', 3)}, {q('equity_benefit', 'equity_benefit')}, {q('total_cost_inr', 'total_cost_inr', 1)}, {q('fitness', 'fitness', 4)} from ft",
)
def g14(spark, d):
    out = PL.score_plans(X.plans(spark, d), _deltas(spark, d), _BUDGET)
    digits = {"mean_delta_C": 6, "population_benefit": 3, "equity_benefit": 6, "total_cost_inr": 1, "fitness": 4}
    return out.select("plan_id", *[r6(c, k).alias(c) for c, k in digits.items()])


_OBJ = PLACED_ALB + WARD_CTE + f""", j as (select p.*, dt, population from plans p join wd using (ward_id, intervention_type)),
  rk as (select plan_id, frac*(case when intervention_type > 0 then 1 else 0 end) as x, row_number() over (partition by plan_id order by frac*(case when intervention_type > 0 then 1 else 0 end)) as i from j),
  gi as (select plan_id, case when max(x) <= 1e-8 then 0e0 else 2*sum(i*x)/(25e0*sum(x)) - 26e0/25e0 end as inequality from rk group by plan_id),
  ob as (select plan_id, -sum(dt*10000e0*frac) as neg_cooling, -sum(dt*population*frac) as neg_benefit, sum({_COST}*10000e0*frac) as total_cost from j group by plan_id),
  obj as (select ob.*, inequality, total_cost - 1.5e8 as excess from ob join gi using (plan_id))"""


@check(
    "g15_plan_objectives",
    _OBJ + f" select plan_id, {q('neg_cooling', 'neg_cooling', 3)}, {q('neg_benefit', 'neg_benefit', 3)}, {q('total_cost', 'total_cost', 1)}, {q('inequality', 'inequality')}, {q('excess', 'excess', 1)} from obj",
)
def g15(spark, d):
    out = PL.plan_objectives(X.plans(spark, d), _deltas(spark, d), 1.5e8)
    digits = {"neg_cooling": 3, "neg_benefit": 3, "total_cost": 1, "inequality": 6, "excess": 1}
    return out.select("plan_id", *[r6(c, k).alias(c) for c, k in digits.items()])


_O4 = ["neg_cooling", "neg_benefit", "total_cost", "inequality"]


@check(
    "g16_pareto_front",
    _OBJ + f""", ro as (select plan_id, {q('neg_cooling', 'neg_cooling', 3)}, {q('neg_benefit', 'neg_benefit', 3)}, {q('total_cost', 'total_cost', 1)}, {q('inequality', 'inequality')} from obj where excess <= 0)
    select plan_id from ro a where not exists (select 1 from ro b where b.neg_cooling <= a.neg_cooling and b.neg_benefit <= a.neg_benefit and b.total_cost <= a.total_cost and b.inequality <= a.inequality
      and (b.neg_cooling < a.neg_cooling or b.neg_benefit < a.neg_benefit or b.total_cost < a.total_cost or b.inequality < a.inequality))""",
)
def g16(spark, d):
    obj = PL.plan_objectives(X.plans(spark, d), _deltas(spark, d), 1.5e8).filter("excess <= 0")
    digits = {"neg_cooling": 3, "neg_benefit": 3, "total_cost": 1, "inequality": 6}
    return PL.pareto_front(obj.select("plan_id", *[r6(c, k).alias(c) for c, k in digits.items()]), _O4).select("plan_id")


_U = lambda salt: f"(('0x' || substr(md5(concat(c_custkey, '|', n_nationkey, '|42:{salt}')), 1, 13))::bigint / 4503599627370496e0)"


@check(
    "g17_generate_plans",
    f"""select c_custkey as plan_id, cast(n_nationkey as varchar) as ward_id, cast(floor({_U('type')}*5) as int) as intervention_type, {_U('frac')} as frac from customer, nation""",
)
def g17(spark, d):
    n = X.table(spark, d, "customer").count()
    wards = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("ward_id"))
    return PL.generate_plans(wards, n, 42, chunk=500)


@check(
    "g18_best_plan",
    _SCORED + f""", b as (select plan_id from ft order by round(fitness, 9) desc, plan_id limit 1) select plan_id, ward_id, intervention_type,
      case intervention_type when 0 then 'No Action' when 1 then 'Tree Cover / Urban Forest' when 2 then 'Cool Roofs' when 3 then 'Reflective / Permeable Pavement' else 'Blue-Green Infrastructure' end as intervention_label,
      frac as intervention_frac from plans where plan_id in (select plan_id from b)""",
)
def g18(spark, d):
    p = X.plans(spark, d)
    return PL.best_plan(p, PL.score_plans(p, _deltas(spark, d), _BUDGET))


# ---- models --------------------------------------------------------------------------------------

_FIT = ["NDVI_L", "NDBI_L", "MNDWI_L", "albedo", "air_temp_C", "humidity_pct", "pop_density", "ntl_radiance", "impervious_ratio", "building_density"]


def _learnable(spark, d):
    """Cells with a target that depends on the features: the linear predictor plus a small deterministic rest."""
    c = X.cells(spark, d).drop("lst_celsius")
    out = A.linear_score({f: 0.2 for f in S.LINEAR_SLOPES})(c)
    return out.withColumn("lst_celsius", F.col("prediction") + (F.col("cell_id") * 17 % 29) / F.lit(29.0)).drop("prediction")


def _all_features(spark, d):
    """The learnable cells with the model features that the fixture lacks, each by its own step through the ids."""
    cells = _learnable(spark, d)
    lacking = [f for f in S.MODEL_FEATURES if f not in cells.columns]
    return cells.withColumns({f: (F.col("cell_id") * (61 + 2 * i) % 997) / F.lit(99.7) for i, f in enumerate(lacking)})


def _small(**kw):
    from emberfield.models.trees import TreeParams

    return TreeParams(rounds=10, depth=4, bins=32, rate=0.3, **kw)


@check("m1_train_lst")
def m1(spark, d):
    from emberfield.models.trees import train_lst

    return rounded(train_lst(_learnable(spark, d), ["cell_id"], _FIT, params=_small())[2], 4)


@check("m2_train_future")
def m2(spark, d):
    from emberfield.models.trees import prepare_future, train_future

    cells = prepare_future(_learnable(spark, d), "grid_id")
    feats = ["NDVI_L", "NDBI_L", "albedo", "air_temp_C", "impervious_ratio", "building_density", "ndvi_lag_1yr", "ndvi_trend_5yr", "ndbi_change_5yr"]
    return train_future(cells, ["cell_id"], feats, _small())[2]


@check(
    "m1_train_report",
    CELLS + """, n as (select count(*) as n from cells) select 'val' as split, cast(floor(n*0.9e0 + 1e-9) - floor(n*0.8e0 + 1e-9) as bigint) as rows, true as fits from n
      union all select 'test', cast(n - floor(n*0.9e0 + 1e-9) as bigint), true from n""",
)
def m1_report(spark, d):
    """Exact sizes of both held-out parts, and a fit that explains well over half of their variance."""
    from emberfield.models.trees import train_lst

    metrics = train_lst(_learnable(spark, d), ["cell_id"], _FIT, params=_small())[2]
    return metrics.select("split", "rows", (F.col("r2") > 0.6).alias("fits"))


@check(
    "m1_train_stopped",
    CELLS + """, n as (select count(*) as n from cells) select 'val' as split, cast(floor(n*0.9e0 + 1e-9) - floor(n*0.8e0 + 1e-9) as bigint) as rows, 24 as features, true as fits, true as stopped from n
      union all select 'test', cast(n - floor(n*0.9e0 + 1e-9) as bigint), 24, true, true from n""",
)
def m1_stopped(spark, d):
    """All features of the main trainer, up to 800 rounds of depth 6, ended by the validation rows."""
    from emberfield.models.trees import TreeParams, train_lst

    params = TreeParams(rounds=800, depth=6, rate=0.3, bins=32, stop_tol=0.01)
    model, _, metrics = train_lst(_all_features(spark, d), ["cell_id"], S.MODEL_FEATURES, params=params)
    return metrics.select(
        "split", "rows", F.lit(len(model.features)).alias("features"), (F.col("r2") > 0.6).alias("fits"),
        F.lit(model.stage.getNumTrees < params.rounds).alias("stopped"),
    )


@check(
    "m2_train_dated",
    f"""with {X.SERIES_CTE}, c as (select date, avg(lst_celsius) as m, stddev_samp(lst_celsius) as s from series group by date),
      l as (select coalesce(cast(lst_celsius > m + 2e0*s as int), 0) as hotspot_label from series join c using (date)),
      n as (select hotspot_label, count(*) as n from l group by 1)
    select hotspot_label, cast(n - floor(n*0.8e0 + 1e-9) as bigint) as rows, cast(n - floor(n*0.8e0 + 1e-9) as bigint) as scored from n""",
)
def m2_dated(spark, d):
    """Lags, trends and per-date labels of the observed histories; test rows of both classes, all of them scored."""
    from emberfield.models.trees import TreeParams, prepare_future, train_future

    series = X.view(spark, d, X.CELL_SERIES).drop("ts")
    rows = prepare_future(series, "grid_id", ("date", "event_id"))
    feats = ["NDVI", "NDBI", *[f"{v}_lag_{y}yr" for v in ("lst", "ndvi") for y in (1, 2, 5)], "lst_trend_5yr", "ndvi_trend_5yr", "ndbi_change_5yr"]
    scored = train_future(rows, ["event_id"], feats, TreeParams(rounds=500, depth=5, rate=0.3, bins=32, stop_tol=0.01))[2]
    known = F.col("predicted_lst").isNotNull() & F.col("predicted_label").isin(0, 1) & F.col("hotspot_prob").between(0, 1)
    return scored.groupBy("hotspot_label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(known).alias("scored"))


@check("m3_reload_report", CELLS + "select count(*) as rows, cast(0 as bigint) as different from cells")
def m3_report(spark, d):
    """A saved and reloaded model predicts every row exactly as the fitted one."""
    from emberfield.models.trees import FittedTrees, train_lst

    cells = _learnable(spark, d)
    model = train_lst(cells, ["cell_id"], _FIT, params=_small())[0]
    path = scratch(spark, "model")
    model.save(path, spark)
    both = FittedTrees.load(path, spark)(model(cells).withColumnRenamed("prediction", "_first"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("prediction").eqNullSafe(F.col("_first"))).alias("different"))


@check("m6_importance_report", f"select {len(_FIT)} as features, true as sums_to_one, true as none_negative, true as driver_first from nation limit 1")
def m6_report(spark, d):
    """Importances of all features, none negative, in sum one, with a feature of the target's formula in front."""
    from emberfield.models.trees import feature_importance, train_lst

    top = feature_importance(train_lst(_learnable(spark, d), ["cell_id"], _FIT, params=_small())[0], spark)
    return top.agg(
        F.count(F.lit(1)).cast("int").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
        (F.min("importance") >= 0).alias("none_negative"), F.max_by("feature", "importance").isin(list(S.LINEAR_SLOPES)).alias("driver_first"),
    )


@check("m3_predict")
def m3(spark, d):
    from emberfield.models.trees import FittedTrees, train_lst

    cells = _learnable(spark, d)
    model = train_lst(cells, ["cell_id"], _FIT, params=_small())[0]
    path = scratch(spark, "model")
    model.save(path, spark)
    return FittedTrees.load(path, spark)(cells.drop("ntl_radiance")).select("cell_id", "prediction")


@check("m4_linear_score", CELLS + f", {MED_CTE} select cell_id, {q(_lin(), 'prediction')} from cells, med")
def m4(spark, d):
    c = X.cells(spark, d)
    return rounded(_model(c)(c).select("cell_id", "prediction"))


@check(
    "m5_prediction_frame",
    CELLS + f", {MED_CTE} select case when cell_id % 2 = 0 then 'val' else 'test' end as split, cell_id, lon, lat, lst_celsius as actual, {q(_lin(), 'predicted')}, {q('lst_celsius - ' + _lin(), 'residual')} from cells, med",
)
def m5(spark, d):
    from emberfield.models.trees import prediction_frame

    c = X.cells(spark, d).withColumn("split", F.when(F.col("cell_id") % 2 == 0, "val").otherwise("test"))
    out = prediction_frame(c, _model(c), ["cell_id"])
    return out.withColumns({k: r6(k) for k in ("predicted", "residual")})


@check("m6_feature_importance")
def m6(spark, d):
    from emberfield.models.trees import feature_importance, train_lst

    return feature_importance(train_lst(_learnable(spark, d), ["cell_id"], _FIT, params=_small())[0], spark)


_FIXED = {f: f"coalesce({f}, 0.2e0)" for f in S.LINEAR_SLOPES}
_PERMUTED = " union all ".join(
    f"select '{f}' as feature, {q('avg(abs(a.y - ' + '(' + _lin({f: f'z.{f}'}, 'a.') + ')) - a.e0)', 'importance')} from asked a join base z on z.i = a.j, med" for f in S.LINEAR_SLOPES
)


@check(
    "m7_permutation_importance",
    CELLS + f""", {MED_CTE}, base as (select c.*, {_lin(_FIXED)} + (cell_id*17 % 29)/29e0 as y, abs({_lin(_FIXED)} + (cell_id*17 % 29)/29e0 - {_lin()}) as e0,
      row_number() over (order by md5(concat(cell_id, '|42'))) - 1 as i from cells c, med),
    n as (select count(*) as n from cells), r as (select unnest([0, 1, 2]) as r),
    maps as (select r, (select min(k) from (select unnest(generate_series(cast(floor(n*0.61803e0) as bigint) + 7*r + 1, cast(floor(n*0.61803e0) as bigint) + 7*r + 200)) as k) where gcd(k, n) = 1) % n as a,
      (42 + 101*r) % n as b, n from r, n),
    asked as (select base.*, (i*m.a + m.b) % m.n as j from base, maps m)
    {_PERMUTED}""",
)
def m7(spark, d):
    c = _learnable(spark, d)
    return rounded(AT.permutation_importance(c, _model(c), list(S.LINEAR_SLOPES), ["cell_id"], repeats=3))


_ATTR = " union all ".join(
    f"select cell_id, '{f}' as feature, {i} as ord, {f} as value, round({_lin()} - {_lin({f: f'm_{f}'})}, 3) + 0e0 as attribution from cells, med" for i, f in enumerate(S.LINEAR_SLOPES)
)


@check(
    "m8_attribute_drivers",
    CELLS + f""", {MED_CTE}, a as ({_ATTR}), r as (select *, cast(row_number() over (partition by cell_id order by abs(attribution) desc, ord) as int) as rank from a)
    select cell_id, feature, value, attribution, rank, {"case feature " + " ".join(f"when '{k}' then '{v}'" for k, v in S.FEATURE_TITLES.items()) + " end"} as title,
      {"case feature " + " ".join(f"when '{k}' then '{v}'" for k, v in S.DRIVER_HEADLINES.items()) + " end"} as headline,
      case when attribution > 0 then 'heating' else 'cooling' end as direction from r where rank <= 5""",
)
def m8(spark, d):
    c = X.cells(spark, d)
    background = fit_medians(c, list(S.LINEAR_SLOPES))
    return AT.attribute_drivers(c.select("cell_id", *S.LINEAR_SLOPES), A.linear_score(background), background)


_VS = " union all ".join(f"select cell_id, '{f}' as feature, {i} as ord, abs(coalesce({f}, 0e0)) as s from cells" for i, f in enumerate(_FIT))


@check(
    "m9_value_share_drivers",
    CELLS + f""", a as ({_VS}), t as (select *, round(s/greatest(sum(s) over (partition by cell_id), 1e0), 9) as importance from a),
    r as (select *, cast(row_number() over (partition by cell_id order by importance desc, ord) as int) as rank from t) select cell_id, feature, importance + 0e0 as importance, rank from r where rank <= 5""",
)
def m9(spark, d):
    return AT.value_share_drivers(X.cells(spark, d), _FIT)


# ---- streams -------------------------------------------------------------------------------------

_HOT = "(temperature_C*9e0/5e0+32e0)"
_HX = f"""(case when {_HOT} < 80 then temperature_C else ((-42.379e0 + 2.04901523e0*{_HOT} + 10.14333127e0*humidity_pct - 0.22475541e0*{_HOT}*humidity_pct
  - 0.00683783e0*{_HOT}*{_HOT} - 0.05481717e0*humidity_pct*humidity_pct + 0.00122874e0*{_HOT}*{_HOT}*humidity_pct + 0.00085282e0*{_HOT}*humidity_pct*humidity_pct
  - 0.00000199e0*{_HOT}*{_HOT}*humidity_pct*humidity_pct) - 32e0)*5e0/9e0 end)"""


def _landed(spark, d):
    """Payload files in a fresh folder of the shared scratch space, with the event id kept inside the payload text."""
    path = scratch(spark, "landed")
    X.view(spark, d, X.WEATHER_JSON).select(F.col("payload").alias("value")).write.text(path)
    return path


@check(
    "t1_weather_stream",
    f"""with p as ({WEATHER_SQL}), h as (select *, coalesce(feels_like_C, {_HX}) as hi from p)
    select status, condition, case when hi > temperature_C + 1.5e0 then 'Feels Hotter' else 'Feels Like' end as feels_label, count(*) as n,
      {q('sum(temperature_C)', 'sum_temp', 3)}, {q('sum(hi)', 'sum_hi', 3)} from h group by 1, 2, 3""",
)
def t1(spark, d):
    stream = WX.weather_stream(spark, _landed(spark, d)).select("status", "condition", "feels_label", "temperature_C", "heat_index_C")
    out = scratch(spark, "weather")
    OB.run_available(stream, out, scratch(spark, "weather-state"))
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.groupBy("status", "condition", "feels_label").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("temperature_C"), 3).alias("sum_temp"), r6(F.sum("heat_index_C"), 3).alias("sum_hi")
    )


@check(
    "t2_cell_alerts",
    CELLS + """, e as (select event_id, event_id as cell_id from events)
    select event_id, cell_id, lst_celsius, case when lst_celsius is null then 'unknown' when lst_celsius >= 42 then 'very_high' when lst_celsius >= 38 then 'high' when lst_celsius >= 34 then 'moderate' else 'low' end as risk_level
    from e join cells using (cell_id)""",
)
def t2(spark, d):
    landed = scratch(spark, "alerts-in")
    X.table(spark, d, "events").select("event_id", F.col("event_id").alias("cell_id")).write.parquet(landed)
    stream = spark.readStream.schema("event_id long, cell_id long").parquet(landed)
    alerts = WX.cell_alerts(stream, X.cells(spark, d)).select("event_id", "cell_id", "lst_celsius", "risk_level")
    out = scratch(spark, "alerts")
    OB.run_available(alerts, out, scratch(spark, "alerts-state"))
    return spark.read.schema(alerts.schema).parquet(out)


_WIN = f"""with {X.SERIES_CTE}, s as (select distinct on (event_id) * from series),
  w as (select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, grid_id,
    count(*) as n, {q('avg(lst_celsius)', 'mean_value')}, {q('max(lst_celsius)', 'max_value')} from s group by 1, 2, 3)"""


@check("t3_windowed_batch", _WIN + " select * from w")
def t3a(spark, d):
    return rounded(OB.windowed_observations(X.view(spark, d, X.CELL_SERIES)))


@check("t3_windowed_stream", _WIN + " select * from w where window_end <= (select max(ts) from series) - interval '2 hours'")
def t3b(spark, d):
    landed = scratch(spark, "obs-in")
    series = X.view(spark, d, X.CELL_SERIES).select("event_id", "grid_id", F.col("ts").cast("timestamp").alias("ts"), "lst_celsius")
    series.write.parquet(landed)
    stream = spark.readStream.schema(series.schema).parquet(landed)
    windows = rounded(OB.windowed_observations(stream))
    windows = windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    out = scratch(spark, "windows")
    OB.run_available(windows, out, scratch(spark, "windows-state"))
    return spark.read.schema(windows.schema).parquet(out)


@check("t3_windowed_closed", _WIN + " select * from w")
def t3c(spark, d):
    """Two runs of one checkpoint: what has landed, then the closing row. Every window of the batch comes out."""
    landed, out, state = scratch(spark, "obs-in"), scratch(spark, "windows"), scratch(spark, "windows-state")
    series = X.view(spark, d, X.CELL_SERIES).select("event_id", "grid_id", F.col("ts").cast("timestamp").alias("ts"), "lst_celsius")
    series.write.parquet(landed)
    windows = rounded(OB.windowed_observations(spark.readStream.schema(series.schema).parquet(landed)))
    windows = windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    OB.run_available(windows, out, state)
    last = spark.read.schema(series.schema).parquet(landed).agg(F.max("ts")).first()[0]
    if last is not None:
        OB.closing_row(spark, series.schema, last).write.mode("append").parquet(landed)
        OB.run_available(windows, out, state)
    return spark.read.schema(windows.schema).parquet(out)
