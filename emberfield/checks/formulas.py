"""Checks of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield import schema as S
from emberfield.checks import fixtures as X
from emberfield.checks.registry import check, q, r6, rounded
from emberfield.functions import bands as B
from emberfield.functions import scalars as SC
from emberfield.functions.geometry import to_utm

CELLS = f"with {X.CELLS_CTE} "
RAW = f"with {X.RAW_CTE} "
OBS = f"with {X.OBS_CTE} "


def _lines(spark, d):
    """Raw observations with a row key made of unique values is not available; results are grouped by their inputs."""
    return X.view(spark, d, X.PIXEL_OBS)


@check(
    "f1_norm_diff",
    RAW + f"""select cell_id, {q('(L_NIR-L_Red)/(L_NIR+L_Red+1e-9)', 'with_eps')},
      {q('(L_NIR-L_Red)/nullif(L_NIR+L_Red, 0)', 'plain')} from raw""",
)
def f1(spark, d):
    return X.cells_raw(spark, d).select(
        "cell_id", r6(B.norm_diff("L_NIR", "L_Red")).alias("with_eps"), r6(B.norm_diff("L_NIR", "L_Red", None)).alias("plain")
    )


_IDX = ["NDVI_L", "NDWI_L", "MNDWI_L", "NDBI_L"]


@check("f2_landsat_indices", CELLS + f"select cell_id, {', '.join(q(c, c) for c in _IDX)} from cells")
def f2(spark, d):
    return rounded(X.cells(spark, d).select("cell_id", *_IDX))


@check(
    "f3_evi",
    RAW + f"""select cell_id, {q('2.5e0*(L_NIR-L_Red)/(L_NIR+6e0*L_Red-7.5e0*L_Blue+1e0+1e-9)', 'evi_blue')},
      {q('2.5e0*(L_NIR-L_Red)/nullif(L_NIR+6e0*L_Red-7.5e0*L_SWIR1+1e0, 0)', 'evi_swir1', 4)} from raw""",
)
def f3(spark, d):
    return X.cells_raw(spark, d).select(
        "cell_id", r6(B.evi("L_NIR", "L_Red", "L_Blue")).alias("evi_blue"),
        r6(B.evi("L_NIR", "L_Red", "L_SWIR1", "swir1"), 4).alias("evi_swir1"),
    )


@check("f4_savi", CELLS + f"select cell_id, {q('SAVI_L', 'savi')} from cells")
def f4(spark, d):
    return X.cells_raw(spark, d).select("cell_id", r6(B.savi("L_NIR", "L_Red")).alias("savi"))


@check("f5_nbi", CELLS + f"select cell_id, {q('NBI_L', 'nbi')} from cells")
def f5(spark, d):
    return X.cells_raw(spark, d).select("cell_id", r6(B.nbi("L_Red", "L_SWIR1", "L_NIR")).alias("nbi"))


@check(
    "f6_albedo",
    RAW + f"""select cell_id, case when L_SWIR2 is not null then least(greatest({q('0.356e0*L_Blue+0.13e0*L_Red+0.373e0*L_NIR+0.085e0*L_SWIR1+0.072e0*L_SWIR2-0.0018e0')}, 0e0), 1e0) end as albedo from raw""",
)
def f6(spark, d):
    return X.cells_raw(spark, d).select("cell_id", r6(B.albedo("L_Blue", "L_Red", "L_NIR", "L_SWIR1", "L_SWIR2")).alias("albedo"))


@check("f7_sentinel_indices", CELLS + f"select cell_id, {q('NDVI_S2', 'NDVI_S2')}, {q('NDBI_S2', 'NDBI_S2')} from cells")
def f7(spark, d):
    return rounded(X.cells(spark, d).select("cell_id", "NDVI_S2", "NDBI_S2"))


@check(
    "f8_clip",
    RAW + "select cell_id, case when albedo is not null then least(greatest(albedo, 0.15e0), 0.25e0) end as clipped from raw",
)
def f8(spark, d):
    return X.cells_raw(spark, d).select("cell_id", B.clip("albedo", 0.15, 0.25).alias("clipped"))


@check("f9_qa_mask", OBS + "select qa, qa & 30 = 0 as clear, count(*) as n from obs group by qa")
def f9(spark, d):
    return _lines(spark, d).groupBy("qa", B.qa_mask("qa").alias("clear")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "f10_scale_dn",
    OBS + f"select dn_red, dn_st, {q('dn_red*2.75e-5-0.2e0', 'sr', 7)}, {q('dn_st*0.00341802e0+149e0', 'st', 8)}, count(*) as n from obs group by dn_red, dn_st",
)
def f10(spark, d):
    return _lines(spark, d).groupBy("dn_red", "dn_st").agg(F.count(F.lit(1)).alias("n")).select(
        "dn_red", "dn_st", r6(B.scale_sr("dn_red"), 7).alias("sr"), r6(B.scale_st("dn_st"), 8).alias("st"), "n"
    )


@check(
    "f11_s2_good",
    OBS + f"""select px, py, count(*) filter (where cloud_cover < 20 and px % 12 not in (3, 8, 9, 10)) as good,
      {q('max(dn_red/1e4)', 'reflectance')} from obs group by px, py""",
)
def f11(spark, d):
    return _lines(spark, d).groupBy("px", "py").agg(
        F.count_if(B.s2_good("cloud_cover", F.col("px") % 12)).alias("good"),
        r6(F.max(B.s2_reflectance("dn_red"))).alias("reflectance"),
    )


_RED, _NIR, _BT = "(dn_red*2.75e-5-0.2e0)", "(dn_nir*2.75e-5-0.2e0)", "(dn_st*0.00341802e0+149e0)"
_NDV = f"least(greatest(({_NIR}-{_RED})/nullif({_NIR}+{_RED},0), 0.2e0), 0.5e0)"
_EM = f"(case when {_NIR}+{_RED} <> 0 then 0.986e0+0.004e0*(({_NDV}-0.2e0)/0.3e0)*(({_NDV}-0.2e0)/0.3e0) end)"
_LST = f"({_BT}/(1e0+0.000796e0*{_BT}*ln({_EM}))-273.15e0)"


@check(
    "f12_emissivity_lst",
    OBS + f"select dn_red, dn_nir, dn_st, {q(_EM, 'emissivity')}, {q(_LST, 'lst')} from obs group by dn_red, dn_nir, dn_st",
)
def f12(spark, d):
    o = _lines(spark, d).select("dn_red", "dn_nir", "dn_st").distinct()
    em = B.emissivity(B.scale_sr("dn_red"), B.scale_sr("dn_nir"))
    return o.select(
        "dn_red", "dn_nir", "dn_st", r6(em).alias("emissivity"), r6(B.lst_from_bt(B.scale_st("dn_st"), em)).alias("lst")
    )


@check("f13_wind_speed", OBS + f"select u10, v10, {q('sqrt(u10*u10+v10*v10)', 'wind')} from obs group by u10, v10")
def f13(spark, d):
    return _lines(spark, d).select("u10", "v10").distinct().select("u10", "v10", r6(B.wind_speed("u10", "v10")).alias("wind"))


_MAG = "exp(17.625e0*({k}-273.15e0)/(({k}-273.15e0)+243.04e0))"
_RH = f"100e0*{_MAG.format(k='td_k')}/{_MAG.format(k='t2m_k')}"


@check("f14_rel_humidity", OBS + f"select t2m_k, td_k, {q(_RH, 'rh')} from obs group by t2m_k, td_k")
def f14(spark, d):
    return _lines(spark, d).select("t2m_k", "td_k").distinct().select("t2m_k", "td_k", r6(B.rel_humidity("t2m_k", "td_k")).alias("rh"))


@check(
    "f15_unit_conversions",
    OBS + f"select t2m_k, rain_m, solar_j, {q('t2m_k-273.15e0', 'c')}, {q('rain_m*1e3', 'mm')}, {q('solar_j/86400e0', 'watts')} from obs group by t2m_k, rain_m, solar_j",
)
def f15(spark, d):
    return _lines(spark, d).select("t2m_k", "rain_m", "solar_j").distinct().select(
        "t2m_k", "rain_m", "solar_j", r6(B.kelvin_to_celsius("t2m_k")).alias("c"), r6(B.metres_to_mm("rain_m")).alias("mm"),
        r6(B.joules_day_to_watts("solar_j")).alias("watts"),
    )


@check(
    "f16_age_ratio",
    CELLS + f"select cell_id, {q('least(greatest((children_ratio+elderly_ratio)/(children_ratio+elderly_ratio+building_density+1e-6), 0e0), 1e0)', 'ratio')} from cells",
)
def f16(spark, d):
    sel = ["children_ratio", "elderly_ratio"]
    return X.cells(spark, d).select("cell_id", r6(B.age_ratio(sel, [*sel, "building_density"])).alias("ratio"))


@check(
    "f17_impervious_ratio",
    CELLS + f"""select cell_id, {q('impervious_ratio', 'main')},
      {q('least(greatest(building_density + 0.15e0*least(greatest(road_density, 0e0), 1e0), 0e0), 1e0)', 'module')} from cells""",
)
def f17(spark, d):
    return X.cells(spark, d).select(
        "cell_id", r6("impervious_ratio").alias("main"),
        r6(B.impervious_ratio("building_density", "road_density", "module")).alias("module"),
    )


_RISK = "case when {x} is null or isnan({x}) or isinf({x}) then 'unknown' when {x} >= 42 then 'very_high' when {x} >= 38 then 'high' when {x} >= 34 then 'moderate' else 'low' end"


@check("f18_classify_heat", CELLS + f"select cell_id, {_RISK.format(x='lst_celsius')} as risk from cells")
def f18(spark, d):
    return X.cells(spark, d).select("cell_id", SC.classify_heat("lst_celsius").alias("risk"))


@check(
    "f19_heat_color",
    CELLS + """select cell_id, case when lst_celsius >= 42 then '#c1121f' when lst_celsius >= 38 then '#f3722c'
      when lst_celsius >= 34 then '#f9c74f' when lst_celsius >= 30 then '#43aa8b' else '#277da1' end as color from cells""",
)
def f19(spark, d):
    return X.cells(spark, d).select("cell_id", SC.heat_color("lst_celsius").alias("color"))


_TF = "(air_temp_C*9e0/5e0+32e0)"
_R = "humidity_pct"
_HI = f"""case when {_TF} < 80 then air_temp_C else ((-42.379e0 + 2.04901523e0*{_TF} + 10.14333127e0*{_R} - 0.22475541e0*{_TF}*{_R}
  - 0.00683783e0*{_TF}*{_TF} - 0.05481717e0*{_R}*{_R} + 0.00122874e0*{_TF}*{_TF}*{_R} + 0.00085282e0*{_TF}*{_R}*{_R}
  - 0.00000199e0*{_TF}*{_TF}*{_R}*{_R}) - 32e0)*5e0/9e0 end"""


@check("f20_heat_index", CELLS + f"select cell_id, {q(_HI, 'heat_index')} from cells")
def f20(spark, d):
    return X.cells(spark, d).select("cell_id", r6(SC.heat_index("air_temp_C", "humidity_pct")).alias("heat_index"))


@check("f21_feels_like", CELLS + f"select cell_id, case when {_HI} > air_temp_C + 1.5e0 then 'Feels Hotter' else 'Feels Like' end as label from cells")
def f21(spark, d):
    hi = SC.heat_index("air_temp_C", "humidity_pct")
    return X.cells(spark, d).select("cell_id", SC.feels_like_label(hi, "air_temp_C").alias("label"))


@check(
    "f22_hvi_class",
    CELLS + """select cell_id, building_density, case when building_density <= 0.25e0 then 'Low' when building_density <= 0.5e0 then 'Medium'
      when building_density <= 0.75e0 then 'High' else 'Very High' end as hvi_class,
      case when building_density <= 0.25e0 then 1 when building_density <= 0.5e0 then 2 when building_density <= 0.75e0 then 3 else 4 end as hvi_rank from cells""",
)
def f22(spark, d):
    return X.cells(spark, d).select(
        "cell_id", "building_density", SC.hvi_class("building_density").alias("hvi_class"), SC.hvi_rank("building_density").alias("hvi_rank")
    )


def _values(table, col):
    return f"case {col} " + " ".join(f"when {k!r} then '{v}'" for k, v in table.items())


_FEATS = [*S.FEATURE_TITLES, "other"]
_FEAT_SQL = "case " + " ".join(f"when event_id % {len(_FEATS)} = {i} then '{f}'" for i, f in enumerate(_FEATS)) + " end"


@check(
    "f23_driver_explanations",
    f"""with e as (select event_id, {_FEAT_SQL} as feature from events)
    select event_id, feature, case feature
      when 'NDVI_L' then 'Less shade and evapotranspiration makes surfaces hotter.'
      when 'EVI_L' then 'Sparse or stressed vegetation reduces natural cooling.'
      when 'SAVI_L' then 'Open dry soil and low vegetation can raise local heat.'
      when 'NDBI_L' then 'Concrete, roofs, and roads store heat during the day.'
      when 'MNDWI_L' then 'Water bodies and moist areas usually cool the surroundings.'
      when 'albedo' then 'Darker roofs and pavements absorb more sunlight.'
      when 'solar_rad_W_m2' then 'High solar radiation increases surface heating.'
      when 'air_temp_C' then 'Higher air temperature adds to heat stress.'
      when 'air_temp_C_max' then 'High daily peaks increase heat exposure.'
      when 'air_temp_C_min' then 'Night heat can keep surfaces from cooling down.'
      when 'humidity_pct' then 'Humidity makes the body cool itself less effectively.'
      when 'wind_speed' then 'Weak wind reduces natural cooling and ventilation.'
      when 'rainfall_mm' then 'Dry ground and dry vegetation heat up faster.'
      when 'Elevation_m' then 'Terrain affects air flow, shade, and heat accumulation.'
      when 'Slope_deg' then 'Land shape changes sunlight exposure and drainage.'
      when 'TPI_500m' then 'Local land shape can trap heat in dense areas.'
      when 'pop_density' then 'More people and activity often means more waste heat.'
      when 'ntl_radiance' then 'Bright night-time areas often mark dense urban use.'
      when 'road_density' then 'Road surfaces absorb heat and reduce green cover.'
      when 'building_density' then 'Dense buildings store heat and limit air movement.'
      when 'impervious_ratio' then 'Hard surfaces stop soil moisture cooling.'
      when 'dist_road_m' then 'Nearby roads add hot pavement and traffic heat.'
      else 'This local condition is linked with higher heat.' end as explanation from e""",
)
def f23_explained(spark, d):
    names = F.array(*[F.lit(f) for f in _FEATS])
    e = X.table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % len(_FEATS) + 1).cast("int")).alias("feature"))
    return e.select("event_id", "feature", SC.driver_explanation("feature").alias("explanation"))


@check(
    "f23_lookups",
    f"""with e as (select event_id, cast(event_id % 100 as int) as code, {_FEAT_SQL} as feature, cast(event_id % 6 as int) as type_id,
      case event_id % 5 when 0 then 'very_high' when 1 then 'high' when 2 then 'moderate' when 3 then 'low' end as risk from events)
    select event_id, {_values(S.WEATHER_TEXT, 'code')} else 'Current weather' end as condition,
      {_values(S.DRIVER_HEADLINES, 'feature')} else feature end as headline,
      {_values(S.FEATURE_TITLES, 'feature')} else feature end as title,
      {_values(S.PLAN_LABELS, 'type_id')} end as label, {_values(S.PLAN_COLORS, 'type_id')} end as color,
      replace(coalesce(risk, 'unknown'), '_', ' ') as risk_text from e""",
)
def f23(spark, d):
    names = F.array(*[F.lit(f) for f in _FEATS])
    risks = F.array(F.lit("very_high"), F.lit("high"), F.lit("moderate"), F.lit("low"), F.lit(None).cast("string"))
    e = X.table(spark, d, "events").select(
        "event_id", (F.col("event_id") % 100).cast("int").alias("code"),
        F.element_at(names, (F.col("event_id") % len(_FEATS) + 1).cast("int")).alias("feature"),
        (F.col("event_id") % 6).cast("int").alias("type_id"),
        F.element_at(risks, (F.col("event_id") % 5 + 1).cast("int")).alias("risk"),
    )
    return e.select(
        "event_id", SC.weather_text("code").alias("condition"), SC.driver_text("feature").alias("headline"),
        SC.feature_title("feature").alias("title"), SC.intervention_label("type_id").alias("label"),
        SC.intervention_color("type_id").alias("color"), SC.risk_text("risk").alias("risk_text"),
    )


_ACT = [*S.INTERVENTIONS, "other"]
_ACT_SQL = "case " + " ".join(f"when o_orderkey % {len(_ACT)} = {i} then '{f}'" for i, f in enumerate(_ACT)) + " end"


@check(
    "f24_co_benefits",
    f"""with e as (select o_orderkey as cell_id, {_ACT_SQL} as intervention,
      case when o_orderkey % 11 <> 0 then ((o_orderkey*7) % 64)/17e0 end as delta from orders)
    select cell_id, {q("coalesce(delta, 0e0)*case intervention when 'trees' then 12.5e0 when 'cool_roofs' then 8.2e0"
      " when 'reflective_pavement' then 3.8e0 when 'blue_green' then 10.8e0 else 26.4e0 end", 'co2', 1)},
      {q("coalesce(delta, 0e0)*case intervention when 'trees' then 3.2e0 when 'cool_roofs' then 7.5e0"
      " when 'reflective_pavement' then 2.1e0 when 'blue_green' then 4.8e0 else 11.5e0 end", 'energy', 1)},
      case intervention when 'trees' then '3-5 yrs' when 'cool_roofs' then 'Immediate' when 'reflective_pavement' then '1-2 yrs'
      when 'blue_green' then '2-3 yrs' else '3-7 yrs' end as effect from e""",
)
def f24(spark, d):
    e = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("cell_id"),
        F.element_at(F.array(*[F.lit(a) for a in _ACT]), (F.col("o_orderkey") % len(_ACT) + 1).cast("int")).alias("intervention"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") * 7) % 64 / F.lit(17.0)).alias("delta"),
    )
    return e.select(
        "cell_id", SC.co2_tonnes("delta", "intervention").alias("co2"), SC.energy_saving_pct("delta", "intervention").alias("energy"),
        SC.time_to_effect("intervention").alias("effect"),
    )


@check(
    "f25_future_outlook",
    CELLS + f"""select cell_id, lst_celsius as no_action_lst_C, {_RISK.format(x='lst_celsius')} as risk_class,
      case when lst_celsius >= 38 then 1e0 else 35e-2 end as hotspot_prob from cells""",
)
def f25(spark, d):
    risk = SC.classify_heat("lst_celsius")
    return X.cells(spark, d).select(
        "cell_id", F.col("lst_celsius").alias("no_action_lst_C"), risk.alias("risk_class"), SC.hotspot_outlook(risk).alias("hotspot_prob")
    )


@check(
    "f26_area_summary",
    CELLS + f""", s as (select *, case when cell_id % 4 <> 0 then 'Ward ' || cast(cell_id % 25 as varchar) end as place,
      case when cell_id % 3 <> 0 then air_temp_C + 1 end as feels, {_RISK.format(x='lst_celsius')} as risk,
      case when cell_id % 5 <> 0 then lower(case cell_id % 2 when 0 then 'Low tree cover' else 'Dark surface materials' end) end as c1,
      case when cell_id % 5 <> 0 then 'more roads' end as c2,
      case when cell_id % 7 <> 0 then case cell_id % 2 when 0 then 'tree cover' else 'cool roofs' end end as act,
      case when cell_id % 7 <> 0 then (cell_id % 41)/9e0 - 1 end as cut from cells)
    select cell_id, coalesce(place, 'selected area') || ' is currently around ' || format('{{:.1f}}', air_temp_C) || ' °C' ||
      case when feels is not null then ', feeling like ' || format('{{:.1f}}', feels) || ' °C' else '' end ||
      '. The local surface heat is estimated near ' || case when lst_celsius is null then '--' else format('{{:.1f}}', lst_celsius) end ||
      ' °C, giving a ' || replace(risk, '_', ' ') || ' heat risk. By 2030, if no cooling action is taken, the heat outlook stays around ' ||
      case when lst_celsius is null then '--' else format('{{:.1f}}', lst_celsius) end || ' °C. The main reasons appear to be ' ||
      coalesce(c1 || ' and ' || c2, 'local built-up and weather conditions') || '.' ||
      case when cut is not null then ' The strongest cooling option is ' || act || ', with an estimated reduction of about ' ||
        format('{{:.1f}}', greatest(cut, 0e0)) || ' °C.' else '' end as summary,
      'Weather: saved local weather | Risk: ' || replace(risk, '_', ' ') || ' | Main Cause: ' || coalesce(c1, 'urban heat conditions') ||
      ' | Cooling: ' || case when cut is not null then '-' || format('{{:.1f}}', greatest(cut, 0e0)) || ' °C' else '--' end as badges from s""".replace("{{", "{").replace("}}", "}"),
)
def f26(spark, d):
    i = F.col("cell_id")
    c = X.cells(spark, d).withColumns(
        {
            "place": F.when(i % 4 != 0, F.concat(F.lit("Ward "), (i % 25).cast("string"))),
            "feels": F.when(i % 3 != 0, F.col("air_temp_C") + 1),
            "risk": SC.classify_heat("lst_celsius"),
            "c1": F.when(i % 5 != 0, F.when(i % 2 == 0, "NDVI_L").otherwise("albedo")),
            "c2": F.when(i % 5 != 0, "road_density"),
            "best": F.when(i % 7 != 0, F.when(i % 2 == 0, "trees").otherwise("cool_roofs")),
            "cut": F.when(i % 7 != 0, (i % 41) / F.lit(9.0) - 1),
            "condition": F.lit(None).cast("string"),
        }
    )
    return c.select(
        "cell_id",
        SC.area_summary("place", "air_temp_C", "feels", "lst_celsius", "risk", "lst_celsius", "c1", "c2", "best", "cut").alias("summary"),
        SC.summary_badges("condition", "risk", "c1", "cut").alias("badges"),
    )


@check(
    "f27_relative_bar",
    """with e as (select event_id, user_id, ((event_id*31) % 257)/1e2 - 1.2e0 as v from events)
    select event_id, greatest(4e0, floor(abs(v)/greatest(max(abs(v)) over (partition by user_id), 0.001e0)*100e0 + 0.5e0)) as driver_bar,
      greatest(4e0, floor(v/greatest(max(v) over (partition by user_id), 0.1e0)*100e0 + 0.5e0)) as action_bar from e""",
)
def f27(spark, d):
    e = X.table(spark, d, "events").select("event_id", "user_id", ((F.col("event_id") * 31) % 257 / F.lit(100.0) - F.lit(1.2)).alias("v"))
    bars = SC.with_relative_bar(e, "v", "user_id", "driver_bar")
    return SC.with_relative_bar(bars, "v", "user_id", "action_bar", 0.1, absolute=False).select(
        "event_id", "driver_bar", "action_bar"
    )


@check(
    "f28_viewport_pos",
    CELLS + f""", g as (select min(lon)-greatest((max(lon)-min(lon))*0.04e0, 0.01e0) as w, max(lon)+greatest((max(lon)-min(lon))*0.04e0, 0.01e0) as e,
      min(lat)-greatest((max(lat)-min(lat))*0.04e0, 0.01e0) as s, max(lat)+greatest((max(lat)-min(lat))*0.04e0, 0.01e0) as n from cells)
    select cell_id, {q('least(greatest((lon-w)/greatest(e-w, 1e-6)*100e0, 0e0), 100e0)', 'pos_left')},
      {q('least(greatest((n-lat)/greatest(n-s, 1e-6)*100e0, 0e0), 100e0)', 'pos_top')} from cells, g""",
)
def f28(spark, d):
    from emberfield.operators.spatial import study_bounds_columns

    c = X.cells(spark, d)
    b = study_bounds_columns(c)
    left, top = SC.viewport_pos("lon", "lat", b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"])
    return c.select("cell_id", r6(left).alias("pos_left"), r6(top).alias("pos_top"))


_UTM = """, k as (select *, 1.6792203863837047e-3 as n, 2*sqrt(1.6792203863837047e-3)/(1+1.6792203863837047e-3) as kk from cells),
u as (select *, sinh(atanh(sin(radians(lat))) - kk*atanh(kk*sin(radians(lat)))) as t, radians(lon - 75e0) as lam from k),
v as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam)/sqrt(1+t*t)) as eta, 6378137e0/(1+n)*(1+n*n/4+n*n*n*n/64) as a,
  n/2-2*n*n/3+5*n*n*n/16 as a1, 13*n*n/48-3*n*n*n/5 as a2, 61*n*n*n/240 as a3 from u)"""


@check(
    "f29_to_utm",
    CELLS + _UTM + f""" select cell_id,
      {q('500000e0+0.9996e0*a*(eta+a1*cos(2*xi)*sinh(2*eta)+a2*cos(4*xi)*sinh(4*eta)+a3*cos(6*xi)*sinh(6*eta))', 'easting', 4)},
      {q('0.9996e0*a*(xi+a1*sin(2*xi)*cosh(2*eta)+a2*sin(4*xi)*cosh(4*eta)+a3*sin(6*xi)*cosh(6*eta))', 'northing', 4)} from v""",
)
def f29(spark, d):
    x, y = to_utm("lon", "lat")
    return X.cells(spark, d).select("cell_id", r6(x, 4).alias("easting"), r6(y, 4).alias("northing"))
