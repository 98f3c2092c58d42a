"""Cooling interventions: catalog, feasibility, scores, rules, what-if scenarios."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import schema as S
from emberfield.functions.bands import clip
from emberfield.functions.scalars import classify_heat, lookup
from emberfield.operators.spatial import nearest_cell
from emberfield.operators.stats import top_k_per_group

Model = Callable[[DataFrame], DataFrame]  # adds a column ``prediction``


def _catalog_array(names: Sequence[str], fields: Mapping[str, Mapping]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("catalog_ord"), F.lit(n).alias("intervention"),
                *[F.lit(v[n]).alias(f) for f, v in fields.items()],
            )
            for i, n in enumerate(names)
        ]
    )


def catalog_cross(df: DataFrame, names: Sequence[str] = tuple(S.INTERVENTIONS), fields: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Every row with every intervention. The catalog is a constant of five, so rows are multiplied in place."""
    if fields is None:
        fields = {
            "cost": {n: float(c["cost"]) for n, c in S.CATALOG.items()},
            "typical_delta": {n: c["typical_delta"] for n, c in S.CATALOG.items()},
        }
    return df.select("*", F.inline(_catalog_array(names, fields)))


def _get(df: DataFrame, default: float, *names: str) -> Column:
    cols = [F.col(n).cast("double") for n in names if n in df.columns]
    return F.coalesce(*cols, F.lit(default))


def feasibility(df: DataFrame) -> Column:
    """Suitability (0-1) of the row's ``intervention`` at the row's location."""
    name = F.col("intervention")
    ndvi, building = _get(df, 0.3, "NDVI_L", "NDVI"), _get(df, 0.3, "building_density")
    road, water, hvi = _get(df, 5.0, "road_density"), _get(df, 500.0, "dist_water_m"), _get(df, 0.5, "HVI")
    one, zero = F.lit(1.0), F.lit(0.0)
    raw = (
        F.when(name == "trees", F.greatest(zero, one - ndvi) * (one - building * F.lit(0.5)))
        .when(name == "cool_roofs", building)
        .when(name == "reflective_pavement", F.least(one, road / F.lit(20.0)))
        .when(name == "blue_green", F.least(one, water / F.lit(2000.0)))
        .when(name == "combined", hvi)
        .otherwise(F.lit(0.5))
    )
    return clip(raw, 0.0, 1.0)


def intervention_score(df: DataFrame, delta: Column, cost: Column) -> Column:
    """Weighted score of temperature drop, vulnerability, population, cheapness and feasibility."""
    one = F.lit(1.0)
    pop = _get(df, 100.0, "pop_density")
    people = F.least(one, F.log1p(pop) / F.log1p(F.lit(5000.0)))
    cheap = one - F.least(cost / F.lit(5000.0), one)
    raw = (
        F.lit(0.35) * F.least(delta / F.lit(6.0), one) + F.lit(0.20) * _get(df, 0.5, "HVI")
        + F.lit(0.15) * people + F.lit(0.15) * cheap + F.lit(0.15) * feasibility(df)
    )
    return clip(raw, 0.0, 1.0)


def recommend(
    cells: DataFrame, cell_id: str = "cell_id", delta_t: Mapping[str, float] | None = None, n: int = 3
) -> DataFrame:
    """Best ``n`` interventions per location by rounded score, ties in catalog order."""
    deltas = {k: float((delta_t or {}).get(k, c["typical_delta"])) for k, c in S.CATALOG.items()}
    crossed = catalog_cross(
        cells, fields={"cost": {k: float(c["cost"]) for k, c in S.CATALOG.items()}, "delta_T_C": deltas}
    )
    scored = crossed.withColumns(
        {
            "score": F.round(intervention_score(crossed, F.col("delta_T_C"), F.col("cost")), 4),
            "feasibility": F.round(feasibility(crossed), 3),
        }
    ).select(cell_id, "catalog_ord", "intervention", "score", F.round("delta_T_C", 2).alias("delta_T_C"), "cost", "feasibility")
    best = top_k_per_group(scored, [cell_id], [F.desc("score"), F.asc("catalog_ord")], n)
    return best.withColumns(
        {
            "label": lookup("intervention", {k: c["label"] for k, c in S.CATALOG.items()}),
            "lifespan_yr": lookup("intervention", {k: c["lifespan"] for k, c in S.CATALOG.items()}),
            "color": lookup("intervention", {k: c["color"] for k, c in S.CATALOG.items()}),
        }
    ).drop("catalog_ord")


# Reason shown for each rule.
RULE_REASONS = {
    "extreme": "High HVI + extreme LST → combined priority intervention",
    "bare": "Low NDVI + open land → tree cover / pocket park",
    "roofs": "High building density → cool reflective roofs",
    "roads": "High road density → reflective / permeable pavement",
    "dry": "Far from water body → blue-green infrastructure",
    "default": "Default recommendation: urban tree planting",
}
_RULE_ACTION = {
    "extreme": "combined", "bare": "trees", "roofs": "cool_roofs", "roads": "reflective_pavement",
    "dry": "blue_green", "default": "trees",
}


def rule_recommend(cells: DataFrame) -> DataFrame:
    """The first rule that fits, with its reason and the catalog entry."""
    building = _get(cells, 0.3, "building_density")
    rule = (
        F.when((_get(cells, 0.5, "HVI") > 0.75) & (_get(cells, 38.0, "lst_celsius") > 42), "extreme")
        .when((_get(cells, 0.3, "NDVI_L", "NDVI") < 0.2) & (building < 0.4), "bare")
        .when(building > 0.5, "roofs")
        .when(_get(cells, 5.0, "road_density") > 15, "roads")
        .when(_get(cells, 500.0, "dist_water_m") > 1500, "dry")
        .otherwise("default")
    )
    out = cells.withColumn("_rule", rule).withColumn("intervention", lookup("_rule", _RULE_ACTION))
    return out.withColumns(
        {
            "reason": lookup("_rule", RULE_REASONS),
            "label": lookup("intervention", {k: c["label"] for k, c in S.CATALOG.items()}),
            "cost_inr_m2": lookup("intervention", {k: float(c["cost"]) for k, c in S.CATALOG.items()}),
            "typical_delta_T": lookup("intervention", {k: c["typical_delta"] for k, c in S.CATALOG.items()}),
            "lifespan_yr": lookup("intervention", {k: c["lifespan"] for k, c in S.CATALOG.items()}),
        }
    ).drop("_rule")


# Bounds used when changed features are clipped.
CLIP_BOUNDS = {
    "full": {
        "NDVI_L": (-1.0, 1.0), "NDBI_L": (-1.0, 1.0), "MNDWI_L": (-1.0, 1.0), "EVI_L": (-1.0, 1.0),
        "SAVI_L": (-1.0, 1.0), "albedo": (0.0, 1.0), "impervious_ratio": (0.0, 1.0),
        "building_density": (0.0, 1.0), "humidity_pct": (0.0, 100.0), "dist_water_m": (0.0, float("inf")),
    },
    "batch": {
        "NDVI_L": (-1.0, 1.0), "NDBI_L": (-1.0, 1.0), "MNDWI_L": (-1.0, 1.0), "albedo": (0.0, 1.0),
        "impervious_ratio": (0.0, 1.0), "building_density": (0.0, 1.0),
    },
    "none": {},
}


def _bounded(feature: str, value: Column, clip_mode: str) -> Column:
    bounds = CLIP_BOUNDS[clip_mode].get(feature)
    if bounds is None:
        return value
    lo, hi = bounds
    return F.when(value.isNotNull(), F.greatest(value, F.lit(lo))) if hi == float("inf") else clip(value, lo, hi)


def apply_intervention(df: DataFrame, name: str, profile: str = "simulate", clip_mode: str = "full") -> DataFrame:
    """Change the features that are present; an unknown name changes nothing."""
    deltas = S.DELTAS[profile].get(name, {})
    new = {f: _bounded(f, F.col(f) + F.lit(d), clip_mode) for f, d in deltas.items() if f in df.columns}
    return df.withColumns(new) if new else df


def apply_interventions_long(df: DataFrame, name: Column, profile: str, clip_mode: str, names: Sequence[str]) -> DataFrame:
    """As above with the intervention read from a column: one pass for any number of interventions."""
    table = {n: S.DELTAS[profile].get(n, {}) for n in names}
    features = [f for f in dict.fromkeys(f for d in table.values() for f in d) if f in df.columns]
    new = {}
    for f in features:
        hit = [n for n in names if f in table[n]]
        delta = F.element_at(F.create_map(*[x for n in hit for x in (F.lit(n), F.lit(table[n][f]))]), name)
        new[f] = F.when(name.isin(*hit), _bounded(f, F.col(f) + delta, clip_mode)).otherwise(F.col(f))
    return df.withColumns(new) if new else df


# --------------------------------------------------------------------------------------------------
# scenarios
# --------------------------------------------------------------------------------------------------


def linear_score(
    medians: Mapping[str, float], slopes: Mapping[str, float] = S.LINEAR_SLOPES, intercept: float = S.LINEAR_INTERCEPT,
    centres: Mapping[str, float] = S.LINEAR_CENTRES,
) -> Model:
    """Linear predictor; absent, null and NaN features take the training median."""

    def model(df: DataFrame) -> DataFrame:
        total = F.lit(float(intercept))
        for f, k in slopes.items():
            m = F.lit(float(medians[f]))
            x = F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f)), m) if f in df.columns else m
            total = total + F.lit(float(k)) * (x - F.lit(float(centres.get(f, 0.0))))
        return df.withColumn("prediction", total)

    return model


def batch_simulate(df: DataFrame, model: Model, name: str) -> DataFrame:
    """Add pred_lst_baseline, pred_lst_<name> and delta_T (not floored); both predictions on one scan."""
    kept = [F.col(c) for c in df.columns]
    base = model(df).withColumnRenamed("prediction", "pred_lst_baseline").withColumn("_row", F.struct(*kept))
    after = model(apply_intervention(base, name, "simulate", "batch"))
    return after.select(
        "_row.*", "pred_lst_baseline", F.col("prediction").alias(f"pred_lst_{name}"),
        (F.col("pred_lst_baseline") - F.col("prediction")).alias("delta_T"),
    )


def scenarios_long(
    df: DataFrame, model: Model, names: Sequence[str], profile: str, clip_mode: str
) -> DataFrame:
    """One row per input row and intervention with lst_base and lst_after; the inputs are read once."""
    base = model(df).withColumnRenamed("prediction", "lst_base")
    crossed = base.select("*", F.inline(_catalog_array(names, {})))
    changed = apply_interventions_long(crossed, F.col("intervention"), profile, clip_mode, names)
    return model(changed).withColumnRenamed("prediction", "lst_after")


def scenario_compare(df: DataFrame, model: Model, cell_id: str = "cell_id") -> DataFrame:
    """All interventions per location: reduction floored at 0 and rounded to 2 digits; the best is flagged on the
    rounded value, first in catalog order on a tie."""
    rows = scenarios_long(df, model, S.INTERVENTIONS, "simulate", "full")
    rows = rows.select(
        cell_id, "catalog_ord", "intervention", F.round("lst_base", 2).alias("baseline_lst"),
        F.round("lst_after", 2).alias("modified_lst"),
        F.round(F.greatest(F.col("lst_base") - F.col("lst_after"), F.lit(0.0)), 2).alias("reduction"),
    )
    ranked = top_k_per_group(rows, [cell_id], [F.desc("reduction"), F.asc("catalog_ord")], len(S.INTERVENTIONS))
    return ranked.withColumns(
        {
            "is_best": F.col("rank") == 1,
            "cost_inr_per_m2": lookup("intervention", {k: float(c["cost"]) for k, c in S.CATALOG.items()}),
            "lifespan_years": lookup("intervention", {k: c["lifespan"] for k, c in S.CATALOG.items()}),
            "description": lookup("intervention", S.DESCRIPTIONS),
        }
    ).drop("rank", "catalog_ord")


def best_scenario(rows: DataFrame, by: str, reduction: str = "reduction", order: str = "catalog_ord") -> DataFrame:
    """Arg-max of the reduction per location, first in catalog order on a tie."""
    rest = [c for c in rows.columns if c not in (by, reduction, order)]
    top = F.min(F.struct((-F.col(reduction)).alias("_neg"), F.col(order), F.col(reduction), *rest)).alias("_b")
    return rows.groupBy(by).agg(top).select(by, f"_b.{reduction}", *[f"_b.{c}" for c in rest])


def delta_t(
    df: DataFrame, model: Model, type_id: Column, profile: str = "plan", clip_mode: str = "none",
    default: str | None = None,
) -> DataFrame:
    """Add delta_T, the drop of the intervention type in each row: floored at 0, 0 for type 0; unknown types take
    ``default`` (or change nothing)."""
    names = [n for n in S.INTERVENTION_TYPES.values() if n != "none"]
    known = lookup(type_id.cast("int"), S.INTERVENTION_TYPES)
    name = F.coalesce(known, F.lit(default or "none"))
    held = df.withColumns({"_row": F.struct(*df.columns), "_name": name})
    base = model(held).withColumnRenamed("prediction", "_base")
    after = model(apply_interventions_long(base, F.col("_name"), profile, clip_mode, names))
    drop = F.greatest(F.lit(0.0), F.col("_base") - F.col("prediction"))
    return after.select("_row.*", F.when(F.col("_name") == "none", F.lit(0.0)).otherwise(drop).alias("delta_T"))


# --------------------------------------------------------------------------------------------------
# point queries
# --------------------------------------------------------------------------------------------------


def scenario_at(
    queries: DataFrame, cells: DataFrame, model: Model, names: Sequence[str] = tuple(S.INTERVENTIONS),
    intensity: float = 1.0, carry: Sequence[str] = tuple(S.LINEAR_SLOPES),
) -> DataFrame:
    """Nearest cell of each query, every named intervention without clipping, unfloored difference, best flagged.
    The intensity is echoed. One nearest join and one prediction pass for all queries and interventions."""
    at = nearest_cell(queries, cells, carry=tuple(c for c in carry if c in cells.columns))
    rows = scenarios_long(at, model, names, "serve", "none").select(
        "qid", "cell_id", "catalog_ord", "intervention", "lst_base", "lst_after",
        (F.col("lst_base") - F.col("lst_after")).alias("delta_C"),
    )
    ranked = top_k_per_group(rows, ["qid"], [F.desc(F.round("delta_C", 9)), F.asc("catalog_ord")], len(names))
    return ranked.withColumns({"is_best": F.col("rank") == 1, "intensity": F.lit(float(intensity))}).drop("rank", "catalog_ord")


HEAT_FIELDS = ("lat", "lon", "grid_id", "lst_celsius", "air_temp_C", "humidity_pct", "wind_speed", "ward_id", "ward_name", "ward_join_method")


def heat_at(queries: DataFrame, cells: DataFrame, model: Model, features: Sequence[str] = tuple(S.LINEAR_SLOPES)) -> DataFrame:
    """Observed and predicted temperature, risk class and ward at the nearest cell of each query."""
    carry = tuple(dict.fromkeys(c for c in (*HEAT_FIELDS, *features) if c in cells.columns))
    at = model(nearest_cell(queries, cells, carry=carry)).withColumnRenamed("prediction", "pred_lst_C")
    fields = [c for c in HEAT_FIELDS if c in cells.columns]
    return at.select("qid", "cell_id", "pred_lst_C", classify_heat("pred_lst_C").alias("risk_level"), *fields)


def recommend_at(queries: DataFrame, cells: DataFrame, model: Model) -> DataFrame:
    """Best scenario, risk class and ward per query. One nearest join feeds both parts."""
    carry = tuple(dict.fromkeys(c for c in (*S.LINEAR_SLOPES, "ward_id", "ward_name") if c in cells.columns))
    at = nearest_cell(queries, cells, carry=carry)
    rows = scenarios_long(at, model, S.INTERVENTIONS, "serve", "none")
    wards = [c for c in ("ward_id", "ward_name") if c in cells.columns]
    rows = rows.select(
        "qid", "catalog_ord", "intervention", "lst_base", *wards,
        F.round(F.col("lst_base") - F.col("lst_after"), 9).alias("delta_C"),
    )
    best = best_scenario(rows, "qid", "delta_C")
    return best.select("qid", "intervention", "delta_C", classify_heat("lst_base").alias("risk_level"), *wards)
