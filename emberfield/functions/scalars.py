"""Classification, comfort, lookup and text functions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import schema as S
from emberfield.functions.bands import _c, clip


def lookup(key, table: Mapping, default=None) -> Column:
    """Dictionary lookup with a default, as a literal map (JVM-side)."""
    key = _c(key)
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.when(key.isNotNull(), F.element_at(pairs, key))
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def classify_heat(lst) -> Column:
    """Risk class; missing and non-finite values are unknown."""
    x = _c(lst)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (
        F.when(~finite | x.isNull(), "unknown")
        .when(x >= 42, "very_high")
        .when(x >= 38, "high")
        .when(x >= 34, "moderate")
        .otherwise("low")
    )


def heat_color(lst) -> Column:
    x = _c(lst)
    return (
        F.when(x >= 42, "#c1121f")
        .when(x >= 38, "#f3722c")
        .when(x >= 34, "#f9c74f")
        .when(x >= 30, "#43aa8b")
        .otherwise("#277da1")
    )


def heat_index(temp_c, humidity) -> Column:
    """Nine-term comfort regression, applied from 80 F upward."""
    t, r = _c(temp_c), _c(humidity)
    f = t * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)
    # Regression coefficients.
    hot = (
        F.lit(-42.379) + F.lit(2.04901523) * f + F.lit(10.14333127) * r
        - F.lit(0.22475541) * f * r - F.lit(0.00683783) * f * f - F.lit(0.05481717) * r * r
        + F.lit(0.00122874) * f * f * r + F.lit(0.00085282) * f * r * r - F.lit(0.00000199) * f * f * r * r
    )
    inf = F.lit(float("inf"))
    ok = t.isNotNull() & r.isNotNull() & ~F.isnan(t) & ~F.isnan(r) & (F.abs(t) < inf) & (F.abs(r) < inf)
    return F.when(ok, F.when(f < 80, t).otherwise((hot - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)))


def feels_like_label(index, temp_c) -> Column:
    hotter = _c(index) > F.coalesce(_c(temp_c), F.lit(0.0)) + F.lit(1.5)
    return F.when(hotter, "Feels Hotter").otherwise("Feels Like")


def hvi_class(hvi) -> Column:
    x = _c(hvi)
    return (
        F.when((x >= 0) & (x <= 0.25), "Low")
        .when((x > 0.25) & (x <= 0.50), "Medium")
        .when((x > 0.50) & (x <= 0.75), "High")
        .when((x > 0.75) & (x <= 1.01), "Very High")
    )


def hvi_rank(hvi) -> Column:
    """Ordinal of the class, for ordered output."""
    return lookup(hvi_class(hvi), {"Low": 1, "Medium": 2, "High": 3, "Very High": 4})


def weather_text(code) -> Column:
    return lookup(_c(code).cast("int"), S.WEATHER_TEXT, "Current weather")


def driver_text(feature) -> Column:
    return lookup(feature, S.DRIVER_HEADLINES, _c(feature))


def driver_explanation(feature) -> Column:
    return lookup(feature, S.DRIVER_EXPLANATIONS, S.OTHER_EXPLANATION)


def feature_title(feature) -> Column:
    return lookup(feature, S.FEATURE_TITLES, _c(feature))


def intervention_label(type_id) -> Column:
    return lookup(_c(type_id).cast("int"), S.PLAN_LABELS)


def intervention_color(type_id) -> Column:
    return lookup(_c(type_id).cast("int"), S.PLAN_COLORS)


def display_label(name) -> Column:
    return lookup(name, {k: v[0] for k, v in S.DISPLAY.items()}, _c(name))


def risk_text(risk) -> Column:
    """First underscore becomes a blank; missing risk reads unknown."""
    return F.regexp_replace(F.coalesce(_c(risk), F.lit("unknown")), "^([^_]*)_", "$1 ")


def co2_tonnes(delta, name) -> Column:
    return F.round(F.coalesce(_c(delta), F.lit(0.0)) * lookup(name, {k: v[1] for k, v in S.DISPLAY.items()}, S.DISPLAY["combined"][1]), 1)


def energy_saving_pct(delta, name) -> Column:
    return F.round(F.coalesce(_c(delta), F.lit(0.0)) * lookup(name, {k: v[2] for k, v in S.DISPLAY.items()}, S.DISPLAY["combined"][2]), 1)


def time_to_effect(name) -> Column:
    return lookup(name, {k: v[3] for k, v in S.DISPLAY.items()}, S.DISPLAY["combined"][3])


def hotspot_outlook(risk) -> Column:
    return F.when(_c(risk).isin("high", "very_high"), F.lit(1.0)).otherwise(F.lit(0.35))


def with_relative_bar(
    df: DataFrame, value: str, by: str, out: str = "bar", floor: float = 0.001, absolute: bool = True
) -> DataFrame:
    """Add the bar width in percent of the largest value shown for the same location, at least 4.

    The largest values are aggregated and joined back (not a window), so a location may hold any share of the rows.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    v = F.abs(v) if absolute else v
    top = df.groupBy(F.col(by).alias("_by")).agg(F.greatest(F.max(v), F.lit(floor)).alias("_top"))
    width = F.greatest(F.lit(4.0), F.floor(v / F.col("_top") * F.lit(100.0) + F.lit(0.5)).cast("double"))
    # a null location is a location
    return df.join(top, F.col(by).eqNullSafe(F.col("_by"))).withColumn(out, width).drop("_by", "_top")


def viewport_pos(lon, lat, min_lon, min_lat, max_lon, max_lat) -> tuple[Column, Column]:
    """(left, top) percent inside padded bounds, kept within 0 to 100; centre if there are no bounds."""
    left = (_c(lon) - min_lon) / F.greatest(max_lon - min_lon, F.lit(1e-6)) * F.lit(100.0)
    top = (max_lat - _c(lat)) / F.greatest(max_lat - min_lat, F.lit(1e-6)) * F.lit(100.0)
    no_bounds = min_lon.isNull()
    return (
        F.when(no_bounds, F.lit(50.0)).otherwise(clip(left, 0.0, 100.0)),
        F.when(no_bounds, F.lit(50.0)).otherwise(clip(top, 0.0, 100.0)),
    )


def one_decimal(x) -> Column:
    return F.when(_c(x).isNotNull() & ~F.isnan(_c(x)), F.format_string("%.1f", _c(x))).otherwise("--")


def area_summary(
    place, air_temp, feels, predicted, risk, outlook, cause1, cause2, best, reduction, year: int = 2030
) -> Column:
    """Readable summary of one location, with fallbacks for whatever is missing."""
    c1, c2 = F.lower(driver_text(cause1)), F.lower(driver_text(cause2))
    causes = F.when(
        _c(cause1).isNotNull(), F.concat_ws(" and ", c1, c2)
    ).otherwise("local built-up and weather conditions")
    action = F.coalesce(F.lower(display_label(best)), F.lit("a cooling intervention"))
    feels_part = F.when(
        _c(feels).isNotNull(), F.concat(F.lit(", feeling like "), one_decimal(feels), F.lit(" °C"))
    ).otherwise("")
    cut = F.greatest(_c(reduction), F.lit(0.0))
    cut_part = F.when(
        _c(reduction).isNotNull(),
        F.concat(
            F.lit(" The strongest cooling option is "), action,
            F.lit(", with an estimated reduction of about "), one_decimal(cut), F.lit(" °C."),
        ),
    ).otherwise("")
    return F.concat(
        F.coalesce(_c(place), F.lit("selected area")), F.lit(" is currently around "), one_decimal(air_temp),
        F.lit(" °C"), feels_part, F.lit(". The local surface heat is estimated near "), one_decimal(predicted),
        F.lit(" °C, giving a "), risk_text(risk), F.lit(f" heat risk. By {year}, if no cooling action is taken, "),
        F.lit("the heat outlook stays around "), one_decimal(F.coalesce(_c(outlook), _c(predicted))),
        F.lit(" °C. The main reasons appear to be "), causes, F.lit("."), cut_part,
    )


def summary_badges(condition, risk, cause1, reduction) -> Column:
    cooling = F.when(
        _c(reduction).isNotNull(),
        F.concat(F.lit("-"), one_decimal(F.greatest(_c(reduction), F.lit(0.0))), F.lit(" °C")),
    ).otherwise("--")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Weather: "), F.coalesce(_c(condition), F.lit("saved local weather"))),
        F.concat(F.lit("Risk: "), risk_text(risk)),
        F.concat(F.lit("Main Cause: "), F.coalesce(F.lower(driver_text(cause1)), F.lit("urban heat conditions"))),
        F.concat(F.lit("Cooling: "), cooling),
    )
