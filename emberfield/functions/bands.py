"""Band algebra, surface temperature and weather formulas as Column functions (JVM-side, codegen)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
# Broadband albedo weights (blue, red, nir, swir1, swir2) and offset.
ALBEDO_WEIGHTS = (0.356, 0.130, 0.373, 0.085, 0.072)
ALBEDO_OFFSET = 0.0018
# Scene classes hidden by the Sentinel mask.
CLOUD_CLASSES = (3, 8, 9, 10)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x) -> Column:
    """NaN counts as missing: Spark orders NaN above every number, so it must not get past ingest."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def clip(x, lo: float, hi: float) -> Column:
    """Null stays null (``least``/``greatest`` alone would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def norm_diff(a, b, eps: float | None = EPS) -> Column:
    a, b = _c(a), _c(b)
    if eps is None:
        return F.try_divide(a - b, a + b)
    return (a - b) / (a + b + F.lit(eps))


def ndvi(nir, red, eps: float | None = EPS) -> Column:
    return norm_diff(nir, red, eps)


def ndwi(green, nir, eps: float | None = EPS) -> Column:
    return norm_diff(green, nir, eps)


def mndwi(green, swir1, eps: float | None = EPS) -> Column:
    return norm_diff(green, swir1, eps)


def ndbi(swir1, nir, eps: float | None = EPS) -> Column:
    return norm_diff(swir1, nir, eps)


def evi(nir, red, third, variant: str = "blue") -> Column:
    """Enhanced vegetation index; ``third`` is blue, or SWIR1 for the raster variant (which has no epsilon)."""
    nir, red, third = _c(nir), _c(red), _c(third)
    top = F.lit(2.5) * (nir - red)
    base = nir + F.lit(6.0) * red - F.lit(7.5) * third + F.lit(1.0)
    return F.try_divide(top, base) if variant == "swir1" else F.try_divide(top, base + F.lit(EPS))


def savi(nir, red, eps: float = EPS) -> Column:
    nir, red = _c(nir), _c(red)
    return F.lit(1.5) * (nir - red) / (nir + red + F.lit(0.5) + F.lit(eps))


def nbi(red, swir1, nir, eps: float = EPS) -> Column:
    return F.try_divide(_c(red) * _c(swir1), _c(nir) + F.lit(eps))


def albedo(blue, red, nir, swir1, swir2) -> Column:
    """Null unless all five bands are there."""
    terms = [F.lit(w) * _c(b) for w, b in zip(ALBEDO_WEIGHTS, (blue, red, nir, swir1, swir2))]
    return clip(reduce(lambda p, q: p + q, terms) - F.lit(ALBEDO_OFFSET), 0.0, 1.0)


def qa_mask(qa) -> Column:
    """Clear pixel: quality bits 1 to 4 all zero."""
    return _c(qa).bitwiseAND(0b11110) == 0


def scale_sr(dn) -> Column:
    return _c(dn) * F.lit(2.75e-5) + F.lit(-0.2)


def scale_st(dn) -> Column:
    return _c(dn) * F.lit(0.00341802) + F.lit(149.0)


def s2_good(cloud_prob, scene_class) -> Column:
    return (_c(cloud_prob) < 20) & ~_c(scene_class).isin(*CLOUD_CLASSES)


def s2_reflectance(dn) -> Column:
    return _c(dn) / F.lit(10000.0)


def emissivity(red, nir) -> Column:
    index = clip(norm_diff(nir, red, None), 0.2, 0.5)
    cover = (index - F.lit(0.2)) / F.lit(0.3)
    return F.lit(0.986) + F.lit(0.004) * cover * cover


def lst_from_bt(brightness_k, em) -> Column:
    tb = _c(brightness_k)
    return tb / (F.lit(1.0) + F.lit(0.000796) * tb * F.ln(_c(em))) - F.lit(273.15)


def wind_speed(u, v) -> Column:
    u, v = _c(u), _c(v)
    return F.sqrt(u * u + v * v)


def rel_humidity(temp_k, dew_k) -> Column:
    def magnus(k: Column) -> Column:
        c = k - F.lit(273.15)
        return F.exp(F.lit(17.625) * c / (c + F.lit(243.04)))

    return F.lit(100.0) * magnus(_c(dew_k)) / magnus(_c(temp_k))


def kelvin_to_celsius(k) -> Column:
    return _c(k) - F.lit(273.15)


def metres_to_mm(m) -> Column:
    return _c(m) * F.lit(1000.0)


def joules_day_to_watts(j) -> Column:
    return _c(j) / F.lit(86400.0)


def age_ratio(selected: Sequence, everyone: Sequence) -> Column:
    """Share of the selected age bands among all of them."""
    total = lambda cols: reduce(lambda p, q: p + q, [_c(c) for c in cols])
    return clip(total(selected) / (total(everyone) + F.lit(1e-6)), 0.0, 1.0)


def impervious_ratio(building, road, variant: str = "main") -> Column:
    """``main``: nulls as 0, 3 % per unit of road density; ``module``: 15 % of road density capped at 1."""
    b, r = _c(building), _c(road)
    if variant == "main":
        return clip(F.coalesce(b, F.lit(0.0)) + F.lit(0.03) * F.coalesce(r, F.lit(0.0)), 0.0, 1.0)
    return clip(b + F.lit(0.15) * clip(r, 0.0, 1.0), 0.0, 1.0)
