"""Raster work as relational jobs on pixel tables: one row per scene and pixel, one column per band."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions import bands as B
from emberfield.functions.geometry import parts_area
from emberfield.operators.columns import with_grid_id
from emberfield.scale import GROUP_ROWS, exact_percentiles, in_hash_order, scalar_struct, ship_package

PIXEL = ("px", "py")


def scene_filter(
    obs: DataFrame, start: str, end: str, max_cloud: float | None = None, box: tuple | None = None
) -> DataFrame:
    """Dates in [start, end), cloud cover strictly below the limit, pixels inside the box (x0, y0, x1, y1).

    Plain comparisons of stored columns with literals of the same type, so they reach the file scan (and prune
    date partitions).
    """
    kind = obs.schema["ts"].dataType
    out = obs.filter((F.col("ts") >= F.lit(start).cast(kind)) & (F.col("ts") < F.lit(end).cast(kind)))
    if max_cloud is not None:
        out = out.filter(F.col("cloud_cover") < max_cloud)
    if box is not None:
        out = out.filter(F.col("px").between(box[0], box[2]) & F.col("py").between(box[1], box[3]))
    return out


def season_filter(obs: DataFrame, first_month: int, last_month: int) -> DataFrame:
    """Inclusive month range; wraps over the new year when the first month is the later one."""
    m = F.month("ts")
    if first_month <= last_month:
        return obs.filter(m.between(first_month, last_month))
    return obs.filter((m >= first_month) | (m <= last_month))


def merge_collections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two collections; order is a matter of output, not of the plan."""
    return a.unionByName(b, allowMissingColumns=True)


def join_first(primary: DataFrame, secondary: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Attach the first match of the secondary collection; primaries without a match are dropped."""
    rest = [c for c in secondary.columns if c not in (key, *order)]
    first = secondary.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_s"))
    return primary.join(first, key).select(*primary.columns, *[F.col(f"_s.{c}").alias(c) for c in rest])


def mask(obs: DataFrame, clear: Column, bands: Sequence[str]) -> DataFrame:
    """Masked pixels keep their row; their bands become null."""
    return obs.withColumns({b: F.when(clear, F.col(b)) for b in bands})


REDUCERS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def composite(
    obs: DataFrame,
    bands: Sequence[str] | Mapping[str, str],
    reducer: str = "median",
    keys: Sequence[str] = PIXEL,
    group_rows: int = GROUP_ROWS,
    known_group_rows: int | None = None,
) -> DataFrame:
    """Per-pixel, per-band reduction over time, nulls ignored. ``bands``: names, or output -> input names.

    The exact median goes through ``exact_percentiles``: ordinary pixels in one aggregate, pixels with a very
    long stack by narrowing. ``median_approx`` keeps a bounded sketch for exploratory work.
    """
    names = dict(bands) if isinstance(bands, Mapping) else {b: b for b in bands}
    if reducer == "median":
        wanted = {out: (src, 0.5) for out, src in names.items()}
        return exact_percentiles(obs, keys, wanted, group_rows, known_group_rows)
    if reducer == "median_approx":
        return obs.groupBy(*keys).agg(*[F.percentile_approx(s, 0.5, 10_000).alias(o) for o, s in names.items()])
    fn = REDUCERS[reducer]
    return obs.groupBy(*keys).agg(*[fn(s).alias(o) for o, s in names.items()])


SURFACE_BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")


def with_reflectance(obs: DataFrame) -> DataFrame:
    """Scale raw numbers and hide clouded pixels: the surface bands that are there (reflectance) and bt_k (kelvin)."""
    bands = [b for b in SURFACE_BANDS if f"dn_{b}" in obs.columns]
    out = obs.withColumns({**{b: B.scale_sr(f"dn_{b}") for b in bands}, "bt_k": B.scale_st("dn_st")})
    return mask(out, B.qa_mask("qa"), [*bands, "bt_k"])


def raster_indices(suffix: str) -> dict[str, Column]:
    """The seven indices of a composite's bands, in the raster's own forms (no epsilon, vegetation index over SWIR1)."""
    nir, red = F.col("nir"), F.col("red")
    out = {
        "NDVI": B.ndvi("nir", "red", None), "NDWI": B.ndwi("green", "nir", None), "MNDWI": B.mndwi("green", "swir1", None),
        "NDBI": B.ndbi("swir1", "nir", None), "EVI": B.evi("nir", "red", "swir1", "swir1"),
        "SAVI": F.try_divide((nir - red) * F.lit(1.5), nir + red + F.lit(0.5)), "NBI": F.try_divide(red * F.col("swir1"), nir),
    }
    return {f"{k}_{suffix}": v for k, v in out.items()}


def sentinel_composite(scenes: DataFrame, clouds: DataFrame, key: str = "scene_id", keys: Sequence[str] = PIXEL, **limits) -> DataFrame:
    """Cloud-probability link, mask, scale, median per pixel, seven indices: S2_Blue ... S2_SWIR2 and NDVI_S2 ... NBI_S2.

    ``scenes`` has dn_blue ... dn_swir2 and ``scene_class``, ``clouds`` the key and ``probability`` (of several the least
    counts). A scene without a cloud probability is dropped, as in an inner link.
    """
    linked = scenes.join(clouds.groupBy(key).agg(F.min("probability").alias("probability")), key)
    scaled = linked.withColumns({b: B.s2_reflectance(f"dn_{b}") for b in SURFACE_BANDS})
    clear = mask(scaled, B.s2_good("probability", "scene_class"), SURFACE_BANDS)
    image = composite(clear, SURFACE_BANDS, keys=keys, **limits)
    names = dict(zip(SURFACE_BANDS, ("S2_Blue", "S2_Green", "S2_Red", "S2_NIR", "S2_SWIR1", "S2_SWIR2"), strict=True))
    return image.withColumns(raster_indices("S2")).withColumnsRenamed(names)


def landsat_composite(obs: DataFrame, **limits) -> DataFrame:
    """Median bands L_Blue ... L_SWIR2, surface temperature and emissivity (per scene first), seven indices and albedo."""
    scenes = with_reflectance(obs).withColumn("emissivity", B.emissivity("red", "nir"))
    scenes = scenes.withColumn("lst_celsius", B.lst_from_bt("bt_k", "emissivity"))
    image = composite(scenes, ["lst_celsius", "emissivity", *SURFACE_BANDS], **limits)
    names = dict(zip(SURFACE_BANDS, ("L_Blue", "L_Green", "L_Red", "L_NIR", "L_SWIR1", "L_SWIR2"), strict=True))
    return image.withColumns({**raster_indices("L"), "albedo": B.albedo("blue", "red", "nir", "swir1", "swir2")}).withColumnsRenamed(names)


def lst_stack(obs: DataFrame, **limits) -> DataFrame:
    """Surface temperature per scene first, then the median over time: the formula is not linear."""
    scenes = with_reflectance(obs).withColumn("emissivity", B.emissivity("red", "nir"))
    scenes = scenes.withColumn("lst_celsius", B.lst_from_bt("bt_k", "emissivity"))
    return composite(scenes, ["lst_celsius", "emissivity"], **limits)


def weather_summary(obs: DataFrame, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Mean, max and min temperature, rain total, mean wind and humidity per pixel."""
    rain = F.sum(B.metres_to_mm("rain_m")) if "rain_m" in obs.columns else None
    aggs = {
        "air_temp_C": F.avg(B.kelvin_to_celsius("t2m_k")),
        "air_temp_C_max": F.max(B.kelvin_to_celsius("t2m_k")),
        "air_temp_C_min": F.min(B.kelvin_to_celsius("t2m_k")),
        "wind_speed": F.avg(B.wind_speed("u10", "v10")),
        "humidity_pct": F.avg(B.rel_humidity("t2m_k", "td_k")),
    }
    if rain is not None:
        aggs["rainfall_mm"] = rain
    return obs.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def solar_summary(obs: DataFrame, col: str = "solar_j", keys: Sequence[str] = PIXEL) -> DataFrame:
    """Mean radiation in W per square metre: whole year, hot season (3-5), monsoon (6-9); one pass."""
    watts, m = B.joules_day_to_watts(col), F.month("ts")
    return obs.groupBy(*keys).agg(
        F.avg(watts).alias("solar_rad_W_m2"),
        F.avg(F.when(m.between(3, 5), watts)).alias("solar_hot"),
        F.avg(F.when(m.between(6, 9), watts)).alias("solar_monsoon"),
    )


def select_first(collection: DataFrame, equals: Mapping[str, object], order: Sequence[str], keys: Sequence[str] = PIXEL) -> DataFrame:
    """Equality filters, then the first image in time order per pixel."""
    kept = reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), equals.items(), collection)
    rest = [c for c in collection.columns if c not in (*keys, *order)]
    first = kept.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


# --------------------------------------------------------------------------------------------------
# neighbourhoods
# --------------------------------------------------------------------------------------------------

TILE = 256


def neighbour_sums(
    dem: DataFrame, offsets: Mapping[tuple[int, int], Mapping[str, float]], names: Sequence[str], value: str, halo: int
) -> DataFrame:
    """Weighted sums over fixed pixel offsets. ``offsets``: (dx, dy) -> weight per output name.

    Pixels are shuffled once, into square tiles with a rim of ``halo`` pixels (rim pixels go to the neighbour
    tiles too). Inside its tile every pixel then adds its weighted value to the pixels around it; that aggregate
    reuses the tile partitioning, so the many-fold expansion is never shuffled.
    """

    def tiles(v: str) -> Column:
        lo = F.floor((F.col(v) - halo) / F.lit(TILE))
        hi = F.floor((F.col(v) + halo) / F.lit(TILE))
        return F.sequence(lo, hi)

    spread = dem.select("px", "py", F.col(value).alias("_v"), F.explode(tiles("px")).alias("tx"), tiles("py").alias("_ty"))
    spread = spread.select("px", "py", "_v", "tx", F.explode("_ty").alias("ty")).repartition("tx", "ty")
    steps = F.array(
        *[
            F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), *[F.lit(float(w.get(n, 0.0))).alias(n) for n in names])
            for (dx, dy), w in offsets.items()
        ]
    )
    # the receiving pixel is the one that sees this pixel at offset (dx, dy)
    sent = spread.select("tx", "ty", "px", "py", "_v", F.inline(steps)).select(
        "tx", "ty", (F.col("px") - F.col("dx")).alias("px"), (F.col("py") - F.col("dy")).alias("py"), "_v",
        "dx", "dy", *names,
    )
    home = (F.floor(F.col("px") / F.lit(TILE)) == F.col("tx")) & (F.floor(F.col("py") / F.lit(TILE)) == F.col("ty"))
    own = (F.col("dx") == 0) & (F.col("dy") == 0)
    return (
        sent.filter(home)
        .groupBy("tx", "ty", "px", "py")
        .agg(
            F.max(F.when(own, F.col("_v"))).alias(value),
            F.count("_v").alias("neighbours"),
            F.max(own).alias("_here"),
            *[F.sum(F.col("_v") * F.col(n)).alias(n) for n in names],
        )
        .filter("_here")
        .drop("tx", "ty", "_here")
    )


def disk_sums_of_tile(tile: pd.DataFrame, k: int, half: Sequence[int], value: str, tx: int, ty: int) -> pd.DataFrame:
    """Sum and number of the values in the disk around each of the tile's own pixels, by running sums along the rows.

    ``half[d]`` is the disk's half width d rows off its centre, so a disk is 2k + 1 differences of running sums.
    """
    side = TILE + 2 * k
    x = (tile["px"] - (tx * TILE - k)).to_numpy()
    y = (tile["py"] - (ty * TILE - k)).to_numpy()
    base = tile[value].mean()  # keeps the running sums small
    grid, known = np.zeros((side, side + 1)), np.zeros((side, side + 1), dtype=np.int64)
    np.add.at(grid, (y, x + 1), tile[value].to_numpy() - base)
    np.add.at(known, (y, x + 1), 1)
    grid, known = grid.cumsum(axis=1), known.cumsum(axis=1)
    own = (x >= k) & (x < k + TILE) & (y >= k) & (y < k + TILE)
    x, y, rows = x[own], y[own], tile[own]
    total, count = np.zeros(len(x)), np.zeros(len(x), dtype=np.int64)
    for d in range(-k, k + 1):
        w = half[abs(d)]
        total += grid[y + d, x + w + 1] - grid[y + d, x - w]
        count += known[y + d, x + w + 1] - known[y + d, x - w]
    return pd.DataFrame({"px": rows["px"], "py": rows["py"], value: rows[value], "_mean": base + total / count})


def terrain_tpi(dem: DataFrame, radius_m: float = 500.0, pixel_m: float = 100.0, value: str = "elevation") -> DataFrame:
    """Elevation minus the mean of the pixels within the radius (the pixel itself included).

    Pixels are shuffled once, into square tiles with a rim; a tile's task takes each disk from running sums, so the
    work per pixel follows the disk's height and no row is multiplied beyond the rim. A pixel listed twice counts twice.
    """
    k = int(radius_m // pixel_m)
    half = [max(w for w in range(k + 1) if (w * w + d * d) * pixel_m * pixel_m <= radius_m * radius_m) for d in range(k + 1)]
    ship_package(dem.sparkSession)

    def tiles(v: str) -> Column:
        return F.sequence(F.floor((F.col(v) - k) / F.lit(TILE)), F.floor((F.col(v) + k) / F.lit(TILE)))

    def means(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        return disk_sums_of_tile(tile, k, half, value, int(key[0]), int(key[1]))

    known = dem.filter(F.col(value).isNotNull()).select(F.col("px").cast("long"), F.col("py").cast("long"), F.col(value).cast("double").alias(value))
    spread = known.withColumn("tx", F.explode(tiles("px"))).withColumn("ty", F.explode(tiles("py")))
    out = spread.groupBy("tx", "ty").applyInPandas(means, f"px long, py long, {value} double, _mean double")
    kinds = dict(dem.dtypes)
    return out.select(F.col("px").cast(kinds["px"]), F.col("py").cast(kinds["py"]), value, (F.col(value) - F.col("_mean")).alias("tpi"))


def slope_aspect(dem: DataFrame, pixel_m: float = 100.0, value: str = "elevation", az: float = 315.0, alt: float = 45.0) -> DataFrame:
    """Slope and aspect in degrees and hillshade (0-255) from the 3x3 Horn gradient; null at the rim.

    y grows northward. Aspect is the compass direction the slope faces.
    """
    around = {}
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            around[(dx, dy)] = {
                "gx": dx * (2.0 if dy == 0 else 1.0),
                "gy": dy * (2.0 if dx == 0 else 1.0),
            }
    g = neighbour_sums(dem.filter(F.col(value).isNotNull()), around, ["gx", "gy"], value, 1)
    p, q = F.col("gx") / F.lit(8.0 * pixel_m), F.col("gy") / F.lit(8.0 * pixel_m)
    whole = F.col("neighbours") == 9
    slope = F.atan(F.sqrt(p * p + q * q))
    facing = F.pmod(F.degrees(F.atan2(-p, -q)) + F.lit(360.0), F.lit(360.0))
    zen, azr = F.radians(F.lit(90.0 - alt)), F.radians(F.lit(az))
    shade = F.cos(zen) * F.cos(slope) + F.sin(zen) * F.sin(slope) * F.cos(azr - F.radians(facing))
    return g.select(
        "px", "py",
        F.when(whole, F.degrees(slope)).alias("slope_deg"),
        F.when(whole & ((p != 0) | (q != 0)), facing).alias("aspect_deg"),
        F.when(whole, F.greatest(F.lit(0.0), shade) * F.lit(255.0)).alias("hillshade"),
    )


def resample_bilinear(coarse: DataFrame, fine: DataFrame, value: str, ratio: float) -> DataFrame:
    """Bilinear value of the coarse grid at fine pixel centres; null where one of the four corners is absent.

    ``ratio`` fine pixels make one coarse pixel. Coarse pixels are first gathered into the quads they are a
    corner of (four values each), so that the fine table is joined once.
    """
    corner = F.array(
        *[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]
    )
    c = coarse.select("px", "py", F.col(value).alias("_v"), F.inline(corner))
    quads = c.groupBy((F.col("px") - F.col("dx")).alias("qx"), (F.col("py") - F.col("dy")).alias("qy")).agg(
        *[
            F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("_v"))).alias(f"v{dx}{dy}")
            for dx in (0, 1)
            for dy in (0, 1)
        ]
    )
    at = lambda v: (F.col(v) + F.lit(0.5)) / F.lit(float(ratio)) - F.lit(0.5)
    f = fine.withColumns({"_gx": at("px"), "_gy": at("py")})
    f = f.withColumns({"qx": F.floor("_gx"), "qy": F.floor("_gy")})
    kx, ky = F.col("_gx") - F.col("qx"), F.col("_gy") - F.col("qy")
    one = F.lit(1.0)
    mix = (
        F.col("v00") * (one - kx) * (one - ky) + F.col("v10") * kx * (one - ky)
        + F.col("v01") * (one - kx) * ky + F.col("v11") * kx * ky
    )
    return f.join(quads, ["qx", "qy"], "left").select(*fine.columns, mix.alias(value))


# --------------------------------------------------------------------------------------------------
# stacks, samples, statistics
# --------------------------------------------------------------------------------------------------


def change(later: DataFrame, earlier: DataFrame, value: str, out: str = "change", keys: Sequence[str] = PIXEL) -> DataFrame:
    a = later.select(*keys, F.col(value).alias("_a"))
    b = earlier.select(*keys, F.col(value).alias("_b"))
    return a.join(b, list(keys)).select(*keys, (F.col("_a") - F.col("_b")).alias(out))


def band_stack(*images: DataFrame, keys: Sequence[str] = PIXEL, how: str = "inner") -> DataFrame:
    """Side-by-side bands on the pixel key. All joins hash on the same key, so each image is shuffled once."""
    return reduce(lambda a, b: a.join(b, list(keys), how), images)


def sample_pixels(image: DataFrame, n: int, seed: int = 42, keys: Sequence[str] = PIXEL) -> DataFrame:
    """``n`` pixels in seeded hash order after dropping incomplete ones. The image is computed once and written."""
    held, (first,) = in_hash_order(image.na.drop("any"), keys, seed, [n])
    return held.filter(first).drop("_h")


def attach_coords(
    samples: DataFrame, lon0: float, lat0: float, step: float, year: int = 2023, season: str = "hot_MAM",
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    out = samples.withColumns(
        {
            "lon": F.lit(lon0) + F.col("px") * F.lit(step),
            "lat": F.lit(lat0) + F.col("py") * F.lit(step),
            "year": F.lit(str(year)),
            "season": F.lit(season),
        }
    )
    if start is not None:
        out = out.withColumns({"start_date": F.lit(start), "end_date": F.lit(end)})
    return with_grid_id(out)


def hot_season_table(obs: DataFrame, shared: DataFrame | None, n: int, seed: int = 42, **limits) -> DataFrame:
    """The hot-season sample: months 3 to 5, temperature and emissivity per scene, then medians; four indices and the albedo
    of the composite; the bands of ``shared`` beside them. Incomplete pixels are dropped, ``n`` // 2 are sampled, and of
    these only rows with temperature, vegetation index and (where it is among the bands) hot-season radiation count.
    """
    image = landsat_composite(season_filter(obs, 3, 5), **limits)
    image = image.select(*PIXEL, "lst_celsius", "emissivity", "NDVI_L", "NDBI_L", "MNDWI_L", "EVI_L", "albedo")
    if shared is not None:
        image = band_stack(image, shared)
    needed = [c for c in ("lst_celsius", "NDVI_L", "solar_hot_W_m2") if c in image.columns]
    return sample_pixels(image, n // 2, seed + 1).na.drop("any", subset=needed)


def base_stack(obs: DataFrame, scenes: DataFrame, clouds: DataFrame, shared: DataFrame | None, n: int, place: tuple[float, float, float], seed: int = 42, **limits) -> DataFrame:
    """From scenes to the sampled cell table: Landsat and Sentinel composites with their indices, the shared bands, a
    sample of ``n`` complete pixels, and coordinates from (lon0, lat0, step)."""
    image = band_stack(landsat_composite(obs, **limits), sentinel_composite(scenes, clouds, **limits))
    if shared is not None:
        image = band_stack(image, shared)
    return attach_coords(sample_pixels(image, n, seed), *place, season="annual")


def region_stats(image: DataFrame, col: str, sketches: DataFrame | None = None) -> DataFrame:
    """min, max, percentiles 25/50/75/95 and sum over the region in one row."""
    ps = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    q = exact_percentiles(image, [], {n: (col, p) for n, p in ps.items()}, sketches=sketches)
    g = scalar_struct(q, {n: F.first(n) for n in ps})
    return image.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.sum(col).alias("sum")).withColumns(
        {n: g[n] for n in ps}
    )


def aoi(admin: DataFrame, where: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Study polygons chosen by attributes (one value or several), with their area in square kilometres (rings in metres)."""
    chosen = {c: [v] if isinstance(v, str) else list(v) for c, v in where.items()}
    picked = reduce(lambda d, kv: d.filter(F.col(kv[0]).isin(kv[1])), chosen.items(), admin)
    return picked.withColumn("area_km2", parts_area("rings") / F.lit(1e6))


def plausible_lst(obs: DataFrame, kelvin: str = "lst_k", qc: str = "qc", **limits) -> DataFrame:
    """Kelvin to Celsius, kept only strictly between 5 and 65 with a quality flag; median per pixel and day."""
    c = B.kelvin_to_celsius(kelvin)
    ok = (c > 5) & (c < 65) & F.col(qc).isNotNull()
    scenes = obs.withColumns({"lst_celsius": F.when(ok, c), "date": F.date_format("ts", "yyyy-MM-dd")})
    return composite(scenes, ["lst_celsius"], keys=(*PIXEL, "date"), **limits)
