"""Ward assignment, ward aggregates and the heat vulnerability index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.functions.bands import clip
from emberfield.functions.scalars import hvi_class
from emberfield.operators.columns import filter_strict
from emberfield.operators.spatial import nearest_segments, segment_boxes, within_join, placed
from emberfield.functions.geometry import ring_edges
from emberfield.operators.temporal import minmax_norm
from emberfield.scale import cut_lineage

# Index weights.
HVI_WEIGHTS = {"heat": 0.35, "population": 0.25, "age": 0.15, "green_deficit": 0.15, "income_proxy": 0.10}
COMPONENTS = {"H_norm": "heat", "P_norm": "population", "A_norm": "age", "G_norm": "green_deficit", "I_norm": "income_proxy"}


def project_rings(wards: DataFrame, to_plane, rings: str = "rings", out: str = "rings_m") -> DataFrame:
    """Ring points through ``to_plane(lon, lat) -> (x, y)``."""

    def point(p: Column) -> Column:
        x, y = to_plane(p.x, p.y)
        return F.struct(x.alias("x"), y.alias("y"))

    return wards.withColumn(out, F.transform(rings, lambda r: F.transform(r, point)))


def ward_join(
    points: DataFrame,
    wards: DataFrame | None,
    pid: str,
    to_plane,
    predicate: str = "intersects",
    without: str | None = None,
) -> DataFrame:
    """Containing ward, else the nearest ward by planar distance. Adds ward_id, ward_name, ward_join_method
    (within / nearest) and ward_distance_m (0 inside). Without wards the columns are null, the method ``without``
    (the module form says ``none`` there). Rows are told apart by a number of their own, not by ``pid``."""
    if wards is None:
        text = F.lit(None).cast("string")
        return points.withColumns(
            {"ward_id": text, "ward_name": text, "ward_join_method": F.lit(without).cast("string"), "ward_distance_m": F.lit(None).cast("double")}
        )
    joined = cut_lineage(within_join(points, wards, pid, predicate=predicate).withColumn("_own", F.monotonically_increasing_id()))
    misses = joined.filter(F.col("ward_id").isNull() & placed("lon") & placed("lat"))
    x, y = to_plane(F.col("lon"), F.col("lat"))
    segments = segment_boxes(project_rings(wards, to_plane).select("ward_ord", F.inline(ring_edges("rings_m"))))
    near = nearest_segments(misses.select("_own", x.alias("px"), y.alias("py")), segments, "_own", "ward_ord")
    names = wards.select("ward_ord", F.col("ward_id").alias("_wid"), F.col("ward_name").alias("_wname"))
    near = near.join(names, "ward_ord").select("_own", "_wid", "_wname", F.col("dist_m").alias("_d"))
    inside = F.col("ward_id").isNotNull()
    return joined.join(near, "_own", "left").select(
        *points.columns,
        F.coalesce("ward_id", "_wid").alias("ward_id"),
        F.coalesce("ward_name", "_wname").alias("ward_name"),
        F.when(inside, "within").when(F.col("_wid").isNotNull(), "nearest").alias("ward_join_method"),
        F.when(inside, F.lit(0.0)).otherwise(F.col("_d")).alias("ward_distance_m"),
    )


def numeric_columns(df: DataFrame, skip: Sequence[str] = ("lon", "lat", "ward_distance_m")) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def ward_aggregate(df: DataFrame, target: str = "lst_celsius", skip: Sequence[str] = ()) -> DataFrame:
    """Strict rows per ward: mean, max, deviation and count of the target, mean of every other number."""
    cols = [c for c in numeric_columns(df) if c != target and c not in skip]
    keys = [c for c in ("ward_id", "ward_name") if c in df.columns]
    rows = filter_strict(df)
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(
        F.avg(target).alias(target), F.max(target).alias("lst_max"), F.stddev_samp(target).alias("lst_std"),
        F.count(target).alias("grid_count"), *[F.avg(c).alias(c) for c in cols],
    )


def hvi(
    df: DataFrame,
    weights: Mapping[str, float] = HVI_WEIGHTS,
    lst: str = "lst_celsius", pop: str = "pop_density", elderly: str = "elderly_ratio",
    children: str = "children_ratio", ndvi: str = "NDVI_L", ntl: str = "ntl_radiance",
) -> DataFrame:
    """Heat vulnerability index and its five min-max components; all bounds come from one aggregate.

    Absent columns, an all-null night light and null components count as 0.5.
    """
    have = set(df.columns)
    raw: dict[str, Column] = {}
    if lst in have:
        raw["H_norm"] = F.col(lst).cast("double")
    if pop in have:
        p = F.col(pop)
        raw["P_norm"] = F.when(p.isNotNull(), F.log1p(F.greatest(p, F.lit(0.0))))
    ages = [c for c in (elderly, children) if c in have]
    if len(ages) == 2:
        raw["A_norm"] = F.coalesce(ages[0], F.lit(0.0)) + F.coalesce(ages[1], F.lit(0.0))
    elif ages:
        raw["A_norm"] = F.col(ages[0])
    if ndvi in have:
        raw["G_norm"] = F.lit(1.0) - F.coalesce(clip(ndvi, -1.0, 1.0), F.lit(0.0))
    if ntl in have:
        n = F.col(ntl)
        raw["I_norm"] = F.when(n.isNotNull(), F.lit(1.0) / (F.greatest(n, F.lit(0.001)) + F.lit(0.001)))
    out = minmax_norm(df, raw)
    half = F.lit(0.5)
    out = out.withColumns({c: F.coalesce(F.col(c), half) if c in raw else half for c in COMPONENTS})
    score = sum((F.lit(weights[w]) * F.col(c) for c, w in COMPONENTS.items()), F.lit(0.0))
    out = out.withColumn("HVI", clip(score, 0.0, 1.0))
    return out.withColumn("hvi_class", hvi_class("HVI"))


def ward_hvi(df: DataFrame, strict: bool = False, ward: str = "ward_name") -> DataFrame:
    """Ward means, population total and cell count, then the index on ward rows, highest first.

    Without a ward column the index is computed per cell. One grouping does all three aggregates.
    """
    if strict and "ward_join_method" in df.columns:
        df = df.filter(F.col("ward_join_method") == "within")
    if ward not in df.columns:
        return hvi(df)
    cols = numeric_columns(df, skip=("lon", "lat"))
    aggs = [F.avg(c).alias(c) for c in cols]
    if "pop_density" in df.columns:
        aggs.append(F.sum("pop_density").alias("total_population"))
    aggs.append(F.count(F.lit(1)).alias("grid_count"))
    means = df.filter(F.col(ward).isNotNull()).groupBy(ward).agg(*aggs)
    return hvi(cut_lineage(means)).orderBy(F.desc("HVI"), ward)


def ward_merge(df: DataFrame, ward: str = "ward_name") -> DataFrame:
    """Population total and cell count per ward."""
    return df.filter(F.col(ward).isNotNull()).groupBy(ward).agg(
        F.sum("pop_density").alias("total_population"), F.count(F.lit(1)).alias("grid_count")
    )


def ward_features(df: DataFrame) -> DataFrame:
    """Numeric means per ward for planning, with defaults for area, population and HVI where the column is absent."""
    if "ward_join_method" in df.columns:
        df = df.filter(F.col("ward_join_method") == "within")
    keys = [c for c in ("ward_id", "ward_name") if c in df.columns]
    cols = numeric_columns(df, skip=())
    out = df.filter(F.col("ward_id").isNotNull()).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
    defaults = {"area_m2": 10_000.0, "pop_density": 1.0, "HVI": 0.5}
    return out.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in out.columns})


def hvi_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("hvi_class").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("HVI").alias("mean_hvi"), F.max("HVI").alias("max_hvi")
    )


def top_vulnerable_wards(df: DataFrame, n: int = 10, ward: str = "ward_name") -> DataFrame:
    return df.orderBy(F.desc("HVI"), ward).limit(n)
