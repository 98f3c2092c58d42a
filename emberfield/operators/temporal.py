"""Lags, trends, hotspot labels, normalisation and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.scale import cut_lineage, hash_cuts, hash_order, hash_uniform, in_hash_order, number_rows, scalar_struct, ship_if_small, split_series

SEASONS = 4
TREND_ROWS = 20
TREND_MIN = 10


def _vegetation(df: DataFrame, name: str) -> str | None:
    return next((c for c in (name, f"{name}_L") if c in df.columns), None)


def lag_years(col: str, years: int, window: Window) -> Column:
    """Value ``years`` x 4 rows earlier (rows, not dates: one row per season is expected)."""
    return F.lag(col, years * SEASONS).over(window)


def rolling_trend(col: str, position: str, window: Window, rows: int = TREND_ROWS, least: int = TREND_MIN) -> Column:
    """Least-squares slope per step over the last ``rows`` rows; null with fewer than ``least`` values."""
    w = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(col).over(w) >= least, F.regr_slope(F.col(col), F.col(position).cast("double")).over(w))


def change_over(col: str, rows: int, window: Window) -> Column:
    return F.col(col) - F.lag(col, rows).over(window)


def temporal_features(
    df: DataFrame,
    key: str = "grid_id",
    order: Sequence[str] = ("date",),
    lags: Sequence[int] = (1, 2, 5),
    group_rows: int | None = None,
) -> DataFrame:
    """Lags of 1, 2 and 5 years, 20-row trends and 20-row change per cell history.

    All windows share one partitioning and order, so there is one shuffle and one sort. Histories longer than a
    task's share are cut into chunks that bring the 20 rows they look back on.
    """
    back = max(TREND_ROWS, max(lags) * SEASONS)
    limits = {} if group_rows is None else {"group_rows": group_rows}
    chunked = split_series(df, key, order, back, **limits)
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    new: dict[str, Column] = {}
    for y in lags:
        new[f"lst_lag_{y}yr"] = lag_years("lst_celsius", y, w)
    ndvi, ndbi = _vegetation(df, "NDVI"), _vegetation(df, "NDBI")
    if ndvi:
        for y in lags:
            new[f"ndvi_lag_{y}yr"] = lag_years(ndvi, y, w)
    new["lst_trend_5yr"] = rolling_trend("lst_celsius", "_pos", w)
    if ndvi:
        new["ndvi_trend_5yr"] = rolling_trend(ndvi, "_pos", w)
    if ndbi:
        new["ndbi_change_5yr"] = change_over(ndbi, TREND_ROWS, w)
    placed = chunked.withColumn("_pos", F.row_number().over(w))
    return placed.withColumns(new).filter(~F.col("_warm")).drop("_chunk", "_warm", "_pos")


def _over_two_sigma(mean: Column, std: Column, col: str = "lst_celsius") -> Column:
    return F.coalesce((F.col(col) > mean + F.lit(2.0) * std).cast("int"), F.lit(0))


def city_stats(df: DataFrame, by: str = "date", col: str = "lst_celsius") -> DataFrame:
    return df.groupBy(by).agg(F.avg(col).alias("city_mean"), F.stddev_samp(col).alias("city_std"))


def join_city_stats(df: DataFrame, by: str = "date", col: str = "lst_celsius") -> DataFrame:
    """Per-date mean and deviation next to each row. Aggregate and join rather than a window: a date may hold a
    third of all rows. The aggregate is combined before its shuffle and broadcast while it has few dates."""
    return df.join(ship_if_small(cut_lineage(city_stats(df, by, col))), by, "left")


def hotspot_label(df: DataFrame, by: str | None = "date", col: str = "lst_celsius") -> DataFrame:
    """1 where the value is above mean + 2 sample deviations of its date (or of the whole table)."""
    if by is not None:
        joined = join_city_stats(df, by, col)
        return joined.withColumn(
            "hotspot_label", _over_two_sigma(F.col("city_mean"), F.col("city_std"), col)
        ).drop("city_mean", "city_std")
    g = scalar_struct(df, {"m": F.avg(col), "s": F.stddev_samp(col)})
    return df.withColumn("hotspot_label", _over_two_sigma(g["m"], g["s"], col))


def lst_anomaly(df: DataFrame, col: str = "lst_celsius") -> DataFrame:
    g = scalar_struct(df, {"m": F.avg(col)})
    return df.withColumn("lst_anomaly", F.col(col) - g["m"])


def _gauss(ids: Sequence[str], salt: str, sigma: float) -> Column:
    """Reproducible normal noise: Box-Muller on two hashed uniforms."""
    u = F.lit(1.0) - hash_uniform(list(ids), salt + ":u")
    v = hash_uniform(list(ids), salt + ":v")
    return F.lit(sigma) * F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)


def proxy_lags(
    df: DataFrame, lags: Sequence[int] = (1, 2, 5), noise: bool = False, seed: int = 42, ids: Sequence[str] = ("grid_id",)
) -> DataFrame:
    """Stand-ins for temporal features on single-date data. They contain the target (models fitted on them look
    better than they are); noise is off by default and seeded when on."""
    ndvi = "NDVI_L" if "NDVI_L" in df.columns else "NDVI"
    ndbi = "NDBI_L" if "NDBI_L" in df.columns else "NDBI"
    have_v, have_b = ndvi in df.columns, ndbi in df.columns
    stats = {"m": F.avg("lst_celsius"), "s": F.stddev_samp("lst_celsius")}
    if have_v:
        stats["v"] = F.avg(ndvi)
    g = scalar_struct(df, stats)
    anomaly = F.col("lst_celsius") - g["m"]
    new = {"lst_anomaly": anomaly, "lst_trend_5yr": anomaly * F.lit(0.1)}
    if have_v:
        new["ndvi_trend_5yr"] = (F.col(ndvi) - g["v"]) * F.lit(0.05)
    if have_b:
        new["ndbi_change_5yr"] = F.col(ndbi) * F.lit(0.03)
    for y in lags:
        new[f"lst_lag_{y}yr"] = F.col("lst_celsius") + (_gauss(ids, f"{seed}:lst:{y}", 0.5) if noise else F.lit(0.0))
        if have_v:
            new[f"ndvi_lag_{y}yr"] = F.col(ndvi) + (_gauss(ids, f"{seed}:ndvi:{y}", 0.02) if noise else F.lit(0.0))
    new["hotspot_label"] = _over_two_sigma(g["m"], g["s"])
    return df.withColumns(new)


def minmax_norm(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """(x - min) / (max - min) for each named expression, all from one aggregate; a constant becomes 0."""
    aggs: dict[str, Column] = {}
    for n, e in exprs.items():
        aggs[f"{n}_lo"], aggs[f"{n}_hi"] = F.min(e), F.max(e)
    g = scalar_struct(df, aggs)
    new = {}
    for n, e in exprs.items():
        lo, hi = g[f"{n}_lo"], g[f"{n}_hi"]
        new[n] = F.when(e.isNull(), F.lit(None)).when(hi == lo, F.lit(0.0)).otherwise((e - lo) / (hi - lo))
    return df.withColumns(new)


def train_val_test_split(
    df: DataFrame,
    ids: Sequence[str],
    parts: tuple[float, float, float] = (0.8, 0.1, 0.1),
    seed: int = 42,
    stratify: str | None = None,
) -> DataFrame:
    """Add ``split`` (train, val, test): disjoint parts of exact size, in seeded hash order, per class if asked.

    Without classes the cut points are found by radix counting on the hash, so the table is neither sorted nor
    shuffled. With classes, of any number, one range shuffle numbers the rows of all of them at once; a null is a class.
    """
    if min(parts) < 0 or parts[0] <= 0 or abs(sum(parts) - 1.0) > 1e-9:
        raise ValueError("split shares must be positive and sum to 1")
    if stratify is not None:
        known = df.withColumns({"_class": F.to_json(F.struct(stratify)), "_hash": hash_order(ids, seed)})
        sizes = cut_lineage(known.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")))
        ranked = number_rows(known, ["_class"], ["_hash", *ids]).join(ship_if_small(sizes), "_class")
        upto = lambda share: F.floor(F.col("_n") * F.lit(share) + F.lit(1e-9))
        name = F.when(F.col("_rn") <= upto(parts[0]), "train").when(F.col("_rn") <= upto(parts[0] + parts[1]), "val").otherwise("test")
        return ranked.withColumn("split", name).select(*df.columns, "split")
    hashed = cut_lineage(df.withColumn("_h", hash_order(ids, seed)))
    n = hashed.count()
    cuts = hash_cuts(hashed.select("_h"), [math.floor(n * share + 1e-9) for share in (parts[0], parts[0] + parts[1])])
    to_train, to_val = (F.lit(True) if c is None else F.col("_h") <= F.lit(c) for c in cuts)
    return hashed.withColumn("split", F.when(to_train, "train").when(to_val, "val").otherwise("test")).drop("_h")


def sample_rows(df: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in seeded hash order (all rows if there are fewer); a filter, not a sort. The input is
    computed once and written."""
    held, (first,) = in_hash_order(df, ids, seed, [n])
    return held.filter(first).drop("_h")
