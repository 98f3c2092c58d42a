"""Summaries, model metrics, inequality, top-k and row utilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.scale import GROUP_ROWS, cut_lineage, exact_percentiles, number_rows, scalar_struct, ship_if_small


def describe(df: DataFrame, col: str = "lst_celsius", sketches: DataFrame | None = None, **limits) -> DataFrame:
    """count, mean, std, min, quartiles, max in one row; kept ``sketches`` of the column save a pass over large tables."""
    quart = exact_percentiles(df, [], {"q25": (col, 0.25), "q50": (col, 0.5), "q75": (col, 0.75)}, sketches=sketches, **limits)
    g = scalar_struct(quart, {c: F.first(c) for c in ("q25", "q50", "q75")})
    base = df.agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    return base.withColumns({c: g[c] for c in ("q25", "q50", "q75")})


def city_summary(df: DataFrame, col: str = "lst_celsius") -> DataFrame:
    return df.agg(
        F.min(col).alias("lst_min"), F.max(col).alias("lst_max"), F.avg(col).alias("lst_mean"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def distance_summary(df: DataFrame) -> DataFrame:
    """Median, 95th percentile and maximum of the nearest-ward fallback distance."""
    near = df.filter(F.col("ward_join_method") == "nearest")
    p = exact_percentiles(near, [], {"median_m": ("ward_distance_m", 0.5), "p95_m": ("ward_distance_m", 0.95)})
    g = scalar_struct(p, {c: F.first(c) for c in ("median_m", "p95_m")})
    return near.agg(F.count(F.lit(1)).alias("nearest_rows"), F.max("ward_distance_m").alias("max_m")).withColumns(
        {c: g[c] for c in ("median_m", "p95_m")}
    )


def join_method_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ward_join_method").agg(F.count(F.lit(1)).alias("rows"))


def regression_metrics(df: DataFrame, by: Sequence[str] = ("split",), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and R2 per group in one aggregate (R2 through the total sum of squares about the mean)."""
    a, p = F.col(actual), F.col(predicted)
    e = a - p
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.sum(e * e).alias("_sse"), (F.var_pop(a) * F.count(a)).alias("_sst"),
        )
        .withColumn("r2", F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst")))
        .drop("_sse", "_sst")
    )


def classification_metrics(
    df: DataFrame, label: str = "label", predicted: str = "predicted", score: str = "score"
) -> DataFrame:
    """Accuracy, F1 and ROC-AUC in one row; F1 is 0 if undefined, AUC 0 if there is one class only.

    AUC uses average ranks. Rows are first counted per distinct score; the running count of negatives below a
    score is taken inside range partitions plus the partition's offset, so no task sees the whole order.
    """
    y, p = F.col(label), F.col(predicted)
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((y == p).cast("double")).alias("accuracy"),
        F.count_if((y == 1) & (p == 1)).alias("_tp"),
        F.count_if((y == 0) & (p == 1)).alias("_fp"),
        F.count_if((y == 1) & (p == 0)).alias("_fn"),
        F.count_if(y == 1).alias("_pos"),
        F.count_if(y == 0).alias("_neg"),
    )
    steps = df.groupBy(score).agg(F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"))
    steps = cut_lineage(steps.repartitionByRange(score).withColumn("_part", F.spark_partition_id()))
    totals = steps.groupBy("_part").agg(F.sum("_n").alias("_t"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(inside), F.lit(0)) + F.col("_off")
    wins = steps.join(offsets, "_part").select((F.col("_p") * (below + F.col("_n") / F.lit(2.0))).alias("w"))
    g = scalar_struct(wins, {"w": F.sum("w")})
    pairs = F.col("_pos").cast("double") * F.col("_neg")
    f1 = F.try_divide(2.0 * F.col("_tp"), 2.0 * F.col("_tp") + F.col("_fp") + F.col("_fn"))
    return base.select(
        "rows", "accuracy", F.coalesce(f1, F.lit(0.0)).alias("f1"),
        F.coalesce(F.try_divide(g["w"], pairs), F.lit(0.0)).alias("auc"),
    )


def gini(df: DataFrame, keys: Sequence[str], value: Column, name: str = "gini", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Gini coefficient of the non-negative part of ``value`` per key; 0 for an empty or all-zero group.

    Ordinary groups are ranked in a window; groups above ``group_rows`` are ranked across partitions.
    """
    keys = list(keys)
    rows = df.select(*keys, F.monotonically_increasing_id().alias("_id"), F.greatest(value, F.lit(0.0)).alias("_x"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    peak = sizes.agg(F.max("_m")).first()[0] or 0
    w = Window.partitionBy(*keys).orderBy("_x", "_id")
    if peak <= group_rows:
        ranked = rows.withColumn("_r", F.row_number().over(w))
    else:
        rows = cut_lineage(rows)
        hot = ship_if_small(cut_lineage(sizes.filter(F.col("_m") > group_rows).drop("_m")))
        ranked = rows.join(hot, keys, "left_anti").withColumn("_r", F.row_number().over(w)).unionByName(
            number_rows(rows.join(hot, keys, "left_semi"), keys, ["_x", "_id"], "_r").withColumn("_r", F.col("_r").cast("int"))
        )
    s, n = F.sum("_x"), F.count("_x").cast("double")
    raw = F.try_divide(F.lit(2.0) * F.sum(F.col("_r") * F.col("_x")), n * s) - (n + F.lit(1.0)) / n
    return ranked.groupBy(*keys).agg(F.when(F.max("_x") > F.lit(1e-8), raw).otherwise(F.lit(0.0)).alias(name))


def class_balance(df: DataFrame, label: str = "hotspot_label") -> DataFrame:
    """Count per label, and whether every class has the two rows needed to stratify."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    g = scalar_struct(counts, {"least": F.min("rows"), "k": F.count(F.lit(1))})
    return counts.withColumn("can_stratify", (g["least"] >= 2) & (g["k"] >= 2))


def global_attribution(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return (
        attributions.groupBy("feature")
        .agg(F.avg(F.abs("attribution")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature")
    )


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def drop_duplicates_keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order; a combining aggregate, so copies vanish before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(key).agg(packed).select(key, "_r.*").select(*df.columns)


def concat_frames(first: DataFrame, second: DataFrame, check: bool = True) -> DataFrame:
    """Rows of both frames; with ``check`` the count must add up."""
    both = first.unionByName(second)
    if check and both.count() != first.count() + second.count():
        raise ValueError("row count of the union does not add up")
    return both
