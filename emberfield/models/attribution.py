"""Which features drive a prediction: permutation, occlusion and value-share measures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions.scalars import driver_text, feature_title
from emberfield.operators.stats import top_k_per_group
from emberfield.scale import cut_lineage, hash_order, number_rows

Model = Callable[[DataFrame], DataFrame]


def _long(df: DataFrame, features: Sequence[str], replace: Callable[[str], Column]) -> DataFrame:
    """One copy of each row per feature, with that feature replaced."""
    out = df.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    return out.withColumns(
        {f: F.when(F.col("feature") == f, replace(f)).otherwise(F.col(f)) for f in features if f in df.columns}
    )


def permutation_importance(
    df: DataFrame, model: Model, features: Sequence[str], ids: Sequence[str], actual: str = "lst_celsius",
    repeats: int = 3, seed: int = 42,
) -> DataFrame:
    """Mean rise of the absolute error when a feature's values change places between rows.

    Rows are numbered once in seeded hash order; repeat r gives row i the values of row (i * step + shift) mod n
    with a step coprime to n, a permutation found by one equi-join for all features together.
    """
    base = model(df).withColumn("_e0", F.abs(F.col(actual) - F.col("prediction"))).drop("prediction")
    numbered = cut_lineage(
        number_rows(base.withColumns({"_one": F.lit(0), "_h": hash_order(ids, seed)}), ["_one"], ["_h", *ids], "_i")
        .withColumn("_i", F.col("_i") - 1).drop("_one", "_h")
    )
    n = numbered.count()
    maps = []
    for r in range(repeats):
        step = max(2, int(n * 0.61803) + 7 * r + 1)
        while n > 1 and gcd(step, n) != 1:
            step += 1
        maps.append(F.struct(F.lit(step % n if n > 1 else 1).alias("a"), F.lit((seed + 101 * r) % max(n, 1)).alias("b")))
    donors = numbered.select(F.col("_i").alias("_j"), F.struct(*features).alias("_d"))
    asked = numbered.select("*", F.inline(F.array(*maps))).withColumn("_j", (F.col("_i") * F.col("a") + F.col("b")) % F.lit(n))
    mixed = _long(asked.join(donors, "_j"), features, lambda f: F.col(f"_d.{f}"))
    rise = F.abs(F.col(actual) - F.col("prediction")) - F.col("_e0")
    return model(mixed).groupBy("feature").agg(F.avg(rise).alias("importance")).orderBy(F.desc("importance"), "feature")


def attributions(
    df: DataFrame, model: Model, background: Mapping[str, float], cell_id: str = "cell_id"
) -> DataFrame:
    """Occlusion effect: prediction minus the prediction with the feature at its background value.
    Output: cell_id, feature, value, attribution. Missing values count as background (effect 0)."""
    features = [f for f in background if f in df.columns]
    order = {f: i for i, f in enumerate(features)}
    base = model(df).withColumnRenamed("prediction", "_p0")
    values = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    rows = _long(base.withColumn("_v", values), features, lambda f: F.lit(float(background[f])))
    ordinal = F.element_at(F.create_map(*[x for f, i in order.items() for x in (F.lit(f), F.lit(i))]), F.col("feature"))
    return model(rows).select(
        cell_id, "feature", F.element_at("_v", F.col("feature")).alias("value"),
        (F.col("_p0") - F.col("prediction")).alias("attribution"), ordinal.alias("feature_ord"),
    )


def attribute_drivers(df: DataFrame, model: Model, background: Mapping[str, float], n: int = 5, cell_id: str = "cell_id") -> DataFrame:
    """Top ``n`` features per row by absolute effect (3 digits), with readable names and the direction."""
    rows = attributions(df, model, background, cell_id).withColumn("attribution", F.round("attribution", 3))
    best = top_k_per_group(rows, [cell_id], [F.desc(F.abs("attribution")), F.asc("feature_ord")], n)
    return best.withColumns(
        {
            "title": feature_title("feature"),
            "headline": driver_text("feature"),
            "direction": F.when(F.col("attribution") > 0, "heating").otherwise("cooling"),
        }
    ).drop("feature_ord")


def value_share_drivers(df: DataFrame, features: Sequence[str], n: int = 5, cell_id: str = "cell_id") -> DataFrame:
    """Fallback without importances: each feature's share of the absolute values (null as 0, total at least 1)."""
    have = [f for f in features if f in df.columns]
    size = {f: F.abs(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in have}
    total = F.greatest(sum(size.values(), F.lit(0.0)), F.lit(1.0))
    items = F.array(*[F.struct(F.lit(i).alias("feature_ord"), F.lit(f).alias("feature"), s.alias("_s")) for i, (f, s) in enumerate(size.items())])
    rows = df.select(cell_id, total.alias("_t"), F.inline(items)).withColumn("importance", F.round(F.col("_s") / F.col("_t"), 9))
    rows = rows.select(cell_id, "feature_ord", "feature", "importance")
    return top_k_per_group(rows, [cell_id], [F.desc("importance"), F.asc("feature_ord")], n).drop("feature_ord")


def top_drivers(importance: DataFrame, n: int = 5, score: str = "importance") -> DataFrame:
    return importance.orderBy(F.desc(F.abs(F.col(score))), "feature").limit(n)
