"""Gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.functions import bands as B
from emberfield.scale import GROUP_ROWS, cut_lineage, exact_percentiles, scalar_struct, ship_if_small

COVER = "LULC_ESA"


def _limits(rows: int, columns: int, group_rows: int | None) -> dict:
    """Percentile options: a table that is small as a whole needs no further group counting."""
    limit = GROUP_ROWS if group_rows is None else group_rows
    out: dict = {"group_rows": limit}
    if rows <= limit // max(1, columns):
        out["known_group_rows"] = rows
    return out


def fill_albedo(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Fill null albedo: Landsat bands, then Sentinel bands, then the land-cover median, then the overall median.

    The land-cover median is taken after the band tiers, the overall median after the land-cover tier.
    """
    have = set(df.columns)
    tiers = [F.col("albedo")] if "albedo" in have else [F.lit(None).cast("double")]
    for p in ("L_", "S2_"):
        bands = [p + b for b in ("Blue", "Red", "NIR", "SWIR1", "SWIR2")]
        if have.issuperset(bands):
            tiers.append(B.albedo(*bands))
    out = df.withColumn("albedo", F.coalesce(*tiers))
    limits = _limits(out.count(), 1, group_rows)
    if COVER in have:
        known = out.filter(F.col(COVER).isNotNull())
        medians = exact_percentiles(known, [COVER], {"_m": ("albedo", 0.5)}, **limits)
        out = out.join(ship_if_small(cut_lineage(medians)), COVER, "left").withColumn("albedo", F.coalesce("albedo", "_m")).drop("_m")
    overall = exact_percentiles(out, [], {"_m": ("albedo", 0.5)}, **limits)
    g = scalar_struct(overall, {"m": F.first("_m")})
    return out.withColumn("albedo", F.coalesce("albedo", g["m"])).select(*df.columns, *([] if "albedo" in have else ["albedo"]))


def fill_mode(df: DataFrame, col: str = COVER) -> DataFrame:
    """Null to the most frequent value, the smallest on a tie."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v")))["v"].alias("v")).scalar()
    return df.withColumn(col, F.coalesce(F.col(col), mode))


def numeric_fill_columns(df: DataFrame, skip: Sequence[str] = ("lst_celsius", "lon", "lat", COVER)) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip
    ]


def impute_grouped_median(
    df: DataFrame, cols: Sequence[str] | None = None, by: str = COVER, group_rows: int | None = None
) -> DataFrame:
    """Null to the class median, then to the overall median of the class-filled column.

    One pass finds which columns have nulls at all; only those are touched.
    """
    cols = list(cols) if cols is not None else numeric_fill_columns(df)
    nulls = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    todo = [c for c in cols if nulls[c]]
    if not todo:
        return df
    limits = _limits(nulls["_rows"], len(todo), group_rows)
    wanted = {f"_m_{c}": (c, 0.5) for c in todo}
    by_class = exact_percentiles(df.filter(F.col(by).isNotNull()), [by], wanted, **limits)
    filled = (
        df.join(ship_if_small(cut_lineage(by_class)), by, "left")
        .withColumns({c: F.coalesce(c, f"_m_{c}") for c in todo})
        .drop(*wanted)
    )
    overall = exact_percentiles(filled, [], wanted, **limits)
    g = scalar_struct(overall, {n: F.first(n) for n in wanted})
    return filled.withColumns({c: F.coalesce(F.col(c), g[f"_m_{c}"]) for c in todo}).select(*df.columns)


def fit_medians(train: DataFrame, cols: Sequence[str], sketches: DataFrame | None = None) -> dict[str, float | None]:
    """Exact medians of the training rows (one row to the driver)."""
    row = exact_percentiles(train, [], {c: (c, 0.5) for c in cols}, sketches=sketches).first()
    return {c: row[c] for c in cols}


def apply_medians(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Null, NaN and absent features become the training median."""
    have = set(df.columns)
    return df.withColumns(
        {
            c: F.coalesce(B.clean(F.col(c).cast("double")), F.lit(m)) if c in have else F.lit(m).cast("double")
            for c, m in medians.items()
        }
    )


def fill_component(df: DataFrame, cols: Sequence[str], value: float = 0.5) -> DataFrame:
    return df.na.fill(value, subset=list(cols))
