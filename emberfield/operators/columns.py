"""Schema alignment, casts, audits and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.scale import cut_lineage, ship_if_small
from pyspark.sql import types as T

from emberfield import schema as S


class SchemaError(ValueError):
    """A table lacks a mandatory column or holds invalid values."""


def align_columns(df: DataFrame, aliases: Mapping[str, str] = S.ALIASES) -> DataFrame:
    """Rename export names to canonical ones, only where the canonical name is still free. Idempotent."""
    have = set(df.columns)
    renames: dict[str, str] = {}
    for src, dst in aliases.items():
        if src in have and dst not in have and dst not in renames.values():
            renames[src] = dst
    return df.withColumnsRenamed(renames) if renames else df


def cast_types(df: DataFrame) -> DataFrame:
    """Land cover to nullable integer (non-numeric to null, halves to even); identifier columns to string."""
    casts: dict[str, Column] = {}
    if "LULC_ESA" in df.columns:
        casts["LULC_ESA"] = F.bround(F.col("LULC_ESA").try_cast("double"), 0).cast("long")
    for c in ("year", "grid_id", "season"):
        if c in df.columns:
            casts[c] = F.col(c).cast("string")
    return df.withColumns(casts) if casts else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one and the same missing value."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def require_columns(df: DataFrame, cols: Iterable[str] = S.REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SchemaError(f"missing required columns: {missing}")
    return df


def schema_audit(df: DataFrame, expected: Sequence[str] = tuple(S.EXPECTED_FEATURES)) -> DataFrame:
    """(column, status, n_filled): expected columns that are missing, and columns nobody expects with the number of
    their non-null rows (0 for missing ones). Names that only identify a cell are no surplus. One counting pass."""
    have, known = set(df.columns), set(expected) | set(S.ID_COLUMNS)
    missing = [c for c in expected if c not in have]
    extra = [c for c in df.columns if c not in known]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in extra], *[F.lit(0).cast("long").alias(c) for c in missing])
    row = lambda c, status: F.struct(F.lit(c).alias("column"), F.lit(status).alias("status"), F.col(f"`{c}`").alias("n_filled"))
    rows = [row(c, "missing") for c in missing] + [row(c, "extra") for c in extra]
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, status string, n_filled long")
    return counts.select(F.inline(F.array(*rows)))


def null_report(df: DataFrame) -> DataFrame:
    """Null count and percent per column, only where there are nulls; one pass over the table."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_count")) for i, c in enumerate(cols)])
    return (
        one.select("n", F.inline(entries))
        .filter(F.col("null_count") > 0)
        .select("column", "null_count", F.round(F.col("null_count") / F.col("n") * F.lit(100.0), 4).alias("null_pct"))
        .orderBy(F.desc("null_count"), "column")
    )


def drop_missing_target(df: DataFrame, cols: Sequence[str] = ("lst_celsius",)) -> DataFrame:
    return df.na.drop(subset=[c for c in cols if c in df.columns])


def validate_coords(df: DataFrame, fail: bool = True) -> DataFrame:
    """Coerce lon and lat to numbers; with ``fail`` any invalid row raises, otherwise a ``coords_valid`` flag is added."""
    require_columns(df, ["lon", "lat"])
    out = df.withColumns({c: F.col(c).try_cast("double") for c in ("lon", "lat")})
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in ("lon", "lat")])
    if not fail:
        return out.withColumn("coords_valid", good)
    bad = out.agg(F.count_if(~good)).first()[0]
    if bad:
        raise SchemaError(f"{bad} rows with invalid coordinates")
    return out


def coord_counts(df: DataFrame) -> DataFrame:
    flagged = validate_coords(df, fail=False)
    return flagged.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("coords_valid")).alias("invalid_rows")
    )


def pick_column(cols: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present by exact name, then ignoring case."""
    for c in candidates:
        if c in cols:
            return c
    lower = {c.lower(): c for c in reversed(list(cols))}
    return next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def feature_status(
    df: DataFrame, core: Sequence[str] = tuple(S.MODEL_FEATURES), optional: Sequence[str] = ()
) -> DataFrame:
    """(feature, status): used, unavailable, all_null, not_numeric or excluded. One counting pass."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in [*core, *optional] if isinstance(types.get(c), T.NumericType)]
    fixed = [
        (c, "unavailable" if c not in types else "not_numeric")
        for c in core
        if c not in types or not isinstance(types[c], T.NumericType)
    ]
    fixed += [(c, "excluded") for c in S.EXCLUDED_FEATURES if c in types and c not in numeric]
    counts = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(numeric)])
    entries = [
        F.struct(F.lit(c).alias("feature"), F.when(F.col(f"c{i}") > 0, "used").otherwise("all_null").alias("status"))
        for i, c in enumerate(numeric)
    ]
    entries += [F.struct(F.lit(c).alias("feature"), F.lit(s).alias("status")) for c, s in fixed]
    return counts.select(F.inline(F.array(*entries)))


def select_features(
    df: DataFrame, core: Sequence[str] = tuple(S.MODEL_FEATURES), optional: Sequence[str] = ()
) -> list[str]:
    """Names of the usable features, in order."""
    clash = sorted(set(core) & set(S.EXCLUDED_FEATURES))
    if clash:
        raise SchemaError(f"excluded columns asked for as features: {clash}")
    status = {r["feature"]: r["status"] for r in feature_status(df, core, optional).collect()}
    bad = [c for c in core if status.get(c) == "not_numeric"]
    if bad:
        raise SchemaError(f"features that are not numeric: {bad}")
    used = [c for c in [*core, *optional] if status.get(c) == "used"]
    if not used:
        raise SchemaError("no usable numeric features")
    return used


def dataset_check(df: DataFrame, target: str = "lst_celsius") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(target).isNull()).alias("null_targets"))


def assert_dataset(df: DataFrame, expected_rows: int | None = 38_244, target: str = "lst_celsius") -> DataFrame:
    require_columns(df, [target])
    rows, nulls = dataset_check(df, target).first()
    if expected_rows is not None and rows != expected_rows:
        raise SchemaError(f"expected {expected_rows} rows, found {rows}")
    if nulls:
        raise SchemaError(f"{nulls} rows without {target}")
    return df


def with_grid_id(df: DataFrame) -> DataFrame:
    return df.withColumn("grid_id", F.format_string("%.4f_%.4f", F.col("lat").cast("double"), F.col("lon").cast("double")))


def filter_strict(df: DataFrame) -> DataFrame:
    """Rows assigned by containment; if there are none, every row with a ward. A table without the method column
    counts as wholly contained. The table is written once, so that what made it runs once for the question and the rows."""
    if "ward_join_method" not in df.columns:
        return df.filter(F.col("ward_id").isNotNull())
    df = cut_lineage(df)
    within = F.col("ward_join_method") == "within"
    some = df.agg(F.count_if(within).alias("n")).scalar() > 0
    return df.filter(F.when(some, F.coalesce(within, F.lit(False))).otherwise(F.col("ward_id").isNotNull()))


def not_null_filter(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(cols))


def with_indices(df: DataFrame) -> DataFrame:
    """Derive the Landsat and Sentinel indices that are absent and whose bands are present."""
    from emberfield.functions import bands as B

    have = set(df.columns)
    new: dict[str, Column] = {}
    for sfx, p in (("L", "L_"), ("S2", "S2_")):
        b = {k: p + k for k in ("Blue", "Green", "Red", "NIR", "SWIR1")}
        recipes = {
            f"NDVI_{sfx}": (("NIR", "Red"), B.ndvi),
            f"NDWI_{sfx}": (("Green", "NIR"), B.ndwi),
            f"MNDWI_{sfx}": (("Green", "SWIR1"), B.mndwi),
            f"NDBI_{sfx}": (("SWIR1", "NIR"), B.ndbi),
            f"EVI_{sfx}": (("NIR", "Red", "Blue"), B.evi),
            f"SAVI_{sfx}": (("NIR", "Red"), B.savi),
            f"NBI_{sfx}": (("Red", "SWIR1", "NIR"), B.nbi),
        }
        for name, (need, fn) in recipes.items():
            if name not in have and all(b[k] in have for k in need):
                new[name] = fn(*[F.col(b[k]) for k in need])
    return df.withColumns(new) if new else df


def map_values(df: DataFrame, key: str, mapping: DataFrame, out: str, map_key: str = "key", map_value: str = "value", only_missing: bool = False) -> DataFrame:
    """Add ``out``, the mapped value of the row's key; null for unknown and null keys. ``mapping`` has one row per key
    (of several the least value counts). ``only_missing`` fills an existing ``out`` where it is null."""
    held = mapping.filter(F.col(map_key).isNotNull()).groupBy(F.col(map_key).alias("_key")).agg(F.min(map_value).alias("_value"))
    met = df.join(ship_if_small(cut_lineage(held)), F.col(key) == F.col("_key"), "left")
    value = F.coalesce(F.col(out), F.col("_value")) if only_missing and out in df.columns else F.col("_value")
    return met.withColumn(out, value).drop("_key", "_value")
