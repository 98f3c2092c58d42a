"""CSV, Parquet and JSON tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.operators.columns import nan_to_null


def read_cells_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, required: bool = True
) -> DataFrame | None:
    """Header CSV. Columns are matched by header name (an explicit schema saves the inference pass); empty text
    and NaN are null. A missing optional file gives None, a missing required file raises."""
    reader = spark.read.option("header", True).option("nullValue", "").option("nanValue", "NaN")
    try:
        if schema is None:
            return nan_to_null(reader.option("inferSchema", True).csv(path))
        return nan_to_null(reader.schema(schema).option("enforceSchema", False).csv(path))
    except AnalysisException as error:
        return _absent(error, path, required)


def _absent(error: AnalysisException, path: str, required: bool) -> None:
    """Nothing for a missing optional file; any other error is passed on."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error
    if required:
        raise FileNotFoundError(path) from None


def read_cells(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    try:
        return nan_to_null(spark.read.parquet(path))
    except AnalysisException as error:
        return _absent(error, path, required)


def write_cells(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_samples_csv(samples: DataFrame, path: str) -> None:
    """Sampled pixel table as CSV part files."""
    write_csv(samples, path)


PLAN_SCHEMA = T.StructType(
    [
        T.StructField("ward_id", T.StringType()),
        T.StructField("intervention_type", T.IntegerType()),
        T.StructField("intervention_label", T.StringType()),
        T.StructField("intervention_frac", T.DoubleType()),
    ]
)


def write_plan_csv(plan: DataFrame, path: str) -> None:
    write_csv(plan.select(*PLAN_SCHEMA.fieldNames()), path)


def read_plan_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(PLAN_SCHEMA).csv(path)


def metrics_document(metrics: DataFrame, features: list[str], by: str = "split") -> DataFrame:
    """Metrics of every split and the feature list as one nested row."""
    names = [c for c in metrics.columns if c != by]
    return metrics.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by), F.struct(*names).alias("m"))))).alias("metrics")
    ).withColumn("features", F.array(*[F.lit(f) for f in features]))


def write_metrics_json(metrics: DataFrame, features: list[str], path: str, by: str = "split") -> None:
    metrics_document(metrics, features, by).coalesce(1).write.mode("overwrite").json(path)
