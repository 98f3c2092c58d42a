"""Live weather as a file stream, and alerts from a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.functions.scalars import classify_heat, feels_like_label, heat_index
from emberfield.scale import ship_if_small
from emberfield.sources.weather import parse_weather


def with_comfort(df: DataFrame) -> DataFrame:
    """Apparent temperature (the feed's own, else the regression) and its label."""
    felt = F.coalesce(F.col("feels_like_C"), heat_index("temperature_C", "humidity_pct"))
    return df.withColumn("heat_index_C", felt).withColumn("feels_label", feels_like_label("heat_index_C", "temperature_C"))


def weather_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Payload files landing in a folder, one JSON document per line."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return with_comfort(parse_weather(lines.withColumnRenamed("value", "payload")))


def cell_alerts(weather: DataFrame, cells: DataFrame, key: str = "cell_id", cell_rows: int | None = None) -> DataFrame:
    """Weather rows (stream or batch) joined with the static cells, with the risk class of the cell.

    The cells are broadcast only when their count is under the limit; otherwise each micro-batch is shuffled.
    """
    static = ship_if_small(cells.select(key, "lst_celsius"), cell_rows)
    return weather.join(static, key).withColumn("risk_level", classify_heat("lst_celsius"))
