"""Current-weather payloads (JSON text) to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions.scalars import weather_text

# Payload field -> output column.
FIELDS = {
    "temperature_2m": "temperature_C",
    "apparent_temperature": "feels_like_C",
    "relative_humidity_2m": "humidity_pct",
    "wind_speed_10m": "wind_speed_m_s",
    "wind_direction_10m": "wind_direction_deg",
    "wind_gusts_10m": "wind_gust_m_s",
    "surface_pressure": "pressure_hpa",
    "cloud_cover": "cloud_cover_pct",
    "precipitation": "precipitation_mm",
    "rain": "rain_mm",
}
PAYLOAD = (
    "current struct<time: string, weather_code: int, "
    + ", ".join(f"{f}: double" for f in FIELDS)
    + ">, current_units map<string,string>"
)


def parse_weather(df: DataFrame, payload: str = "payload", units: bool = False) -> DataFrame:
    """Add the weather columns. An absent or malformed payload has status ``unavailable`` and nulls."""
    parsed = df.withColumn("_w", F.from_json(F.col(payload), PAYLOAD))
    ok = F.col("_w.current").isNotNull()

    def field(name: str) -> Column:
        return F.col(f"_w.current.{name}")

    cols = {out: field(src) for src, out in FIELDS.items()}
    cols["time"] = field("time")
    cols["weather_code"] = field("weather_code")
    cols["condition"] = F.when(ok, weather_text(field("weather_code")))
    cols["status"] = F.when(ok, "ok").otherwise("unavailable")
    if units:
        cols["units"] = F.col("_w.current_units")
    return parsed.withColumns(cols).drop("_w")
