"""Windowed observation statistics, the same for a stream and a batch."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def windowed_observations(
    obs: DataFrame, key: str = "grid_id", value: str = "lst_celsius", window: str = "1 hour", late: str = "2 hours",
    event_id: str = "event_id",
) -> DataFrame:
    """Tumbling count, mean and max per cell. Repeated deliveries of one event within the lateness count once.

    On a stream the state holds only open windows and ids within the watermark; on a batch duplicates are
    dropped over the whole input.
    """
    if obs.isStreaming:
        rows = obs.withWatermark("ts", late).dropDuplicatesWithinWatermark([event_id])
    else:
        rows = obs.dropDuplicates([event_id])
    return (
        rows.groupBy(F.window("ts", window).alias("_w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), key, "n", "mean_value", "max_value")
    )


def closing_row(
    spark: SparkSession, schema: StructType, last: datetime.datetime, window: str = "1 hour", late: str = "2 hours"
) -> DataFrame:
    """One row that ends a stream whose last event was at ``last``: landed like any observation, it moves the watermark
    past every open window and every remembered id, so that the next run writes the rest and empties the state.

    All columns but ``ts`` are null. The row's own window lies beyond the watermark it sets and is never written;
    observations that land afterwards are late.
    """
    at = F.lit(last) + F.expr(f"greatest(interval {window}, interval {late})") + F.expr(f"interval {late}") + F.expr("interval 1 second")
    kinds = {f.name: f.dataType for f in schema.fields}
    return spark.range(1).select(*[(at if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Process what has landed and stop; exactly-once files plus a checkpoint in the shared folder. Returns the recent
    progress reports (rows kept in state, watermark)."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.recentProgress
