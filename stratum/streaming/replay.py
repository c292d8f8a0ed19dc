"""An extension beyond replay in batches: trace counters as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.trace import EVENT_SCHEMA


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA + ", at timestamp").json(folder)


def windowed_counters(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events per trace, type and time window; those later than `late` are left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "trace", "type").agg(F.count(F.lit(1)).alias("events"))
