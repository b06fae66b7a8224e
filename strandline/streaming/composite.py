"""The freshest class of each cell, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freshest_stream(obs: DataFrame, window: str = "7 days") -> DataFrame:
    """(day, cell, cls, ts) of a stream of (cell, ts, layer, cls): by day the newest class, the finer layer first, then the greater class. Rows later
    than the window are dropped and their days forgotten."""
    order = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (-F.col("layer")).alias("fine"), "cls")
    return obs.withWatermark("ts", window).groupBy(F.window("ts", "1 day").alias("day"), "cell").agg(F.max_by("cls", order).alias("cls"), F.max("ts").alias("ts")).select(F.to_date("day.start").alias("day"), "cell", "cls", "ts")


def hourly_dose_stream(obs: DataFrame, limit: float, window: str = "1 day") -> DataFrame:
    """(hour, station, dose): the wind above a limit, hour by hour."""
    hour = F.window("ts", "1 hour").alias("hour")
    return obs.withWatermark("ts", window).groupBy(hour, "station").agg(F.sum(F.greatest(F.col("wind") - limit, F.lit(0.0))).alias("dose")).select(F.col("hour.start").alias("hour"), "station", "dose")
