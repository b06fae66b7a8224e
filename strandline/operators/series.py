"""Observations in time: freshest composites, interpolated wind, mixing doses and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S


def freshest(obs: DataFrame, today: Column, days: int) -> DataFrame:
    """The newest class of each cell within the window; on one day the finer layer, then the smaller id. One aggregation."""
    rows = obs.withColumn("age", F.datediff(today, F.to_date("ts"))).where(F.col("age").between(0, days - 1))
    best = rows.groupBy("cell").agg(F.min(F.struct("age", "layer", "event_id", "cls")).alias("b"))
    return best.select("cell", F.col("b.cls").alias("cls"), F.col("b.age").alias("age"), F.col("b.layer").alias("layer"))


def idw(stations: DataFrame, points: DataFrame, most: int = 100_000) -> DataFrame:
    """Inverse-distance wind at every point and hour, weight 1 / max(d^2, 1), missing stations skipped.

    ``stations``: (hour, x, y, wind); ``points``: (id, x, y). An hour's stations become one array, and points meet hours;
    the station network is checked to be small, since every point depends on all of it.
    """
    hours = stations.where("wind IS NOT NULL AND NOT isnan(wind)").groupBy("hour").agg(F.sort_array(F.collect_list(F.struct("x", "y", "wind"))).alias("st"))
    n = stations.select("x", "y").distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} stations; interpolate by region")
    grid = points.crossJoin(F.broadcast(hours) if n <= 10_000 else hours)

    def weight(s: Column) -> Column:
        dx, dy = F.col("x") - s["x"], F.col("y") - s["y"]
        return 1.0 / F.greatest(dx * dx + dy * dy, F.lit(1.0))

    total = lambda f: F.aggregate("st", F.lit(0.0), lambda acc, s: acc + f(s))
    return grid.select("id", "hour", (total(lambda s: weight(s) * s["wind"]) / total(weight)).alias("wind"))


def mixing_dose(hourly: DataFrame, days: int) -> DataFrame:
    """(cell, age, dose): wind above the mixing limit summed over the last 24 * age hours, for age 0 .. days."""
    w = W.partitionBy("cell").orderBy(F.desc("hour"))
    run = hourly.select("cell", F.sum(F.greatest(F.col("wind") - S.MIX_WIND, F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("dose"), F.row_number().over(w).alias("rn"))
    last = run.groupBy("cell").agg(F.max("rn").alias("n"))
    ages = last.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(days)))).withColumn("rn", F.least(F.col("age") * 24, "n"))
    return ages.join(run, ["cell", "rn"], "left").select("cell", "age", F.coalesce("dose", F.lit(0.0)).alias("dose"))


def deterioration(obs: DataFrame, level: Column, hours: int = 3) -> DataFrame:
    """Times at which the next hours reach class 3 though not there now, or rise by 0.75 and end at 1 or more."""
    rows = obs.withColumn("level", level).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = W.partitionBy("station").orderBy("sec").rangeBetween(0, hours * 3600)
    rows = rows.withColumn("ahead", F.max("level").over(w))
    warn = ((F.col("ahead") >= 3) & (F.col("level") < 3)) | ((F.col("ahead") - F.col("level") >= 0.75) & (F.col("ahead") >= 1))
    return rows.select("event_id", "station", warn.alias("warning"))


def circular_mean(obs: DataFrame, key: str, degrees: Column) -> DataFrame:
    """Mean direction by key, in degrees 0 .. 360."""
    r = F.radians(degrees)
    mean = F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))
    return obs.groupBy(key).agg(F.pmod(mean + 360.0, F.lit(360.0)).alias("direction"))


def time_slices(spark, start: str, end: str, days: int) -> DataFrame:
    """Consecutive slices of a time range, as a paged source wants them."""
    t = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {days} DAYS"))).alias("begin"))
    return t.select("begin", F.least(F.col("begin") + F.expr(f"INTERVAL {days} DAYS"), F.lit(end).cast("timestamp")).alias("stop")).where("begin < stop")


def dose_at(obs: DataFrame, doses: DataFrame, x0: float, y1: float, size: float, rows: int, cols: int, oldest: int) -> DataFrame:
    """``obs (x, y, age)`` with the dose of their cell at their age in whole days, both clamped to what ``doses (age, r, c, dose)`` has."""
    inside = obs.where((F.col("x") >= x0) & (F.col("x") < x0 + cols * size) & (F.col("y") <= y1) & (F.col("y") > y1 - rows * size))
    r = F.least(F.floor((F.lit(y1) - F.col("y")) / size), F.lit(rows - 1)).cast("int")
    c = F.least(F.floor((F.col("x") - x0) / size), F.lit(cols - 1)).cast("int")
    day = F.least(F.bround(F.greatest("age", F.lit(0.0))), F.lit(oldest)).cast("int")
    return inside.withColumns({"r": r, "c": c, "day": day}).join(doses.withColumnRenamed("age", "day"), ["day", "r", "c"], "left")


def coverage(obs: DataFrame, day: Column) -> DataFrame:
    """(day, layer): observations, and cells seen on that day for the first time by any layer."""
    rows = obs.select("cell", "layer", day.alias("day"))
    first = rows.groupBy("cell").agg(F.min(F.struct("day", "layer")).alias("first")).groupBy("first.day", "first.layer").agg(F.count("*").alias("fresh"))
    counts = rows.groupBy("day", "layer").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("cells"))
    return counts.join(first, ["day", "layer"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
