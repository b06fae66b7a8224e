"""Shoreline strips: cells grouped by their nearest shore cell, and the best strips alongshore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .raster import nearest_seed, window_extreme


def lower_percentile(df: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """Element trunc((n - 1) * percent / 100) of each sorted group, as a discrete percentile over value counts."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    got = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(value, "n"))).alias("vs"), F.sum("n").alias("total"))
    place = F.floor((F.col("total") - 1) * percent / 100)
    step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when((acc["seen"] <= place) & (place < acc["seen"] + x["n"]), x[value]).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(dict(df.dtypes)[value]).alias("out"))
    return got.select(*keys, F.aggregate("vs", start, step, lambda acc: acc["out"]).alias(value))


def strips(cells: DataFrame, shore: Column, low: int, high: int) -> DataFrame:
    """Cells between ``low`` and ``high`` cells from the shore, with their shore cell (sr, sc)."""
    near = nearest_seed(cells, shore, high)
    return near.where((F.col("d2") >= low * low) & (F.col("d2") <= high * high))


def prime(cells: DataFrame, shore: Column, value: str, low: int = 1, high: int = 4, percent: int = 10, radius: int = 2) -> DataFrame:
    """Each zone cell's strip value: the lower percentile of the strip, then the least of strips within ``radius`` alongshore."""
    zone = strips(cells, shore, low, high).join(cells.select("tile", "r", "c", value), ["tile", "r", "c"])
    by_strip = lower_percentile(zone, ["tile", "sr", "sc"], value, percent)
    anchors = by_strip.select("tile", F.col("sr").alias("r"), F.col("sc").alias("c"), value)
    worst = window_extreme(anchors, value, radius).select("tile", F.col("r").alias("sr"), F.col("c").alias("sc"), "m")
    return zone.select("tile", "r", "c", "sr", "sc").join(worst, ["tile", "sr", "sc"]).select("tile", "r", "c", F.col("m").alias(value))


COMPONENTS = ("slope", "dist", "rock", "not_swamp")


def prime_components(cells: DataFrame, shore: Column, low: int = 1, high: int = 4, percent: int = 10, radius: int = 2) -> DataFrame:
    """Zone cells with the four strip components of 0 to 1; the zone is found once."""
    parts = cells.select("tile", "r", "c", S.slope_score(F.col("slope_deg")).alias("slope"), S.dist_score(F.col("dist_m")).alias("dist"), F.col("rock").cast("double").alias("rock"), (~F.col("swamp")).cast("double").alias("not_swamp"))
    zone = strips(cells, shore, low, high).select("tile", "r", "c", "sr", "sc")
    rows = zone.join(parts, ["tile", "r", "c"])
    out = zone
    for name in COMPONENTS:
        by_strip = lower_percentile(rows, ["tile", "sr", "sc"], name, percent)
        anchors = by_strip.select("tile", F.col("sr").alias("r"), F.col("sc").alias("c"), name)
        worst = window_extreme(anchors, name, radius).select("tile", F.col("r").alias("sr"), F.col("c").alias("sc"), F.col("m").alias(name))
        out = out.join(worst, ["tile", "sr", "sc"])
    return out


def prime_bytes(components: DataFrame) -> DataFrame:
    """The components as they are stored: two bytes and two bits."""
    return components.select("tile", "r", "c", S.byte(F.col("slope")).alias("slope_b"), S.byte(F.col("dist")).alias("dist_b"), (F.col("rock") >= 0.5).alias("rock"), (F.col("not_swamp") < 0.5).alias("swamp"))
