"""Point clouds to cells, and canopy measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUND, LOW, MID, HIGH = 2, 3, 4, 5


def grid(points: DataFrame, least: int = 3) -> DataFrame:
    """One pass over ``points (cell, z, cls)``: tops, counts, cover and undergrowth; thin cells are not valid."""
    c = F.col("cls")
    rows = points.where(c.between(GROUND, HIGH)).groupBy("cell").agg(
        F.max("z").alias("surface"), F.max(F.when(c == GROUND, F.col("z"))).alias("ground"), F.count("*").alias("n"),
        F.count_if(c >= LOW).alias("canopy"), F.count_if(c.between(LOW, MID)).alias("low"),
    )
    return rows.select("cell", "surface", "ground", "n", (F.col("canopy") / F.col("n")).alias("cover"), (F.col("low") / F.col("n")).alias("undergrowth"), (F.col("n") >= least).alias("valid"))


def canopy_height(cells: DataFrame) -> DataFrame:
    return cells.withColumn("canopy_height", F.least(F.greatest(F.col("surface") - F.col("ground"), F.lit(0.0)), F.lit(50.0)))


def combine(sheets: DataFrame) -> DataFrame:
    """Cells of overlapping sheets: greatest top, any validity."""
    return sheets.groupBy("cell").agg(F.max("surface").alias("surface"), F.bool_or("valid").alias("valid"))
