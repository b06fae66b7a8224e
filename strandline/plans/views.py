"""Views over the star-schema tables that stand in for rasters, series, points and boxes, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (tile, r, c): slope, distance, rock, swamp, buffer, elevation."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("tile"), (F.col("l_orderkey") % SIDE).alias("r"), (F.col("l_partkey") % SIDE).alias("c")).agg(
        F.min("l_quantity").alias("slope_deg"),
        (F.max("l_extendedprice") / 500).alias("dist_m"),
        F.bool_or(F.col("l_returnflag") == "R").alias("rock"),
        F.bool_and(F.col("l_linestatus") == "F").alias("swamp"),
        F.bool_or(F.col("l_discount") >= 0.05).alias("buffer"),
        F.max(F.col("l_tax") * 100).alias("elev"),
    )


PIXELS = f"""pixels AS (SELECT l_suppkey AS tile, l_orderkey % {SIDE} AS r, l_partkey % {SIDE} AS c, min(l_quantity) AS slope_deg,
  max(l_extendedprice) / 500 AS dist_m, bool_or(l_returnflag = 'R') AS rock, bool_and(l_linestatus = 'F') AS swamp,
  bool_or(l_discount >= 0.05) AS buffer, max(l_tax * 100) AS elev FROM lineitem GROUP BY 1, 2, 3)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: station, cell, time, wind, class and source rank."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", (F.col("user_id") % 12).alias("station"), (F.col("event_id") % 400).alias("cell"), "ts", (F.col("value") / 20).alias("wind"), (F.length("event_type") % 4).cast("int").alias("cls"), F.when(F.col("event_type").isin("click", "view"), 1).otherwise(2).alias("layer"))


OBS = """obs AS (SELECT event_id, user_id % 12 AS station, event_id % 400 AS cell, ts, value / 20 AS wind,
  (length(event_type) % 4)::INTEGER AS cls, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS layer FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = table(spark, sf_dir, "customer")
    return cu.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") * 7) % 10000).cast("double").alias("y"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("nation"))


POINTS = "points AS (SELECT c_custkey AS id, c_acctbal AS x, ((c_custkey * 7) % 10000)::DOUBLE AS y, c_mktsegment AS kind, c_nationkey AS nation FROM customer)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rectangles of growing size."""
    na = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return na.select(k.alias("box"), (k * 400.0 - 1000).alias("minx"), ((k % 5) * 1800.0).alias("miny"), (k * 400.0 - 1000 + 1500 + (k % 3) * 700).alias("maxx"), ((k % 5) * 1800.0 + 2500).alias("maxy"))


BOXES = """boxes AS (SELECT n_nationkey AS box, n_nationkey * 400.0::DOUBLE - 1000 AS minx, (n_nationkey % 5) * 1800.0::DOUBLE AS miny,
  n_nationkey * 400.0::DOUBLE - 1000 + 1500 + (n_nationkey % 3) * 700 AS maxx, (n_nationkey % 5) * 1800.0::DOUBLE + 2500 AS maxy FROM nation)"""
