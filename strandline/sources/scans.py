"""Readers: padded box scans, layer unions, palettes and embedded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def features(spark: SparkSession, path: str, layers: list[str], box: tuple[float, float, float, float], pad: float = 0.0, fmt: str = "parquet") -> DataFrame:
    """Features of the layers whose bounds touch the padded box; a layer that is not there gives nothing. The comparisons
    are plain, so they reach the file's statistics."""
    x0, y0, x1, y1 = box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad
    df = spark.read.format(fmt).load(path)
    return df.where(F.col("layer").isin(*layers) & (F.col("maxx") >= x0) & (F.col("minx") <= x1) & (F.col("maxy") >= y0) & (F.col("miny") <= y1))


def union_layers(*layers: DataFrame) -> DataFrame:
    """Layers under one schema; missing columns are null."""
    out = layers[0]
    for df in layers[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def palette(index: Column, colours: list[tuple[int, int, int]]) -> tuple[Column, Column, Column]:
    """Colours of a palette index, from a literal table of at most 256 entries."""
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in colours)), (index + 1).cast("int"))
    return pick(0), pick(1), pick(2)


def json_elements(raw: DataFrame, column: str, schema: str, field: str) -> DataFrame:
    """One row for each element of an array field of JSON documents; a wrong document gives none."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    return raw.select(F.explode(parsed[field]).alias("e")).select("e.*")


def counted(df: DataFrame, expected: int) -> DataFrame:
    """Fails if a source returned another number of features than it announced."""
    n = df.count()
    if n != expected:
        raise ValueError(f"the source announced {expected} features and gave {n}")
    return df


def xml_dates(raw: DataFrame, column: str) -> DataFrame:
    """(layer, day) of capability documents, newest first within a layer."""
    names = F.xpath(F.col(column), F.lit("//Layer/Name/text()"))
    days = F.xpath(F.col(column), F.lit("//Layer/Dimension/text()"))
    rows = raw.select(F.explode(F.arrays_zip(names.alias("layer"), days.alias("days"))).alias("x")).select("x.layer", F.explode(F.array_distinct(F.split("x.days", ","))).alias("day"))
    return rows.select("layer", F.to_date(F.substring(F.trim("day"), 1, 10)).alias("day")).orderBy("layer", F.desc("day"))


def series_text(raw: DataFrame, column: str) -> DataFrame:
    """(k, value) of a whitespace-separated series; what is no number is null."""
    return raw.select(F.posexplode(F.split(F.trim(F.col(column)), r"\s+")).alias("k", "v")).select("k", F.col("v").try_cast("double").alias("value"))


def locked(paths: DataFrame, folder: str) -> DataFrame:
    """Paths that have the folder as one of their parts."""
    return paths.where(F.array_contains(F.split("path", "/"), folder))


def bounds(width: Column, height: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> Column:
    """Extent of a raster from its corner, cell size (dy is negative downwards) and shape; needs the metadata only."""
    far_x, far_y = x0 + width * dx, y0 + height * dy
    return F.struct(F.least(x0, far_x).alias("minx"), F.least(y0, far_y).alias("miny"), F.greatest(x0, far_x).alias("maxx"), F.greatest(y0, far_y).alias("maxy"))


def quarters(tiles: DataFrame, key: str) -> DataFrame:
    """The four sheets of each tile."""
    return tiles.withColumn("sheet", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.concat(F.col(key).cast("string"), k.cast("string")))))


def day_layer(spark: SparkSession, path: str, layer: str, day: str) -> DataFrame:
    """One day's class cells of a layer, from a table partitioned by both; an absent day is an empty table."""
    return spark.read.parquet(path).where((F.col("layer") == layer) & (F.col("day").cast("string") == day))
