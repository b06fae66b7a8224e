"""Block, window and neighbourhood operators on cell tables (tile, r, c)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def block_representative(cells: DataFrame, order: Column, k: int) -> DataFrame:
    """The lower-median buffer cell of each k x k block by ``order``, then place."""
    block = [F.floor(F.col("r") / k).alias("br"), F.floor(F.col("c") / k).alias("bc")]
    rows = cells.where("buffer").select("*", *block, order.cast("float").alias("ord"))
    w = W.partitionBy("tile", "br", "bc")
    rows = rows.withColumn("rn", F.row_number().over(w.orderBy("ord", F.col("r") % k, F.col("c") % k))).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("rn") == F.floor((F.col("n") - 1) / 2) + 1).drop("rn", "n", "ord")


def masked_downsample(cells: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Means over each block's buffer cells; NaN counts on neither side."""
    means = [F.avg(F.when(F.col("buffer") & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in columns]
    return cells.groupBy("tile", F.floor(F.col("r") / k).alias("br"), F.floor(F.col("c") / k).alias("bc")).agg(*means, F.bool_or("buffer").alias("buffer"))


def block_max_mean(cells: DataFrame, k: int, side: int) -> DataFrame:
    """Maximum height and whether half of the cells are bare, for whole blocks (trailing parts are dropped)."""
    whole = cells.where((F.col("r") < side // k * k) & (F.col("c") < side // k * k))
    return whole.groupBy("tile", F.floor(F.col("r") / k).alias("br"), F.floor(F.col("c") / k).alias("bc")).agg(F.max("elev").alias("top"), (F.avg(F.col("rock").cast("int")) >= 0.5).alias("bare"))


def first_hit(cells: DataFrame, k: int) -> DataFrame:
    """The buffer cell nearest each block's centre, the first by place among equals."""
    mid = (k - 1) / 2
    i, j = F.col("r") % k, F.col("c") % k
    rows = cells.where("buffer").select("tile", F.floor(F.col("r") / k).alias("br"), F.floor(F.col("c") / k).alias("bc"), "r", "c", ((i - mid) * (i - mid) + (j - mid) * (j - mid)).alias("d2"), (i * k + j).alias("at"))
    return rows.groupBy("tile", "br", "bc").agg(F.min(F.struct("d2", "at", "r", "c")).alias("best")).select("tile", "br", "bc", F.col("best.r").alias("r"), F.col("best.c").alias("c"))


def gradient(cells: DataFrame, value: str, size: float) -> DataFrame:
    """Slope in degrees by central differences, one-sided at edges and gaps."""

    def along(line: str, axis: str) -> Column:
        w = W.partitionBy("tile", line).orderBy(axis)
        low, high = F.lag(value).over(w), F.lead(value).over(w)
        low = F.when(F.lag(axis).over(w) == F.col(axis) - 1, low)
        high = F.when(F.lead(axis).over(w) == F.col(axis) + 1, high)
        steps = F.when(low.isNotNull() & high.isNotNull(), 2.0).otherwise(1.0)
        return (F.coalesce(high, F.col(value)) - F.coalesce(low, F.col(value))) / (steps * size)

    return cells.select("tile", "r", "c", along("c", "r").alias("dr"), along("r", "c").alias("dc")).select("tile", "r", "c", F.degrees(F.atan(F.hypot("dr", "dc"))).alias("slope"))


def _spread(df: DataFrame, axis: str, radius: int) -> DataFrame:
    return df.withColumn("off", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn(axis, F.col(axis) + F.col("off"))


def nearest_seed(cells: DataFrame, seeds: Column, radius: int) -> DataFrame:
    """Squared distance to the nearest seed cell of the tile within ``radius``, and the smallest seed at it.

    Two passes: every seed spreads along its column, the best of each place spreads along its row; so work is linear in
    seeds times the radius, with an equal-key aggregation each, and a tile without seeds has no rows.
    """
    start = cells.where(seeds).select("tile", F.col("r").cast("long"), F.col("c").cast("long"))
    down = _spread(start.withColumn("sr", F.col("r")), "r", radius).groupBy("tile", "r", "c").agg(F.min(F.struct((F.col("off") * F.col("off")).alias("g"), "sr")).alias("m"))
    across = _spread(down.withColumn("sc", F.col("c")), "c", radius)
    d2 = F.col("m.g") + F.col("off") * F.col("off")
    best = across.groupBy("tile", "r", "c").agg(F.min(F.struct(d2.alias("d2"), F.col("m.sr").alias("sr"), "sc")).alias("b"))
    out = cells.select("tile", "r", "c").join(best, ["tile", "r", "c"])
    return out.where(F.col("b.d2") <= radius * radius).select("tile", "r", "c", F.col("b.d2").cast("long").alias("d2"), "b.sr", "b.sc")


def window_extreme(cells: DataFrame, value: str, radius: int, least: bool = True) -> DataFrame:
    """Smallest (or largest) value within the square of ``radius``, at the cells that have one; separable in two steps."""
    pick = F.min if least else F.max
    rows = _spread(cells.select("tile", "r", "c", F.col(value).alias("v")), "r", radius).groupBy("tile", "r", "c").agg(pick("v").alias("v"))
    w = W.partitionBy("tile", "r").orderBy("c").rangeBetween(-radius, radius)
    rows = rows.withColumn("m", pick("v").over(w))
    return cells.select("tile", "r", "c").join(rows.select("tile", "r", "c", "m"), ["tile", "r", "c"])


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of a round kernel."""
    h = size // 2
    return [(i, j) for i in range(-h, h + 1) for j in range(-h, h + 1) if i * i + j * j <= h * h + h * 0.5]


def dilate(mask: DataFrame, size: int) -> DataFrame:
    """Cells (tile, r, c) that the kernel reaches from a cell of the mask."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ellipse(size)))
    return mask.select("tile", "r", "c", F.explode(offsets).alias("o")).select("tile", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c")).distinct()


def close(mask: DataFrame, size: int, side: int) -> DataFrame:
    """Dilation, then erosion, within tiles of ``side`` cells (outside counts as set for the erosion)."""
    grown = dilate(mask, size).where(F.col("r").between(0, side - 1) & F.col("c").between(0, side - 1))
    n = len(ellipse(size))
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ellipse(size)))
    reach = grown.select("tile", "r", "c", F.explode(offsets).alias("o")).select("tile", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    hit = reach.groupBy("tile", "r", "c").agg(F.count("*").alias("k"))
    outside = sum((F.when((F.col("r") + i).between(0, side - 1) & (F.col("c") + j).between(0, side - 1), 0).otherwise(1) for i, j in ellipse(size)), F.lit(0))
    return hit.where(F.col("r").between(0, side - 1) & F.col("c").between(0, side - 1) & (F.col("k") + outside >= n)).select("tile", "r", "c")


def bilinear_double(cells: DataFrame, value: str) -> DataFrame:
    """Twice the resolution: each new cell mixes its four nearest old ones 9:3:3:1, over those that exist."""
    old = cells.select("tile", "r", "c", F.col(value).alias("v"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(wa * wb).alias("w")) for a, wa in ((-1, 0.25), (0, 0.75), (1, 0.75), (2, 0.25)) for b, wb in ((-1, 0.25), (0, 0.75), (1, 0.75), (2, 0.25))))
    part = old.select("tile", "r", "c", "v", F.explode(steps).alias("s")).select("tile", (F.col("r") * 2 + F.col("s.a")).alias("r"), (F.col("c") * 2 + F.col("s.b")).alias("c"), (F.col("v") * F.col("s.w")).alias("p"), F.col("s.w").alias("w"))
    mixed = part.groupBy("tile", "r", "c").agg((F.sum("p") / F.sum("w")).alias("v"))
    inside = old.select("tile", F.explode(F.array(*(F.struct((F.col("r") * 2 + a).alias("r"), (F.col("c") * 2 + b).alias("c")) for a in (0, 1) for b in (0, 1)))).alias("p")).select("tile", "p.r", "p.c")
    return inside.join(mixed, ["tile", "r", "c"])


def edge_length(land: DataFrame) -> DataFrame:
    """Cell edges between land and not land, by tile: an approximation of the shoreline's length."""
    sides = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    next_ = land.select("tile", F.explode(sides).alias("o"), "r", "c").select("tile", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    return next_.join(land, ["tile", "r", "c"], "left_anti").groupBy("tile").agg(F.count("*").alias("edges"))


def label_components(land: DataFrame) -> DataFrame:
    """8-connected components within each tile: the smallest r * 100000 + c of the component. One tile's cells are one
    group, bounded by the tile's size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(r, c): r * 100_000 + c for r, c in zip(pdf.r.tolist(), pdf.c.tolist(), strict=True)}
        out: dict[tuple[int, int], int] = {}
        for cell in sorted(at):
            if cell in out:
                continue
            stack, label = [cell], at[cell]
            out[cell] = label
            while stack:
                r, c = stack.pop()
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        n = (r + i, c + j)
                        if n in at and n not in out:
                            out[n] = label
                            stack.append(n)
        cells = np.array(list(out), np.int64).reshape(-1, 2)
        return pd.DataFrame({"tile": pdf.tile.iloc[0], "r": cells[:, 0], "c": cells[:, 1], "component": list(out.values())})

    return land.select("tile", "r", "c").groupBy("tile").applyInPandas(run, "tile long, r long, c long, component long")


def mosaic(frame: DataFrame, known: DataFrame, keys: list[str], value: str, default: bool = True) -> DataFrame:
    """``value`` of every cell of ``frame``; cells that nobody knows get the default (unknown is water)."""
    return frame.select(*keys).join(known.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def summary(cells: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, least, mean, most) of each column, without NaN and null."""
    stack = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.nanvl(F.col(c), F.lit(None).cast("double")).alias("v")) for c in columns))).alias("s")
    return cells.select(stack).groupBy("s.name").agg(F.count("s.v").alias("n"), F.min("s.v").alias("least"), F.avg("s.v").alias("mean"), F.max("s.v").alias("most"))
