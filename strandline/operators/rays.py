"""Open-water distance along bearings, and its directional means.

A ray's cells are the origin plus offsets shared by all origins. Cells travel once, to their region of their tile and
to each region from which a ray can reach them; a region's rays are then marched together in an Arrow worker, and a ray
that has met land or left the cells' extent takes no more steps. No row for a ray's steps is ever made.
Cells outside the land set are water.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTORS, FAN, STEP_DEG = 12, 45.0, 7.5
ENTER = 4
#: A region's side is 2 ** REGION cells; so many origins are marched at once.
REGION, ORIGINS = 11, 4096


def bearings(spark: SparkSession, step: float = STEP_DEG) -> DataFrame:
    """Unique bearings with their steps in rows (south is positive) and columns."""
    rows = [(float(b), -math.cos(math.radians(b)), math.sin(math.radians(b))) for b in (i * step for i in range(int(360 / step)))]
    return spark.createDataFrame(rows, "bearing double, dr double, dc double")


@lru_cache(maxsize=8)
def offsets(steps: int, step: float = STEP_DEG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bearings, and rows and columns from the origin by step (0 .. steps) and bearing, rounded half to even."""
    b = np.arange(int(360 / step)) * step
    k = np.arange(steps + 1)[:, None]
    dr, dc = (np.array([f(math.radians(x)) for x in b]) for f in (lambda x: -math.cos(x), math.sin))
    return b, *(np.rint(np.round(k * d, 9)).astype(np.int64) for d in (dr, dc))


def march(grid: np.ndarray, heights: np.ndarray, start: np.ndarray, di: np.ndarray, dj: np.ndarray, steps: int, size: float, least: float, look: int) -> tuple[np.ndarray, np.ndarray]:
    """Fetch and obstacle by origin and bearing. ``grid``: 0 for water, else the place of a land cell's height, -1 in a frame
    that is wider than a look ahead. ``start``: flat places of the origins; ``heights`` begin and end with minus infinity."""
    flat, width, n = grid.ravel(), grid.shape[1], di.shape[1]
    enter = np.zeros(len(start) * n, np.int16)
    for k in range(1, ENTER + 1):
        water = flat[(start[:, None] + (di[k] * width + dj[k])).ravel()] <= 0
        enter[water & (enter == 0)] = k
    hit = np.zeros(len(enter), np.int32)
    live = np.flatnonzero(enter)
    base, b, began = start[live // n], live % n, enter[live]
    for k in range(2, steps + 1):
        if not len(live):
            break
        v = flat[base + (di[k] * width + dj[k])[b]]
        on = v > 0
        if k <= ENTER:
            on &= began < k
        hit[live[on]] = k
        stay = ~on & (v >= 0)  # a ray in the frame never comes back
        if not stay.all():
            live, base, b = live[stay], base[stay], b[stay]
            if k <= ENTER:
                began = began[stay]
    fetch = np.where(enter > 0, steps * float(size), float(least))
    obstacle = np.zeros(len(enter))
    met = np.flatnonzero(hit)
    if len(met):
        k, base, b = hit[met], start[met // n], met % n
        fetch[met] = np.maximum((k - enter[met]) * float(size), least)
        reach = (di[: k.max() + look + 1] * width + dj[: k.max() + look + 1]).ravel()
        tall = np.full(len(met), -np.inf)
        for j in range(look + 1):
            np.maximum(tall, heights[flat[base + reach[(k + j) * n + b]]], out=tall)
        obstacle[met] = np.where(np.isneginf(tall), 0.0, tall)  # heights unknown
    return fetch.reshape(-1, n), obstacle.reshape(-1, n)


def _marched(steps: int, size: float, step: float, least: float, look: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = pa.Table.from_batches(list(batches))
        origins = cells.filter(cells.column("origin")).select(["tile", "r", "c"]).combine_chunks()
        if not len(origins):
            return
        b, di, dj = offsets(steps + look, step)
        jump = int(max(np.abs(np.diff(di, axis=0)).max(), np.abs(np.diff(dj, axis=0)).max()))
        frame = max(look + 1, ENTER) * jump
        place = pc.and_(pc.and_(cells.column("tile").is_valid(), cells.column("r").is_valid()), cells.column("c").is_valid())
        cells = cells.filter(place)  # a null is equal to no place
        at = [cells.column(x).to_numpy() for x in ("r", "c")]
        low = [int(x.min()) - frame if len(x) else 0 for x in at]
        shape = [int(x.max()) + frame + 1 - y if len(x) else 1 for x, y in zip(at, low, strict=True)]
        where = (at[0] - low[0]) * shape[1] + (at[1] - low[1])
        land = cells.column("land").to_numpy()
        height = pc.fill_null(cells.column("height").filter(cells.column("land")), -math.inf).to_numpy()
        order = np.argsort(height, kind="stable")  # of a cell's rows the highest counts
        grid = np.full(shape, -1, np.int32)
        if len(land):
            grid[frame:-frame, frame:-frame] = 0
        grid.ravel()[where[land][order]] = np.arange(1, len(order) + 1)
        heights = np.concatenate([[-np.inf], height[order], [-np.inf]])
        known = pc.and_(pc.and_(origins.column("tile").is_valid(), origins.column("r").is_valid()), origins.column("c").is_valid()).to_numpy()
        start = np.zeros(len(origins), np.int64)
        start[known] = where[cells.column("origin").to_numpy()]
        for i in range(0, len(origins), ORIGINS):
            part, sure = origins.slice(i, ORIGINS), known[i : i + ORIGINS]
            fetch, obstacle = np.full((len(part), len(b)), steps * float(size)), np.zeros((len(part), len(b)))
            if sure.any():
                fetch[sure], obstacle[sure] = march(grid, heights, start[i : i + ORIGINS][sure], di, dj, steps, size, least, look)
            rows = part.take(pa.array(np.repeat(np.arange(len(part)), len(b))))
            yield pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in rows.columns), pa.array(np.tile(b, len(part))), pa.array(fetch.ravel()), pa.array(obstacle.ravel())], ["tile", "r", "c", "bearing", "fetch", "obstacle"])

    return run


def ray_fetch(origins: DataFrame | None, land: DataFrame, steps: int, size: float, step: float = STEP_DEG, least: float = 50.0, look: int = 10) -> DataFrame:
    """(tile, r, c, bearing, fetch, obstacle). ``land``: (tile, r, c, height). Without ``origins``, all land cells are. A ray
    that has not met water within ``ENTER`` steps has the least fetch, one that never meets land again the greatest and
    no obstacle."""
    types = dict((land if origins is None else origins).dtypes)
    place = lambda df: [df["tile"], *(df[x].cast("long").alias(x) for x in ("r", "c"))]
    cells = land.select(*place(land), land["height"].cast("double").alias("height"), F.lit(True).alias("land"), F.lit(origins is None).alias("origin"))
    if origins is not None:
        cells = cells.unionAll(origins.select(*place(origins), F.lit(None).cast("double"), F.lit(False), F.lit(True)))
    # regions beyond the extent hold no origins
    extent = cells.agg(*(f(x).alias(f"{x}_{y}") for x in ("r", "c") for f, y in ((F.min, "lo"), (F.max, "hi"))))
    region = lambda x: F.shiftright(x, REGION)
    reach = lambda x: F.when(F.col("land"), steps + look).otherwise(0)
    near = lambda x: F.sequence(region(F.greatest(F.col(x) - reach(x), F.col(f"{x}_lo"))), region(F.least(F.col(x) + reach(x), F.col(f"{x}_hi"))))
    rows = cells.crossJoin(F.broadcast(extent))
    rows = rows.withColumn("pr", F.explode_outer(F.when(F.col("r").isNotNull(), near("r")))).withColumn("pc", F.explode_outer(F.when(F.col("c").isNotNull(), near("c"))))
    own = F.col("pr").eqNullSafe(region("r")) & F.col("pc").eqNullSafe(region("c"))
    rows = rows.select("tile", "r", "c", "height", "land", (F.col("origin") & own).alias("origin"), "pr", "pc")
    out = rows.groupBy("tile", "pr", "pc").applyInArrow(_marched(steps, size, step, least, look), f"tile {types['tile']}, r long, c long, bearing double, fetch double, obstacle double")
    return out.select("tile", *(F.col(x).cast(types[x]).alias(x) for x in ("r", "c")), "bearing", "fetch", "obstacle")


def fan_weights(spark: SparkSession) -> DataFrame:
    """(sector, bearing, w, w2): cosine and its square of each ray of each sector's fan."""
    rows = []
    n = int(FAN / STEP_DEG)
    for s in range(SECTORS):
        for k in range(-n, n + 1):
            w = math.cos(math.radians(k * STEP_DEG))
            rows.append((s, (s * 360.0 / SECTORS + k * STEP_DEG) % 360.0, w, w * w))
    return spark.createDataFrame(rows, "sector int, bearing double, w double, w2 double")


def effective(rays: DataFrame, keys: list[str]) -> DataFrame:
    """Effective fetch sum(F cos^2) / sum(cos) and mean obstacle sum(H cos^2) / sum(cos^2) by sector."""
    fan = F.broadcast(fan_weights(rays.sparkSession))
    return rays.join(fan, "bearing").groupBy(*keys, "sector").agg((F.sum(F.col("fetch") * F.col("w2")) / F.sum("w")).alias("fetch"), (F.sum(F.col("obstacle") * F.col("w2")) / F.sum("w2")).alias("obstacle"))


def halo(cells: DataFrame, region: int, reach: int) -> DataFrame:
    """Cells with every region (square of ``region`` cells) that they belong to or lie within ``reach`` of."""
    near = lambda c: F.sequence(F.floor((F.col(c) - reach) / region), F.floor((F.col(c) + reach) / region))
    out = cells.withColumn("pr", F.explode(near("r"))).withColumn("pc", F.explode(near("c")))
    own: Column = (F.col("pr") == F.floor(F.col("r") / region)) & (F.col("pc") == F.floor(F.col("c") / region))
    return out.withColumn("core", own)


def height_model(cells: DataFrame) -> DataFrame:
    """Height above water: the greater of elevation and measured surface; where unmeasured, vegetation on large islands."""
    return cells.select("*", F.when(F.col("surface").isNotNull(), F.greatest("elev", "surface")).when(F.col("island_cells") >= 100, F.col("elev") + 12.0).otherwise(F.col("elev")).alias("height"))
