"""Points, boxes and lines: first covers, overlaps, dirty sets, thinning, grids, simplification and corridors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _blocks(lo: str, hi: str, size: float, pad: float = 0.0) -> Column:
    return F.sequence(F.floor((F.col(lo) - pad) / size), F.floor((F.col(hi) + pad) / size))


def by_block(boxes: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """Each box with every block (bx, by) that it touches after padding: the equal key of spatial joins."""
    return boxes.withColumn("bx", F.explode(_blocks("minx", "maxx", size, pad))).withColumn("by", F.explode(_blocks("miny", "maxy", size, pad)))


def point_block(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("bx", F.floor(F.col("x") / size)).withColumn("by", F.floor(F.col("y") / size))


def first_cover(points: DataFrame, boxes: DataFrame, size: float, tolerance: float = 0.0) -> DataFrame:
    """Each point's first box (by key) that holds it; points without one are dropped."""
    found = point_block(points, size).join(by_block(boxes, size, tolerance), ["bx", "by"])
    inside = F.col("x").between(F.col("minx") - tolerance, F.col("maxx") + tolerance) & F.col("y").between(F.col("miny") - tolerance, F.col("maxy") + tolerance)
    return found.where(inside).groupBy("id").agg(F.min("box").alias("box"))


def near_any(points: DataFrame, boxes: DataFrame, radius: float) -> DataFrame:
    """Points within ``radius`` of any box."""
    dx = F.greatest(F.col("minx") - F.col("x"), F.col("x") - F.col("maxx"), F.lit(0.0))
    dy = F.greatest(F.col("miny") - F.col("y"), F.col("y") - F.col("maxy"), F.lit(0.0))
    size = max(radius, 1.0) * 4
    blocked = by_block(boxes, size, radius)
    return point_block(points, size).join(blocked, ["bx", "by"]).where(dx * dx + dy * dy <= radius * radius).select("id").distinct()


def overlapping(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes that touch a view; four plain comparisons, pushed down to the scan."""
    return boxes.where((F.col("maxx") >= x0) & (F.col("minx") <= x1) & (F.col("maxy") >= y0) & (F.col("miny") <= y1))


def context(boxes: DataFrame, core: DataFrame, margin: float) -> DataFrame:
    """Boxes that overlap (strictly) the bounding box of ``core`` with a margin; the bounding box is one row."""
    b = core.agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.max("maxx").alias("x1"), F.max("maxy").alias("y1"))
    hit = (F.col("minx") < F.col("x1") + margin) & (F.col("maxx") > F.col("x0") - margin) & (F.col("miny") < F.col("y1") + margin) & (F.col("maxy") > F.col("y0") - margin)
    return boxes.join(F.broadcast(b), hit, "left_semi")


def thin(points: DataFrame, importance: Column, cells: tuple[float, ...]) -> DataFrame:
    """Display level of each point: level k for the most important one of each cell of size ``cells[k]`` among those not
    shown before; the last level for the others. Cells taken at one level do not reserve cells of the next."""
    rows = points.withColumn("imp", importance)
    done, rest = None, rows
    for k, size in enumerate(cells):
        w = W.partitionBy(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).orderBy("imp", "id")
        rest = rest.withColumn("rn", F.row_number().over(w))
        now = rest.where("rn = 1").drop("rn").withColumn("z", F.lit(k))
        done, rest = (now if done is None else done.unionByName(now)), rest.where("rn > 1").drop("rn")
    return done.unionByName(rest.withColumn("z", F.lit(len(cells)))).drop("imp")


def grid_means(points: DataFrame, size: float) -> DataFrame:
    return points.groupBy(F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def category(tag: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The first category whose key the value holds."""
    out = F.lit(None).cast("string")
    for key, name in reversed(table):
        out = F.when(F.contains(tag, F.lit(key)), name).otherwise(out)
    return out


def rasterise(rings: DataFrame) -> DataFrame:
    """Cells (id, r, c) whose centre is inside the rings (even-odd, half-open). ``rings``: (id, ring, points array of (x, y))."""
    pts = rings.select("id", "ring", F.posexplode("points").alias("k", "p"))
    w = W.partitionBy("id", "ring").orderBy("k")
    edges = pts.select("id", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.lead("p.x").over(w).alias("x1"), F.lead("p.y").over(w).alias("y1")).where("x1 IS NOT NULL AND y0 <> y1")
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.withColumn("a", F.ceil(lo - 0.5)).withColumn("b", F.ceil(hi - 0.5) - 1).where("a <= b").withColumn("r", F.explode(F.sequence("a", "b")))
    x = F.col("x0") + (F.col("r") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    w = W.partitionBy("id", "r").orderBy("x")
    pairs = rows.select("id", "r", x.alias("x")).withColumn("nx", F.lead("x").over(w)).withColumn("rn", F.row_number().over(w)).where("rn % 2 = 1")
    pairs = pairs.withColumn("a", F.ceil(F.col("x") - 0.5)).withColumn("b", F.ceil(F.col("nx") - 0.5) - 1).where("a <= b")
    return pairs.select("id", "r", F.explode(F.sequence("a", "b")).alias("c"))


def _simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, z = stack.pop()
        if z - a < 2:
            continue
        p, d = points[a + 1 : z] - points[a], points[z] - points[a]
        n = math.hypot(*d)
        away = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / n if n else np.hypot(p[:, 0], p[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, z)]
    return points[keep]


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on (id, points); lines only, topology between features is not kept."""

    def run(batches):
        for pdf in batches:
            out = [[{"x": x, "y": y} for x, y in _simplified(np.array([(p["x"], p["y"]) for p in pts], float), tolerance)] if len(pts) > 2 else list(pts) for pts in pdf.points]
            yield pd.DataFrame({"id": pdf.id, "points": out})

    return lines.select("id", "points").mapInPandas(run, "id long, points array<struct<x:double,y:double>>")


def to_grid(lat: Column, lon: Column, central: float = 27.0, scale: float = 0.9996, east: float = 500_000.0) -> tuple[Column, Column]:
    """Transverse Mercator coordinates on the GRS80 ellipsoid by the Kruger series to the third order."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = math.sqrt(f * (2 - f))
    phi, lam = F.radians(lat), F.radians(lon - central)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, al in enumerate(alpha, 1):
        x = x + al * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + al * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east + scale * radius * x, scale * radius * y


def corridor_sheets(spark: SparkSession, line: list[tuple[float, float]], width: float, size: float) -> DataFrame:
    """Squares (sx, sy) of ``size`` whose centre is within half a width plus half a diagonal of the line."""
    segs = spark.createDataFrame([(*p, *q) for p, q in zip(line[:-1], line[1:], strict=True)], "x0 double, y0 double, x1 double, y1 double")
    reach = width / 2 + size * math.sqrt(2) / 2
    near = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / size), F.floor((F.greatest(a, b) + reach) / size))
    cells = segs.withColumn("sx", F.explode(near("x0", "x1"))).withColumn("sy", F.explode(near("y0", "y1")))
    px, py = (F.col("sx") + 0.5) * size, (F.col("sy") + 0.5) * size
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - F.col("x0")) * dx + (py - F.col("y0")) * dy, dx * dx + dy * dy)))
    t = F.coalesce(t, F.lit(0.0))
    ex, ey = px - F.col("x0") - t * dx, py - F.col("y0") - t * dy
    return cells.where(ex * ex + ey * ey <= reach * reach).select("sx", "sy").distinct()


def clusters(cells: DataFrame) -> DataFrame:
    """8-neighbour components of (x, y) cells: the smallest id reachable, by propagation along equal-key joins until
    nothing changes, however many rounds a long chain takes. Each round is checkpointed."""
    sides = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    state = cells.select("id", "x", "y", F.col("id").alias("label"))
    known = None
    while True:
        reach = state.select("label", F.explode(sides).alias("o"), "x", "y").select("label", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
        least = reach.groupBy("x", "y").agg(F.min("label").alias("label"))
        state = state.drop("label").join(least, ["x", "y"]).select("id", "x", "y", "label").checkpoint()
        total = state.agg(F.sum("label")).first()[0]
        if total == known:
            return state.select("id", F.col("label").alias("cluster"))
        known = total


def cluster_boxes(members: DataFrame, margin: float) -> DataFrame:
    """Bounding box of each cluster of ``members (cluster, x, y)``, widened by a margin, and its size."""
    return members.groupBy("cluster").agg(F.count("*").alias("n"), *((f(F.col(v)) + m).alias(name) for f, v, m, name in ((F.min, "x", -margin, "minx"), (F.min, "y", -margin, "miny"), (F.max, "x", margin, "maxx"), (F.max, "y", margin, "maxy"))))


def clip_to_blocks(boxes: DataFrame, size: float) -> DataFrame:
    """Each box's part in every block that it overlaps, by block keys rather than by comparing all pairs."""
    rows = by_block(boxes, size)
    low = lambda b, v: F.greatest(F.col(v), F.col(b) * size)
    high = lambda b, v: F.least(F.col(v), (F.col(b) + 1) * size)
    return rows.withColumns({"minx": low("bx", "minx"), "miny": low("by", "miny"), "maxx": high("bx", "maxx"), "maxy": high("by", "maxy")}).where("minx < maxx AND miny < maxy")


def distinct_geometries(rows: DataFrame, key: str, geometry: Column) -> DataFrame:
    """The row with the smallest key of each geometry, told apart by a 128-bit hash of its coordinates."""
    best = rows.groupBy(F.md5(geometry).alias("_hash")).agg(F.min(key).alias(key), F.count("*").alias("copies"))
    return best.select(key, "copies")


def attributes(fields: dict[str, Column]) -> Column:
    """Map of the fields that are neither null nor blank."""
    entries = [x for name, c in fields.items() for x in (F.lit(name), c.cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull() & (F.trim(v) != ""))


def rounded(points: Column, digits: int) -> Column:
    """Coordinates rounded half to even."""
    return F.transform(points, lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))
