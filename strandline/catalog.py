"""Registered queries over the star-schema tables, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec as C
from .functions import scoring as S
from .operators import incremental, pointcloud, ranking, raster, rays, series, transect, vector
from .plans import views as V
from .sources import scans, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Pieces of DuckDB SQL.
SLOPE = "CASE WHEN slope_deg <= 5 THEN 1.0::DOUBLE WHEN slope_deg >= 20 THEN 0.0::DOUBLE ELSE (20.0::DOUBLE - slope_deg) / 15.0::DOUBLE END"
DIST = "CASE WHEN dist_m < 20 THEN 0.0::DOUBLE WHEN dist_m > 150 THEN 1.0::DOUBLE ELSE (dist_m - 20.0::DOUBLE) / 130.0::DOUBLE END"
TIE = "(0.5::DOUBLE * least(greatest(1.0::DOUBLE - slope_deg / 90.0::DOUBLE, 0), 1) + 0.35::DOUBLE * least(greatest(dist_m / 1000.0::DOUBLE, 0), 1)) / (0.5::DOUBLE + 0.35::DOUBLE)"
SCORED = f"scored AS (SELECT *, {SLOPE} AS s, {DIST} AS d, {TIE} AS t FROM pixels)"
TOTAL = "(0.5::DOUBLE * s + 0.35::DOUBLE * d + 0.15::DOUBLE * CASE WHEN rock THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END) * CASE WHEN swamp THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
RANKED = f"{V.PIXELS}, {SCORED}, ranked AS (SELECT *, {TOTAL} + 1e-4::DOUBLE * t AS rank FROM scored WHERE buffer)"
BYTES = f"{V.PIXELS}, {SCORED}, bytes AS (SELECT *, trunc(s * 255)::INTEGER AS slope_b, trunc(d * 255)::INTEGER AS dist_b, trunc(t * 255)::INTEGER AS tie_b FROM scored WHERE buffer)"


def _mask_sql(shelter: bool = False) -> str:
    extra_t = " + CASE WHEN mask & 16 <> 0 THEN 0.7::DOUBLE * 1.0::DOUBLE ELSE 0 END" if shelter else ""
    extra_w = " + CASE WHEN mask & 16 <> 0 THEN 0.7::DOUBLE ELSE 0 END" if shelter else ""
    total = "(CASE WHEN mask & 1 <> 0 THEN 0.5::DOUBLE * (slope_b / 255.0::DOUBLE) ELSE 0 END + CASE WHEN mask & 2 <> 0 THEN 0.35::DOUBLE * (dist_b / 255.0::DOUBLE) ELSE 0 END + CASE WHEN mask & 4 <> 0 THEN 0.15::DOUBLE * CASE WHEN rock THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END ELSE 0 END" + extra_t + ")"
    weight = "(CASE WHEN mask & 1 <> 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN mask & 2 <> 0 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN mask & 4 <> 0 THEN 0.15::DOUBLE ELSE 0 END" + extra_w + ")"
    base = f"CASE WHEN {weight} > 0 THEN {total} / {weight} ELSE 1.0::DOUBLE END"
    return f"least(greatest(({base}) * CASE WHEN mask & 8 <> 0 AND swamp THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 0), 1)"


def _masks_sql(masks: str, shelter: bool = False) -> str:
    return f"{BYTES}, masked AS (SELECT *, {_mask_sql(shelter)} AS score FROM bytes, (SELECT unnest({masks})::INTEGER AS mask))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


# --- scores -------------------------------------------------------------------------------------------------------


@query(f"WITH {V.PIXELS}, {SCORED} SELECT tile, r, c, round(s, 9) AS slope, round(d, 9) AS dist, round((0.5::DOUBLE * s + 0.35::DOUBLE * d) / (0.5::DOUBLE + 0.35::DOUBLE), 9) AS partial, round({TOTAL}, 9) AS total FROM scored")
def slope_dist_scores(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    s, d = S.slope_score(F.col("slope_deg")), S.dist_score(F.col("dist_m"))
    return px.select("tile", "r", "c", _r(s, 9).alias("slope"), _r(d, 9).alias("dist"), _r(S.partial_score(s, d), 9).alias("partial"), _r(S.total_score(s, d, F.col("rock"), F.col("swamp")), 9).alias("total"))


@query(f"WITH {RANKED} SELECT tile, r, c, round(t, 9) AS tie, round(rank, 9) AS rank FROM ranked")
def tiebreak_rank(spark, sf_dir):
    px = V.pixels(spark, sf_dir).where("buffer")
    return px.select("tile", "r", "c", _r(S.tiebreak(F.col("slope_deg"), F.col("dist_m")), 9).alias("tie"), _r(ranking.rank_score(px), 9).alias("rank"))


_LN = f"(ln(least(greatest(dist_m * 60, 50), 15000)) - {math.log(50.0)!r}) / {math.log(15000.0) - math.log(50.0)!r}"


@query(f"WITH {BYTES} SELECT tile, r, c, slope_b, dist_b, tie_b, least(greatest(round_even({_LN} * 15, 0), 0), 15)::INTEGER AS fetch_q, round_even(least(greatest(elev, 0), 20) / 20.0::DOUBLE * 15, 0)::INTEGER AS obstacle_q FROM bytes")
def quantise_bytes(spark, sf_dir):
    px = ranking.with_components(V.pixels(spark, sf_dir).where("buffer"))
    return px.select("tile", "r", "c", "slope_b", "dist_b", "tie_b", C.fetch_level(F.col("dist_m") * 60).alias("fetch_q"), C.obstacle_level(F.col("elev")).alias("obstacle_q"))


@query(f"WITH {_masks_sql('range(1, 16)')} SELECT mask, count(*) AS n, round(sum(score), 4) AS total, round(min(score), 9) AS least, round(max(score), 9) AS most FROM masked GROUP BY 1")
def mask_scores(spark, sf_dir):
    px = ranking.with_components(V.pixels(spark, sf_dir).where("buffer")).withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit(15))))
    score = S.mask_score(F.col("mask"), F.col("slope_b"), F.col("dist_b"), F.col("rock"), F.col("swamp"))
    return px.groupBy("mask").agg(F.count("*").alias("n"), _r(F.sum(score), 4).alias("total"), _r(F.min(score), 9).alias("least"), _r(F.max(score), 9).alias("most"))


_SHARES = "[" + ", ".join(f"{1 - p / 100!r}::DOUBLE" for p in range(1, 11)) + "]"


def _threshold_sql(masks: str, shelter: bool = False) -> str:
    return f"WITH {_masks_sql(masks, shelter)}, q AS (SELECT mask, quantile_cont(score + 1e-4::DOUBLE * (tie_b / 255.0::DOUBLE), {_SHARES}) AS q FROM masked GROUP BY 1) SELECT mask, k::INTEGER AS pct, round(q[k], 9) AS threshold FROM q, (SELECT unnest(range(1, 11)) AS k)"


@query(_threshold_sql("range(1, 16)"))
def factor_thresholds(spark, sf_dir):
    return ranking.factor_thresholds(V.pixels(spark, sf_dir)).withColumn("threshold", _r("threshold", 9))


@query(_threshold_sql("range(16, 32)", True))
def shelter_thresholds(spark, sf_dir):
    return ranking.factor_thresholds(V.pixels(spark, sf_dir), range(16, 32), shelter=True).withColumn("threshold", _r("threshold", 9))


@query(f"WITH {RANKED} SELECT round(coalesce(quantile_cont(rank, 0.93), 1), 9) AS threshold FROM ranked")
def global_threshold(spark, sf_dir):
    return ranking.global_threshold(V.pixels(spark, sf_dir), 7).select(_r("threshold", 9).alias("threshold"))


@query(f"WITH {_masks_sql('range(1, 16)')} SELECT mask, least(floor(score * 25), 24)::INTEGER AS bin, count(*) AS n FROM masked GROUP BY 1, 2")
def shoreline_hist(spark, sf_dir):
    return ranking.histogram(V.pixels(spark, sf_dir))


@query(f"WITH {RANKED}, x AS (SELECT tile, r, c, round(t, 12) AS v FROM ranked) SELECT tile, r, c, trunc(cume_dist() OVER (ORDER BY v) * 255)::INTEGER AS rank_b FROM x")
def rank_byte(spark, sf_dir):
    return ranking.byte_rank(V.pixels(spark, sf_dir), _r(S.tiebreak(F.col("slope_deg"), F.col("dist_m")), 12), ["tile", "r", "c"])


@query(f"WITH {RANKED}, th AS (SELECT quantile_cont(rank, 0.93) AS q FROM ranked) SELECT tile, r, c FROM ranked, th WHERE rank >= q")
def top_percent_select(spark, sf_dir):
    return ranking.top_share(V.pixels(spark, sf_dir), 7)


@query(f"WITH {V.PIXELS}, b AS (SELECT tile, r, c, row_number() OVER (PARTITION BY tile ORDER BY r, c) - 1 AS k, count(*) OVER (PARTITION BY tile) AS n FROM pixels WHERE buffer) SELECT tile, r, c FROM b WHERE k % greatest(1, n // 50) = 0")
def percentile_markers(spark, sf_dir):
    return ranking.markers(V.pixels(spark, sf_dir), 50)


# --- blocks and neighbourhoods --------------------------------------------------------------------------------------


@query(f"WITH {RANKED}, x AS (SELECT *, row_number() OVER (PARTITION BY tile, r // 4, c // 4 ORDER BY rank::FLOAT, r % 4, c % 4) AS rn, count(*) OVER (PARTITION BY tile, r // 4, c // 4) AS n FROM ranked) SELECT tile, r, c, round(slope_deg, 6) AS slope_deg FROM x WHERE rn = (n - 1) // 2 + 1")
def block_representative(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    return raster.block_representative(px, ranking.rank_score(px), 4).select("tile", "r", "c", _r("slope_deg").alias("slope_deg"))


@query(f"WITH {V.PIXELS} SELECT tile, r // 2 AS br, c // 2 AS bc, round(avg(slope_deg) FILTER (buffer), 6) AS slope_deg, round(avg(dist_m) FILTER (buffer), 6) AS dist_m, bool_or(buffer) AS buffer FROM pixels GROUP BY 1, 2, 3")
def masked_downsample(spark, sf_dir):
    out = raster.masked_downsample(V.pixels(spark, sf_dir), ["slope_deg", "dist_m"], 2)
    return out.select("tile", "br", "bc", _r("slope_deg").alias("slope_deg"), _r("dist_m").alias("dist_m"), "buffer")


@query(f"WITH {V.PIXELS} SELECT tile, r // 5 AS br, c // 5 AS bc, round(max(elev), 6) AS top, avg(rock::INTEGER) >= 0.5 AS bare FROM pixels WHERE r < 20 AND c < 20 GROUP BY 1, 2, 3")
def block_max_mean(spark, sf_dir):
    return raster.block_max_mean(V.pixels(spark, sf_dir), 5, V.SIDE).withColumn("top", _r("top"))


@query(f"WITH {V.PIXELS}, x AS (SELECT tile, r // 5 AS br, c // 5 AS bc, r, c, row_number() OVER (PARTITION BY tile, r // 5, c // 5 ORDER BY (r % 5 - 2) * (r % 5 - 2) + (c % 5 - 2) * (c % 5 - 2), (r % 5) * 5 + c % 5) AS rn FROM pixels WHERE buffer) SELECT tile, br, bc, r, c FROM x WHERE rn = 1")
def native_cell_pick(spark, sf_dir):
    return raster.first_hit(V.pixels(spark, sf_dir), 5)


_GRAD = """WITH {p}, g AS (SELECT a.tile, a.r, a.c,
  (coalesce(d.elev, a.elev) - coalesce(u.elev, a.elev)) / (CASE WHEN d.elev IS NOT NULL AND u.elev IS NOT NULL THEN 2 ELSE 1 END * 2.0::DOUBLE) AS dr,
  (coalesce(e.elev, a.elev) - coalesce(w.elev, a.elev)) / (CASE WHEN e.elev IS NOT NULL AND w.elev IS NOT NULL THEN 2 ELSE 1 END * 2.0::DOUBLE) AS dc
  FROM pixels a LEFT JOIN pixels u ON u.tile = a.tile AND u.r = a.r - 1 AND u.c = a.c LEFT JOIN pixels d ON d.tile = a.tile AND d.r = a.r + 1 AND d.c = a.c
  LEFT JOIN pixels w ON w.tile = a.tile AND w.r = a.r AND w.c = a.c - 1 LEFT JOIN pixels e ON e.tile = a.tile AND e.r = a.r AND e.c = a.c + 1)
SELECT tile, r, c, round(degrees(atan(sqrt(dr * dr + dc * dc))), 6) AS slope FROM g"""


@query(_GRAD.format(p=V.PIXELS))
def slope_gradient(spark, sf_dir):
    return raster.gradient(V.pixels(spark, sf_dir), "elev", 2.0).select("tile", "r", "c", _r("slope").alias("slope"))


_SEEDS = "seeds AS (SELECT tile, r, c FROM pixels WHERE slope_deg <= 1 AND rock)"
_NEAR = f"""{V.PIXELS}, {_SEEDS}, near AS (SELECT p.tile, p.r, p.c, (p.r - s.r) * (p.r - s.r) + (p.c - s.c) * (p.c - s.c) AS d2, s.r AS sr, s.c AS sc
  FROM pixels p JOIN seeds s ON p.tile = s.tile AND abs(p.r - s.r) <= 4 AND abs(p.c - s.c) <= 4)"""


def _seeds():
    return (F.col("slope_deg") <= 1) & F.col("rock")


_NEAREST = f"{_NEAR}, nearest AS (SELECT tile, r, c, d2, sr, sc FROM (SELECT *, row_number() OVER (PARTITION BY tile, r, c ORDER BY d2, sr, sc) AS rn FROM near) WHERE rn = 1 AND d2 <= 16)"


@query(f"WITH {_NEAREST} SELECT tile, r, c, d2, sr, sc FROM nearest")
def nearest_seed(spark, sf_dir):
    return raster.nearest_seed(V.pixels(spark, sf_dir), _seeds(), 4).select("tile", "r", "c", "d2", "sr", "sc")


@query(f"WITH {_NEAR} SELECT tile, r, c FROM near JOIN pixels USING (tile, r, c) WHERE NOT swamp GROUP BY 1, 2, 3 HAVING min(d2) BETWEEN 1 AND 9")
def buffer_zone(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    return raster.nearest_seed(px, _seeds(), 3).where("d2 >= 1").join(px.where("NOT swamp").select("tile", "r", "c"), ["tile", "r", "c"], "left_semi").select("tile", "r", "c")


@query(f"WITH {V.PIXELS}, x AS (SELECT tile, r, slope_deg AS v FROM pixels), y AS (SELECT tile, r, v, row_number() OVER (PARTITION BY tile, r ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY tile, r) AS n FROM x) SELECT tile, r, v AS slope_deg FROM y WHERE k = ((n - 1) * 10) // 100")
def grouped_p10(spark, sf_dir):
    return transect.lower_percentile(V.pixels(spark, sf_dir), ["tile", "r"], "slope_deg", 10)


@query(f"WITH {V.PIXELS} SELECT a.tile, a.r, a.c, min(b.slope_deg) AS m FROM pixels a JOIN pixels b ON a.tile = b.tile AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY 1, 2, 3")
def alongshore_min(spark, sf_dir):
    return raster.window_extreme(V.pixels(spark, sf_dir), "slope_deg", 2)


#: Zone cells, and the lower percentile of each strip with its least value alongshore, for a column of ``zone``.
_ZONE = f"{_NEAREST}, zone AS (SELECT n.tile, n.r, n.c, sr, sc, slope_deg, s AS slope, d AS dist, rock::INTEGER::DOUBLE AS rock, (NOT swamp)::INTEGER::DOUBLE AS not_swamp FROM nearest n JOIN scored p ON p.tile = n.tile AND p.r = n.r AND p.c = n.c WHERE d2 >= 1)".replace(", near AS", f", {SCORED}, near AS")


def _strip(column: str) -> str:
    return f"""p_{column} AS (SELECT tile, sr, sc, v FROM (SELECT tile, sr, sc, {column} AS v, row_number() OVER (PARTITION BY tile, sr, sc ORDER BY {column}) - 1 AS k, count(*) OVER (PARTITION BY tile, sr, sc) AS n FROM zone) WHERE k = ((n - 1) * 10) // 100),
w_{column} AS (SELECT a.tile, a.sr, a.sc, min(b.v) AS {column} FROM p_{column} a JOIN p_{column} b ON a.tile = b.tile AND abs(a.sr - b.sr) <= 2 AND abs(a.sc - b.sc) <= 2 GROUP BY 1, 2, 3)"""


_PRIMES = f"{_ZONE}, {', '.join(_strip(c) for c in transect.COMPONENTS)}, primes AS (SELECT z.tile, z.r, z.c, w_slope.slope, w_dist.dist, w_rock.rock, w_not_swamp.not_swamp FROM (SELECT tile, r, c, sr, sc FROM zone) z " + " ".join(f"JOIN w_{c} USING (tile, sr, sc)" for c in transect.COMPONENTS) + ")"
_PRIME_BYTES = f"{_PRIMES}, prime_bytes AS (SELECT tile, r, c, trunc(slope * 255)::INTEGER AS slope_b, trunc(dist * 255)::INTEGER AS dist_b, rock >= 0.5 AS rock, not_swamp < 0.5 AS swamp FROM primes)"


@query(f"WITH {_ZONE} SELECT tile, r, c, sr, sc FROM zone")
def strip_zone(spark, sf_dir):
    return transect.strips(V.pixels(spark, sf_dir), _seeds(), 1, 4).select("tile", "r", "c", "sr", "sc")


@query(f"WITH {_PRIMES} SELECT tile, r, c, round(slope, 9) AS slope, round(dist, 9) AS dist, rock, not_swamp FROM primes")
def prime_components(spark, sf_dir):
    return transect.prime_components(V.pixels(spark, sf_dir), _seeds()).select("tile", "r", "c", _r("slope", 9).alias("slope"), _r("dist", 9).alias("dist"), "rock", "not_swamp")


@query(f"WITH {_PRIME_BYTES} SELECT tile, r, c, slope_b, dist_b, rock, swamp FROM prime_bytes")
def prime_bytes(spark, sf_dir):
    return transect.prime_bytes(transect.prime_components(V.pixels(spark, sf_dir), _seeds()))


@query(f"WITH {_PRIME_BYTES}, ties AS (SELECT tile, r, c, trunc(t * 255)::INTEGER AS tie_b FROM scored), masked AS (SELECT *, {_mask_sql()} AS score FROM prime_bytes JOIN ties USING (tile, r, c), (SELECT unnest(range(1, 16))::INTEGER AS mask)), q AS (SELECT mask, quantile_cont(score + 1e-4::DOUBLE * (tie_b / 255.0::DOUBLE), {_SHARES}) AS q FROM masked GROUP BY 1) SELECT mask, k::INTEGER AS pct, round(q[k], 9) AS threshold FROM q, (SELECT unnest(range(1, 11)) AS k)")
def prime_thresholds(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    primes = transect.prime_bytes(transect.prime_components(px, _seeds()))
    return ranking.prime_thresholds(primes, px).withColumn("threshold", _r("threshold", 9))


@query(f"WITH {_ZONE}, {_strip('slope_deg')} SELECT z.tile, z.r, z.c, w_slope_deg.slope_deg FROM (SELECT tile, r, c, sr, sc FROM zone) z JOIN w_slope_deg USING (tile, sr, sc)")
def prime_strips(spark, sf_dir):
    return transect.prime(V.pixels(spark, sf_dir), _seeds(), "slope_deg")


@query(f"WITH {V.PIXELS}, l AS (SELECT tile, r, c FROM pixels WHERE rock), n AS (SELECT tile, r + i AS r, c + j AS c FROM l, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(i, j)) SELECT n.tile, count(*) AS edges FROM n LEFT JOIN l ON n.tile = l.tile AND n.r = l.r AND n.c = l.c WHERE l.tile IS NULL GROUP BY 1")
def edge_count_length(spark, sf_dir):
    return raster.edge_length(V.pixels(spark, sf_dir).where("rock").select("tile", "r", "c"))


_KERNEL = ", ".join(f"({i}, {j})" for i, j in raster.ellipse(3))


@query(f"WITH {V.PIXELS}, k(i, j) AS (VALUES {_KERNEL}) SELECT DISTINCT tile, r + i AS r, c + j AS c FROM pixels, k WHERE swamp")
def dilation(spark, sf_dir):
    return raster.dilate(V.pixels(spark, sf_dir).where("swamp").select("tile", "r", "c"), 3)


@query(f"""WITH {V.PIXELS}, k(i, j) AS (VALUES {_KERNEL}),
g AS (SELECT DISTINCT tile, r + i AS r, c + j AS c FROM pixels, k WHERE swamp AND r + i BETWEEN 0 AND 23 AND c + j BETWEEN 0 AND 23),
a AS (SELECT tile, r, c, i, j FROM g, k), s AS (SELECT a.tile, a.r, a.c, count(*) AS n FROM a JOIN g ON g.tile = a.tile AND g.r = a.r + i AND g.c = a.c + j GROUP BY 1, 2, 3),
o AS (SELECT tile, r, c, count(*) FILTER (r + i BETWEEN 0 AND 23 AND c + j BETWEEN 0 AND 23) AS n FROM a GROUP BY 1, 2, 3)
SELECT tile, r, c FROM s JOIN o USING (tile, r, c, n)""")
def closing(spark, sf_dir):
    return raster.close(V.pixels(spark, sf_dir).where("swamp").select("tile", "r", "c"), 3, V.SIDE)


@query(f"""WITH {V.PIXELS}, s(a, wa) AS (VALUES (-1, 0.25::DOUBLE), (0, 0.75), (1, 0.75), (2, 0.25)), p AS (SELECT tile, 2 * r + x.a AS r, 2 * c + y.a AS c, elev * (x.wa * y.wa) AS v, x.wa * y.wa AS w FROM pixels, s x, s y),
m AS (SELECT tile, r, c, sum(v) / sum(w) AS v FROM p GROUP BY 1, 2, 3), n AS (SELECT tile, 2 * r + a AS r, 2 * c + b AS c FROM pixels, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b)) SELECT tile, r, c, round(v, 6) AS v FROM m JOIN n USING (tile, r, c)""")
def bilinear_resample(spark, sf_dir):
    return raster.bilinear_double(V.pixels(spark, sf_dir), "elev").withColumn("v", _r("v"))


@query()
def land_components(spark, sf_dir):
    return raster.label_components(V.pixels(spark, sf_dir).where("swamp"))


@query(f"WITH {V.PIXELS} SELECT tile, count(*) AS n, round(100.0::DOUBLE * avg(rock::INTEGER), 6) AS rock_pct, round(100.0::DOUBLE * avg(swamp::INTEGER), 6) AS swamp_pct, count(*) FILTER (buffer) AS buffer_px, bool_and(buffer) OR NOT bool_or(buffer) AS shoreless FROM pixels GROUP BY 1")
def tile_stats(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    pct = lambda c: _r(100.0 * F.avg(F.col(c).cast("int")))
    return px.groupBy("tile").agg(F.count("*").alias("n"), pct("rock").alias("rock_pct"), pct("swamp").alias("swamp_pct"), F.count_if("buffer").alias("buffer_px"), (F.bool_and("buffer") | ~F.bool_or("buffer")).alias("shoreless"))


@query(f"WITH {BYTES} SELECT tile, r, c, rock::INTEGER + 2 * swamp::INTEGER AS bits, ((slope_b % 16) << 4) | (dist_b % 16) AS pair, ((((slope_b % 16) << 4) | (dist_b % 16)) >> 4) & 15 AS high FROM bytes")
def nibble_pack(spark, sf_dir):
    px = ranking.with_components(V.pixels(spark, sf_dir).where("buffer"))
    pair = C.nibbles(F.col("slope_b") % 16, F.col("dist_b") % 16)
    return px.select("tile", "r", "c", (F.col("rock").cast("int") + 2 * F.col("swamp").cast("int")).alias("bits"), pair.alias("pair"), C.high_nibble(pair).alias("high"))


@query()
def hsv_masks(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    colours = [((37 * i) % 256, (91 * i + 40) % 256, (173 * i + 90) % 256) for i in range(64)]
    h = S.hsv(*scans.palette((F.col("r") * 7 + F.col("c")) % 64, colours))
    return px.select("tile", "r", "c", h[0].alias("h"), h[1].alias("s"), h[2].alias("v"), S.within(h, (90, 40, 40), (130, 255, 255)).alias("water"))


@query()
def packed_images(spark, sf_dir):
    px = ranking.with_components(V.pixels(spark, sf_dir))
    cells = px.select("tile", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("slope_b").alias("red"), F.col("dist_b").alias("green"), (F.col("rock").cast("int") + 2 * F.col("swamp").cast("int")).alias("blue"), F.when(F.col("buffer"), 255).otherwise(0).alias("alpha"))
    return sinks.packed_tiles(cells, V.SIDE).select("tile", F.length("png").alias("bytes"), F.substring("png", 1, 8).alias("magic"))


# --- waves and rays -------------------------------------------------------------------------------------------------

_EV = "e AS (SELECT event_id, 50 + value * 20 AS f, value / 25 AS u, value / 20 AS g, (event_id % 9)::DOUBLE AS h FROM events)"
_LEE = "{u} * CASE WHEN h > 0 THEN 1.0::DOUBLE - 0.6::DOUBLE * exp(-(f / 2.0::DOUBLE) / (8.0::DOUBLE * h)) ELSE 1.0::DOUBLE END"


def _ladder_sql(v: str, a: float, b: float, c: float) -> str:
    return f"CASE WHEN {v} < {a} THEN {v} / {a}::DOUBLE WHEN {v} < {b} THEN 1 + ({v} - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE) WHEN {v} < {c} THEN 2 + ({v} - {b}::DOUBLE) / ({c}::DOUBLE - {b}::DOUBLE) ELSE 3 END"


def _waves(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    return ev.select("event_id", (50 + F.col("value") * 20).alias("f"), (F.col("value") / 25).alias("u"), (F.col("value") / 20).alias("g"), (F.col("event_id") % 9).cast("double").alias("h"))


@query(f"WITH {_EV}, w AS (SELECT *, 5.1e-4::DOUBLE * {_LEE.format(u='u')} * sqrt(f) AS hs FROM e) SELECT event_id, round(least(greatest((0.30::DOUBLE - hs) / (0.30::DOUBLE - 0.05::DOUBLE), 0), 1), 6) AS shelter FROM w")
def shelter_score(spark, sf_dir):
    return _waves(spark, sf_dir).select("event_id", _r(S.shelter_score(F.col("f"), F.col("u"), F.col("h"))).alias("shelter"))


@query(f"WITH {_EV}, w AS (SELECT *, 5.1e-4::DOUBLE * {_LEE.format(u='u')} * sqrt(f) AS hs, {_LEE.format(u='g')} AS ge FROM e) SELECT event_id, round(greatest({_ladder_sql('hs', 0.2, 0.4, 0.7)}, {_ladder_sql('ge', 8.0, 12.0, 16.0)}) / 3.0::DOUBLE, 9) AS difficulty FROM w")
def paddle_difficulty(spark, sf_dir):
    return _waves(spark, sf_dir).select("event_id", _r(S.paddle_difficulty(F.col("f"), F.col("u"), F.col("g"), F.col("h")), 9).alias("difficulty"))


_METRES = "[" + ", ".join(f"{m!r}::DOUBLE" for m in S.FETCH_METRES) + "]"


@query(f"WITH b AS (SELECT event_id, (value * 3) % 360 / 30.0::DOUBLE AS pos FROM events), i AS (SELECT *, floor(pos)::BIGINT % 12 AS lo FROM b), l AS (SELECT *, {_METRES}[(event_id + lo * 5) % 16 + 1] AS a, {_METRES}[(event_id + ((lo + 1) % 12) * 5) % 16 + 1] AS z FROM i) SELECT event_id, round(a + (z - a) * (pos - floor(pos)), 9) AS fetch FROM l")
def circular_interp(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    levels = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: ((F.col("event_id") + k * 5) % 16).cast("int"))
    return ev.select("event_id", _r(S.fetch_at(levels, (F.col("value") * 3) % 360), 9).alias("fetch"))


@query()
def ray_fetch(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    land = px.where("swamp OR elev >= 7").select("tile", "r", "c", F.col("elev").alias("height"))
    return rays.ray_fetch(None, land, steps=1500, size=10.0)


@query("""WITH b AS (SELECT unnest(range(0, 48)) * 7.5::DOUBLE AS bearing), t AS (SELECT p_partkey, bearing, 50 + (p_partkey * 7 + bearing * 10) % 14950 AS f, (p_partkey % 21)::DOUBLE AS obstacle FROM part, b),
f AS (SELECT s AS sector, (s * 30.0::DOUBLE + k * 7.5::DOUBLE + 360) % 360 AS bearing, cos(radians(k * 7.5::DOUBLE)) AS w FROM (SELECT unnest(range(0, 12))::INTEGER AS s), (SELECT unnest(range(-6, 7)) AS k))
SELECT p_partkey, sector, round(sum(f * w * w) / sum(w), 4) AS metres, round(sum(obstacle * w * w) / sum(w * w), 6) AS obstacle FROM t JOIN f USING (bearing) GROUP BY 1, 2""")
def effective_fetch(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select("p_partkey")
    rows = part.crossJoin(F.broadcast(rays.bearings(spark).select("bearing")))  # 48 bearings
    rows = rows.select("p_partkey", "bearing", (50 + (F.col("p_partkey") * 7 + F.col("bearing") * 10) % 14950).alias("fetch"), (F.col("p_partkey") % 21).cast("double").alias("obstacle"))
    return rays.effective(rows, ["p_partkey"]).select("p_partkey", "sector", _r("fetch", 4).alias("metres"), _r("obstacle").alias("obstacle"))


@query(f"""WITH {V.PIXELS}, p AS (SELECT tile, r, c, unnest(range(floor((r - 3) / 8.0)::BIGINT, floor((r + 3) / 8.0)::BIGINT + 1)) AS pr FROM pixels), q AS (SELECT *, unnest(range(floor((c - 3) / 8.0)::BIGINT, floor((c + 3) / 8.0)::BIGINT + 1)) AS pc FROM p)
SELECT tile, pr, pc, count(*) AS n, count(*) FILTER (pr = r // 8 AND pc = c // 8) AS core FROM q GROUP BY 1, 2, 3""")
def halo_regions(spark, sf_dir):
    out = rays.halo(V.pixels(spark, sf_dir).select("tile", "r", "c"), 8, 3)
    return out.groupBy("tile", "pr", "pc").agg(F.count("*").alias("n"), F.count_if("core").alias("core"))


# --- series ---------------------------------------------------------------------------------------------------------


@query(f"WITH {V.OBS}, x AS (SELECT *, date_diff('day', ts::DATE, DATE '2024-01-30') AS age FROM obs), y AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY age, layer, event_id) AS rn FROM x WHERE age BETWEEN 0 AND 6) SELECT cell, cls, age::INTEGER AS age, layer FROM y WHERE rn = 1")
def freshest_composite(spark, sf_dir):
    return series.freshest(V.obs(spark, sf_dir), F.lit("2024-01-30").cast("date"), 7)


_HOURLY = "hourly AS (SELECT station AS cell, date_trunc('hour', ts) AS hour, round(avg(wind), 6) AS wind FROM obs GROUP BY 1, 2)"


def _hourly(spark, sf_dir):
    return V.obs(spark, sf_dir).groupBy(F.col("station").alias("cell"), F.date_trunc("hour", "ts").alias("hour")).agg(_r(F.avg("wind")).alias("wind"))


@query(f"""WITH {V.OBS}, st AS (SELECT date_trunc('day', ts) AS hour, (station * 13 % 12) * 5.0::DOUBLE AS x, (station * 5 % 12) * 5.0::DOUBLE AS y, round(avg(wind), 6) AS wind FROM obs GROUP BY 1, 2, 3),
p AS (SELECT s_suppkey AS id, s_acctbal / 200 AS x, (s_suppkey % 60)::DOUBLE AS y FROM supplier)
SELECT id, hour, round(sum(st.wind / greatest((p.x - st.x) * (p.x - st.x) + (p.y - st.y) * (p.y - st.y), 1)) / sum(1 / greatest((p.x - st.x) * (p.x - st.x) + (p.y - st.y) * (p.y - st.y), 1)), 5) AS wind FROM p, st GROUP BY 1, 2""")
def idw_wind(spark, sf_dir):
    day = V.obs(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("hour"), ((F.col("station") * 13 % 12) * 5.0).alias("x"), ((F.col("station") * 5 % 12) * 5.0).alias("y")).agg(_r(F.avg("wind")).alias("wind"))
    points = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 200).alias("x"), (F.col("s_suppkey") % 60).cast("double").alias("y"))
    return series.idw(day, points).select("id", "hour", _r("wind", 5).alias("wind"))


@query(f"WITH {V.OBS}, {_HOURLY}, x AS (SELECT cell, row_number() OVER w AS rn, sum(greatest(wind - 5.0::DOUBLE, 0)) OVER w AS dose FROM hourly WINDOW w AS (PARTITION BY cell ORDER BY hour DESC ROWS UNBOUNDED PRECEDING)), n AS (SELECT cell, max(rn) AS n FROM x GROUP BY 1), a AS (SELECT cell, n, unnest(range(0, 8))::INTEGER AS age FROM n) SELECT a.cell, age, round(coalesce(dose, 0), 6) AS dose FROM a LEFT JOIN x ON x.cell = a.cell AND rn = least(age * 24, n)")
def mixing_dose(spark, sf_dir):
    return series.mixing_dose(_hourly(spark, sf_dir), 7).select("cell", "age", _r("dose", 6).alias("dose"))


@query("SELECT event_id, round(exp(-value / 40.0::DOUBLE - (event_id % 7) / 10.0::DOUBLE), 9) AS confidence FROM events")
def confidence(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", _r(S.confidence(F.col("event_id") % 7, F.col("value")), 9).alias("confidence"))


@query(f"WITH {V.OBS}, x AS (SELECT event_id, station, {_ladder_sql('wind', 8.0, 12.0, 16.0)} AS lv, floor(epoch(ts))::BIGINT AS sec FROM obs), y AS (SELECT *, max(lv) OVER (PARTITION BY station ORDER BY sec RANGE BETWEEN CURRENT ROW AND 10800 FOLLOWING) AS ahead FROM x) SELECT event_id, station, (ahead >= 3 AND lv < 3) OR (ahead - lv >= 0.75 AND ahead >= 1) AS warning FROM y")
def deterioration_warning(spark, sf_dir):
    return series.deterioration(V.obs(spark, sf_dir), S.ladder(F.col("wind"), S.GUST_LIMITS))


@query(f"WITH {V.OBS} SELECT station, round((degrees(atan2(avg(sin(radians(wind * 14))), avg(cos(radians(wind * 14))))) + 720) % 360, 4) AS direction FROM obs GROUP BY 1")
def circular_mean(spark, sf_dir):
    return series.circular_mean(V.obs(spark, sf_dir), "station", F.col("wind") * 14).withColumn("direction", _r("direction", 4))


@query("SELECT b AS begin, least(b + INTERVAL 2 DAY, TIMESTAMP '2024-01-30') AS stop FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 2 DAY)) AS b)")
def time_slices(spark, sf_dir):
    out = series.time_slices(spark, "2024-01-01", "2024-01-30", 2)
    return out.select(F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("stop").cast("timestamp_ntz").alias("stop"))


# --- points, boxes, registries --------------------------------------------------------------------------------------


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_first(spark, sf_dir):
    return incremental.keep_first(V.table(spark, sf_dir, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def dedup_last(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return incremental.keep_first(rows, ["user_id", "event_type"], [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, try_cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) AS k FROM events")
def regex_extract_value(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", r'"k": *([0-9]+)', 1).try_cast("int").alias("k"))


_IMPORTANCE = "CASE kind WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END"


def _importance():
    return F.when(F.col("kind") == "BUILDING", 0).when(F.col("kind") == "MACHINERY", 1).when(F.col("kind") == "AUTOMOBILE", 2).otherwise(3)


@query(f"""WITH {V.POINTS}, a AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 500), floor(y / 500) ORDER BY {_IMPORTANCE}, id) AS rn FROM points),
b AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 150), floor(y / 150) ORDER BY {_IMPORTANCE}, id) AS r2 FROM a WHERE rn > 1)
SELECT id, 0 AS z FROM a WHERE rn = 1 UNION ALL SELECT id, CASE WHEN r2 = 1 THEN 1 ELSE 2 END FROM b""")
def service_thinning(spark, sf_dir):
    return vector.thin(V.points(spark, sf_dir), _importance(), (500.0, 150.0)).select("id", "z")


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'harbour' WHEN contains(p_type, 'BRASS') THEN 'ramp' WHEN contains(p_type, 'TIN') THEN 'sauna' END AS kind FROM part")
def category_dispatch(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", vector.category(F.col("p_type"), (("STEEL", "harbour"), ("BRASS", "ramp"), ("TIN", "sauna"))).alias("kind"))


@query(f"WITH {V.POINTS} SELECT floor(x / 1000)::BIGINT AS gx, floor(y / 1000)::BIGINT AS gy, round(avg(x), 4) AS x, round(avg(y), 4) AS y, count(*) AS n FROM points GROUP BY 1, 2")
def wind_grid(spark, sf_dir):
    return vector.grid_means(V.points(spark, sf_dir), 1000.0).select("gx", "gy", _r("x", 4).alias("x"), _r("y", 4).alias("y"), "n")


@query(f"WITH {V.POINTS}, {V.BOXES} SELECT id, min(box) AS box FROM points JOIN boxes ON x BETWEEN minx - 1 AND maxx + 1 AND y BETWEEN miny - 1 AND maxy + 1 GROUP BY 1")
def cover_first_match(spark, sf_dir):
    return vector.first_cover(V.points(spark, sf_dir), V.boxes(spark, sf_dir), 1000.0, 1.0)


@query(f"WITH {V.BOXES} SELECT box FROM boxes WHERE maxx >= 2000 AND minx <= 5000 AND maxy >= 1000 AND miny <= 4000")
def viewport_overlap(spark, sf_dir):
    return vector.overlapping(V.boxes(spark, sf_dir), 2000.0, 1000.0, 5000.0, 4000.0).select("box")


@query(f"WITH {V.POINTS}, {V.BOXES}, ch AS (SELECT * FROM boxes WHERE box % 4 = 0) SELECT id FROM points WHERE EXISTS (SELECT 1 FROM ch WHERE pow(greatest(minx - x, x - maxx, 0), 2) + pow(greatest(miny - y, y - maxy, 0), 2) <= 250000)")
def dirty_semi(spark, sf_dir):
    return vector.near_any(V.points(spark, sf_dir), V.boxes(spark, sf_dir).where("box % 4 = 0"), 500.0)


@query(f"WITH {V.BOXES}, b AS (SELECT min(minx) AS x0, min(miny) AS y0, max(maxx) AS x1, max(maxy) AS y1 FROM boxes WHERE box < 3) SELECT box FROM boxes, b WHERE minx < x1 + 300 AND maxx > x0 - 300 AND miny < y1 + 300 AND maxy > y0 - 300")
def halo_context(spark, sf_dir):
    boxes = V.boxes(spark, sf_dir)
    return vector.context(boxes, boxes.where("box < 3"), 300.0).select("box")


@query("""WITH o AS (SELECT o_orderkey, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), n AS (SELECT o_orderkey, max(o_totalprice) * 2 AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-07-01' GROUP BY 1)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.v ELSE o.v END AS v FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def incremental_merge(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    old = orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).groupBy("o_orderkey").agg(F.max("o_totalprice").alias("v"))
    new = orders.where(F.col("o_orderdate") >= F.lit("1995-07-01").cast("timestamp_ntz")).groupBy("o_orderkey").agg((F.max("o_totalprice") * 2).alias("v"))
    return incremental.merge(old, new, "o_orderkey", ["v"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def skip_existing(spark, sf_dir):
    present = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return incremental.missing(V.table(spark, sf_dir, "customer").select("c_custkey"), present, "c_custkey")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS batch FROM customer")
def work_batches(spark, sf_dir):
    return incremental.batches(V.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100)


@query("""WITH p AS (SELECT l_partkey % 1000 AS cell, l_extendedprice / 1000 AS z, l_quantity::INTEGER % 7 AS cls FROM lineitem WHERE l_quantity::INTEGER % 7 BETWEEN 2 AND 5),
g AS (SELECT cell, max(z) AS surface, max(z) FILTER (cls = 2) AS ground, count(*) AS n, count(*) FILTER (cls >= 3) AS canopy, count(*) FILTER (cls BETWEEN 3 AND 4) AS low FROM p GROUP BY 1)
SELECT cell, surface, ground, n, round(canopy / n, 9) AS cover, round(low / n, 9) AS undergrowth, n >= 3 AS valid, round(least(greatest(surface - ground, 0), 50), 6) AS canopy_height FROM g""")
def point_grid_stats(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1000).alias("cell"), (F.col("l_extendedprice") / 1000).alias("z"), (F.col("l_quantity").cast("int") % 7).alias("cls"))
    out = pointcloud.canopy_height(pointcloud.grid(li))
    return out.withColumns({"cover": _r("cover", 9), "undergrowth": _r("undergrowth", 9), "canopy_height": F.when(F.col("ground").isNotNull(), _r("canopy_height"))}).withColumn("canopy_height", F.coalesce("canopy_height", F.lit(0.0)))


_GRID = "g AS (SELECT (s_suppkey * 7) % 40 AS x, (s_suppkey * 11) % 37 AS y, min(s_suppkey) AS id FROM supplier GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_GRID}, reach AS (SELECT id AS a, id AS b FROM g UNION SELECT reach.a, h.id FROM reach JOIN g k ON k.id = reach.b JOIN g h ON abs(h.x - k.x) <= 1 AND abs(h.y - k.y) <= 1) SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1")
def clusters(spark, sf_dir):
    su = V.table(spark, sf_dir, "supplier")
    cells = su.groupBy(((F.col("s_suppkey") * 7) % 40).alias("x"), ((F.col("s_suppkey") * 11) % 37).alias("y")).agg(F.min("s_suppkey").alias("id"))
    if not (spark.sparkContext.getCheckpointDir() or ""):
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return vector.clusters(cells)


@query("SELECT c_custkey, round_even(c_acctbal * 9 / 10.0::DOUBLE, 0)::BIGINT * 100000 + round_even(c_custkey * 37 % 9000 / 10.0::DOUBLE, 0)::BIGINT AS gid FROM customer")
def cell_ids(spark, sf_dir):
    cu = V.table(spark, sf_dir, "customer")
    return cu.select("c_custkey", C.cell_id((F.col("c_custkey") * 37 % 9000).cast("double"), F.col("c_acctbal") * 9).alias("gid"))


_SHEET = """WITH p AS (SELECT c_custkey, 50000 + (c_custkey * 977) % 650000 + 0.5::DOUBLE AS x, 6600000 + (c_custkey * 1361) % 1100000 + 0.5::DOUBLE AS y FROM customer),
a AS (SELECT *, floor((x + 76000) / 192000) AS col, floor((y - 6570000) / 96000) AS row FROM p),
b AS (SELECT *, x + 76000 - col * 192000 AS dx, y - 6570000 - row * 96000 AS dy FROM a)
SELECT c_custkey, substr('KLMNPQRSTUVWX', (row + 1)::INTEGER, 1) || (col + 2)::BIGINT || (1 + 2 * (floor(dx / 96000) % 2) + floor(dy / 48000) % 2)::BIGINT || (1 + 2 * (floor(dx / 48000) % 2) + floor(dy / 24000) % 2)::BIGINT
  || (1 + 2 * (floor(dx / 24000) % 2) + floor(dy / 12000) % 2)::BIGINT || substr('ABCDEFGH', (floor(dx / 6000) % 4 * 2 + floor(dy / 6000) % 2 + 1)::INTEGER, 1) AS sheet,
  floor((x + 76000) / 6000) * 6000 - 76000 AS minx, floor((y - 6570000) / 6000) * 6000 + 6570000 AS miny FROM b"""


@query(_SHEET)
def sheet_codec(spark, sf_dir):
    k = F.col("c_custkey")
    pts = V.table(spark, sf_dir, "customer").select(k, (50000 + (k * 977) % 650000 + 0.5).alias("x"), (6600000 + (k * 1361) % 1100000 + 0.5).alias("y"))
    named = pts.select(k, C.sheet_name(F.col("x"), F.col("y")).alias("sheet"))
    x, y = C.sheet_origin(F.col("sheet"))
    return named.select(k, "sheet", x.cast("double").alias("minx"), y.cast("double").alias("miny"))


@query()
def registry_fingerprint(spark, sf_dir):
    return incremental.fingerprint(V.boxes(spark, sf_dir), ["box", "minx", "miny", "maxx", "maxy"])


@query("""WITH o AS (SELECT n_nationkey AS k, n_name AS f FROM nation WHERE n_nationkey < 20), n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'x' ELSE n_name END AS f FROM nation WHERE n_nationkey > 3)
SELECT coalesce(o.k, n.k) AS box, CASE WHEN o.f IS NULL THEN 'added' WHEN n.f IS NULL THEN 'removed' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.k = n.k WHERE o.f IS NULL OR n.f IS NULL OR o.f <> n.f""")
def manifest_changes(spark, sf_dir):
    na = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("box"), F.col("n_name").alias("fingerprint"))
    new = na.where("box > 3").withColumn("fingerprint", F.when(F.col("box") % 5 == 0, "x").otherwise(F.col("fingerprint")))
    return incremental.changed(na.where("box < 20"), new, "box")


@query(f"WITH {V.PIXELS}, a AS (SELECT tile, r, c, rock FROM pixels WHERE r > 0), b AS (SELECT tile, r, c, swamp FROM pixels WHERE c > 0) SELECT count(*) AS cells, count(*) FILTER (a.tile IS NULL OR b.tile IS NULL) AS alone, count(*) FILTER (a.tile IS NOT NULL AND b.tile IS NOT NULL AND rock IS DISTINCT FROM swamp) AS differing FROM a FULL JOIN b ON a.tile = b.tile AND a.r = b.r AND a.c = b.c")
def raster_difference(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    return incremental.difference(px.where("r > 0"), px.where("c > 0").withColumn("rock", F.col("swamp")), ["tile", "r", "c"], "rock")


@query(f"WITH {V.PIXELS}, t AS (SELECT tile, avg(elev) AS e FROM pixels GROUP BY 1) SELECT p.tile, p.r, p.c, round(p.elev - t.e, 6) AS above FROM pixels p JOIN t USING (tile)")
def lookup_join(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    found = incremental.lookup(px, px.groupBy("tile").agg(F.avg("elev").alias("e")), "tile")
    return found.select("tile", "r", "c", _r(F.col("elev") - F.col("e")).alias("above"))


@query()
def rasterised_polygons(spark, sf_dir):
    na = V.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    rings = na.select(k.cast("long").alias("id"), F.lit(0).alias("ring"), F.array(corner(k, k), corner(k + 12, k + 3), corner(k + 8, k + 14), corner(k, k)).alias("points"))
    return vector.rasterise(rings).groupBy("id").agg(F.count("*").alias("cells"))


@query()
def simplified_lines(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    lines = ev.groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("x"), F.col("value").alias("y")))).alias("points"))
    return vector.simplify(lines, 50.0).select("id", F.size("points").alias("n"))


@query()
def projected_points(spark, sf_dir):
    cu = V.table(spark, sf_dir, "customer")
    x, y = vector.to_grid(60 + (F.col("c_custkey") % 1000) / 100.0, 20 + (F.col("c_custkey") % 1100) / 100.0)
    return cu.select("c_custkey", _r(x, 3).alias("x"), _r(y, 3).alias("y"))


@query()
def corridor(spark, sf_dir):
    return vector.corridor_sheets(spark, [(120000.0, 6700000.0), (250000.0, 6650000.0), (420000.0, 6690000.0)], 20_000.0, 6_000.0)


@query()
def threshold_json(spark, sf_dir):
    return sinks.nested_thresholds(factor_thresholds(spark, sf_dir))


@query("SELECT layer, count(*) AS n FROM (SELECT 'a' AS layer, s_suppkey AS id FROM supplier UNION ALL SELECT 'b', c_custkey FROM customer) GROUP BY 1")
def layer_union(spark, sf_dir):
    a = V.table(spark, sf_dir, "supplier").select(F.lit("a").alias("layer"), F.col("s_suppkey").alias("id"))
    b = V.table(spark, sf_dir, "customer").select(F.lit("b").alias("layer"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return scans.union_layers(a, b).groupBy("layer").agg(F.count("*").alias("n"))


# --- maintenance and products -------------------------------------------------------------------------------------

_LEVELS = {"detail": "", "mid": "_mid", "far": "_far"}
_KEYS = "keys AS (SELECT o_orderkey, 'L' || o_orderkey || ['', '_mid', '_far', '_x'][o_orderkey % 4 + 1] || ['', '_t1', '_t3', '_t9', '_t12'][o_orderkey % 5 + 1] || ['', '_p1', '_p10', '_p11', '_p7', '_p'][o_orderkey % 6 + 1] AS key FROM orders)"


@query(f"""WITH {_KEYS}, a AS (SELECT o_orderkey, regexp_extract(key, '_p(1|5|7|10)$', 1) AS p, regexp_replace(key, '_p(1|5|7|10)$', '') AS k FROM keys),
b AS (SELECT *, regexp_extract(k, '_t(1|3|5)$', 1) AS t, regexp_replace(k, '_t(1|3|5)$', '') AS m FROM a)
SELECT o_orderkey, regexp_replace(m, '(_mid|_far)$', '') AS id, CASE WHEN ends_with(m, '_mid') THEN 'mid' WHEN ends_with(m, '_far') THEN 'far' ELSE 'detail' END AS level, coalesce(nullif(t, '')::INTEGER, 3) AS thickness, coalesce(nullif(p, '')::INTEGER, 7) AS percent FROM b""")
def tile_keys(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda *values: F.array(*map(F.lit, values))[(k % len(values)).cast("int")]
    keys = V.table(spark, sf_dir, "orders").select(k, F.concat(F.lit("L"), k.cast("string"), pick("", "_mid", "_far", "_x"), pick("", "_t1", "_t3", "_t9", "_t12"), pick("", "_p1", "_p10", "_p11", "_p7", "_p")).alias("key"))
    parts = C.parse_key(F.col("key"), _LEVELS, (1, 3, 5), (1, 5, 7, 10), 3, 7)
    return keys.select("o_orderkey", *(c.alias(name) for name, c in parts.items()))


@query(f"WITH {V.PIXELS} SELECT tile, r, c, elev > 4 AND NOT swamp AND slope_deg > 3 AS land FROM pixels")
def land_mask(spark, sf_dir):
    height = F.when(F.col("slope_deg") > 3, F.col("elev") - 4).otherwise(F.lit(float("nan")))  # unknown on flat cells
    return V.pixels(spark, sf_dir).select("tile", "r", "c", S.is_land(height, F.col("swamp")).alias("land"))


@query(f"WITH {V.PIXELS}, t AS (SELECT DISTINCT tile FROM pixels), k AS (SELECT tile, r // 8 AS br, c // 8 AS bc, bool_and(swamp) AS water FROM pixels WHERE slope_deg > 20 GROUP BY 1, 2, 3) SELECT t.tile, br, bc, coalesce(water, true) AS water FROM t CROSS JOIN (SELECT unnest(range(0, 3)) AS br) CROSS JOIN (SELECT unnest(range(0, 3)) AS bc) LEFT JOIN k USING (tile, br, bc)")
def water_mosaic(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))
    frame = px.select("tile").distinct().withColumn("br", F.explode(blocks)).withColumn("bc", F.explode(blocks))
    known = px.where("slope_deg > 20").groupBy("tile", F.floor(F.col("r") / 8).alias("br"), F.floor(F.col("c") / 8).alias("bc")).agg(F.bool_and("swamp").alias("water"))
    return raster.mosaic(frame, known, ["tile", "br", "bc"], "water")


@query(f"WITH {V.PIXELS}, {SCORED}, v AS (SELECT unnest(['slope', 'dist', 'tie']) AS name, unnest([CASE WHEN NOT swamp THEN s END, d, CASE WHEN rock THEN t END]) AS v FROM scored) SELECT name, count(v) AS n, round(min(v), 9) AS least, round(avg(v), 9) AS mean, round(max(v), 9) AS most FROM v GROUP BY 1")
def score_summary(spark, sf_dir):
    nan = F.lit(float("nan"))
    cells = V.pixels(spark, sf_dir).select(F.when(F.col("swamp"), nan).otherwise(S.slope_score(F.col("slope_deg"))).alias("slope"), S.dist_score(F.col("dist_m")).alias("dist"), F.when(F.col("rock"), S.tiebreak(F.col("slope_deg"), F.col("dist_m"))).otherwise(nan).alias("tie"))
    return raster.summary(cells, ["slope", "dist", "tie"]).select("name", "n", *(_r(c, 9).alias(c) for c in ("least", "mean", "most")))


@query(f"WITH closed AS ({ORACLES['closing']}), {V.PIXELS}, b AS (SELECT tile, count(*) AS cells, count(*) FILTER (swamp) AS before FROM pixels GROUP BY 1), n AS (SELECT tile, count(*) AS after FROM closed GROUP BY 1) SELECT tile, before, coalesce(after, 0) AS after, coalesce(after, 0) - before AS added, round(100.0::DOUBLE * before / cells, 6) AS percent FROM b LEFT JOIN n USING (tile)")
def closing_summary(spark, sf_dir):
    before = V.pixels(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("cells"), F.count_if("swamp").alias("before"))
    after = closing(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("after"))
    n = F.coalesce("after", F.lit(0))
    return before.join(after, "tile", "left").select("tile", "before", n.alias("after"), (n - F.col("before")).alias("added"), _r(100 * F.col("before") / F.col("cells")).alias("percent"))


_AGED = "aged AS (SELECT event_id, (user_id * 37 % 1000)::DOUBLE AS x, (event_id * 53 % 900)::DOUBLE AS y, (event_id % 90) / 4.0::DOUBLE - 1 AS age FROM events), doses AS (SELECT (user_id % 15)::INTEGER AS age, (event_id % 8)::INTEGER AS r, (event_id // 8 % 10)::INTEGER AS c, round(avg(value), 6) AS dose FROM events GROUP BY 1, 2, 3)"


@query(f"WITH {_AGED}, k AS (SELECT *, least(round_even(greatest(age, 0), 0), 14)::INTEGER AS day, least(floor((900 - y) / 100), 7)::INTEGER AS r, least(floor((x - 100) / 100), 7)::INTEGER AS c FROM aged WHERE x >= 100 AND x < 900 AND y <= 900 AND y > 100) SELECT event_id, day, k.r, k.c, dose, least(round_even(k.age, 0), 254)::INTEGER AS age_b, round_even(least(dose / 200, 1) * 255, 0)::INTEGER AS conf_b FROM k LEFT JOIN doses d ON d.age = k.day AND d.r = k.r AND d.c = k.c")
def dose_lookup(spark, sf_dir):
    ev, e, u = V.table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    aged = ev.select(e, (u * 37 % 1000).cast("double").alias("x"), (e * 53 % 900).cast("double").alias("y"), ((e % 90) / 4.0 - 1).alias("age"))
    doses = ev.groupBy((u % 15).cast("int").alias("age"), (e % 8).cast("int").alias("r"), (F.floor(e / 8) % 10).cast("int").alias("c")).agg(_r(F.avg("value")).alias("dose"))
    found = series.dose_at(aged, doses, 100.0, 900.0, 100.0, 8, 8, 14)
    return found.select("event_id", "day", "r", "c", "dose", S.age_byte(F.rint("age")).alias("age_b"), S.confidence_byte(F.least(F.col("dose") / 200, F.lit(1.0))).alias("conf_b"))


@query(f"WITH {V.OBS}, x AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM obs), f AS (SELECT day, layer, count(*) AS fresh FROM (SELECT cell, day, layer, row_number() OVER (PARTITION BY cell ORDER BY day, layer) AS rn FROM x) WHERE rn = 1 GROUP BY 1, 2) SELECT day, layer, count(*) AS n, count(DISTINCT cell) AS cells, any_value(coalesce(fresh, 0)) AS fresh FROM x LEFT JOIN f USING (day, layer) GROUP BY 1, 2")
def coverage(spark, sf_dir):
    return series.coverage(V.obs(spark, sf_dir), F.date_format("ts", "yyyy-MM-dd"))


@query(f"WITH RECURSIVE {_GRID}, reach AS (SELECT id AS a, id AS b FROM g UNION SELECT reach.a, h.id FROM reach JOIN g k ON k.id = reach.b JOIN g h ON abs(h.x - k.x) <= 1 AND abs(h.y - k.y) <= 1), m AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1), t AS (SELECT cluster, count(*) AS n, min(x) - 2.0::DOUBLE AS minx, min(y) - 2.0::DOUBLE AS miny, max(x) + 2.0::DOUBLE AS maxx, max(y) + 2.0::DOUBLE AS maxy FROM m JOIN g USING (id) GROUP BY 1) SELECT * FROM t")
def cluster_boxes(spark, sf_dir):
    su = V.table(spark, sf_dir, "supplier")
    cells = su.groupBy(((F.col("s_suppkey") * 7) % 40).alias("x"), ((F.col("s_suppkey") * 11) % 37).alias("y")).agg(F.min("s_suppkey").alias("id"))
    return vector.cluster_boxes(clusters(spark, sf_dir).join(cells, "id"), 2.0)


_MANIFESTS = "o AS (SELECT n_nationkey AS k, n_name AS f FROM nation WHERE n_nationkey < 20), n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'x' ELSE n_name END AS f FROM nation WHERE n_nationkey > 3)"


def _manifests(spark, sf_dir):
    na = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("box"), F.col("n_name").alias("fingerprint"))
    return na.where("box < 20"), na.where("box > 3").withColumn("fingerprint", F.when(F.col("box") % 5 == 0, "x").otherwise(F.col("fingerprint")))


@query(f"""WITH {_MANIFESTS}, e AS (SELECT * FROM o WHERE k > 3), x AS (SELECT 'removed' AS run, n.k AS box, CASE WHEN o.k IS NULL THEN 'added' WHEN o.f <> n.f THEN 'changed' ELSE 'all' END AS state FROM n LEFT JOIN o ON o.k = n.k
UNION ALL SELECT 'kept', n.k, CASE WHEN e.k IS NULL THEN 'added' ELSE 'changed' END FROM n LEFT JOIN e ON e.k = n.k WHERE e.k IS NULL OR e.f <> n.f) SELECT * FROM x""")
def recompute_plan(spark, sf_dir):
    old, new = _manifests(spark, sf_dir)
    runs = {"removed": old, "kept": old.where("box > 3")}
    parts = [incremental.to_compute(o, new, "box").select(F.lit(name).alias("run"), "box", "state") for name, o in runs.items()]
    return parts[0].union(parts[1])


@query(f"WITH {_MANIFESTS} SELECT o.k AS box FROM o LEFT JOIN n ON o.k = n.k WHERE n.k IS NULL OR o.f <> n.f")
def outdated_products(spark, sf_dir):
    old, new = _manifests(spark, sf_dir)
    return incremental.outdated(old, new, "box").union(incremental.outdated(old.limit(0), new, "box"))  # a first run drops nothing


@query("SELECT o_custkey % 500 AS key, CASE WHEN k THEN total ELSE -total END AS value, k AS cached FROM (SELECT o_custkey % 500 AS o_custkey, round(sum(o_totalprice), 2) AS total, o_custkey % 500 % 3 <> 0 AND o_custkey % 500 % 7 <> 0 AND o_custkey % 500 % 2 = 0 AS k FROM orders GROUP BY o_custkey % 500)")
def cached_values(spark, sf_dir):
    totals = V.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("key")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    wanted = totals.select("key", F.lit("v2").alias("fingerprint"))
    # of the cached values some are absent, some corrupt, and some of an older version
    cache = totals.where("key % 3 <> 0").select("key", F.when(F.col("key") % 2 == 0, "v2").otherwise("v1").alias("fingerprint"), F.when(F.col("key") % 7 != 0, F.col("value")).alias("value"))
    return incremental.read_through(wanted, cache, "key", "value", lambda missing: missing.join(totals, "key").withColumn("value", -F.col("value")))


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'a%' OR p_name LIKE '%e%' OR p_name LIKE '%n'")
def matching_files(spark, sf_dir):
    return incremental.matching(V.table(spark, sf_dir, "part"), "p_name", ("a%", "%e%", "%n")).select("p_partkey")


@query("SELECT c_custkey, concat_ws('|', 'v3', c_mktsegment, c_nationkey::VARCHAR, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END) AS fingerprint FROM customer")
def source_fingerprints(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select("c_custkey", incremental.combined("v3", F.col("c_mktsegment"), F.col("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))).alias("fingerprint"))


@query(f"WITH {V.BOXES}, k AS (SELECT unnest(range(-10, 20)) AS b) SELECT box, x.b AS bx, y.b AS by, greatest(minx, x.b * 1000.0::DOUBLE) AS minx, greatest(miny, y.b * 1000.0::DOUBLE) AS miny, least(maxx, (x.b + 1) * 1000.0::DOUBLE) AS maxx, least(maxy, (y.b + 1) * 1000.0::DOUBLE) AS maxy FROM boxes, k x, k y WHERE minx < (x.b + 1) * 1000 AND maxx > x.b * 1000 AND miny < (y.b + 1) * 1000 AND maxy > y.b * 1000")
def clipped_boxes(spark, sf_dir):
    return vector.clip_to_blocks(V.boxes(spark, sf_dir), 1000.0).select("box", "bx", "by", "minx", "miny", "maxx", "maxy")


@query("SELECT min(l_orderkey * 10 + l_linenumber) AS id, count(*) AS copies FROM lineitem GROUP BY l_suppkey, l_quantity")
def distinct_geometries(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return vector.distinct_geometries(li, "id", F.concat_ws(" ", F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string")))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN trim(b) <> '' THEN 'brand=' || b END, 'size=' || p_size, CASE WHEN trim(t) <> '' THEN 'type=' || t END) AS fields FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_brand END AS b, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS t FROM part)")
def feature_attributes(spark, sf_dir):
    part, k = V.table(spark, sf_dir, "part"), F.col("p_partkey")
    kept = vector.attributes({"brand": F.when(k % 3 == 0, "  ").otherwise(F.col("p_brand")), "size": F.col("p_size"), "type": F.when(k % 4 != 0, F.col("p_type"))})
    return part.select(k, F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("fields"))


@query("SELECT n_nationkey, q AS sheet, x0 AS minx, y0 - h * 10.0::DOUBLE AS miny, x0 + w * 10.0::DOUBLE AS maxx, y0 AS maxy FROM (SELECT n_nationkey, n_nationkey::VARCHAR || unnest([1, 2, 3, 4])::VARCHAR AS q, n_nationkey * 100.0::DOUBLE AS x0, 5000.0::DOUBLE - n_nationkey AS y0, 60 + n_nationkey AS w, 50 + n_regionkey AS h FROM nation)")
def tile_bounds(spark, sf_dir):
    na, k = V.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    box = scans.bounds(60 + k, 50 + F.col("n_regionkey"), k * 100.0, 5000.0 - k, F.lit(10.0), F.lit(-10.0))
    return scans.quarters(na.select(k, box.alias("b")), "n_nationkey").select("n_nationkey", "sheet", "b.*")


@query("SELECT c_custkey, floor(100 * (c_custkey % 7) / w + 0.5)::BIGINT AS a, floor(100 * (c_nationkey % 5 + 1) / w + 0.5)::BIGINT AS b FROM (SELECT *, ((c_custkey % 7) + (c_nationkey % 5 + 1))::DOUBLE AS w FROM customer)")
def factor_shares(spark, sf_dir):
    shares = S.factor_shares(F.array((F.col("c_custkey") % 7).cast("double"), (F.col("c_nationkey") % 5 + 1).cast("double")))
    return V.table(spark, sf_dir, "customer").select("c_custkey", shares.alias("s")).select("c_custkey", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
