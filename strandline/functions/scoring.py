"""Scores of a shoreline cell as column expressions (code generation, no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring model.
FLAT_DEG, STEEP_DEG = 5.0, 20.0
NEAR_M, FAR_M = 20.0, 150.0
W_SLOPE, W_DIST, W_ROCK, W_SHELTER = 0.5, 0.35, 0.15, 0.7
ROCK_YES, ROCK_NO, SWAMP_FACTOR = 1.0, 0.2, 0.5
TIE = 1e-4
SLOPE, DIST, ROCK, SWAMP, SHELTER = 1, 2, 4, 8, 16
WAVE, CALM_M, ROUGH_M = 5.1e-4, 0.05, 0.30
LEE_MAX, LEE_K = 0.6, 8.0
WAVE_LIMITS, GUST_LIMITS = (0.20, 0.40, 0.70), (8.0, 12.0, 16.0)
FETCH_METRES = (50.0, 73.1327, 106.9677, 156.4567, 228.842, 334.7165, 489.5742, 716.0773, 1047.3729, 1531.9435, 2240.7024, 3277.3709, 4793.6576, 7011.4594, 10255.3348, 15000.0)
MAX_FETCH_M = 15000.0
TAU_MIX, TAU_AGE, MIX_WIND = 40.0, 10.0, 5.0


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def slope_score(deg: Column) -> Column:
    """1 up to the flat limit, 0 from the steep one on, linear between; NaN and null stay."""
    return F.when(F.isnan(deg), deg).when(deg <= FLAT_DEG, 1.0).when(deg >= STEEP_DEG, 0.0).otherwise((STEEP_DEG - deg) / (STEEP_DEG - FLAT_DEG))


def dist_score(m: Column) -> Column:
    return F.when(m < NEAR_M, 0.0).when(m > FAR_M, 1.0).otherwise((m - NEAR_M) / (FAR_M - NEAR_M))


def partial_score(slope: Column, dist: Column) -> Column:
    return (W_SLOPE * slope + W_DIST * dist) / (W_SLOPE + W_DIST)


def total_score(slope: Column, dist: Column, rock: Column, swamp: Column) -> Column:
    base = W_SLOPE * slope + W_DIST * dist + W_ROCK * F.when(rock, ROCK_YES).otherwise(ROCK_NO)
    return F.when(swamp, base * SWAMP_FACTOR).otherwise(base)


def tiebreak(deg: Column, m: Column) -> Column:
    return (W_SLOPE * clip(1.0 - deg / 90.0, 0, 1) + W_DIST * clip(m / 1000.0, 0, 1)) / (W_SLOPE + W_DIST)


def byte(x: Column) -> Column:
    """Truncated to 0..255."""
    return clip(x * 255.0, 0, 255).cast("int")


def has(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


def mask_score(mask: Column, slope_b: Column, dist_b: Column, rock: Column, swamp: Column, shelter: Column | None = None) -> Column:
    """Score under a set of factors: unselected ones leave and the weights are brought to a sum of one; swamp multiplies."""
    terms = [(SLOPE, W_SLOPE, slope_b / 255.0), (DIST, W_DIST, dist_b / 255.0), (ROCK, W_ROCK, F.when(rock, ROCK_YES).otherwise(ROCK_NO))]
    if shelter is not None:
        terms.append((SHELTER, W_SHELTER, shelter))
    total, weight = F.lit(0.0), F.lit(0.0)
    for bit, w, value in terms:
        total = total + F.when(has(mask, bit), w * value).otherwise(0.0)
        weight = weight + F.when(has(mask, bit), w).otherwise(0.0)
    score = F.when(weight > 0, total / weight).otherwise(1.0)
    return clip(F.when(has(mask, SWAMP) & swamp, score * SWAMP_FACTOR).otherwise(score), 0, 1)


def lee_wind(wind: Column, fetch: Column, height: Column) -> Column:
    """Wind behind an obstacle of that height, half the fetch away."""
    return F.when(height > 0, wind * (1.0 - LEE_MAX * F.exp(-(fetch / 2.0) / (LEE_K * height)))).otherwise(wind)


def wave_height(wind: Column, fetch: Column, height: Column) -> Column:
    return WAVE * lee_wind(wind, fetch, height) * F.sqrt(fetch)


def shelter_score(fetch: Column, wind: Column, height: Column) -> Column:
    return clip((ROUGH_M - wave_height(wind, fetch, height)) / (ROUGH_M - CALM_M), 0, 1)


def ladder(v: Column, limits: tuple[float, float, float]) -> Column:
    """Continuous class 0..3 with the limits at 1, 2 and 3."""
    a, b, c = limits
    return clip(F.when(v < a, v / a).when(v < b, 1.0 + (v - a) / (b - a)).when(v < c, 2.0 + (v - b) / (c - b)).otherwise(3.0), 0, 3)


def paddle_difficulty(fetch: Column, wind: Column, gust: Column, height: Column, forecast_wave: Column | None = None) -> Column:
    wave = wave_height(wind, fetch, height)
    if forecast_wave is not None:
        w = F.least(fetch / MAX_FETCH_M, F.lit(1.0))
        wave = (1.0 - w) * wave + w * forecast_wave
    return F.greatest(ladder(wave, WAVE_LIMITS), ladder(lee_wind(gust, fetch, height), GUST_LIMITS)) / 3.0


def fetch_at(levels: Column, bearing: Column) -> Column:
    """Metres at a bearing, between the two nearest of the twelve sectors' levels."""
    pos = F.pmod(bearing, F.lit(360.0)) / 30.0
    lo = F.floor(pos).cast("int") % 12
    metres = F.array(*map(F.lit, FETCH_METRES))
    a, b = metres[levels[lo]], metres[levels[(lo + 1) % 12]]
    return a + (b - a) * (pos - F.floor(pos))


def confidence(age_days: Column, dose: Column) -> Column:
    return F.exp(-dose / TAU_MIX - age_days / TAU_AGE)


def hsv(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue 0..179, saturation and value 0..255 of 8-bit colours."""
    v, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = (v - low).cast("double")
    hue = F.when(span == 0, 0.0).when(v == red, 60.0 * (green - blue) / span).when(v == green, 120.0 + 60.0 * (blue - red) / span).otherwise(240.0 + 60.0 * (red - green) / span)
    hue = F.when(hue < 0, hue + 360.0).otherwise(hue)
    sat = F.when(v == 0, 0.0).otherwise(255.0 * span / v)
    return F.rint(hue / 2.0).cast("int") % 180, F.rint(sat).cast("int"), v.cast("int")


def within(triple: tuple[Column, Column, Column], low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    out = F.lit(True)
    for c, a, z in zip(triple, low, high, strict=True):
        out = out & c.between(a, z)
    return out


def is_land(height: Column, water: Column) -> Column:
    """Above the water level and no water; an unknown height is none (NaN would compare as the greatest number)."""
    return F.coalesce((F.nanvl(height, F.lit(0.0)) > 0) & ~F.coalesce(water, F.lit(False)), F.lit(False))


def confidence_byte(share: Column) -> Column:
    return F.rint(share * 255).cast("int")


def age_byte(days: Column) -> Column:
    """Age in days; 254 stands for all older, 255 is left for none."""
    return F.least(days, F.lit(254)).cast("int")


def factor_shares(weights: Column) -> Column:
    """Each weight's share of their sum, in whole percent."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.when(total > 0, F.transform(F.arrays_zip(weights.alias("w"), F.array_repeat(total, F.size(weights)).alias("t")), lambda x: F.floor(100 * x["w"] / x["t"] + 0.5)))
