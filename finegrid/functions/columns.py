"""Scalar column functions: math, season, classes, agronomy, plane geometry."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# 24-hour rain class upper bounds in mm (a class holds its upper bound).
RAIN_CLASSES = [
    (0.1, "no rain"),
    (2.5, "very light"),
    (15.6, "light"),
    (64.5, "moderate"),
    (115.6, "heavy"),
    (204.5, "very heavy"),
    (math.inf, "extremely heavy"),
]
MONSOON_MONTHS = [6, 7, 8, 9]
# Calendar month to season name.
SEASONS = {
    "winter (DJF)": [12, 1, 2],
    "pre-monsoon (MAM)": [3, 4, 5],
    "monsoon (JJAS)": [6, 7, 8, 9],
    "post-monsoon (ON)": [10, 11],
}


def null_if_nan(c: Column) -> Column:
    """NULL for NaN and infinities, so that aggregates skip them."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(~bad, c)


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bounded value; NULL stays NULL (greatest/least alone would skip it)."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)


def keep_between(c: Column, lower: float, upper: float) -> Column:
    """The value inside ``[lower, upper]``, NULL outside (impossible readings, nodata codes)."""
    return F.when(c.between(lower, upper), c)


def to_space(c: Column, space: str) -> Column:
    """Forward transform of a value for residual modelling."""
    return F.log1p(clip(c, 0)) if space == "log1p" else c


def from_space(c: Column, space: str) -> Column:
    return F.expm1(c) if space == "log1p" else c


# --- season and classes -------------------------------------------------------------------

def is_monsoon(date: Column) -> Column:
    return F.month(date).isin(MONSOON_MONTHS).cast("int")


def season_name(date: Column) -> Column:
    month = F.month(date)
    return reduce(lambda acc, item: acc.when(month.isin(item[1]), item[0]), SEASONS.items(), F.when(F.lit(False), ""))


def season_terms(date: Column) -> dict[str, Column]:
    """Yearly harmonic of the date, its month and the monsoon flag."""
    angle = F.dayofyear(date) * (2 * math.pi / 365.25)
    return {"doy_sin": F.sin(angle), "doy_cos": F.cos(angle), "month": F.month(date), "is_monsoon": is_monsoon(date)}


def rain_class(c: Column) -> Column:
    """Rain class name; each class is open below and closed above."""
    out = F.when(F.lit(False), "")
    for upper, name in RAIN_CLASSES:
        out = out.when(c.isNotNull() if math.isinf(upper) else c <= upper, name)
    return out


def map_bin(c: Column, edges: list[float]) -> Column:
    """How many of the ascending ``edges`` the value reaches (NULL stays NULL)."""
    reached = F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: c >= e)
    return F.when(c.isNotNull(), F.size(reached))


# --- plane geometry -----------------------------------------------------------------------

def plane_xy(lat: Column, lon: Column, lat0: Column | float) -> tuple[Column, Column]:
    """Kilometres in a local plane: longitude shrinks with the cosine of ``lat0``."""
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(float(lat0))
    return F.radians(lon) * EARTH_RADIUS_KM * F.cos(F.radians(lat0)), F.radians(lat) * EARTH_RADIUS_KM


def equal_area_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area plane in kilometres."""
    return F.radians(lon) * EARTH_RADIUS_KM, F.sin(F.radians(lat)) * EARTH_RADIUS_KM


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area of an array of (x, y) structs; the ring may be open."""
    # relative to the first corner, so that the cross products keep their precision
    x0, y0 = ring[0]["x"], ring[0]["y"]
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a ring of (x, y) structs."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def crosses(a, b):
        straddles = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return (straddles & (x < at)).cast("int")

    hits = F.zip_with(ring, nxt, crosses)
    return F.aggregate(hits, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 2 == 1


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a line segment."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, F.nullif(length2, F.lit(0.0))), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


# --- agronomy -----------------------------------------------------------------------------

def extraterrestrial_radiation(lat: Column, doy: Column) -> Column:
    """Daily radiation above the atmosphere, MJ per square metre (FAO-56 equation 21)."""
    phi = F.radians(lat)
    yearly = doy * (2 * math.pi / 365)
    distance = 1 + 0.033 * F.cos(yearly)
    declination = 0.409 * F.sin(yearly - 1.39)
    cos_hour = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(declination)))
    hour = F.acos(cos_hour)
    daylight = hour * F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.sin(hour)
    return (24 * 60 / math.pi) * 0.0820 * distance * daylight


def _saturation_pressure(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def reference_et0(tmax: Column, tmin: Column, rh: Column, wind_kmh: Column, lat: Column, elev: Column,
                  doy: Column, krs: float = 0.16, gust_to_mean: float = 0.55) -> Column:
    """FAO-56 Penman-Monteith reference evapotranspiration, mm per day.

    Radiation comes from the temperature range (``krs``); the daily maximum 10 m
    wind becomes a mean 2 m wind through ``gust_to_mean`` and the log profile.
    """
    tmean = (tmax + tmin) / 2
    pressure = 101.3 * F.pow((293 - 0.0065 * elev) / 293, F.lit(5.26))
    gamma = 0.000665 * pressure
    es = (_saturation_pressure(tmax) + _saturation_pressure(tmin)) / 2
    ea = F.when(rh > 100, 100.0).when(rh < 1, 1.0).otherwise(rh) / 100 * es
    slope = 4098 * _saturation_pressure(tmean) / F.pow(tmean + 237.3, F.lit(2.0))
    ra = extraterrestrial_radiation(lat, doy)
    rs = krs * F.sqrt(F.greatest(F.lit(0.0), tmax - tmin)) * ra
    clear_sky = F.greatest((0.75 + 2e-5 * elev) * ra, F.lit(1e-6))
    cloud = 1.35 * F.greatest(F.lit(0.25), F.least(F.lit(1.0), rs / clear_sky)) - 0.35
    black_body = (F.pow(tmax + 273.16, F.lit(4.0)) + F.pow(tmin + 273.16, F.lit(4.0))) / 2
    net = 0.77 * rs - 4.903e-9 * black_body * (0.34 - 0.14 * F.sqrt(ea)) * cloud
    u2 = wind_kmh / 3.6 * gust_to_mean * 4.87 / math.log(67.8 * 10 - 5.42)
    et0 = (0.408 * slope * net + gamma * 900 / (tmean + 273) * u2 * (es - ea)) / (slope + gamma * (1 + 0.34 * u2))
    # not below zero, as arithmetic: NULL stays NULL, and without a condition around it the
    # repeated parts are computed once and the compiled method stays small
    return (et0 + F.abs(et0)) / 2


def soil_water(sand_pct: Column, clay_pct: Column, om_pct: Column) -> tuple[Column, Column]:
    """Water content at wilting point and field capacity (Saxton and Rawls 2006)."""
    s, c = sand_pct / 100, clay_pct / 100
    om = F.greatest(F.lit(0.0), F.least(F.lit(8.0), om_pct))
    dry = -0.024 * s + 0.487 * c + 0.006 * om + 0.005 * s * om - 0.013 * c * om + 0.068 * s * c + 0.031
    wet = -0.251 * s + 0.195 * c + 0.011 * om + 0.006 * s * om - 0.027 * c * om + 0.452 * s * c + 0.299
    return dry + (0.14 * dry - 0.02), wet + (1.283 * wet * wet - 0.374 * wet - 0.015)


def available_water_mm(sand_pct: Column, clay_pct: Column, om_pct: Column, depth_mm: float = 300.0) -> Column:
    wilting, capacity = soil_water(sand_pct, clay_pct, om_pct)
    return clip(capacity - wilting, 0, 0.35) * depth_mm


def depth_weighted(values: list[Column], thickness: list[float]) -> Column:
    """Profile mean over soil layers of the given thickness."""
    total = float(sum(thickness))
    return reduce(lambda a, b: a + b, [v * (t / total) for v, t in zip(values, thickness)])


def ordered_temperatures(tmin: Column, tmax: Column) -> tuple[Column, Column]:
    """Minimum and maximum; a crossed pair becomes its midpoint minus/plus 0.05."""
    mid = (tmin + tmax) / 2
    crossed = tmin > tmax
    return F.when(crossed, mid - 0.05).otherwise(tmin), F.when(crossed, mid + 0.05).otherwise(tmax)
