"""Reference forecasts a model is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finegrid.functions.columns import clip, plane_xy

LAPSE_C_PER_M = -0.0065  # fixed value: standard temperature lapse rate


def climatology(var: str, fc: Column, ratio: Column, elev_diff: Column) -> Column:
    """Forecast scaled by the climate ratio (rain), by the lapse rate (temperature), or copied."""
    if var == "rain":
        return fc * ratio
    return fc + LAPSE_C_PER_M * elev_diff if var in ("tmax", "tmin") else fc


def climate_ratio(unit_month: Column, parent_month: Column) -> Column:
    """Monthly normal of the unit over that of its parent; 1 mm is added to both against dry months."""
    return (unit_month + 1) / (parent_month + 1)


def bounded(var: str, c: Column) -> Column:
    return clip(c, 0) if var in ("rain", "wind") else clip(c, 0, 100) if var == "rh" else c


def idw_of_parents(units: DataFrame, unit: str, lat: str, lon: str, parents: DataFrame, forecasts: DataFrame, value: str, out: str,
                   lat0: float, power: float = 2.0, min_km: float = 1.0, chunk: int = 1024) -> DataFrame:
    """Inverse-distance mean of all parents' forecasts per unit, day and lead.

    Every parent has a weight for every unit, but the pairs are never rows: a day's
    forecasts travel as arrays of at most ``chunk`` parents, each array is folded into
    a partial sum next to the unit, and the partial sums are added up.  ``parents`` has
    parent, latitude, longitude; ``forecasts`` has parent, valid_date, lead_day, value.
    A missing forecast drops out of both sums.
    """
    n_chunks = max(1, -(-parents.count() // chunk))
    px, py = plane_xy(F.col("latitude"), F.col("longitude"), lat0)
    p = parents.select("parent", px.alias("px"), py.alias("py"), F.pmod(F.xxhash64("parent"), F.lit(n_chunks)).cast("int").alias("chunk"))
    known = forecasts.where(F.col(value).isNotNull()).join(p, "parent")
    arrays = known.groupBy("valid_date", "lead_day", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("parent", "px", "py", F.col(value).alias("v")))).alias("near"))
    ux, uy = plane_xy(F.col(lat), F.col(lon), lat0)
    u = units.select("*", ux.alias("_x"), uy.alias("_y")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))

    def weight(e: Column) -> Column:
        d = F.greatest(F.hypot(e["px"] - F.col("_x"), e["py"] - F.col("_y")), F.lit(min_km))
        return 1 / F.pow(d, F.lit(power))

    start = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    part = F.aggregate("near", start, lambda a, e: F.struct((a["num"] + weight(e) * e["v"]).alias("num"), (a["den"] + weight(e)).alias("den")))
    s = u.join(arrays, ["valid_date", "lead_day", "chunk"]).select(unit, "valid_date", "lead_day", part.alias("s"))
    return s.groupBy(unit, "valid_date", "lead_day").agg((F.sum("s.num") / F.sum("s.den")).alias(out))
