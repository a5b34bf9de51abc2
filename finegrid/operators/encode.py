"""Group-mean encoders: shrunken bias tables, leave-one-fold-out values, spatial fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finegrid.functions.columns import plane_xy
from finegrid.operators.geometry import nearest_k


def _shrunk(total: Column, n: Column, parent_total: Column, parent_n: Column, k: float) -> Column:
    w = n / (n + k)
    parent = F.try_divide(parent_total, parent_n)
    return F.when(n > 0, w * F.try_divide(total, n) + (1 - w) * parent)


def shrunken_bias(df: DataFrame, unit: str, parent: str, season: str, resid: str, k: float = 20.0) -> DataFrame:
    """Mean residual per unit and season, pulled towards the parent's mean when a unit has few rows."""
    u = df.where(F.col(resid).isNotNull()).groupBy(unit, parent, season).agg(F.sum(resid).alias("_s"), F.count(resid).alias("_n"))
    p = u.groupBy(parent, season).agg(F.sum("_s").alias("_ps"), F.sum("_n").alias("_pn"))
    bias = _shrunk(F.col("_s"), F.col("_n"), F.col("_ps"), F.col("_pn"), k)
    return u.join(p, [parent, season]).select(unit, season, bias.alias("bias"))


def out_of_fold_bias(df: DataFrame, unit: str, parent: str, season: str, fold: str, resid: str, k: float = 20.0) -> DataFrame:
    """``shrunken_bias`` for every fold, computed from the other folds only.

    Sums per (unit, season, fold) are taken once; a fold's statistics are the totals
    minus the fold's own part, so nothing is refitted.
    """
    cell = df.groupBy(unit, parent, season, fold).agg(F.coalesce(F.sum(resid), F.lit(0.0)).alias("_s"), F.count(resid).alias("_n"))
    # each of these windows holds one unit's or one parent's folds
    own = Window.partitionBy(unit, parent, season)
    cell = cell.withColumn("_ts", F.sum("_s").over(own)).withColumn("_tn", F.sum("_n").over(own))
    pcell = cell.groupBy(parent, season, fold).agg(F.sum("_s").alias("_ps"), F.sum("_n").alias("_pn"))
    whole = Window.partitionBy(parent, season)
    pcell = pcell.withColumn("_pts", F.sum("_ps").over(whole)).withColumn("_ptn", F.sum("_pn").over(whole))
    j = cell.join(pcell, [parent, season, fold])
    bias = _shrunk(F.col("_ts") - F.col("_s"), F.col("_tn") - F.col("_n"), F.col("_pts") - F.col("_ps"), F.col("_ptn") - F.col("_pn"), k)
    return j.select(unit, season, fold, bias.alias("bias"))


def idw_knn(wanted: DataFrame, table: DataFrame, unit: str, lat: str, lon: str, value: str, lat0: float, k: int = 8,
            power: float = 2.0, min_km: float = 0.5) -> DataFrame:
    """Inverse-distance mean of the ``k`` nearest known units for every wanted unit."""
    qx, qy = plane_xy(F.col(lat), F.col(lon), lat0)
    q = wanted.select(F.col(unit).alias("qid"), qx.alias("x"), qy.alias("y"))
    t = table.select(F.col(unit).alias("tid"), qx.alias("ax"), qy.alias("ay"), qx.alias("bx"), qy.alias("by"))
    near = nearest_k(q, t, k).join(table.select(F.col(unit).alias("tid"), F.col(value).alias("_v")), "tid")
    w = 1 / F.pow(F.greatest(F.col("dist"), F.lit(min_km)), F.lit(power))
    return near.groupBy(F.col("qid").alias(unit)).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(value), F.count("*").alias("neighbours"))


def parent_season_lead_bias(train: DataFrame, keys: list[str], y: str, fc: str) -> DataFrame:
    """Mean error of the parent forecast per key."""
    ok = F.col(y).isNotNull() & F.col(fc).isNotNull()
    return train.where(ok).groupBy(*keys).agg(F.avg(F.col(y) - F.col(fc)).alias("bias"))


def with_bias(df: DataFrame, table: DataFrame, keys: list[str], fc: str, out: str) -> DataFrame:
    """Forecast plus the looked-up bias; an unseen key has bias 0."""
    return df.join(table, keys, "left").withColumn(out, F.col(fc) + F.coalesce("bias", F.lit(0.0))).drop("bias")
