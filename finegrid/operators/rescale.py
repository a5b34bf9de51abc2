"""Rescaling of unit values so that their weighted mean equals the parent value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["block_lgd", "issue_date", "lead_day"]


def area_weights_in_parent(units: DataFrame, parent: str = "block_lgd", area: str = "area_km2") -> DataFrame:
    """Share of each unit in the area of its parent's units."""
    total = units.groupBy(parent).agg(F.sum(area).alias("_a"))
    return units.join(total, parent).withColumn("w_area", F.col(area) / F.col("_a")).drop("_a")


def conserve(df: DataFrame, pred: str, fc: str, weight: str, out: str, multiplicative: bool) -> DataFrame:
    """Adds ``out``: ``pred`` rescaled so its weighted mean over the parent forecast equals ``fc``.

    Rain is scaled by a factor (the parent value where the mean vanishes, never below
    zero); other variables are shifted.  Units without a prediction take no part in
    the mean.  The mean is a partial aggregation joined back, so a parent with very
    many units is not gathered in one task.
    """
    known = F.when(F.col(pred).isNotNull(), F.col(weight))
    mean = df.groupBy(*KEYS).agg((F.sum(F.col(pred) * known) / F.nullif(F.sum(known), F.lit(0.0))).alias("_mean"))
    joined = df.join(mean, KEYS, "left")
    p, f, m = F.col(pred), F.col(fc), F.col("_mean")
    value = F.greatest(F.lit(0.0), F.when(m > 1e-6, p * f / m).otherwise(f)) if multiplicative else p + (f - m)
    return joined.withColumn(out, F.when(p.isNotNull() & f.isNotNull(), value)).drop("_mean")
