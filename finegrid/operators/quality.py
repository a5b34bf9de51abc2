"""Checks of incoming tables.  A check returns a table of violations; ``require`` turns it into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted range per forecast variable.
RANGES = {"rain": (0, 500), "tmax": (-5, 50), "tmin": (-10, 40), "rh": (0, 100), "wind": (0, 200)}
REQUIRED_FORECAST = ["lead_day", "rain", "tmax", "tmin", "rh", "wind"]


class ForecastTableError(ValueError):
    """A forecast table that must not be used; ``unknown`` holds all keys that have no parent, where that was asked."""

    def __init__(self, message: str, unknown: DataFrame | None = None):
        super().__init__(message)
        self.unknown = unknown


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules counted in one pass: ``(rule, n)`` for rules with n > 0."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    long = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])
    return counts.select(F.explode(long).alias("v")).select("v.*").where("n > 0")


def forecast_rules(leads: list[int], ranges: dict[str, tuple] = RANGES) -> dict[str, Column]:
    """Lead day in the list, every variable in its range (a missing value is outside), tmin not above tmax."""
    rules = {"lead_day": ~F.col("lead_day").isin(leads)}
    for v, (lo, hi) in ranges.items():
        rules[f"range_{v}"] = ~F.coalesce(F.col(v).between(lo, hi), F.lit(False))
    rules["tmin_above_tmax"] = F.col("tmin") > F.col("tmax")
    return rules


def unknown_keys(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Key values without a match, once each."""
    return df.select(key).distinct().join(known.select(key), key, "left_anti")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return violations(df, {c: F.col(c).isNull() for c in columns})


def below_coverage(df: DataFrame, share: Column, least: float, sample: int = 5) -> DataFrame:
    """A few rows whose valid share is below ``least``."""
    return df.where(share < least).orderBy(*df.columns).limit(sample)


def coverage_by_month(df: DataFrame, date: Column, columns: list[str]) -> DataFrame:
    """Share of known values per month and column, in long form."""
    wide = df.groupBy(date.alias("month")).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot("month", columns, "input", "share")


def input_gaps(df: DataFrame, issue_month: Column, columns: list[str], norm: DataFrame, tolerance: float) -> DataFrame:
    """Inputs whose known share falls short of the seasonal norm by more than ``tolerance``."""
    now = coverage_by_month(df, issue_month, columns).withColumnRenamed("share", "now")
    return now.join(norm.withColumnRenamed("share", "norm"), ["month", "input"]).where(F.col("now") < F.col("norm") - tolerance)


def attribute_agreement(df: DataFrame, a: str, b: str, key: str, sample: int = 25) -> DataFrame:
    """Disagreeing rows (NULL equals NULL), the first ``sample`` by key."""
    return df.where(~F.col(a).eqNullSafe(F.col(b))).orderBy(key).limit(sample)


def area_balance(units: DataFrame, others: DataFrame, parents: DataFrame, area: str, tolerance: float = 0.01) -> DataFrame:
    """Total of unit and other areas against the parents' total, and whether they agree."""
    parts = units.select(area).unionByName(others.select(area)).agg(F.sum(area).alias("parts"))
    both = parts.withColumn("whole", parents.agg(F.sum(area)).scalar())
    return both.withColumn("ratio", F.col("parts") / F.col("whole")).withColumn("balanced", F.abs(F.col("ratio") - 1) <= tolerance)


def split_by_pattern(df: DataFrame, column: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text matches the pattern, and the others."""
    hit = F.coalesce(F.col(column).cast("string").rlike(pattern), F.lit(False))
    return df.where(hit), df.where(~hit)


def profile(df: DataFrame, unit: str, date: str, lead: str, targets: list[str]) -> DataFrame:
    """One row that describes a panel: size, units, days, leads, period and share of known targets."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(unit).alias("units"), F.count_distinct(date).alias("dates"),
                  F.concat_ws(",", F.sort_array(F.collect_set(lead))).alias("leads"), F.min(date).alias("first"), F.max(date).alias("last"),
                  *[(100 * F.avg(F.col(c).isNotNull().cast("double"))).alias(f"{c}_pct") for c in targets])


def star_join(base: DataFrame, key: str, tables: dict[str, DataFrame | None]) -> tuple[DataFrame, list[str]]:
    """Left join of every covariate table that is present, and the names of the absent ones."""
    present = [d for d in tables.values() if d is not None]
    return reduce(lambda a, d: a.join(d, key, "left"), present, base), [n for n, d in tables.items() if d is None]


def require_forecast(df: DataFrame, parents: DataFrame, leads: list[int], key: str = "block_lgd") -> DataFrame:
    """The table itself when it may be used; otherwise an error that names every problem.

    Counts go into the message; all unknown keys are in the error's ``unknown`` table.
    """
    missing = missing_columns(df, [key, *REQUIRED_FORECAST])
    if missing:
        raise ForecastTableError(f"missing columns: {missing}")
    problems = [f"{r['rule']}: {r['n']} rows" for r in violations(df, forecast_rules(leads)).collect()]
    strangers = unknown_keys(df, parents, key)
    n = strangers.count()
    if n:
        problems.append(f"unknown {key}: {n} keys")
    if not df.groupBy(key, "lead_day").count().where("count > 1").isEmpty():
        problems.append(f"duplicate ({key}, lead_day) rows")
    if problems:
        raise ForecastTableError("; ".join(problems), strangers)
    return df
