"""Forecast panels and day sequences: expansion, trailing windows, as-of joins, folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finegrid.operators.relational import bucket_of_md5, salted_join


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def persistence_forecast(parent_day: DataFrame, leads: list[int], value: str, out: str) -> DataFrame:
    """Today's parent value issued as the forecast for each lead day."""
    issue = F.col("d")
    return (parent_day.select("block_lgd", issue.alias("issue_date"), F.explode(_ints(leads)).alias("lead_day"),
                              F.col(value).alias(out))
            .select("block_lgd", "issue_date", F.date_add("issue_date", F.col("lead_day")).alias("valid_date"), "lead_day", out))


def expand_to_units(fc: DataFrame, units: DataFrame, key: str = "block_lgd", unit: str = "gp_code", units_per_task: int = 20_000) -> DataFrame:
    """Every forecast row of a parent for every unit of that parent.

    A parent with more than ``units_per_task`` units is spread over as many partitions as
    they need, so that no parent is one task; only its forecasts are repeated.
    """
    return salted_join(units, fc, [key], [unit], units_per_task)


# --- hourly and daily ---------------------------------------------------------------------

def hourly_to_daily(hourly: DataFrame, keys: list[str], time: str, min_hours: int = 20) -> DataFrame:
    """Daily rain total, temperature extremes, mean humidity and maximum wind.

    A day with fewer than ``min_hours`` known temperatures has no values; the rain
    total also needs that many known rain hours.
    """
    day = hourly.groupBy(*keys, F.to_date(time).alias("valid_date")).agg(
        F.when(F.count("rain") >= min_hours, F.sum("rain")).alias("rain"), F.max("temp").alias("tmax"),
        F.min("temp").alias("tmin"), F.avg("rh").alias("rh"), F.max("wind").alias("wind"), F.count("temp").alias("n_hours"))
    complete = F.col("n_hours") >= min_hours
    return day.select(*keys, "valid_date", *[F.when(complete, F.col(c)).alias(c) for c in ("rain", "tmax", "tmin", "rh", "wind")],
                      "n_hours")


def short_range_summary(steps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Total, largest step and number of missing steps; a missing step is not a zero."""
    return steps.groupBy(*keys).agg(F.round(F.sum(value), 1).alias("mm_total"), F.round(F.max(value), 1).alias("max_step"),
                                    F.count("*").alias("steps"), (F.count("*") - F.count(value)).alias("missing_steps"))


def date_spine(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """One row per key and calendar day between its first and last day; other columns may be NULL."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    days = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(date))
    return days.join(df, [*keys, date], "left")


def _day_window(keys: list[str], date: str, first: int, last: int) -> Window:
    """Rows of the same key whose day lies in ``[day + first, day + last]``."""
    return Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(first, last)


def ffill_limited(df: DataFrame, keys: list[str], date: str, value: str, limit: int, out: str) -> DataFrame:
    """Last known value at most ``limit`` days old."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_day_window(keys, date, -limit, 0)))


def trailing_lead1(fc: DataFrame, value: str, out: str, days: int = 3) -> DataFrame:
    """Sum of the lead-1 forecasts valid on the ``days`` days up to the issue date; needs all of them."""
    lead1 = fc.where("lead_day = 1").groupBy("block_lgd", "valid_date").agg(F.min(value).alias("_v"))
    w = _day_window(["block_lgd"], "valid_date", 1 - days, 0)
    ante = lead1.select("block_lgd", F.col("valid_date").alias("issue_date"),
                        F.when(F.count("_v").over(w) == days, F.sum("_v").over(w)).alias(out))
    return fc.join(ante, ["block_lgd", "issue_date"], "left")


def issue_total(fc: DataFrame, value: str, leads: list[int], out: str) -> DataFrame:
    """Forecast total of the issue over the given leads, on every row of the issue (a handful of leads each)."""
    w = Window.partitionBy("block_lgd", "issue_date")
    return fc.withColumn(out, F.coalesce(F.sum(F.when(F.col("lead_day").isin(leads), F.col(value))).over(w), F.lit(0.0)))


def antecedent(requests: DataFrame, obs: DataFrame, unit: str, issue: str, day: str, value: str, out: str,
               latency: int = 3, length: int = 7, min_known: int = 5, carry_days: int = 0) -> DataFrame:
    """Observed total over the newest ``length`` days that were published at issue time.

    The window is ``[issue - latency - length + 1, issue - latency]`` and needs
    ``min_known`` values.  With ``carry_days`` an incomplete window falls back to
    the newest complete one, at most that many days older.  ``obs`` has one row per
    unit and day, so a unit's sequence is bounded by the calendar.
    """
    asked = requests.select(unit, issue).distinct()
    both = obs.select(unit, F.col(day).alias("_d"), F.col(value).alias("_v"), F.lit(False).alias("_ask")).unionByName(
        asked.select(unit, F.col(issue).alias("_d"), F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_ask")))
    options = []
    for k in range(carry_days + 1):
        w = _day_window([unit], "_d", -latency - length + 1 - k, -latency - k)
        options.append(F.when(F.count("_v").over(w) >= min_known, F.sum("_v").over(w)))
    ante = both.withColumn(out, F.coalesce(*options)).where("_ask").select(unit, F.col("_d").alias(issue), out)
    return requests.join(ante, [unit, issue], "left")


def previous_day_sum(df: DataFrame, keys: list[str], date: str, value: str, out: str) -> DataFrame:
    """Value plus the previous row's value (0 before the first row)."""
    w = Window.partitionBy(*keys).orderBy(date)
    return df.withColumn(out, F.col(value) + F.lag(value, 1, 0.0).over(w))


def longest_run(df: DataFrame, keys: list[str], order: str, favourable: Column) -> DataFrame:
    """Length of the longest run of favourable rows per key, and how many are favourable."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.select(*keys, order, F.coalesce(favourable, F.lit(False)).alias("_ok"), F.row_number().over(w).alias("_rn"))
    marked = marked.withColumn("_island", F.col("_rn") - F.sum(F.col("_ok").cast("int")).over(w))
    runs = marked.groupBy(*keys, "_island").agg(F.count_if("_ok").alias("_len"))
    return runs.groupBy(*keys).agg(F.max("_len").alias("longest_run"), F.sum("_len").alias("favourable"))


def first_worst_day(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """First day on which the value is greatest and on which it is least."""
    known = F.col(value).isNotNull()
    return df.where(known).groupBy(*keys).agg(
        F.min_by(day, F.struct(-F.col(value), F.col(day))).alias("first_max_day"), F.max(value).alias("max_value"),
        F.min_by(day, F.struct(F.col(value), F.col(day))).alias("first_min_day"), F.min(value).alias("min_value"))


# --- as-of and shifted joins --------------------------------------------------------------

def asof_backward(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, value: str, out: str,
                  tolerance_days: int) -> DataFrame:
    """Newest right value on or before each left day, at most ``tolerance_days`` old.

    Days are cut into spans as long as the tolerance.  A right row is placed in its
    own span and in the next one, so a key's history is processed span by span.
    """
    span = max(1, tolerance_days)

    def span_of(c: Column) -> Column:
        return F.floor(F.unix_date(c) / span)

    newest = right.where(F.col(value).isNotNull()).groupBy(key, right_day).agg(F.max(value).alias("_v"))
    r = newest.select(key, F.unix_date(right_day).alias("_t"), F.lit(0).alias("_side"), "_v",
                      F.explode(F.array(span_of(F.col(right_day)), span_of(F.col(right_day)) + 1)).alias("_span"))
    asked = left.select(key, left_day).distinct()
    q = asked.select(key, F.unix_date(left_day).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"),
                     span_of(F.col(left_day)).alias("_span"))
    w = Window.partitionBy(key, "_span").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_side") == 0, F.struct("_t", "_v")), ignorenulls=True).over(w)
    found = r.unionByName(q).withColumn("_hit", hit).where("_side = 1")
    fresh = F.col("_t") - F.col("_hit._t") <= tolerance_days
    found = found.select(key, F.date_from_unix_date("_t").alias(left_day), F.when(fresh, F.col("_hit._v")).alias(out),
                         F.when(fresh, F.date_from_unix_date(F.col("_hit._t"))).alias(f"{out}_day"))
    return left.join(found, [key, left_day], "left")


def lagged_join(left: DataFrame, right: DataFrame, keys: list[str], date: str, lags: list[int]) -> DataFrame:
    """Inner join of ``left`` on day D with ``right`` on day D - lag, for every lag in one pass."""
    shifted = right.withColumn("lag", F.explode(_ints(lags))).withColumn(date, F.date_add(date, F.col("lag")))
    return left.join(shifted, [*keys, date])


def in_season(month_day: Column, start: Column, end: Column) -> Column:
    """Whether an ``MM-dd`` text lies in a window that may wrap over the year's end."""
    return F.when(start <= end, month_day.between(start, end)).otherwise((month_day >= start) | (month_day <= end))


def season_stage(dates: DataFrame, calendar: DataFrame, date: str, parent: str) -> DataFrame:
    """First stage of each crop of the parent that is in season on the date.

    ``calendar`` has one row per (crop, parent, stage): crop, parent, ord, stage, start, end, kc.
    Distinct (parent, date) pairs are matched, so the join is as large as the calendar of days.
    """
    pairs = dates.select(parent, date).distinct().withColumn("_up", F.upper(parent))
    cal = calendar.withColumn("_up", F.upper("parent")).drop("parent")
    md = F.date_format(date, "MM-dd")
    hit = pairs.join(cal, "_up").where(in_season(md, F.col("start"), F.col("end")))
    stage = hit.groupBy(parent, date, "crop").agg(F.min(F.struct("ord", "stage", "stage_type", "kc")).alias("s"))
    return stage.select(parent, date, "crop", "s.stage", "s.stage_type", "s.kc")


def month_pick(df: DataFrame, months: list[str], date: str) -> Column:
    """Value of the column that belongs to the month of ``date``."""
    return F.element_at(F.array(*[F.col(m) for m in months]), F.month(date))


# --- folds and splits ---------------------------------------------------------------------

def time_folds(dates: DataFrame, date: str, folds: int) -> DataFrame:
    """Distinct days cut into contiguous folds 1..n; the first folds take the remainder.

    The un-partitioned window sees calendar days only, never data rows.
    """
    return dates.select(date).distinct().withColumn("fold", F.ntile(folds).over(Window.orderBy(date)))


def calibration_days(dates: DataFrame, date: str, before: Column, every: int = 5, gap: int = 2) -> DataFrame:
    """Days before ``before`` with flags: in a calibration week, or in the buffer around one."""
    days = dates.select(date).distinct().where(F.col(date) < before)
    everything = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    week = F.floor(F.datediff(date, F.min(date).over(everything)) / 7)
    days = days.withColumn("is_calib", week % every == every // 2)
    near = Window.orderBy(F.unix_date(date)).rangeBetween(-gap, gap)
    return days.withColumn("is_buffer", ~F.col("is_calib") & F.max("is_calib").over(near))


def holdout_units(units: DataFrame, unit: str, parent: str, fraction: float, seed: int, min_units: int = 5) -> DataFrame:
    """Units kept for spatial testing: a seeded share of every parent with enough units.

    Digest buckets are counted per parent first; only the one bucket in which the
    share ends needs ranking, so a huge parent is never sorted in one task.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(unit)))
    df = units.select(unit, parent).distinct().withColumn("_h", digest).withColumn("_b", bucket_of_md5(F.col("_h")))
    counts = df.groupBy(parent, "_b").agg(F.count("*").alias("_n"))
    per_parent = Window.partitionBy(parent)
    upto = F.sum("_n").over(per_parent.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_end", upto).withColumn("_total", F.sum("_n").over(per_parent))
    quota = F.bround(F.col("_total") * fraction)
    counts = counts.where(F.col("_total") >= min_units).withColumn("_left", quota - (F.col("_end") - F.col("_n")))
    df = df.join(counts.where("_left > 0"), [parent, "_b"])
    whole, split = df.where("_left >= _n"), df.where("_left < _n")
    rank = F.row_number().over(Window.partitionBy(parent, "_b").orderBy("_h", unit))
    split = split.withColumn("_r", rank).where("_r <= _left")
    return whole.select(unit, parent).unionByName(split.select(unit, parent))


def split_masks(panel: DataFrame, calib: DataFrame, hold: DataFrame, unit: str, date: str, test_start: Column) -> DataFrame:
    """Adds ``train``, ``calib``, ``test`` and ``holdout`` flags; no row is in two of the first three."""
    df = panel.join(calib, date, "left").join(hold.select(unit, F.lit(True).alias("_hold")), unit, "left")
    held, is_cal, is_buf = (F.coalesce(c, F.lit(False)) for c in ("_hold", "is_calib", "is_buffer"))
    before = F.col(date) < test_start
    return (df.withColumn("train", before & ~is_cal & ~is_buf & ~held).withColumn("calib", before & is_cal & ~held)
            .withColumn("test", ~before).withColumn("holdout", held).drop("_hold", "is_calib", "is_buffer"))
