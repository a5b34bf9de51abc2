"""Forecast verification tables: scores by slice, reference skills, bootstrap intervals, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finegrid.functions import scores as S
from finegrid.operators.relational import exact_quantiles


def _named(cols: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in cols.items()]


def score(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Continuous scores of one method per slice."""
    return df.groupBy(*by).agg(*_named(S.continuous(F.col(y), F.col(p))))


def score_methods(df: DataFrame, by: list[str], y: str, methods: list[str], references: dict[str, str]) -> DataFrame:
    """Scores of all methods per slice, with a skill against each reference method.

    ``references`` maps an output column to the method it compares with.  All methods
    are scored in one aggregation; the long form has slices x methods rows only.
    """
    wide = df.groupBy(*by).agg(*[F.struct(*_named(S.continuous(F.col(y), F.col(m)))).alias(m) for m in methods])
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("s"),
                               *[F.col(ref)["rmse"].alias(f"_{out}") for out, ref in references.items()]) for m in methods])
    long = wide.select(*by, F.explode(pairs).alias("m"))
    return long.select(*by, "m.method", "m.s.*", *[S.skill(F.col("m.s.rmse"), F.col(f"m._{out}")).alias(out) for out in references])


def score_slices(df: DataFrame, y: str, methods: list[str], reference: str, slices: dict[str, Column],
                 min_rows: int = 50) -> DataFrame:
    """Scores for every value of every slice column in one pass; small groups are left out."""
    parts = [F.struct(F.lit(n).alias("slice"), c.cast("string").alias("key")) for n, c in slices.items()]
    long = df.withColumn("_s", F.explode(F.array(*parts))).select("_s.slice", "_s.key", y, *methods)
    long = long.where("key is not null")
    big = long.groupBy("slice", "key").agg(F.count("*").alias("_rows"),
                                           *[F.struct(*_named(S.continuous(F.col(y), F.col(m)))).alias(m) for m in methods])
    big = big.where(F.col("_rows") >= min_rows)
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("s")) for m in methods])
    out = big.select("slice", "key", F.col(reference)["rmse"].alias("_ref"), F.explode(pairs).alias("m"))
    return out.select("slice", "key", "m.method", "m.s.*", S.skill(F.col("m.s.rmse"), F.col("_ref")).alias("skill"))


def with_subsets(df: DataFrame, unseen: str) -> DataFrame:
    """Each row once for all rows and once for its own subset (unseen or seen units)."""
    own = F.when(F.col(unseen), "unseen").otherwise("seen")
    return df.withColumn("subset", F.explode(F.array(F.lit("all"), own)))


def group_skill_summary(df: DataFrame, group: str, y: str, p: str, ref: str, min_rows: int = 50) -> DataFrame:
    """Unweighted and row-weighted mean of the group skills, and the skill from pooled squared errors."""
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(ref).isNotNull())
    g = ok.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("sse"),
                              F.sum(F.pow(F.col(ref) - F.col(y), F.lit(2.0))).alias("sse_ref")).where(F.col("n") >= min_rows)
    g = g.withColumn("skill", S.skill(F.sqrt("sse"), F.sqrt("sse_ref")))
    return g.agg(F.avg("skill").alias("mean_unweighted"), (F.sum(F.col("skill") * F.col("n")) / F.sum("n")).alias("mean_weighted"),
                 S.skill(F.sqrt(F.sum("sse")), F.sqrt(F.sum("sse_ref"))).alias("pooled"),
                 F.count_if(F.col("skill") > 0).alias("positive"), F.count("*").alias("groups"))


def contingency(df: DataFrame, by: list[str], y: str, p: str, thresholds: list[float]) -> DataFrame:
    """Contingency counts and scores per threshold and slice."""
    counts = df.groupBy(*by).agg(*[F.struct(F.lit(float(t)).alias("threshold"),
                                            *_named(S.contingency_counts(F.col(y), F.col(p), t))).alias(f"_t{i}")
                                   for i, t in enumerate(thresholds)])
    long = counts.select(*by, F.explode(F.array(*[F.col(f"_t{i}") for i in range(len(thresholds))])).alias("c")).select(*by, "c.*")
    four = [F.col(c) for c in ("hits", "misses", "false_alarms", "correct_neg")]
    return long.select("*", *_named(S.contingency_scores(*four)))


def reliability(df: DataFrame, event: str, prob: str, bins: int = 10) -> DataFrame:
    """Mean probability and observed frequency per equal-width bin; the last bin is closed."""
    ok = df.where(F.col(event).isNotNull() & F.col(prob).isNotNull())
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.col(prob) * bins).cast("int")))
    return ok.groupBy(b.alias("bin")).agg(F.avg(prob).alias("p_mean"), F.avg(F.col(event).cast("double")).alias("obs_freq"),
                                          F.count("*").alias("n"))


def bootstrap_skill(df: DataFrame, day: str, y: str, p: str, ref: str, draws: int = 300, block_days: int = 7) -> DataFrame:
    """Skill with a moving-block bootstrap interval over days.

    Rows shrink to squared-error sums per day before anything is drawn.  Draw k of
    block b starts at a position from a fixed linear congruential sequence, so a
    run can be repeated exactly.  Fewer than two blocks of days give no interval.
    """
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(ref).isNotNull())
    days = ok.groupBy(day).agg(F.sum(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("sp"),
                               F.sum(F.pow(F.col(ref) - F.col(y), F.lit(2.0))).alias("sr"), F.count("*").alias("n"))
    # the un-partitioned windows see one row per calendar day
    days = days.withColumn("pos", F.row_number().over(Window.orderBy(day)) - 1)
    total = days.agg(F.count("*").alias("n_days"), F.sum("sp").alias("sp"), F.sum("sr").alias("sr"))
    point = total.select("n_days", S.skill(F.sqrt("sp"), F.sqrt("sr")).alias("skill"))
    plan = point.where(F.col("n_days") >= 2 * block_days).select("n_days", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    blocks = F.ceil(F.col("n_days") / block_days)
    plan = plan.select("n_days", "draw", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("b"))
    number = F.col("draw") * 1000 + F.col("b")
    start = (1103515245 * number.cast("long") + 12345) % 2147483648 % (F.col("n_days") - block_days + 1)
    plan = plan.select("draw", "n_days", "b", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(block_days - 1))).alias("o"))
    plan = plan.where(F.col("b") * block_days + F.col("o") < F.col("n_days")).select("draw", (F.col("start") + F.col("o")).alias("pos"))
    drawn = plan.join(days.select("pos", "sp", "sr"), "pos").groupBy("draw").agg(
        S.skill(F.sqrt(F.sum("sp")), F.sqrt(F.sum("sr"))).alias("s"))
    ci = drawn.agg(F.percentile("s", [0.025, 0.975]).alias("q"))
    return point.withColumn("q", ci.scalar()).select("skill", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "n_days")


def conservation_report(df: DataFrame, pred: str, fc: str, weight: str) -> DataFrame:
    """How far the weighted unit mean departs from the parent forecast, over all parent forecasts."""
    ok = df.where(F.col(pred).isNotNull() & F.col(fc).isNotNull() & F.col(weight).isNotNull())
    g = ok.groupBy("block_lgd", "issue_date", "lead_day").agg(
        (F.sum(F.col(pred) * F.col(weight)) / F.sum(weight) - F.first(fc)).alias("diff"), F.first(fc).alias("fc"))
    g = g.withColumn("rel", F.abs(F.when(F.abs("fc") > 0.5, F.col("diff") / F.col("fc"))))
    stats = g.agg(F.avg(F.abs("diff")).alias("mean_abs_departure"), F.avg("diff").alias("mean_departure"),
                  F.count("*").alias("n_parent_forecasts"))
    median = exact_quantiles(g, [], "rel", {"median_abs_relative": 0.5})
    return stats.withColumn("median_abs_relative", median.scalar())


def density(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Counts on a square lattice of observed against predicted values."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ok.groupBy(F.floor(F.col(x) / width).cast("int").alias("bx"), F.floor(F.col(y) / width).cast("int").alias("by")
                      ).agg(F.count("*").alias("n"))


def anomaly_correlation(df: DataFrame, y: str, p: str, parent_value: str) -> DataFrame:
    """Correlation of unit departures from the parent value."""
    ok = F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(parent_value).isNotNull()
    return df.where(ok).agg(F.count("*").alias("n"), F.corr(F.col(y) - F.col(parent_value), F.col(p) - F.col(parent_value)).alias("r"))


def source_agreement(reference: DataFrame, source: DataFrame, keys: list[str], date: str, y: str, p: str,
                     lags: list[int], threshold: float) -> DataFrame:
    """Agreement of two observation sources at several day shifts, daily and on weekly sums."""
    from finegrid.operators.panel import lagged_join

    m = lagged_join(reference, source, keys, date, lags).where(F.col(y).isNotNull() & F.col(p).isNotNull())
    counts = S.contingency_counts(F.col(y), F.col(p), threshold)
    daily = m.groupBy("lag").agg(*_named(S.continuous(F.col(y), F.col(p))), S.contingency_scores(*counts.values())["csi"].alias("csi"))
    week = m.groupBy("lag", *keys, F.date_trunc("week", date).alias("_w")).agg(F.sum(y).alias("_y"), F.sum(p).alias("_p"))
    return daily.join(week.groupBy("lag").agg(F.corr("_y", "_p").alias("weekly_r")), "lag", "left")
