"""Ridge regression in closed form from moments per group: one pass over the rows, whatever the number of groups left out.

Moments (count, means, summed products of deviations) of groups add up and can be taken away again, so the model
that has not seen a group needs no pass of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finegrid.functions import scores as S
from finegrid.session import stored

MOMENTS = "moments"
FLAT = 1e-12  # a variance below this part of what it was computed from is rounding


def _place(i: int, j: int) -> int:
    """Where the product of variables ``i`` and ``j`` stands in the list of products."""
    i, j = max(i, j), min(i, j)
    return i * (i + 1) // 2 + j


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i + 1)]


def moments(df: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    """One row per key with ``moments``: ``n``, ``mean`` and ``co`` (lower triangle) of the inputs, then the label.

    Rows with a missing or not-a-number input or label take no part. A null key is a key of its own. An empty table
    gives no row, or, without keys, one row with a count of zero.
    """
    names = [*features, label]
    x = [F.col(v).cast("double") for v in names]
    n = F.count(F.lit(1)).cast("double")
    co = F.array(*[F.covar_pop(x[i], x[j]) * n for i, j in _pairs(len(x))])
    parts = F.struct(n.alias("n"), F.array(*[F.avg(v) for v in x]).alias("mean"), co.alias("co"))
    return df.dropna(subset=names).groupBy(*keys).agg(parts.alias(MOMENTS))


def _total(stats: DataFrame, size: int) -> tuple[Column, Column]:
    """Means and products of all groups together, as scalar subqueries over a stored table of groups."""
    m = F.col(MOMENTS)
    n = F.sum(m["n"])
    head = stats.agg(F.struct(n.alias("n"), F.array(*[F.sum(m["n"] * m["mean"][i]) / F.nullif(n, F.lit(0.0)) for i in range(size)]).alias("mean")).alias("t")).scalar()
    d = [m["mean"][i] - F.col("_t")["mean"][i] for i in range(size)]
    co = F.array(*[F.sum(m["co"][_place(i, j)] + m["n"] * d[i] * d[j]) for i, j in _pairs(size)])
    return head, stats.withColumn("_t", head).agg(co.alias("co")).scalar()


def without_each(stats: DataFrame, inputs: int) -> DataFrame:
    """The stored table ``stats`` with the moments of all other groups in place of each group's own.

    A group that holds all rows gets a count of zero and null means.
    """
    size = inputs + 1
    head, co = _total(stats, size)
    m, t = F.col(MOMENTS), F.col("_t")
    rest = t["n"] - m["n"]
    df = stats.withColumns({"_t": head, "_co": co})
    df = df.withColumn("_mean", F.array(*[(t["n"] * t["mean"][i] - m["n"] * m["mean"][i]) / F.nullif(rest, F.lit(0.0)) for i in range(size)]))
    gap = [m["mean"][i] - F.col("_mean")[i] for i in range(size)]

    def left(i: int, j: int) -> Column:
        whole = F.col("_co")[_place(i, j)]
        c = whole - m["co"][_place(i, j)] - gap[i] * gap[j] * m["n"] * rest / t["n"]
        return F.when(c > whole * FLAT, c).otherwise(0.0) if i == j else c

    parts = F.struct(rest.alias("n"), F.col("_mean").alias("mean"), F.array(*[left(i, j) for i, j in _pairs(size)]).alias("co"))
    return df.withColumn(MOMENTS, parts).drop("_t", "_co", "_mean")


def solve(stats: DataFrame, inputs: int, alpha: float = 1.0) -> DataFrame:
    """Adds ``weights`` (per unit of each input) and ``intercept``, and drops ``moments``.

    Least squares on inputs of mean 0 and variance 1 with ``alpha`` times the sum of squared weights added. An input
    that does not vary gets weight 0; without rows, or where the system is singular, both are null. The factor of
    the matrix is written out as columns, one projection per row of it.
    """
    m = F.col(MOMENTS)
    n = F.nullif(m["n"], F.lit(0.0))
    var = [m["co"][_place(i, i)] / n for i in range(inputs)]
    sd = [F.when(v > F.pow(m["mean"][i], F.lit(2)) * FLAT * FLAT, F.sqrt(v)) for i, v in enumerate(var)]
    df = stats.withColumns({f"_sd{i}": s for i, s in enumerate(sd)} | {"_n": n})
    cell = {f"_a{i}_{j}": F.coalesce(m["co"][_place(i, j)] / F.col("_n") / F.col(f"_sd{i}") / F.col(f"_sd{j}"), F.lit(float(i == j))) + (alpha / F.col("_n") if i == j else 0.0)
            for i, j in _pairs(inputs)}
    cell |= {f"_a{inputs}_{j}": F.coalesce(m["co"][_place(inputs, j)] / F.col("_n") / F.col(f"_sd{j}"), F.lit(0.0)) for j in range(inputs)}
    df = df.withColumns(cell)
    for j in range(inputs):  # column j of the Cholesky factor; its last row is the forward substitution of the label
        def inner(i, j=j):
            return F.col(f"_a{i}_{j}") - sum((F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)), F.lit(0.0))

        df = df.withColumn(f"_l{j}_{j}", F.when(inner(j) > FLAT, F.sqrt(inner(j))))
        df = df.withColumns({f"_l{i}_{j}": inner(i) / F.col(f"_l{j}_{j}") for i in range(j + 1, inputs + 1)})
    for j in reversed(range(inputs)):
        known = sum((F.col(f"_l{i}_{j}") * F.col(f"_w{i}") for i in range(j + 1, inputs)), F.lit(0.0))
        df = df.withColumn(f"_w{j}", (F.col(f"_l{inputs}_{j}") - known) / F.col(f"_l{j}_{j}"))
    whole = F.col("_n").isNotNull()
    for j in range(inputs):
        whole = whole & F.col(f"_w{j}").isNotNull()
    weights = F.when(whole, F.array(*[F.coalesce(F.col(f"_w{j}") / F.col(f"_sd{j}"), F.lit(0.0)) for j in range(inputs)]))
    kept = [c for c in stats.columns if c != MOMENTS]
    df = df.withColumn("weights", weights)
    intercept = m["mean"][inputs] - sum((F.col("weights")[j] * m["mean"][j] for j in range(inputs)), F.lit(0.0))
    return df.select(*kept, "weights", intercept.alias("intercept"))


def estimate(features: list[str]) -> Column:
    """Estimate from ``weights`` and ``intercept`` of the row; null where an input is."""
    return F.col("intercept") + sum((F.col("weights")[i] * F.col(f).cast("double") for i, f in enumerate(features)), F.lit(0.0))


def fit(train: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> DataFrame:
    """One row with ``weights`` and ``intercept``."""
    return solve(moments(train, [], features, label), len(features), alpha)


def predict(model: DataFrame, df: DataFrame, features: list[str], name: str = "ridge") -> DataFrame:
    """Adds the estimate of a one-row model as ``name``; columns of ``df`` keep their names and values."""
    one = model.agg(F.first(F.struct("weights", "intercept"))).scalar()
    m = F.col("_model")
    value = m["intercept"] + sum((m["weights"][i] * F.col(f).cast("double") for i, f in enumerate(features)), F.lit(0.0))
    return df.withColumn("_model", one).withColumn(name, value).drop("_model")


def leave_group_out(df: DataFrame, group: str, features: list[str], label: str, reference: str, train: str, test: str, unit: str,
                    min_units: int = 5, alpha: float = 1.0) -> DataFrame:
    """Scores per group of the ridge model that has not seen the group, beside those of ``reference``.

    ``train`` and ``test`` are flag columns; groups with fewer than ``min_units`` units among the test rows are left
    out. Rows without a group take part in training and are not scored. Only moments, one row per group, are kept
    between the pass that collects them and the pass that scores; the jobs do not grow with the groups.
    """
    inputs, size = len(features), len(features) + 1
    own = moments(df.where(train), [group], features, label)
    none = F.struct(F.lit(0.0).alias("n"), F.array(*[F.lit(0.0)] * size).alias("mean"), F.array(*[F.lit(0.0)] * len(_pairs(size))).alias("co"))
    groups = df.where(test).select(F.col(group).alias("_g")).distinct()
    # groups that have test rows only are left out of nothing: their model sees all training rows
    stats = groups.join(own, F.col("_g").eqNullSafe(F.col(group)), "full").select(F.coalesce(group, "_g").alias(group), F.coalesce(MOMENTS, none).alias(MOMENTS))
    models = stored(solve(without_each(stored(stats, "moments"), inputs), inputs, alpha), "ridge")
    rows = df.where(test).select(F.col(group), F.col(unit).alias("_unit"), F.col(label).cast("double").alias("_y"), F.col(reference).cast("double").alias("_ref"), *[F.col(f).alias(f"_x{i}") for i, f in enumerate(features)])
    rows = rows.where(F.col("_y").isNotNull() & F.col("_ref").isNotNull()).join(models, group)
    rows = rows.withColumn("_p", estimate([f"_x{i}" for i in range(inputs)])).where("_p is not null")
    ours, other = S.continuous(F.col("_y"), F.col("_p")), S.continuous(F.col("_y"), F.col("_ref"))
    out = rows.groupBy(group).agg(F.count_distinct("_unit").alias("units"), ours["n"].alias("n"), ours["rmse"].alias("model_rmse"), other["rmse"].alias("copy_rmse"),
                                  S.skill(ours["rmse"], other["rmse"]).alias("skill"))
    return out.where(F.col("units") >= min_units)
