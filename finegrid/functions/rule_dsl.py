"""Day-sequence predicates compiled to column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = {
    "ge": lambda a, b: a >= b,
    "gt": lambda a, b: a > b,
    "le": lambda a, b: a <= b,
    "lt": lambda a, b: a < b,
}
VARIABLES = ("rain", "rain_2day", "tmax", "tmin", "tmean", "rh")


def sure(c: Column) -> Column:
    """False where the condition is unknown."""
    return F.coalesce(c, F.lit(False))


def mask(days: Column, condition) -> Column:
    """Array of booleans, one per day."""
    return F.transform(days, lambda d: sure(condition(d)))


def true_positions(flags: Column) -> Column:
    """0-based positions of the true entries."""
    marked = F.transform(flags, lambda ok, i: F.when(ok, i.cast("int")))
    return F.array_compact(marked)


def longest_true_run(flags: Column) -> Column:
    """Length of the longest run of true entries."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, ok: Column) -> Column:
        run = F.when(ok, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(flags, start, step, lambda acc: acc["best"])


def derived_days(days: Column) -> Column:
    """Days with the two derived variables: mean temperature and two-day rain (0 before the first day)."""
    def derive(d: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(days, i)["rain"]).otherwise(0.0)
        return F.struct(d["rain"].alias("rain"), (d["rain"] + before).alias("rain_2day"), d["tmax"].alias("tmax"),
                        d["tmin"].alias("tmin"), ((d["tmax"] + d["tmin"]) / 2).alias("tmean"), d["rh"].alias("rh"))

    return F.transform(days, derive)


def compile_rule(when: dict[str, dict[str, float]]):
    """Predicate on a derived day from ``{variable: {operator: threshold}}``; unknown names are errors."""
    for var, cond in when.items():
        if var not in VARIABLES:
            raise KeyError(f"unknown variable '{var}' (use one of {sorted(VARIABLES)})")
        for op in cond:
            if op not in OPS:
                raise KeyError(f"unknown operator '{op}' (use one of {sorted(OPS)})")

    def predicate(d: Column) -> Column:
        parts = [OPS[op](d[var], float(thr)) for var, cond in when.items() for op, thr in cond.items()]
        return reduce(lambda a, b: a & b, parts)

    return predicate


def runs_to(flags: Column, n: int) -> Column:
    """Whether ``n`` true entries stand in a row; entries are never null. Compiled, unlike `longest_true_run`."""
    if n < 1:
        return F.lit(True)
    return F.contains(F.array_join(flags.cast("array<string>"), ","), F.lit(",".join(["true"] * n)))


def true_count(flags: Column) -> Column:
    """Number of true entries; entries are never null. Compiled."""
    return F.size(F.array_remove(flags, False))


def risk_level(levels: list[dict], flags_of, model: str | None = None) -> Column:
    """First level whose rule fires, with its favourable days: ``struct<level, days>`` (level 0 when none does).

    ``flags_of`` maps a ``when`` condition to its column of day flags.  With ``model``, that name stands first in
    the struct.  Positions, which are not compiled, are sought for the level that fires only.
    """
    def value(level: int, days: Column) -> Column:
        named = [] if model is None else [F.lit(model).alias("model")]
        return F.struct(*named, F.lit(level).alias("level"), days.alias("days"))

    out = None
    for lv in levels:
        flags = flags_of(lv["when"])
        fired = runs_to(flags, lv["consecutive"]) if "consecutive" in lv else true_count(flags) >= lv["min_days"]
        found = value(int(lv["level"]), true_positions(flags))
        out = F.when(fired, found) if out is None else out.when(fired, found)
    return out.otherwise(value(0, F.array().cast("array<int>")))
