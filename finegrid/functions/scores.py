"""Verification scores as aggregate columns, for use inside any ``groupBy().agg``.

Pairs with a missing side never count.  Each function returns named columns, so
several scores share one aggregation and one shuffle of partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _paired(y: Column, p: Column) -> tuple[Column, Column]:
    both = y.isNotNull() & p.isNotNull()
    return F.when(both, y), F.when(both, p)


def continuous(y: Column, p: Column) -> dict[str, Column]:
    """n, RMSE, MAE, bias and Pearson r (NULL for a constant side)."""
    y, p = _paired(y, p)
    e = p - y
    varies = (F.stddev_pop(y) > 0) & (F.stddev_pop(p) > 0)
    return {
        "n": F.count(e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "bias": F.avg(e),
        "r": F.when(varies, F.corr(y, p)),
    }


def skill(rmse: Column, reference_rmse: Column) -> Column:
    """One minus the RMSE ratio; NULL unless the reference RMSE is positive."""
    return F.when(reference_rmse > 0, 1 - rmse / reference_rmse)


def contingency_counts(y: Column, p: Column, threshold: Column | float) -> dict[str, Column]:
    y, p = _paired(y, p)
    obs, fc = y >= threshold, p >= threshold
    return {
        "hits": F.count_if(obs & fc),
        "misses": F.count_if(obs & ~fc),
        "false_alarms": F.count_if(~obs & fc),
        "correct_neg": F.count_if(~obs & ~fc),
    }


def contingency_scores(hits: Column, misses: Column, false_alarms: Column, correct_neg: Column) -> dict[str, Column]:
    """Event scores from the four counts; a zero denominator gives NULL."""
    a, c, b, d = (x.cast("double") for x in (hits, misses, false_alarms, correct_neg))
    n = a + b + c + d

    def ratio(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den)

    by_chance = ratio((a + b) * (a + c), n)
    return {
        "event_freq": ratio(a + c, n),
        "pod": ratio(a, a + c),
        "far": ratio(b, a + b),
        "csi": ratio(a, a + b + c),
        "ets": ratio(a - by_chance, a + b + c - by_chance),
        "freq_bias": ratio(a + b, a + c),
        "hss": ratio(2 * (a * d - b * c), (a + c) * (c + d) + (a + b) * (b + d)),
    }


def brier(event: Column, prob: Column) -> dict[str, Column]:
    """Brier score, its skill against the base rate, and the base rate."""
    event, prob = _paired(event.cast("double"), prob)
    score, base = F.avg((prob - event) * (prob - event)), F.avg(event)
    spread = base * (1 - base)
    return {"brier": score, "bss": F.when(spread > 0, 1 - score / spread), "base_rate": base}


def pinball(y: Column, q: Column, alpha: float) -> Column:
    y, q = _paired(y, q)
    d = y - q
    return F.avg(F.greatest(alpha * d, (alpha - 1) * d))


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(((y >= lo) & (y <= hi)).cast("double"))


def null_aware_mean(value: Column, weight: Column, min_covered: float = 1e-9) -> Column:
    """Weighted mean over known values, weights renormalised; NULL if too little weight is known."""
    known = F.when(value.isNotNull(), weight)
    covered = F.sum(known)
    return F.when(covered > min_covered, F.sum(value * known) / covered)
