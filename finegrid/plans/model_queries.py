"""Queries that fit and apply models on the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from finegrid.functions import scores as S
from finegrid.functions.columns import season_terms
from finegrid.operators import linear as Ln
from finegrid.operators import model as Md
from finegrid.operators import panel as P
from finegrid.operators.relational import dealt
from finegrid.plans.bindings import sql
from finegrid.plans.panel_queries import CALIB_SQL, HOLD_SQL
from finegrid.plans.registry import R, query, r4
from finegrid.session import checkpointed, scratch_path

LAT0 = 18.5
SPEC = Md.VariableSpec("rain", "rain_obs", "fc_rain", ("fc_rain", "lead_day", "elev_diff", "doy_sin", "doy_cos", "area_km2"), lower=0.0, thresholds=(2.5, 64.5))
FAST = {"rounds": 5, "depth": 3, "step": 0.2}


def frame(t):
    """Panel with season terms, a contrast, and flags for training, calibration and testing days."""
    parent = t.unit.groupBy("block_lgd").agg(F.avg("elev").alias("_e"))
    df = t.panel.join(parent, "block_lgd").withColumn("elev_diff", F.col("elev") - F.col("_e")).drop("_e")
    df = df.withColumns(season_terms(F.col("valid_date"))).withColumn("month", F.month("valid_date"))
    days = P.calibration_days(t.panel.select("valid_date"), "valid_date", F.expr("to_date('2024-01-25')"), every=3)
    hold = P.holdout_units(t.unit, "gp_code", "block_lgd", 0.2, 42)
    return P.split_masks(df, days, hold, "gp_code", "valid_date", F.expr("to_date('2024-01-25')"))


def cached(t):
    """The modelling frame, written once, evenly by unit and day: every fit and prediction of a query reads some of its days again."""
    return checkpointed(dealt(frame(t), ["gp_code", "valid_date"]))


def scored(df, pred):
    c, ref = S.continuous(F.col("rain_obs"), F.col(pred)), S.continuous(F.col("rain_obs"), F.col("fc_rain"))
    return df.groupBy("lead_day").agg(c["n"].alias("n"), r4(c["rmse"]).alias("rmse"), r4(S.skill(c["rmse"], ref["rmse"])).alias("skill"))


@query("ridge_mos", "M7")
def ridge_mos(t):
    df = cached(t)
    features = ["fc_rain", "elev_diff", "doy_sin", "doy_cos", "lead_day", "is_monsoon"]
    m = Md.fit_ridge(df.where("train"), features, "rain_obs")
    return scored(Md.predict_ridge(m, df.where("test"), features), "ridge")


LINEAR = ["fc_rain", "lead_day", "elev_diff", "doy_sin", "doy_cos", "area_km2", "is_monsoon"]
FRAME_SQL = f""", {CALIB_SQL.replace("SELECT DISTINCT d FROM obs", "SELECT DISTINCT valid_date AS d FROM panel")}, {HOLD_SQL},
    e AS (SELECT block_lgd, avg(elev) AS e FROM unit GROUP BY 1),
    fr AS (SELECT p.*, p.elev - e.e AS elev_diff, sin(dayofyear(p.valid_date) * (2 * pi() / 365.25)) AS doy_sin, cos(dayofyear(p.valid_date) * (2 * pi() / 365.25)) AS doy_cos,
      CAST(month(p.valid_date) IN (6, 7, 8, 9) AS INTEGER) AS is_monsoon, p.valid_date >= DATE '2024-01-25' AS test,
      p.valid_date < DATE '2024-01-25' AND NOT coalesce(cal.is_calib, false) AND NOT coalesce(cal.is_buffer, false) AND h.gp_code IS NULL AS train
      FROM panel p JOIN e ON e.block_lgd = p.block_lgd LEFT JOIN cal ON cal.d = p.valid_date LEFT JOIN hold h ON h.gp_code = p.gp_code),
    tr AS (SELECT * FROM fr WHERE train AND rain_obs IS NOT NULL AND fc_rain IS NOT NULL)"""


def _elimination(groups, source, alpha=1.0):
    """SQL views: per group the normal equations on standardised inputs, solved by Gauss-Jordan; ``w`` holds the weights."""
    k = len(LINEAR)
    cov = [f"covar_pop({a}, {b}) AS c{i}_{j}" for i, a in enumerate(LINEAR) for j, b in enumerate(LINEAR)]
    cov += [f"covar_pop({a}, rain_obs) AS cy{i}" for i, a in enumerate(LINEAR)] + [f"avg({a}) AS m{i}" for i, a in enumerate(LINEAR)]
    flat = [f"(CASE WHEN c{i}_{i} > 0 THEN sqrt(c{i}_{i}) END)" for i in range(k)]
    cells = [f"coalesce(c{i}_{j} / {flat[i]} / {flat[j]}, {float(i == j)}) + {alpha if i == j else 0.0} / n AS a{i}_{j}" for i in range(k) for j in range(k)]
    cells += [f"coalesce(cy{i} / {flat[i]}, 0.0) AS b{i}" for i in range(k)] + [f"{flat[i]} AS s{i}" for i in range(k)] + [f"m{i}" for i in range(k)]
    views = [f"co AS (SELECT {groups}, count(*) AS n, avg(rain_obs) AS my, {', '.join(cov)} FROM {source} GROUP BY {groups})", f"e0 AS (SELECT {groups}, my, {', '.join(cells)} FROM co)"]
    kept = [f"s{i}, m{i}" for i in range(k)]
    for p in range(k):
        step = [f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" if i != p else f"a{i}_{j}" for i in range(k) for j in range(k)]
        step += [f"b{i} - a{i}_{p} / a{p}_{p} * b{p} AS b{i}" if i != p else f"b{i}" for i in range(k)]
        views.append(f"e{p + 1} AS (SELECT {groups}, my, {', '.join(step + kept)} FROM e{p})")
    views.append(f"w AS (SELECT {groups}, my, {', '.join(f'coalesce(b{i} / a{i}_{i} / s{i}, 0.0) AS w{i}, m{i}' for i in range(k))} FROM e{k})")
    return ", ".join(views), "w.my + " + " + ".join(f"w.w{i} * (fr.{f} - w.m{i})" for i, f in enumerate(LINEAR))


_ALL, _ALL_P = _elimination("one", "(SELECT *, 1 AS one FROM tr) tr")
_OUT, _OUT_P = _elimination("b", "(SELECT x.b, tr.* FROM (SELECT DISTINCT block_lgd AS b FROM fr) x JOIN tr ON tr.block_lgd <> x.b) tr")
_RMSE = "sqrt(avg(({} - rain_obs) * ({} - rain_obs)))"


@query("ridge_closed", "M7", sql(f"""{FRAME_SQL}, {_ALL},
    p AS (SELECT fr.*, {_ALL_P} AS ridge FROM fr CROSS JOIN w WHERE fr.test AND rain_obs IS NOT NULL AND fc_rain IS NOT NULL)
    SELECT lead_day, count(*) AS n, {R(_RMSE.format('ridge', 'ridge'))} AS rmse, {R("1 - " + _RMSE.format('ridge', 'ridge') + " / " + _RMSE.format('fc_rain', 'fc_rain'))} AS skill
    FROM p GROUP BY lead_day""", "panel"))
def ridge_closed(t):
    df = cached(t)
    return scored(Ln.predict(Ln.fit(df.where("train"), LINEAR, "rain_obs"), df.where("test and fc_rain is not null"), LINEAR), "ridge")


@query("leave_parent_out_linear", "M18 M7 A23", sql(f"""{FRAME_SQL}, {_OUT},
    p AS (SELECT fr.*, {_OUT_P} AS ridge FROM fr JOIN w ON w.b = fr.block_lgd WHERE fr.test AND rain_obs IS NOT NULL AND fc_rain IS NOT NULL)
    SELECT block_lgd, count(DISTINCT gp_code) AS units, count(*) AS n, {R(_RMSE.format('ridge', 'ridge'))} AS model_rmse, {R(_RMSE.format('fc_rain', 'fc_rain'))} AS copy_rmse,
      {R("1 - " + _RMSE.format('ridge', 'ridge') + " / " + _RMSE.format('fc_rain', 'fc_rain'))} AS skill FROM p GROUP BY block_lgd HAVING count(DISTINCT gp_code) >= 3""", "panel"))
def leave_parent_out_linear(t):
    out = Ln.leave_group_out(cached(t), "block_lgd", LINEAR, "rain_obs", "fc_rain", "train", "test", "gp_code", min_units=3)
    return out.select("block_lgd", "units", "n", r4("model_rmse").alias("model_rmse"), r4("copy_rmse").alias("copy_rmse"), r4("skill").alias("skill"))


@query("residual_trees", "M9 M10 M14 M2")
def residual_trees(t):
    df = cached(t)
    m = Md.fit_point(df.where("train"), df.where("calib"), SPEC, "linear", t.unit, LAT0, **FAST)
    return scored(Md.predict_point(m, df.where("test")), "rain_pred")


@query("space_select", "M11 M9")
def space_select(t):
    df = cached(t)
    best, rmse = Md.select_space(df.where("train"), df.where("calib"), SPEC, t.unit, LAT0, rounds=3)
    rows = [(k, float(v), k == best) for k, v in rmse.items()]
    return t.spark.createDataFrame(rows, "space string, rmse double, chosen boolean")


@query("quantile_conformal", "M12 W18 A18")
def quantile_conformal(t):
    df = cached(t)
    m = Md.fit_point(df.where("train"), df.where("calib"), SPEC, "linear", t.unit, LAT0, **FAST)
    m = Md.fit_intervals(m, df.where("train"), df.where("calib"))
    q = Md.predict_intervals(m, df.where("test"))
    y = F.col("rain_obs")
    return q.groupBy("lead_day").agg(r4(S.coverage(y, F.col("rain_q10"), F.col("rain_q90"))).alias("coverage"),
                                     F.count_if((F.col("rain_q10") > F.col("rain_q50")) | (F.col("rain_q50") > F.col("rain_q90"))).alias("crossed"),
                                     r4(F.avg(F.col("rain_q90") - F.col("rain_q10"))).alias("width"))


FAMILIES = {"fc_rain": "forecast", "lead_day": "forecast", "elev_diff": "terrain", "area_km2": "terrain", "doy_sin": "season", "doy_cos": "season", "hist_bias": "history"}


@query("tree_contributions", "M16 A32")
def tree_contributions(t):
    """Mean and mean size of each family's part of the residual estimate, and the largest gap between parts and estimate."""
    df = cached(t)
    m = Md.fit_point(df.where("train"), df.where("calib"), SPEC, "linear", t.unit, LAT0, **FAST)
    rows = Md.tree_contributions(m, df.where("test"), FAMILIES)
    gap = F.abs(F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda s, v: s + v) - F.col("r_hat"))
    long = rows.select("lead_day", gap.alias("gap"), F.explode("contributions").alias("family", "value"))
    return long.groupBy("lead_day", "family").agg(r4(F.avg("value")).alias("mean"), r4(F.avg(F.abs("value"))).alias("size"), r4(F.max("gap")).alias("gap"))


@query("quantile_leaves", "M12 W18 A18")
def quantile_leaves(t):
    df = cached(t)
    m = Md.fit_point(df.where("train"), df.where("calib"), SPEC, "linear", t.unit, LAT0, **FAST)
    m = Md.fit_leaf_intervals(m, df.where("train"), df.where("calib"))
    q = Md.predict_leaf_intervals(m, df.where("test"))
    y = F.col("rain_obs")
    return q.groupBy("lead_day").agg(r4(S.coverage(y, F.col("rain_q10"), F.col("rain_q90"))).alias("coverage"),
                                     F.count_if((F.col("rain_q10") > F.col("rain_q50")) | (F.col("rain_q50") > F.col("rain_q90"))).alias("crossed"),
                                     r4(F.avg(F.col("rain_q90") - F.col("rain_q10"))).alias("width"))


@query("exceedance_isotonic", "M13 A15")
def exceedance_isotonic(t):
    df = cached(t)
    m = Md.fit_point(df.where("train"), None, SPEC, "linear", t.unit, LAT0, rounds=2, depth=2)
    m = Md.fit_exceedance(m, df.where("train"), df.where("calib"), rounds=3)
    p = Md.predict_exceedance(m, df.where("test"))
    names = [c for c in p.columns if "_p_ge_" in c]
    long = p.where("rain_obs is not null").unpivot(["rain_obs"], names, "name", "p")
    thr = F.regexp_replace(F.regexp_extract("name", "_p_ge_(.*)$", 1), "p", ".").cast("double")
    b = S.brier((F.col("rain_obs") >= thr), F.col("p"))
    return long.groupBy("name").agg(F.count("p").alias("n"), r4(b["brier"]).alias("brier"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("outside"))


@query("group_cv", "M15")
def group_cv(t):
    df = cached(t).where("train").drop("train", "calib", "test", "holdout")
    res = Md.grouped_search(df, SPEC, "linear", [{"rounds": 2, "depth": 2}, {"rounds": 2, "depth": 3}], t.unit, LAT0, folds=2)
    return t.spark.createDataFrame([(r["rounds"], r["depth"], float(r["cv_rmse"])) for r in res], "rounds int, depth int, cv_rmse double")


@query("leave_parent_out", "M18 A23")
def leave_parent_out(t):
    df = cached(t)
    out = Md.leave_parent_out(df, SPEC, "linear", t.unit, LAT0, "train", "test", min_units=3, rounds=2, depth=2)
    return out.select("block_lgd", "units", "n", r4("model_rmse").alias("model_rmse"), r4("copy_rmse").alias("copy_rmse"), r4("skill").alias("skill"))


@query("importance", "M17 A32")
def importance(t):
    df = cached(t)
    m = Md.fit_point(df.where("train"), None, SPEC, "linear", t.unit, LAT0, **FAST)
    return t.spark.createDataFrame([(k, float(v)) for k, v in Md.importance(m).items()], "feature string, share double")


@query("operational_refit", "M20 M14 M21")
def operational_refit(t):
    df = cached(t)
    path = scratch_path(t.spark, "model")
    Md.fit_operational(df.where("rain_obs is not null"), "calib", SPEC, "linear", t.unit, LAT0, path)
    m = Md.load_operational(t.spark, SPEC, "linear", path)
    return scored(Md.predict_all({"rain": m}, df.where("test")), "rain_pred")
