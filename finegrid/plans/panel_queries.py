"""Queries over forecast panels, day sequences, folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from finegrid.functions import scores as S
from finegrid.functions.columns import season_terms
from finegrid.operators import panel as P
from finegrid.operators import relational as L
from finegrid.operators import verify as V
from finegrid.plans.bindings import LEADS, sql
from finegrid.plans.registry import R, query, r4

SCORES_SQL = f"""CAST(count(e) AS BIGINT) AS n, {R('sqrt(avg(e * e))')} AS rmse, {R('avg(abs(e))')} AS mae, {R('avg(e)')} AS bias,
    CASE WHEN stddev_pop(y) > 0 AND stddev_pop(p) > 0 THEN {R('corr(y, p)')} END AS r"""


def rounded(df, cols):
    return df.select(*[r4(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("panel_minimum_slice", "J1 J2 A12 A13 M3 M4 S1", sql(f"""
    , b AS (SELECT block_lgd, lead_day, avg(rain_obs - fc_rain) AS bias FROM panel WHERE rain_obs IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT p.lead_day, p.rain_obs AS y, p.fc_rain AS c, p.fc_rain + coalesce(b.bias, 0) AS k
          FROM panel p LEFT JOIN b USING (block_lgd, lead_day) WHERE p.rain_obs IS NOT NULL)
    SELECT lead_day, CAST(count(*) AS BIGINT) AS n, {R('sqrt(avg((c - y) * (c - y)))')} AS rmse_copy,
      {R('sqrt(avg((k - y) * (k - y)))')} AS rmse_corrected, {R('avg(c - y)')} AS bias_copy, {R('corr(y, c)')} AS r_copy,
      {R('1 - sqrt(avg((k - y) * (k - y))) / sqrt(avg((c - y) * (c - y)))')} AS skill
    FROM m GROUP BY lead_day""", "panel"))
def panel_minimum_slice(t):
    panel = t.panel.where(F.col("rain_obs").isNotNull())
    bias = panel.groupBy("block_lgd", "lead_day").agg(F.avg(F.col("rain_obs") - F.col("fc_rain")).alias("b"))
    m = panel.join(bias, ["block_lgd", "lead_day"], "left").withColumn("k", F.col("fc_rain") + F.coalesce("b", F.lit(0.0)))
    y, c, k = F.col("rain_obs"), S.continuous(F.col("rain_obs"), F.col("fc_rain")), S.continuous(F.col("rain_obs"), F.col("k"))
    return m.groupBy("lead_day").agg(c["n"].alias("n"), r4(c["rmse"]).alias("rmse_copy"), r4(k["rmse"]).alias("rmse_corrected"),
                                     r4(c["bias"]).alias("bias_copy"), r4(c["r"]).alias("r_copy"),
                                     r4(S.skill(k["rmse"], c["rmse"])).alias("skill"))


@query("hourly_to_daily_complete", "A3 F4 S12", sql(f"""
    , h AS (SELECT CAST(user_id % 5 AS INTEGER) AS block_lgd, date_trunc('hour', ts) AS hr,
        sum(value) FILTER (WHERE event_type = 'click') AS rain, avg(value) AS temp,
        avg(value) FILTER (WHERE event_type = 'signup') AS rh, max(value) FILTER (WHERE event_type = 'purchase') AS wind
        FROM events GROUP BY 1, 2)
    SELECT block_lgd, CAST(hr AS DATE) AS valid_date,
      CASE WHEN count(temp) >= 18 AND count(rain) >= 18 THEN {R('sum(rain)')} END AS rain,
      CASE WHEN count(temp) >= 18 THEN {R('max(temp)')} END AS tmax, CASE WHEN count(temp) >= 18 THEN {R('min(temp)')} END AS tmin,
      CASE WHEN count(temp) >= 18 THEN {R('avg(rh)')} END AS rh, CASE WHEN count(temp) >= 18 THEN {R('max(wind)')} END AS wind,
      CAST(count(temp) AS BIGINT) AS n_hours FROM h GROUP BY 1, 2""", "unit"))
def hourly_to_daily_complete(t):
    def of(e):
        return F.when(F.col("event_type") == e, F.col("value"))

    hourly = t.events_d.groupBy((F.col("user_id") % 5).cast("int").alias("block_lgd"), F.date_trunc("hour", "ts").alias("hr")).agg(
        F.sum(of("click")).alias("rain"), F.avg("value").alias("temp"), F.avg(of("signup")).alias("rh"), F.max(of("purchase")).alias("wind"))
    out = P.hourly_to_daily(hourly, ["block_lgd"], "hr", min_hours=18)
    return rounded(out, ["rain", "tmax", "tmin", "rh", "wind"])


@query("trailing3_lead1", "W1 A4", sql(f"""
    , l AS (SELECT block_lgd, valid_date, min(fc_rain) AS v FROM fc WHERE lead_day = 1 GROUP BY 1, 2),
    a AS (SELECT block_lgd, valid_date AS issue_date, CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END AS ante3 FROM l
          WINDOW w AS (PARTITION BY block_lgd ORDER BY valid_date RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW))
    SELECT f.block_lgd, f.issue_date, f.lead_day, {R('a.ante3')} AS ante3,
      {R('sum(f.fc_rain) FILTER (WHERE f.lead_day <= 3) OVER (PARTITION BY f.block_lgd, f.issue_date)')} AS issue_sum
    FROM fc f LEFT JOIN a USING (block_lgd, issue_date)""", "fc"))
def trailing3_lead1(t):
    df = P.issue_total(P.trailing_lead1(t.fc, "fc_rain", "ante3"), "fc_rain", [1, 2, 3], "issue_sum")
    return df.select("block_lgd", "issue_date", "lead_day", r4("ante3").alias("ante3"), r4("issue_sum").alias("issue_sum"))


ANTE = """(SELECT CASE WHEN count(o.rain_obs) >= 5 THEN sum(o.rain_obs) END FROM obs o WHERE o.gp_code = q.gp_code
      AND o.d BETWEEN q.issue_date - {a} AND q.issue_date - {b})"""


@query("antecedent7_lag3", "W2 M21", sql(f"""
    , q AS (SELECT DISTINCT gp_code, issue_date FROM panel)
    SELECT gp_code, issue_date, {R(ANTE.format(a=9, b=3))} AS ante FROM q""", "panel"))
def antecedent7_lag3(t):
    asked = t.panel.select("gp_code", "issue_date").distinct()
    out = P.antecedent(asked, t.obs, "gp_code", "issue_date", "d", "rain_obs", "ante")
    return out.select("gp_code", "issue_date", r4("ante").alias("ante"))


@query("antecedent_carry_forward", "W2 W3 M21 P5", sql(f"""
    , q AS (SELECT DISTINCT gp_code, CAST(d + 4 AS DATE) AS issue_date FROM obs)
    SELECT gp_code, issue_date, {R(f"coalesce({ANTE.format(a=9, b=3)}, {ANTE.format(a=10, b=4)}, {ANTE.format(a=11, b=5)})")} AS ante
    FROM q""", "obs"))
def antecedent_carry_forward(t):
    asked = t.obs.select("gp_code", F.date_add("d", 4).alias("issue_date")).distinct()
    out = P.antecedent(asked, t.obs, "gp_code", "issue_date", "d", "rain_obs", "ante", carry_days=2)
    return out.select("gp_code", "issue_date", r4("ante").alias("ante"))


@query("date_spine", "W4", sql("""
    , s AS (SELECT gp_code, min(d) AS lo, max(d) AS hi FROM obs GROUP BY 1),
    x AS (SELECT gp_code, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM s)
    SELECT x.gp_code, x.d, o.rain_obs FROM x LEFT JOIN obs o USING (gp_code, d)""", "obs"))
def date_spine(t):
    return P.date_spine(t.obs.select("gp_code", "d", "rain_obs"), ["gp_code"], "d").select("gp_code", "d", "rain_obs")


@query("ffill_limited", "W3 W4", sql("""
    , s AS (SELECT gp_code, min(d) AS lo, max(d) AS hi FROM obs GROUP BY 1),
    x AS (SELECT gp_code, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM s)
    SELECT x.gp_code, x.d, (SELECT arg_max(o.rain_obs, o.d) FROM obs o WHERE o.gp_code = x.gp_code AND o.d BETWEEN x.d - 1 AND x.d) AS filled
    FROM x""", "obs"))
def ffill_limited(t):
    spine = P.date_spine(t.obs.select("gp_code", "d", "rain_obs"), ["gp_code"], "d")
    return P.ffill_limited(spine, ["gp_code"], "d", "rain_obs", 1, "filled").select("gp_code", "d", "filled")


@query("asof_latest_available", "J5", sql("""
    , r AS (SELECT CAST(user_id AS VARCHAR) AS gp_code, d AS rd, max(value) AS ndvi FROM events_d WHERE event_type = 'signup' GROUP BY 1, 2),
    q AS (SELECT DISTINCT gp_code, d FROM obs),
    j AS (SELECT q.gp_code, q.d, max(r.rd) AS rd FROM q LEFT JOIN r ON r.gp_code = q.gp_code AND r.rd <= q.d AND r.rd >= q.d - 6 GROUP BY 1, 2)
    SELECT j.gp_code, j.d, r.ndvi, j.rd AS ndvi_day FROM j LEFT JOIN r ON r.gp_code = j.gp_code AND r.rd = j.rd""", "obs"))
def asof_latest_available(t):
    right = t.events_d.where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("gp_code"), F.col("d").alias("rd"), "value")
    return P.asof_backward(t.obs.select("gp_code", "d"), right, "gp_code", "d", "rd", "value", "ndvi", 6)


@query("previous_day_sum", "W5", sql(f"""
    SELECT gp_code, d, {R('rain_obs + lag(rain_obs, 1, 0.0) OVER (PARTITION BY gp_code ORDER BY d)')} AS rain_2day FROM obs""", "obs"))
def previous_day_sum(t):
    out = P.previous_day_sum(t.obs, ["gp_code"], "d", "rain_obs", "rain_2day")
    return out.select("gp_code", "d", r4("rain_2day").alias("rain_2day"))


@query("longest_run", "W6", sql("""
    , m AS (SELECT gp_code, rain_obs < 80 AS ok, row_number() OVER (PARTITION BY gp_code ORDER BY d)
              - row_number() OVER (PARTITION BY gp_code, rain_obs < 80 ORDER BY d) AS g FROM obs),
    r AS (SELECT gp_code, g, ok, count(*) FILTER (WHERE ok) AS n FROM m GROUP BY 1, 2, 3)
    SELECT gp_code, CAST(max(n) AS BIGINT) AS longest_run, CAST(sum(n) AS BIGINT) AS favourable FROM r GROUP BY 1""", "obs"))
def longest_run(t):
    return P.longest_run(t.obs, ["gp_code"], "d", F.col("rain_obs") < 80)


@query("first_worst_day", "W7", sql("""
    SELECT gp_code, (SELECT min(d) FROM obs x WHERE x.gp_code = o.gp_code AND x.rain_obs = max(o.rain_obs)) AS first_max_day,
      max(o.rain_obs) AS max_value, (SELECT min(d) FROM obs x WHERE x.gp_code = o.gp_code AND x.rain_obs = min(o.rain_obs)) AS first_min_day,
      min(o.rain_obs) AS min_value FROM obs o GROUP BY gp_code""", "obs"))
def first_worst_day(t):
    return P.first_worst_day(t.obs, ["gp_code"], "d", "rain_obs")


@query("dedupe_keep_last", "W8", """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_keep_last(t):
    df = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return L.keep_one(df, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice"])


@query("history_upsert", "S19 U1 S6", """
    WITH o AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2),
    n AS (SELECT l_orderkey, l_linenumber, max(l_quantity) + 100 AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, coalesce(n.q, o.q) AS q FROM o FULL JOIN n USING (l_orderkey, l_linenumber)""")
def history_upsert(t):
    li = t.table("lineitem")
    key = ["l_orderkey", "l_linenumber"]
    old = li.where("l_returnflag <> 'A'").groupBy(*key).agg(F.max("l_quantity").alias("q"))
    new = li.where("l_returnflag = 'A'").groupBy(*key).agg((F.max("l_quantity") + 100).alias("q"))
    return L.upsert(old, new, key)


@query("final_over_prelim", "U2 X8", sql("""
    , f AS (SELECT gp_code, d, rain_obs FROM obs WHERE rain_obs >= 40),
    p AS (SELECT gp_code, d, round(rain_obs * 2, 2) AS rain_obs FROM obs WHERE rain_obs < 120)
    SELECT gp_code, d, coalesce(f.rain_obs, p.rain_obs) AS rain_obs, f.d IS NOT NULL AS is_final FROM f FULL JOIN p USING (gp_code, d)""", "obs"))
def final_over_prelim(t):
    cols = ["gp_code", "d", "rain_obs"]
    final = t.obs.where("rain_obs >= 40").select(*cols, F.lit(True).alias("is_final"))
    prelim = t.obs.where("rain_obs < 120").select("gp_code", "d", F.round(F.col("rain_obs") * 2, 2).alias("rain_obs"), F.lit(False).alias("is_final"))
    return L.upsert(prelim, final, ["gp_code", "d"])


@query("time_folds", "W9", sql("""
    SELECT d, CAST(ntile(5) OVER (ORDER BY d) AS INTEGER) AS fold FROM (SELECT DISTINCT d FROM obs)""", "obs"))
def time_folds(t):
    return P.time_folds(t.obs, "d", 5)


CALIB_SQL = """dd AS (SELECT DISTINCT d FROM obs WHERE d < DATE '2024-01-25'),
    c AS (SELECT d, (date_diff('day', (SELECT min(d) FROM dd), d) // 7) % 3 = 1 AS is_calib FROM dd),
    cal AS (SELECT d, is_calib, NOT is_calib AND EXISTS (SELECT 1 FROM c k WHERE k.is_calib AND abs(date_diff('day', k.d, c.d)) <= 2)
      AS is_buffer FROM c)"""
HOLD_SQL = """hold AS (SELECT gp_code, block_lgd FROM (SELECT gp_code, block_lgd, count(*) OVER (PARTITION BY block_lgd) AS n,
      row_number() OVER (PARTITION BY block_lgd ORDER BY md5('42:' || gp_code), gp_code) AS rn FROM unit)
      WHERE n >= 5 AND rn <= round_even(n * 0.2, 0))"""
TEST_START = "to_date('2024-01-25')"


@query("calibration_weeks", "W10", sql(f", {CALIB_SQL} SELECT d, is_calib, is_buffer FROM cal", "obs"))
def calibration_weeks(t):
    return P.calibration_days(t.obs, "d", F.expr(TEST_START), every=3)


@query("holdout_units", "W11", sql(f", {HOLD_SQL} SELECT gp_code, block_lgd FROM hold", "unit"))
def holdout_units(t):
    return P.holdout_units(t.unit, "gp_code", "block_lgd", 0.2, 42)


@query("split_masks", "P11 W10 W11", sql(f"""
    , {CALIB_SQL}, {HOLD_SQL},
    m AS (SELECT o.*, coalesce(cal.is_calib, false) AS ic, coalesce(cal.is_buffer, false) AS ib, h.gp_code IS NOT NULL AS holdout,
      o.d < DATE '2024-01-25' AS pre FROM obs o LEFT JOIN cal USING (d) LEFT JOIN hold h ON h.gp_code = o.gp_code)
    SELECT gp_code, d, pre AND NOT ic AND NOT ib AND NOT holdout AS train, pre AND ic AND NOT holdout AS calib, NOT pre AS test, holdout
    FROM m""", "obs", "unit"))
def split_masks(t):
    cal = P.calibration_days(t.obs, "d", F.expr(TEST_START), every=3)
    hold = P.holdout_units(t.unit, "gp_code", "block_lgd", 0.2, 42)
    return P.split_masks(t.obs, cal, hold, "gp_code", "d", F.expr(TEST_START)).select("gp_code", "d", "train", "calib", "test", "holdout")


@query("lagged_join", "J15", sql("""
    SELECT a.block_lgd, a.d, k.lag, a.v AS y, b.v AS p FROM pday a CROSS JOIN (SELECT unnest([0, 1, 2]) AS lag) k
    JOIN pday b ON b.block_lgd = a.block_lgd AND b.d = a.d - k.lag""", "pday"))
def lagged_join(t):
    left, right = t.pday.withColumnRenamed("v", "y"), t.pday.withColumnRenamed("v", "p")
    return P.lagged_join(left, right, ["block_lgd"], "d", [0, 1, 2])


@query("group_total", "A4", sql(f"""
    SELECT u.gp_code, u.block_lgd, {R('u.area_km2 / s.a')} AS w_area FROM unit u JOIN (SELECT block_lgd, sum(area_km2) AS a FROM unit GROUP BY 1) s
    USING (block_lgd)""", "unit"))
def group_total(t):
    from finegrid.operators.rescale import area_weights_in_parent
    return area_weights_in_parent(t.unit).select("gp_code", "block_lgd", r4("w_area").alias("w_area"))


@query("modelling_table", "J1 J2 J5 W1 W2 F2 P8 T1 M21 S2", sql(f"""
    , l AS (SELECT block_lgd, valid_date, min(fc_rain) AS v FROM fc WHERE lead_day = 1 GROUP BY 1, 2),
    a AS (SELECT block_lgd, valid_date AS issue_date, CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END AS ante3 FROM l
          WINDOW w AS (PARTITION BY block_lgd ORDER BY valid_date RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW)),
    q0 AS (SELECT DISTINCT gp_code, issue_date FROM panel),
    q1 AS (SELECT q.gp_code, q.issue_date, {R(ANTE.format(a=9, b=3))} AS ante7 FROM q0 q)
    SELECT p.gp_code, p.issue_date, p.lead_day, p.valid_date, p.fc_rain, {R('ln(1 + greatest(p.fc_rain, 0))')} AS fc_rain_log1p,
      {R('a.ante3')} AS ante3, q1.ante7, {R('sin(dayofyear(p.valid_date) * (2 * pi() / 365.25))')} AS doy_sin,
      {R('cos(dayofyear(p.valid_date) * (2 * pi() / 365.25))')} AS doy_cos, CAST(month(p.valid_date) AS INTEGER) AS month,
      CAST(month(p.valid_date) IN (6, 7, 8, 9) AS INTEGER) AS is_monsoon, p.rain_obs
    FROM panel p LEFT JOIN a ON a.block_lgd = p.block_lgd AND a.issue_date = p.issue_date
    LEFT JOIN q1 ON q1.gp_code = p.gp_code AND q1.issue_date = p.issue_date""", "panel"))
def modelling_table(t):
    fc = P.trailing_lead1(t.fc, "fc_rain", "ante3")
    df = P.expand_to_units(fc, t.unit)
    df = P.antecedent(df, t.obs, "gp_code", "issue_date", "d", "rain_obs", "ante7")
    df = df.join(t.obs.select("gp_code", F.col("d").alias("valid_date"), "rain_obs"), ["gp_code", "valid_date"], "left")
    s = season_terms(F.col("valid_date"))
    return df.select("gp_code", "issue_date", "lead_day", "valid_date", "fc_rain", r4(F.log1p(F.greatest("fc_rain", F.lit(0.0)))).alias("fc_rain_log1p"),
                     r4("ante3").alias("ante3"), r4("ante7").alias("ante7"), r4(s["doy_sin"]).alias("doy_sin"), r4(s["doy_cos"]).alias("doy_cos"),
                     s["month"].alias("month"), s["is_monsoon"].alias("is_monsoon"), "rain_obs")


# --- verification -------------------------------------------------------------------------

@query("scores_by_lead", "A12 A13 A20 F1", sql(f"""
    , m AS (SELECT lead_day, 'pred' AS method, rain_obs AS y, pred AS p, pred - rain_obs AS e FROM scored UNION ALL
            SELECT lead_day, 'fc_rain', rain_obs, fc_rain, fc_rain - rain_obs FROM scored),
    s AS (SELECT lead_day, method, {SCORES_SQL}, sqrt(avg(e * e)) AS raw FROM m WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
    SELECT s.lead_day, s.method, s.n, s.rmse, s.mae, s.bias, s.r, {R('1 - s.raw / b.raw')} AS skill
    FROM s JOIN s b ON b.lead_day = s.lead_day AND b.method = 'fc_rain'""", "scored"))
def scores_by_lead(t):
    out = V.score_methods(t.scored, ["lead_day"], "rain_obs", ["pred", "fc_rain"], {"skill": "fc_rain"})
    return rounded(out, ["rmse", "mae", "bias", "r", "skill"])


@query("scores_sliced", "A21 F5 A38", sql(f"""
    , x AS (SELECT rain_obs, pred, fc_rain, unnest(['block', 'lead', 'class', 'month']) AS slice, unnest([CAST(block_lgd AS VARCHAR),
        CAST(lead_day AS VARCHAR), CASE WHEN rain_obs <= 0.1 THEN 'no rain' WHEN rain_obs <= 2.5 THEN 'very light' WHEN rain_obs <= 15.6 THEN 'light'
        WHEN rain_obs <= 64.5 THEN 'moderate' WHEN rain_obs <= 115.6 THEN 'heavy' WHEN rain_obs <= 204.5 THEN 'very heavy'
        WHEN rain_obs IS NOT NULL THEN 'extremely heavy' END, CAST(month(valid_date) AS VARCHAR)]) AS key FROM scored),
    big AS (SELECT slice, key FROM x WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 50),
    m AS (SELECT slice, key, 'pred' AS method, rain_obs AS y, pred AS p, pred - rain_obs AS e FROM x SEMI JOIN big USING (slice, key) UNION ALL
          SELECT slice, key, 'fc_rain', rain_obs, fc_rain, fc_rain - rain_obs FROM x SEMI JOIN big USING (slice, key)),
    s AS (SELECT slice, key, method, {SCORES_SQL}, sqrt(avg(e * e)) AS raw FROM m WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2, 3)
    SELECT s.slice, s.key, s.method, s.n, s.rmse, s.mae, s.bias, s.r, CASE WHEN b.raw > 0 THEN {R('1 - s.raw / b.raw')} END AS skill
    FROM s JOIN s b ON b.slice = s.slice AND b.key = s.key AND b.method = 'fc_rain'""", "scored"))
def scores_sliced(t):
    from finegrid.functions.columns import rain_class
    slices = {"block": F.col("block_lgd"), "lead": F.col("lead_day"), "class": rain_class(F.col("rain_obs")), "month": F.month("valid_date")}
    out = V.score_slices(t.scored, "rain_obs", ["pred", "fc_rain"], "fc_rain", slices)
    return rounded(out.where("n > 0"), ["rmse", "mae", "bias", "r", "skill"])


@query("subset_scores", "A22 A20", sql(f"""
    , m AS (SELECT unnest(['all', CASE WHEN unseen_gp THEN 'unseen' ELSE 'seen' END]) AS subset, rain_obs AS y, pred AS p, pred - rain_obs AS e FROM scored)
    SELECT subset, {SCORES_SQL} FROM m WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1""", "scored"))
def subset_scores(t):
    return rounded(V.score(V.with_subsets(t.scored, "unseen_gp"), ["subset"], "rain_obs", "pred"), ["rmse", "mae", "bias", "r"])


@query("skill_mean_weighted", "A23", sql(f"""
    , g AS (SELECT block_lgd, count(*) AS n, sum((pred - rain_obs) ** 2) AS sse, sum((fc_rain - rain_obs) ** 2) AS ref FROM scored
            WHERE rain_obs IS NOT NULL GROUP BY 1 HAVING count(*) >= 50),
    k AS (SELECT *, 1 - sqrt(sse) / sqrt(ref) AS skill FROM g)
    SELECT {R('avg(skill)')} AS mean_unweighted, {R('sum(skill * n) / sum(n)')} AS mean_weighted, {R('1 - sqrt(sum(sse)) / sqrt(sum(ref))')} AS pooled,
      CAST(count(*) FILTER (WHERE skill > 0) AS BIGINT) AS positive, CAST(count(*) AS BIGINT) AS groups FROM k""", "scored"))
def skill_mean_weighted(t):
    return rounded(V.group_skill_summary(t.scored, "block_lgd", "rain_obs", "pred", "fc_rain"), ["mean_unweighted", "mean_weighted", "pooled"])


@query("contingency", "A14", sql(f"""
    , c AS (SELECT lead_day, threshold, count(*) FILTER (WHERE rain_obs >= threshold AND pred >= threshold) AS a,
        count(*) FILTER (WHERE rain_obs >= threshold AND pred < threshold) AS c, count(*) FILTER (WHERE rain_obs < threshold AND pred >= threshold) AS b,
        count(*) FILTER (WHERE rain_obs < threshold AND pred < threshold) AS d FROM scored CROSS JOIN (SELECT unnest([2.5, 15.6, 64.5]::DOUBLE[]) AS threshold)
        WHERE rain_obs IS NOT NULL AND pred IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, a + b + c + d AS n, (a + b) * (a + c) / nullif(a + b + c + d, 0) AS ar FROM c)
    SELECT lead_day, threshold, CAST(a AS BIGINT) AS hits, CAST(c AS BIGINT) AS misses, CAST(b AS BIGINT) AS false_alarms, CAST(d AS BIGINT) AS correct_neg,
      {R('(a + c) / nullif(n, 0)')} AS event_freq, {R('a / nullif(a + c, 0)')} AS pod, {R('b / nullif(a + b, 0)')} AS far,
      {R('a / nullif(a + b + c, 0)')} AS csi, CASE WHEN a + b + c - ar > 0 THEN {R('(a - ar) / (a + b + c - ar)')} END AS ets,
      {R('(a + b) / nullif(a + c, 0)')} AS freq_bias,
      {R('2 * (a * d - b * c) / nullif((a + c) * (c + d) + (a + b) * (b + d), 0)')} AS hss FROM k""", "scored"))
def contingency(t):
    out = V.contingency(t.scored, ["lead_day"], "rain_obs", "pred", [2.5, 15.6, 64.5])
    return rounded(out, ["event_freq", "pod", "far", "csi", "ets", "freq_bias", "hss"])


PROB_SQL = "prob AS (SELECT l.quality AS y, least(1.0, d.n_chars / 2000) AS p FROM labels l JOIN documents d USING (doc_id))"


def prob(t):
    docs = t.table("documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 2000).alias("p"))
    return t.table("labels").join(docs, "doc_id").select(F.col("quality").alias("y"), "p")


@query("brier", "A15", sql(f"""
    SELECT {R('avg((p - y) ** 2)')} AS brier, CASE WHEN avg(y) * (1 - avg(y)) > 0 THEN {R('1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y)))')} END AS bss,
    {R('avg(y)')} AS base_rate FROM prob WHERE y IS NOT NULL""", prob=PROB_SQL[9:-1]))
def brier(t):
    return prob(t).agg(*[r4(c).alias(n) for n, c in S.brier(F.col("y"), F.col("p")).items()])


@query("reliability", "A16", sql(f"""
    SELECT CAST(least(9, CAST(floor(p * 10) AS INTEGER)) AS INTEGER) AS bin, {R('avg(p)')} AS p_mean, {R('avg(y)')} AS obs_freq, CAST(count(*) AS BIGINT) AS n
    FROM prob WHERE y IS NOT NULL GROUP BY 1""", prob=PROB_SQL[9:-1]))
def reliability(t):
    return rounded(V.reliability(prob(t), "y", "p"), ["p_mean", "obs_freq"])


@query("pinball", "A17", sql(f"""
    SELECT lead_day, {R('avg(greatest(0.1 * (rain_obs - pred * 0.5), -0.9 * (rain_obs - pred * 0.5)))')} AS q10,
      {R('avg(greatest(0.5 * (rain_obs - pred), -0.5 * (rain_obs - pred)))')} AS q50,
      {R('avg(greatest(0.9 * (rain_obs - pred * 2), -0.1 * (rain_obs - pred * 2)))')} AS q90
    FROM scored WHERE rain_obs IS NOT NULL GROUP BY 1""", "scored"))
def pinball(t):
    y, p = F.col("rain_obs"), F.col("pred")
    return t.scored.groupBy("lead_day").agg(r4(S.pinball(y, p * 0.5, 0.1)).alias("q10"), r4(S.pinball(y, p, 0.5)).alias("q50"),
                                            r4(S.pinball(y, p * 2, 0.9)).alias("q90"))


@query("coverage", "A18", sql(f"""
    SELECT lead_day, {R('avg(CAST(rain_obs BETWEEN pred * 0.5 AND pred * 2 AS DOUBLE))')} AS coverage, {R('avg(pred * 2 - pred * 0.5)')} AS mean_width
    FROM scored GROUP BY 1""", "scored"))
def coverage(t):
    y, lo, hi = F.col("rain_obs"), F.col("pred") * 0.5, F.col("pred") * 2
    return t.scored.groupBy("lead_day").agg(r4(S.coverage(y, lo, hi)).alias("coverage"), r4(F.avg(hi - lo)).alias("mean_width"))


@query("bootstrap_skill_ci", "A19", sql(f"""
    , g AS (SELECT valid_date, sum((pred - rain_obs) ** 2) AS sp, sum((fc_rain - rain_obs) ** 2) AS sr FROM scored WHERE rain_obs IS NOT NULL GROUP BY 1),
    g2 AS (SELECT row_number() OVER (ORDER BY valid_date) - 1 AS pos, sp, sr FROM g), c AS (SELECT count(*) AS nd FROM g),
    pl AS (SELECT k, b, o, (1103515245 * (k * 1000 + b) + 12345) % 2147483648 % (nd - 6) + o AS pos, nd FROM c, (SELECT unnest(range(0, 300)) AS k),
        (SELECT unnest(range(0, 7)) AS o), (SELECT unnest(range(0, CAST(ceil((SELECT nd FROM c) / 7) AS BIGINT))) AS b) WHERE b * 7 + o < nd),
    d AS (SELECT k, 1 - sqrt(sum(sp)) / sqrt(sum(sr)) AS s FROM pl JOIN g2 USING (pos) GROUP BY 1)
    SELECT {R('(SELECT 1 - sqrt(sum(sp)) / sqrt(sum(sr)) FROM g)')} AS skill, {R('quantile_cont(s, 0.025)')} AS ci_low, {R('quantile_cont(s, 0.975)')} AS ci_high,
      (SELECT CAST(nd AS BIGINT) FROM c) AS n_days FROM d""", "scored"))
def bootstrap_skill_ci(t):
    return rounded(V.bootstrap_skill(t.scored, "valid_date", "rain_obs", "pred", "fc_rain"), ["skill", "ci_low", "ci_high"])


@query("source_agreement", "A24 J15", sql(f"""
    , s AS (SELECT block_lgd, d, v * (1 + block_lgd / 10) AS p FROM pday),
    m AS (SELECT k.lag, a.block_lgd, a.d, a.v AS y, s.p, s.p - a.v AS e FROM pday a CROSS JOIN (SELECT unnest([0, 1]) AS lag) k
          JOIN s ON s.block_lgd = a.block_lgd AND s.d = a.d - k.lag),
    w AS (SELECT lag, block_lgd, date_trunc('week', d) AS wk, sum(y) AS y, sum(p) AS p FROM m GROUP BY 1, 2, 3)
    SELECT m.lag, {SCORES_SQL}, {R('''count(*) FILTER (WHERE y >= 50 AND p >= 50) / nullif(count(*) FILTER (WHERE y >= 50 OR p >= 50), 0)''')} AS csi,
      (SELECT {R('corr(w.y, w.p)')} FROM w WHERE w.lag = m.lag) AS weekly_r FROM m GROUP BY m.lag""", "pday"))
def source_agreement(t):
    src = t.pday.select("block_lgd", "d", (F.col("v") * (1 + F.col("block_lgd") / 10)).alias("p"))
    out = V.source_agreement(t.pday.withColumnRenamed("v", "y"), src, ["block_lgd"], "d", "y", "p", [0, 1], 50.0)
    return rounded(out, ["rmse", "mae", "bias", "r", "csi", "weekly_r"])


@query("anomaly_corr", "A28", sql(f"""
    SELECT CAST(count(*) AS BIGINT) AS n, {R('corr(rain_obs - fc_rain, pred - fc_rain)')} AS r FROM scored WHERE rain_obs IS NOT NULL""", "scored"))
def anomaly_corr(t):
    return rounded(V.anomaly_correlation(t.scored, "rain_obs", "pred", "fc_rain"), ["r"])


@query("method_compare", "J23 A12", sql(f"""
    , a AS (SELECT gp_code, valid_date, avg(pred) AS tree FROM scored GROUP BY 1, 2),
    b AS (SELECT gp_code, valid_date, max(fc_rain) AS net, max(rain_obs) AS y FROM scored GROUP BY 1, 2),
    m AS (SELECT y, tree AS p, tree - y AS e, 'tree' AS method FROM a JOIN b USING (gp_code, valid_date) UNION ALL
          SELECT y, net, net - y, 'net' FROM a JOIN b USING (gp_code, valid_date))
    SELECT method, {SCORES_SQL} FROM m WHERE y IS NOT NULL GROUP BY 1""", "scored"))
def method_compare(t):
    key = ["gp_code", "valid_date"]
    tree = t.scored.groupBy(*key).agg(F.avg("pred").alias("tree"))
    net = t.scored.groupBy(*key).agg(F.max("fc_rain").alias("net"), F.max("rain_obs").alias("y"))
    out = V.score_methods(tree.join(net, key), [], "y", ["tree", "net"], {})
    return rounded(out, ["rmse", "mae", "bias", "r"])


@query("site_scores", "A26 J22 A14", sql(f"""
    , site AS (SELECT gp_code, d AS valid_date, CASE WHEN rain_obs < 150 THEN rain_obs END AS y FROM obs),
    m AS (SELECT s.y, p.pred AS p, p.fc_rain AS c FROM site s JOIN scored p USING (gp_code, valid_date) WHERE s.y IS NOT NULL AND p.pred IS NOT NULL)
    SELECT CAST(count(*) AS BIGINT) AS n, {R('sqrt(avg((p - y) ** 2))')} AS rmse_pred, {R('sqrt(avg((c - y) ** 2))')} AS rmse_copy,
      {R('1 - sqrt(avg((p - y) ** 2)) / sqrt(avg((c - y) ** 2))')} AS skill,
      {R('count(*) FILTER (WHERE y >= 15.6 AND p >= 15.6) / nullif(count(*) FILTER (WHERE y >= 15.6 OR p >= 15.6), 0)')} AS csi FROM m""", "scored"))
def site_scores(t):
    from finegrid.functions.columns import keep_between
    site = t.obs.select("gp_code", F.col("d").alias("valid_date"),
                                                  F.when(F.col("rain_obs") < 150, keep_between(F.col("rain_obs"), 0, 600)).alias("y"))
    m = site.join(t.scored.drop("rain_obs"), ["gp_code", "valid_date"]).where("y is not null and pred is not null")
    y, a, b = F.col("y"), S.continuous(F.col("y"), F.col("pred")), S.continuous(F.col("y"), F.col("fc_rain"))
    csi = S.contingency_scores(*S.contingency_counts(y, F.col("pred"), 15.6).values())["csi"]
    return m.agg(a["n"].alias("n"), r4(a["rmse"]).alias("rmse_pred"), r4(b["rmse"]).alias("rmse_copy"),
                 r4(S.skill(a["rmse"], b["rmse"])).alias("skill"), r4(csi).alias("csi"))


@query("density2d", "A39", sql("""
    SELECT CAST(floor(rain_obs / 20) AS INTEGER) AS bx, CAST(floor(pred / 20) AS INTEGER) AS by, CAST(count(*) AS BIGINT) AS n FROM scored
    WHERE rain_obs IS NOT NULL GROUP BY 1, 2""", "scored"))
def density2d(t):
    return V.density(t.scored, "rain_obs", "pred", 20.0)


@query("headline_rollup", "A38 A20 A23", sql(f"""
    , v AS (SELECT 'rain' AS var, lead_day, rain_obs AS y, pred AS p, fc_rain AS c FROM scored UNION ALL
            SELECT 'half', lead_day, rain_obs / 2, pred / 2 + 1, fc_rain / 2 FROM scored)
    SELECT var, coalesce(CAST(lead_day AS VARCHAR), 'all') AS lead, CAST(count(*) AS BIGINT) AS n, {R('sqrt(avg((p - y) ** 2))')} AS rmse,
      {R('1 - sqrt(avg((p - y) ** 2)) / sqrt(avg((c - y) ** 2))')} AS skill FROM v WHERE y IS NOT NULL GROUP BY GROUPING SETS ((var, lead_day), (var))""", "scored"))
def headline_rollup(t):
    s = t.scored.where("rain_obs is not null")
    pick = [F.struct(F.lit("rain").alias("var"), F.col("rain_obs").alias("y"), F.col("pred").alias("p"), F.col("fc_rain").alias("c")),
            F.struct(F.lit("half").alias("var"), (F.col("rain_obs") / 2).alias("y"), (F.col("pred") / 2 + 1).alias("p"), (F.col("fc_rain") / 2).alias("c"))]
    v = s.select("lead_day", F.explode(F.array(*pick)).alias("x")).select("x.*", "lead_day")
    a, b = S.continuous(F.col("y"), F.col("p")), S.continuous(F.col("y"), F.col("c"))
    g = v.groupingSets([[F.col("var"), F.col("lead_day")], [F.col("var")]], F.col("var"), F.col("lead_day"))
    out = g.agg(a["n"].alias("n"), r4(a["rmse"]).alias("rmse"), r4(S.skill(a["rmse"], b["rmse"])).alias("skill"))
    return out.select("var", F.coalesce(F.col("lead_day").cast("string"), F.lit("all")).alias("lead"), "n", "rmse", "skill")
