"""Queries over advisory rules, agronomy scalars and season calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from finegrid.functions import columns as C
from finegrid.operators import agronomy_values as A
from finegrid.operators import rules as U
from finegrid.plans.bindings import sql
from finegrid.plans.registry import R, query, r4

PARENTS = ["MAVAL", "JUNNAR", "BARAMATI", "PURANDAR", "HAVELI"]
_NAME = "(['" + "', '".join(PARENTS) + "'])[block_lgd + 1]"


def day_rows(t):
    """Forecast rows whose issue dates are spread over the year, so that every season occurs."""
    df = t.ufc.withColumn("issue_date", F.date_add("issue_date", (F.col("user_id") % 12 * 30).cast("int")))
    df = df.withColumn("block_name", F.element_at(F.array(*[F.lit(p) for p in PARENTS]), F.col("block_lgd") + 1))
    return df.withColumn("ante_obs7", F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 90).cast("double")))


def sequences(t):
    """Day sequences of :func:`day_rows`."""
    return U.day_sequences(day_rows(t), ["gp_code", "issue_date"], ["user_id", "block_name", "latitude", "elev", "slope_mean", "soil_clay_pct", "tpi_2km", "ante_obs7"])


def evaluated(t):
    seq = sequences(t)
    # the calendar of every valid day, as the first days of the sequences are among them: sequences are collected once
    on = day_rows(t).select("block_name", F.date_add("issue_date", F.col("lead_day")).alias("on_date"))
    crops = U.crops_in_season(on, U.crop_calendar(t.spark), "block_name", "on_date")
    return U.evaluate(seq, crops, "block_name")


_LISTS = ", ".join(f"list({c} ORDER BY lead_day) AS {a}" for c, a in [
    ("rain_pred", "r"), ("tmax_pred", "x"), ("tmin_pred", "n"), ("rh_pred", "h"), ("wind_pred", "w"), ("rain_p_ge_2p5", "pl"),
    ("rain_p_ge_15p6", "pm"), ("rain_p_ge_64p5", "ph"), ("lead_day", "ld")])
SEQ = f"""SELECT *, range(1, len(r) + 1) AS ix, list_sum(list_transform(r[1:3], lambda v: coalesce(v, 0))) AS r3, CAST(issue_date + ld[1] AS DATE) AS on_date
    FROM (SELECT gp_code, user_id, {_NAME} AS block_name, latitude, elev, slope_mean, soil_clay_pct, tpi_2km,
    CAST(issue_date + CAST(user_id % 12 * 30 AS INTEGER) AS DATE) AS issue_date, {_LISTS},
    CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 90 AS DOUBLE) END AS ante
    FROM ufc GROUP BY gp_code, user_id, block_lgd, latitude, elev, slope_mean, soil_clay_pct, tpi_2km, ufc.issue_date)"""

WEATHER = """
    heavy AS (SELECT *, list_transform(ix, lambda i: CASE WHEN r[i] >= 115.6 OR ph[i] >= 0.6 THEN 3 WHEN r[i] >= 64.5 OR ph[i] >= 0.3 THEN 2
        WHEN r[i] >= 35.5 THEN 1 ELSE 0 END) AS lv FROM sq),
    spray AS (SELECT *, list_filter(ix, lambda i: r[i] <= 1 AND w[i] <= 15 AND (pl[i] IS NULL OR pl[i] <= 0.3)) AS ok FROM sq),
    thunder AS (SELECT *, list_filter(ix, lambda i: pm[i] >= 0.3 AND x[i] >= 32 AND h[i] >= 50) AS c FROM sq WHERE month(on_date) IN (3, 4, 5, 10, 11)),
    pest AS (SELECT *, list_filter(ix, lambda i: x[i] > 35 AND h[i] > 70) AS c FROM sq),
    weather AS (
    SELECT gp_code, issue_date, 'heavy_rain' AS rule, (['yellow', 'orange', 'red'])[list_max(lv)] AS severity, CAST(list_position(lv, list_max(lv)) - 1 AS VARCHAR) AS days,
      CAST(round_even(r[list_position(lv, list_max(lv))], 1) AS VARCHAR) AS detail, 'general' AS category FROM heavy WHERE list_max(lv) > 0
    UNION ALL SELECT gp_code, issue_date, 'waterlogging', CASE WHEN r3 >= 100 THEN 'orange' ELSE 'yellow' END, '0,1,2', CAST(round_even(r3, 1) AS VARCHAR), 'general' FROM sq
      WHERE r3 >= 50 AND slope_mean <= 3 AND soil_clay_pct >= 40
    UNION ALL SELECT gp_code, issue_date, 'spray_window', CASE WHEN len(ok) > 0 THEN 'green' ELSE 'yellow' END,
      array_to_string(list_transform(CASE WHEN len(ok) > 0 THEN ok ELSE ix END, lambda i: i - 1), ','), '', 'general' FROM spray
    UNION ALL SELECT gp_code, issue_date, 'fertiliser', 'yellow', '0,1', CAST(round_even(coalesce(r[1], 0) + coalesce(r[2], 0), 1) AS VARCHAR), 'general' FROM sq
      WHERE coalesce(r[1], 0) + coalesce(r[2], 0) >= 15.6
    UNION ALL SELECT gp_code, issue_date, 'heat', CASE WHEN list_max(x) >= 45 THEN 'red' WHEN list_max(x) >= 42 THEN 'orange' ELSE 'yellow' END,
      CAST(list_position(x, list_max(x)) - 1 AS VARCHAR), CAST(round_even(list_max(x), 1) AS VARCHAR), 'general' FROM sq WHERE list_max(x) >= 40
    UNION ALL SELECT gp_code, issue_date, CASE WHEN list_min(n) <= 6 THEN 'frost' ELSE 'cold' END, (['yellow', 'orange', 'red'])[least(3,
      CASE WHEN list_min(n) <= 4 THEN 3 WHEN list_min(n) <= 7 THEN 2 ELSE 1 END + CASE WHEN tpi_2km <= -10 THEN 1 ELSE 0 END)],
      CAST(list_position(n, list_min(n)) - 1 AS VARCHAR), CAST(round_even(list_min(n), 1) + 0.0 AS VARCHAR), 'general' FROM sq WHERE list_min(n) <= 10
    UNION ALL SELECT gp_code, issue_date, 'thunderstorm', CASE WHEN list_max(list_transform(c, lambda i: pm[i])) >= 0.6 THEN 'orange' ELSE 'yellow' END,
      array_to_string(list_transform(c, lambda i: i - 1), ','), CAST(CAST(round_even(100 * list_max(list_transform(c, lambda i: pm[i])), 0) AS INTEGER) AS VARCHAR), 'general' FROM thunder WHERE len(c) > 0
    UNION ALL SELECT gp_code, issue_date, 'wind', CASE WHEN list_max(w) >= 60 THEN 'red' WHEN list_max(w) >= 40 THEN 'orange' ELSE 'yellow' END,
      CAST(list_position(w, list_max(w)) - 1 AS VARCHAR), CAST(CAST(round_even(list_max(w), 0) AS INTEGER) AS VARCHAR), 'general' FROM sq WHERE list_max(w) >= 30
    UNION ALL SELECT gp_code, issue_date, 'pest_fungal', 'yellow', array_to_string(list_transform(c, lambda i: i - 1), ','), CAST(round_even(x[c[1]], 1) AS VARCHAR), 'general' FROM pest WHERE len(c) > 0)"""
DETAIL = {"heavy_rain": "rain", "waterlogging": "rain3", "fertiliser": "rain2", "heat": "tmax", "frost": "tmin", "cold": "tmin", "thunderstorm": "prob",
          "wind": "wind", "pest_fungal": "tmax", "dry_spell": "etc", "sowing_window": "cum"}


def rule_rows(t, rules):
    rows = U.advisory_rows(evaluated(t), ["gp_code", "issue_date"])
    rows = rows.where(F.col("rule").isin(rules) if rules else F.col("rule").startswith("disease:"))
    detail = F.lit("")
    for rule, p in DETAIL.items():
        detail = F.when(F.col("rule") == rule, F.try_element_at("params", F.lit(p))).otherwise(detail)
    return rows.select("gp_code", "issue_date", "rule", "severity", F.array_join(F.col("days").cast("array<string>"), ",").alias("days"),
                       detail.alias("detail"), "category", "crop")


@query("rules_weather", "R1 R2 R5 R6 R7 R8 R9 R10 R11 W7", sql(f""", sq AS ({SEQ}), {WEATHER} SELECT gp_code, issue_date, rule, severity, days, detail FROM weather""", "ufc"))
def rules_weather(t):
    names = ["heavy_rain", "waterlogging", "spray_window", "fertiliser", "heat", "frost", "cold", "thunderstorm", "wind", "pest_fungal"]
    return rule_rows(t, names).drop("category", "crop")


def et0_sql(tx, tn, rh, w, lat, elev, doy):
    es = lambda v: f"(0.6108 * exp(17.27 * {v} / ({v} + 237.3)))"
    tm = f"(({tx} + {tn}) / 2)"
    gamma = f"(0.000665 * 101.3 * pow((293 - 0.0065 * {elev}) / 293, 5.26))"
    e_s = f"(({es(tx)} + {es(tn)}) / 2)"
    e_a = f"(greatest(1, least(100, {rh})) / 100 * {e_s})"
    delta = f"(4098 * {es(tm)} / pow({tm} + 237.3, 2))"
    dec = f"(0.409 * sin(2 * pi() * {doy} / 365 - 1.39))"
    ws = f"acos(greatest(-1, least(1, -tan(radians({lat})) * tan({dec}))))"
    ra = (f"(24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(2 * pi() * {doy} / 365)) * ({ws} * sin(radians({lat})) * sin({dec}) + "
          f"cos(radians({lat})) * cos({dec}) * sin({ws})))")
    rs = f"(0.16 * sqrt(greatest(0, {tx} - {tn})) * {ra})"
    rso = f"greatest(1e-6, (0.75 + 2e-5 * {elev}) * {ra})"
    rnl = (f"(4.903e-9 * (pow({tx} + 273.16, 4) + pow({tn} + 273.16, 4)) / 2 * (0.34 - 0.14 * sqrt({e_a})) * "
           f"(1.35 * greatest(0.25, least(1.0, {rs} / {rso})) - 0.35))")
    u2 = f"({w} / 3.6 * 0.55 * 4.87 / ln(67.8 * 10 - 5.42))"
    return (f"greatest(0.0, (0.408 * {delta} * (0.77 * {rs} - {rnl}) + {gamma} * 900 / ({tm} + 273) * {u2} * ({e_s} - {e_a})) / "
            f"({delta} + {gamma} * (1 + 0.34 * {u2})))")


@query("et0_daily", "F14 F2", sql(f"""
    SELECT gp_code, issue_date, lead_day, CASE WHEN tmax_pred + tmin_pred + rh_pred + wind_pred IS NOT NULL THEN
      {R(et0_sql('tmax_pred', 'tmin_pred', 'rh_pred', 'wind_pred', 'latitude', 'elev', 'dayofyear(issue_date + lead_day)'))} END AS et0 FROM ufc""", "ufc"))
def et0_daily(t):
    et0 = C.reference_et0(F.col("tmax_pred"), F.col("tmin_pred"), F.col("rh_pred"), F.col("wind_pred"), F.col("latitude"), F.col("elev"),
                          F.dayofyear(F.date_add("issue_date", F.col("lead_day"))))
    return t.ufc.select("gp_code", "issue_date", "lead_day", r4(et0).alias("et0"))


@query("soil_awc", "F15 Q8", sql(f"""
    , s AS (SELECT gp_code, (10 + user_id % 60) * 1.0 AS sand, (5 + user_id % 33) * 1.0 AS clay, (user_id % 100) / 10 * 1.724 AS om FROM unit),
    a AS (SELECT *, -0.024 * sand / 100 + 0.487 * clay / 100 + 0.006 * om + 0.005 * sand / 100 * om - 0.013 * clay / 100 * om + 0.068 * sand / 100 * clay / 100 + 0.031 AS d,
      -0.251 * sand / 100 + 0.195 * clay / 100 + 0.011 * om + 0.006 * sand / 100 * om - 0.027 * clay / 100 * om + 0.452 * sand / 100 * clay / 100 + 0.299 AS w
      FROM (SELECT gp_code, sand, clay, least(8, om) AS om FROM s))
    SELECT gp_code, {R('greatest(0.0, least(0.35, w + 1.283 * w * w - 0.374 * w - 0.015 - (d + 0.14 * d - 0.02))) * 300')} AS awc_mm FROM a""", "unit"))
def soil_awc(t):
    u = F.col("user_id")
    layers = [(10 + u % 60).cast("double"), (10 + u % 60).cast("double")]
    sand = C.depth_weighted(layers, [10.0, 20.0])
    return t.unit.select("gp_code", r4(C.available_water_mm(sand, (5 + u % 33).cast("double"), (u % 100) / 10 * 1.724)).alias("awc_mm"))


@query("season_terms", "F2 F4 F5", sql(f"""
    SELECT o_orderkey, {R('sin(dayofyear(o_orderdate) * (2 * pi() / 365.25))')} AS doy_sin, {R('cos(dayofyear(o_orderdate) * (2 * pi() / 365.25))')} AS doy_cos,
      CAST(month(o_orderdate) AS INTEGER) AS month, CAST(month(o_orderdate) IN (6, 7, 8, 9) AS INTEGER) AS is_monsoon,
      CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter (DJF)' WHEN month(o_orderdate) <= 5 THEN 'pre-monsoon (MAM)' WHEN month(o_orderdate) <= 9
        THEN 'monsoon (JJAS)' ELSE 'post-monsoon (ON)' END AS season, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders"""))
def season_terms(t):
    o = t.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    s = C.season_terms(F.col("d"))
    return o.select("o_orderkey", r4(s["doy_sin"]).alias("doy_sin"), r4(s["doy_cos"]).alias("doy_cos"), s["month"].alias("month"),
                    s["is_monsoon"].alias("is_monsoon"), C.season_name(F.col("d")).alias("season"), F.to_date(F.date_trunc("week", "d")).alias("week"))


@query("rain_class", "F5 A30", sql("""
    SELECT gp_code, d, CASE WHEN rain_obs <= 0.1 THEN 'no rain' WHEN rain_obs <= 2.5 THEN 'very light' WHEN rain_obs <= 15.6 THEN 'light'
      WHEN rain_obs <= 64.5 THEN 'moderate' WHEN rain_obs <= 115.6 THEN 'heavy' WHEN rain_obs <= 204.5 THEN 'very heavy' ELSE 'extremely heavy' END AS class FROM obs""", "obs"))
def rain_class(t):
    return t.obs.select("gp_code", "d", C.rain_class(F.col("rain_obs")).alias("class"))


@query("map_bins", "F6", sql(f"""
    SELECT gp_code, d, CAST(len(list_filter([2.5, 15.6, 64.5, 115.6], lambda b: rain >= b)) AS INTEGER) AS bin, {R('rain - tmax')} AS diff FROM vars WHERE rain IS NOT NULL""", "vars"))
def map_bins(t):
    v = t.vars.where("rain is not null")
    return v.select("gp_code", "d", C.map_bin(F.col("rain"), [2.5, 15.6, 64.5, 115.6]).alias("bin"), r4(F.col("rain") - F.col("tmax")).alias("diff"))


def _calendar_sql():
    rows = [f"('{c}', {k}, '{p}', {i}, '{s[0]}', '{s[1]}', '{s[2]}', '{s[3]}', CAST({s[4]} AS DOUBLE))" for k, (c, v) in enumerate(A.CROPS.items())
            for p in v["parents"] for i, s in enumerate(v["stages"])]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(crop, crop_ord, parent, ord, stage, stage_type, s, e, kc)"


_IN = "CASE WHEN c.s <= c.e THEN {md} BETWEEN c.s AND c.e ELSE {md} >= c.s OR {md} <= c.e END"


@query("crop_stages", "J18", sql(f"""
    SELECT o_orderkey, crop, stage, kc FROM (SELECT o.o_orderkey, c.*, row_number() OVER (PARTITION BY o.o_orderkey, c.crop ORDER BY c.ord) AS rn FROM
      (SELECT *, upper((['maval', 'Junnar', 'BARAMATI', 'PURANDAR', 'HAVELI'])[CAST(o_custkey % 5 AS INTEGER) + 1]) AS parent, strftime(o_orderdate, '%m-%d') AS md FROM orders) o
      JOIN cal c ON c.parent = o.parent AND {_IN.format(md='o.md')}) WHERE rn = 1""", cal=_calendar_sql()))
def crop_stages(t):
    names = F.array(*[F.lit(n) for n in ("maval", "Junnar", "BARAMATI", "PURANDAR", "HAVELI")])
    o = t.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.element_at(names, (F.col("o_custkey") % 5).cast("int") + 1).alias("p"))
    crops = U.crops_in_season(o, U.crop_calendar(t.spark), "p", "d")
    out = o.join(crops, ["p", "d"]).select("o_orderkey", F.explode("crops").alias("c"))
    return out.select("o_orderkey", "c.crop", "c.stage", "c.kc")


CROP_CTES = f"""
    cal AS ({_calendar_sql()}),
    cs AS (SELECT * FROM (SELECT q.gp_code, q.issue_date, c.crop, c.stage_type, c.kc, c.crop_ord, c.stage, row_number() OVER (PARTITION BY q.gp_code, q.issue_date, c.crop ORDER BY c.ord) AS rn
      FROM (SELECT *, strftime(on_date, '%m-%d') AS md FROM sq) q JOIN cal c ON c.parent = q.block_name AND {_IN.format(md='q.md')}) WHERE rn = 1),
    ev AS (SELECT gp_code, CAST(issue_date + CAST(user_id % 12 * 30 AS INTEGER) AS DATE) AS issue_date, sum(CASE WHEN tmax_pred + tmin_pred + rh_pred + wind_pred IS NOT NULL THEN
      {et0_sql('tmax_pred', 'tmin_pred', 'rh_pred', 'wind_pred', 'latitude', 'elev', 'dayofyear(CAST(issue_date + CAST(user_id % 12 * 30 AS INTEGER) AS DATE) + lead_day)')} END) AS et FROM
      (SELECT * FROM ufc QUALIFY row_number() OVER (PARTITION BY gp_code, issue_date ORDER BY lead_day) <= 3) ufc GROUP BY 1, 2, ufc.issue_date),
    hv AS (SELECT *, list_transform(ix, lambda i: coalesce(r[i] < 2.5, false)) AS f FROM sq),
    cropr AS (
    SELECT q.gp_code, q.issue_date, 'dry_spell' AS rule, 'yellow' AS severity, '0,1,2' AS days, CAST(round_even(coalesce(ev.et, 0) * c.kc, 1) AS VARCHAR) AS detail, c.crop, 'crop' AS category FROM sq q JOIN cs c USING (gp_code, issue_date)
      JOIN ev USING (gp_code, issue_date) WHERE r3 < 2.5 AND coalesce(list_max(pl[1:3]), 0) <= 0.4 AND c.stage_type IN ('sowing', 'vegetative', 'flowering', 'fruit_development')
    UNION ALL SELECT gp_code, issue_date, 'sowing_window', CASE WHEN ante + r3 >= 65 THEN 'green' ELSE 'yellow' END, '0,1,2', CAST(CAST(round_even(ante + r3, 0) AS INTEGER) AS VARCHAR), NULL, 'general' FROM sq
      WHERE month(on_date) IN (6, 7) AND ante IS NOT NULL AND EXISTS (SELECT 1 FROM cs WHERE cs.gp_code = sq.gp_code AND cs.issue_date = sq.issue_date AND cs.stage_type = 'sowing')
    UNION ALL SELECT h.gp_code, h.issue_date, 'harvest', 'green', array_to_string(list_transform(list_filter(ix, lambda i: f[i]), lambda i: i - 1), ','), '', c.crop, 'crop' FROM hv h JOIN cs c USING (gp_code, issue_date)
      WHERE c.stage_type = 'harvest' AND len(list_filter(ix, lambda i: f[i] AND f[i + 1] AND f[i + 2])) > 0
    UNION ALL SELECT h.gp_code, h.issue_date, 'harvest', 'yellow', array_to_string(list_transform(list_filter(ix, lambda i: NOT f[i]), lambda i: i - 1), ','), '', c.crop, 'crop' FROM hv h JOIN cs c USING (gp_code, issue_date)
      WHERE c.stage_type = 'harvest' AND len(list_filter(ix, lambda i: f[i] AND f[i + 1] AND f[i + 2])) = 0 AND len(list_filter(ix, lambda i: NOT f[i])) > 0)"""


@query("rules_crop", "R3 R4 R12 J18 F14", sql(f""", sq AS ({SEQ}), {CROP_CTES} SELECT gp_code, issue_date, rule, severity, days, detail, crop FROM cropr""", "ufc"))
def rules_crop(t):
    return rule_rows(t, ["dry_spell", "sowing_window", "harvest"]).drop("category")


def _disease_sql():
    var = {"rain": "r[i]", "rain_2day": "(r[i] + CASE WHEN i > 1 THEN r[i - 1] ELSE 0 END)", "tmax": "x[i]", "tmin": "n[i]", "tmean": "((x[i] + n[i]) / 2)", "rh": "h[i]"}
    ops = {"ge": ">=", "gt": ">", "le": "<=", "lt": "<"}
    parts = []
    for m, levels in A.DISEASES.items():
        crop = [c for c, v in A.CROPS.items() if m in v["diseases"]]
        cases = []
        for lv in levels:
            cond = " AND ".join(f"{var[v]} {ops[o]} {thr}" for v, cs in lv["when"].items() for o, thr in cs.items())
            flags = f"list_transform(ix, lambda i: coalesce({cond}, false))"
            idx = f"list_filter(ix, lambda k: ({flags})[k])"
            if "consecutive" in lv:
                run = " AND ".join(f"({flags})[k + {o}]" for o in range(lv["consecutive"]))
                fired = f"len(list_filter(ix, lambda k: coalesce({run}, false))) > 0"
            else:
                fired = f"len({idx}) >= {lv['min_days']}"
            cases.append(f"WHEN {fired} THEN {{'level': {lv['level']}, 'days': array_to_string(list_transform({idx}, lambda i: i - 1), ',')}}")
        parts.append(f"SELECT gp_code, issue_date, '{m}' AS model, {crop!r} AS crops, CASE {' '.join(cases)} END AS o FROM sq")
    return " UNION ALL ".join(parts)


DISEASE_CTES = f"""dz AS ({_disease_sql()}),
    disease AS (SELECT d.gp_code, d.issue_date, 'disease:' || d.model AS rule, CASE WHEN d.o.level = 3 THEN 'orange' ELSE 'yellow' END AS severity, d.o.days AS days, '' AS detail, c.crop, 'disease' AS category
      FROM dz d JOIN cs c ON c.gp_code = d.gp_code AND c.issue_date = d.issue_date AND list_contains(d.crops, c.crop) WHERE d.o.level >= 2)"""


@query("rules_disease", "R13 D1 W5 W6", sql(f""", sq AS ({SEQ}), {CROP_CTES}, {DISEASE_CTES} SELECT gp_code, issue_date, rule, severity, days, crop FROM disease""", "ufc"))
def rules_disease(t):
    return rule_rows(t, None).drop("category", "detail")


@query("overall_severity", "R14 D4", sql(f""", sq AS ({SEQ}), {WEATHER}, {CROP_CTES},
    a AS (SELECT gp_code, issue_date, rule, severity FROM weather UNION ALL SELECT gp_code, issue_date, rule, severity FROM cropr)
    SELECT q.gp_code, q.issue_date, (['green', 'yellow', 'orange', 'red'])[1 + coalesce((SELECT max(list_position(['yellow', 'orange', 'red'], a.severity)) FROM a WHERE a.gp_code = q.gp_code
      AND a.issue_date = q.issue_date AND a.rule NOT IN ('spray_window', 'harvest', 'sowing_window') AND a.severity <> 'green'), 0)] AS overall FROM sq q""", "ufc"))
def overall_severity(t):
    return evaluated(t).select("gp_code", "issue_date", "overall")


@query("advisories_lateral", "D4 R14", sql(f""", sq AS ({SEQ}), {WEATHER}, {CROP_CTES}, {DISEASE_CTES},
    a AS (SELECT gp_code, issue_date, rule, severity, days, NULL AS crop FROM weather UNION ALL SELECT gp_code, issue_date, rule, severity, days, crop FROM cropr
      UNION ALL SELECT gp_code, issue_date, rule, severity, days, crop FROM disease)
    SELECT q.gp_code, q.issue_date, a.rule, a.severity, a.days, a.crop FROM sq q JOIN a ON a.gp_code = q.gp_code AND a.issue_date = q.issue_date WHERE a.severity <> 'green'""", "ufc"))
def advisories_lateral(t):
    rows = evaluated(t)
    U.register_table_function(t.spark, rows, "gp_code", "issue_date")
    sequences(t).select("gp_code", "issue_date").createOrReplaceTempView("_issues")
    return t.spark.sql("""SELECT i.gp_code, i.issue_date, a.rule, a.severity, array_join(CAST(a.days AS ARRAY<STRING>), ',') AS days, a.crop
        FROM _issues i, LATERAL advisories(i.gp_code, i.issue_date) a WHERE a.severity <> 'green'""")
