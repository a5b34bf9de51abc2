"""Advisory rules over a unit's day sequence, as one projection per unit and issue.

A row carries the ordered days of one issue as an array; every rule is a column
expression that yields an array of advisories, so all units are evaluated in
parallel without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finegrid.functions.columns import reference_et0
from finegrid.functions.rule_dsl import compile_rule, derived_days, longest_true_run, mask, risk_level, sure, true_positions
from finegrid.operators import agronomy_values as A
from finegrid.operators.panel import in_season

DAY_FIELDS = ["rain", "tmax", "tmin", "rh", "wind", "p_light", "p_moderate", "p_heavy"]
ADVISORY = ("array<struct<rule:string,severity:string,category:string,key:string,params:map<string,string>,"
            "days:array<int>,crop:string>>")


def crop_calendar(spark: SparkSession, crops: dict | None = None) -> DataFrame:
    """The calendar as rows: one per crop, parent and stage (a configuration table of a few hundred rows)."""
    rows = [(c, v["name"], k, p.upper(), i, s[0], s[1], s[2], s[3], float(s[4]), list(v["diseases"]))
            for k, (c, v) in enumerate((crops or A.CROPS).items()) for p in v["parents"] for i, s in enumerate(v["stages"])]
    return spark.createDataFrame(rows, "crop string, crop_name string, crop_ord int, parent string, ord int, stage string, stage_type string, "
                                       "start string, end string, kc double, diseases array<string>")


def crops_in_season(dates: DataFrame, calendar: DataFrame, parent: str, date: str, only: list[str] | None = None) -> DataFrame:
    """For each distinct (parent, date): the crops in season with their first matching stage, in calendar order.

    ``only`` picks crops by name whatever the parent.  The calendar is configuration,
    so each result holds a dozen crops at most.
    """
    pairs = dates.select(parent, date).distinct()
    md = F.date_format(date, "MM-dd")
    if only:
        cal = calendar.where(F.col("crop").isin(only)).drop("parent").distinct()
        hit = pairs.join(cal, in_season(md, F.col("start"), F.col("end")))
    else:
        hit = pairs.join(calendar, (F.upper(F.col(parent)) == F.col("parent")) & in_season(md, F.col("start"), F.col("end")))
        hit = hit.select(pairs[parent], pairs[date], *[calendar[c] for c in calendar.columns if c != "parent"])
    stage = F.struct("crop_ord", "ord", "crop", "crop_name", "stage", "stage_type", "kc", "diseases")
    first = hit.groupBy(parent, date, "crop").agg(F.min(stage).alias("s"))
    return first.groupBy(parent, date).agg(F.array_sort(F.collect_list("s")).alias("crops"))


def day_sequences(df: DataFrame, keys: list[str], attributes: list[str], lead: str = "lead_day",
                  probabilities: dict[str, str] | None = None) -> DataFrame:
    """One row per key with ``days``, ordered by lead; a sequence is as long as the forecast horizon."""
    probs = probabilities or {n: "rain_p_ge_" + f"{mm:g}".replace(".", "p") for n, mm in A.PROBABILITY_MM.items()}
    rain = F.when(F.col("rain_pred").isNotNull(), F.greatest(F.lit(0.0), F.col("rain_pred")))
    fields = [F.col(lead).alias("lead"), rain.alias("rain"), *[F.col(f"{v}_pred").alias(v) for v in ("tmax", "tmin", "rh", "wind")]]
    for n in ("light", "moderate", "heavy"):
        fields.append((F.col(probs[n]) if probs[n] in df.columns else F.lit(None).cast("double")).alias(f"p_{n}"))
    # evaporation is computed on the day rows, as compiled code; rules later only add it up
    et0 = F.lit(None).cast("double")
    if {"latitude", "elev", "issue_date"} <= set(df.columns):
        doy = F.dayofyear(F.date_add(F.col("issue_date"), F.col(lead)))
        et0 = reference_et0(*[F.col(f"{v}_pred") for v in ("tmax", "tmin", "rh", "wind")], F.col("latitude"), F.col("elev"), doy, **A.ET0)
    fields.append(et0.alias("et0"))
    # a projection of its own: the list aggregate evaluates whatever stands inside it row by row, uncompiled
    rows = df.select(*keys, *attributes, F.struct(*fields).alias("_day"))
    return rows.groupBy(*keys, *attributes).agg(F.collect_list("_day").alias("_days")).withColumn("days", F.array_sort("_days")).drop("_days")


def _text(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c.cast("string")


def _advisory(rule: str | Column, severity: Column | str, category: str, key: str | Column, params: dict[str, Column | str],
              days: Column, crop: Column | None = None) -> Column:
    pairs = [x for k, v in params.items() for x in (F.lit(k), F.coalesce(_text(v), F.lit("-")))]
    values = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(_text(rule).alias("rule"), _text(severity).alias("severity"), F.lit(category).alias("category"), _text(key).alias("key"),
                    values.alias("params"), days.cast("array<int>").alias("days"),
                    (crop if crop is not None else F.lit(None)).cast("string").alias("crop"))


def _if(condition: Column, advisory: Column) -> Column:
    """Array with the advisory, or an empty one."""
    return F.when(sure(condition), F.array(advisory)).otherwise(F.array().cast(ADVISORY))


def _one_decimal(c: Column) -> Column:
    return F.bround(c, 1)


def _whole(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def _at(days: Column, i: Column) -> Column:
    return F.try_element_at(days, i.cast("int") + 1)


def _first(n: int) -> Column:
    return F.array(*[F.lit(i) for i in range(n)])


def _sum_first(days: Column, n: int) -> Column:
    """Rain over the first ``n`` days; unknown days add nothing."""
    return F.aggregate(F.slice(days, 1, n), F.lit(0.0), lambda s, d: s + F.coalesce(d["rain"], F.lit(0.0)))


def _known(days: Column, field: str) -> Column:
    return F.array_compact(F.transform(days, lambda d: d[field]))


def _first_extreme(days: Column, field: str, largest: bool) -> Column:
    """Position of the first day with the extreme value."""
    best = F.array_max(_known(days, field)) if largest else F.array_min(_known(days, field))
    return F.array_position(F.transform(days, lambda d: d[field]), best) - 1


def _step(value: Column, r: dict, falling: bool = False) -> Column:
    hit = (lambda t: value <= t) if falling else (lambda t: value >= t)
    return F.when(hit(r["red"]), 3).when(hit(r["orange"]), 2).when(hit(r["yellow"]), 1).otherwise(0)


def level_name(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in A.LEVELS]), i.cast("int") + 1)


def level_index(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in A.LEVELS]), name).cast("int") - 1


def _prepare(df: DataFrame, r: dict, diseases: dict) -> DataFrame:
    """Adds what several rules share, as columns, so that each is computed once per row."""
    days = F.col("days")

    def heavy(d: Column) -> Column:
        h, p = r["heavy_rain"], d["p_heavy"]
        return (F.when(sure(d["rain"] >= h["red_mm"]) | sure(p >= h["red_prob"]), 3)
                .when(sure(d["rain"] >= h["orange_mm"]) | sure(p >= h["orange_prob"]), 2).when(sure(d["rain"] >= h["yellow_mm"]), 1).otherwise(0))

    s, t, p, n = r["spray_window"], r["thunderstorm"], r["pest_fungal"], r["dry_spell"]["window_days"]
    first = F.slice(days, 1, n)
    df = df.withColumns({
        "_heavy": F.transform(days, heavy),
        "_fit": true_positions(mask(days, lambda d: (d["rain"] <= s["max_rain_mm"]) & (d["wind"] <= s["max_wind_kmh"])
                                    & (d["p_light"].isNull() | (d["p_light"] <= s["max_prob"])))),
        "_storm": F.transform(days, lambda d: F.when((d["p_moderate"] >= t["min_prob"]) & (d["tmax"] >= t["min_tmax"]) & (d["rh"] >= t["min_rh"]), d["p_moderate"])),
        "_pest": true_positions(mask(days, lambda d: (d["tmax"] > p["tmax"]) & (d["rh"] > p["rh"]))),
        "_dry": mask(days, lambda d: d["rain"] < r["harvest"]["rain_mm"]),
        "_hot_at": _first_extreme(days, "tmax", True), "_cold_at": _first_extreme(days, "tmin", False), "_wind_at": _first_extreme(days, "wind", True),
        "_et0": F.aggregate(first, F.lit(0.0), lambda a, d: a + F.coalesce(d["et0"], F.lit(0.0))),
        "_light": F.coalesce(F.array_max(_known(first, "p_light")), F.lit(0.0)),
        "_seq": derived_days(days),
    })
    conditions = _conditions(diseases)
    return df.withColumns({
        "_heavy_at": F.array_position("_heavy", F.array_max("_heavy")) - 1, "_storm_at": F.array_position("_storm", F.array_max("_storm")) - 1,
        "_dry_run": longest_true_run(F.col("_dry")), "_dry_days": true_positions(F.col("_dry")),
        "_wet_days": true_positions(F.transform("_dry", lambda ok: ~ok)),
        **{f"_flags{i}": mask(F.col("_seq"), compile_rule(w)) for i, w in enumerate(conditions)},
    })


def _conditions(diseases: dict) -> list[dict]:
    """The distinct day conditions of all disease levels."""
    out: list[dict] = []
    for levels in diseases.values():
        for lv in levels:
            if lv["when"] not in out:
                out.append(lv["when"])
    return out


def weather_rules(r: dict) -> list[Column]:
    """Rules that need no crop, over prepared rows with slope_mean, soil_clay_pct and tpi_2km."""
    days, out = F.col("days"), []

    def date_of(i: Column) -> Column:
        return F.date_add("issue_date", _at(days, i)["lead"])

    # heavy rain by amount or probability: worst level, first day that reaches it
    worst, at = F.array_max("_heavy"), F.col("_heavy_at")
    day = _at(days, at)
    out.append(_if(worst > 0, _advisory("heavy_rain", level_name(worst), "general", "heavy_rain", {
        "rain": _one_decimal(day["rain"]), "prob": _whole(100 * day["p_heavy"]), "thr": str(A.PROBABILITY_MM["heavy"]), "day_index": at, "date": date_of(at)},
        F.array(at))))

    # waterlogging on flat, clayey land; unknown terrain or soil gives no advice
    w = r["waterlogging"]
    n, rain = w["window_days"], _sum_first(days, w["window_days"])
    fired = (rain >= w["trigger_mm"]) & (F.col("slope_mean") <= w["flat_slope_deg"]) & (F.col("soil_clay_pct") >= w["clay_pct"])
    sev = F.when(rain >= w["orange_multiplier"] * w["trigger_mm"], "orange").otherwise("yellow")
    out.append(_if(fired, _advisory("waterlogging", sev, "general", "waterlogging", {
        "rain3": _one_decimal(rain), "window": str(n), "slope": _one_decimal(F.col("slope_mean")), "clay": _whole(F.col("soil_clay_pct"))}, _first(n))))

    # days fit for spraying, else advice against it on all days
    good = F.col("_fit")
    ok = _advisory("spray_window", "green", "general", "spray_ok", {"day_indices": F.array_join(good.cast("array<string>"), ",")}, good)
    no = _advisory("spray_window", "yellow", "general", "spray_no", {}, F.transform(days, lambda d, i: i))
    out.append(F.array(F.when(F.size(good) > 0, ok).otherwise(no)))

    # fertiliser timing
    f = r["fertiliser"]
    rain2 = _sum_first(days, f["window_days"])
    out.append(_if(rain2 >= f["avoid_mm"], _advisory("fertiliser", "yellow", "general", "fert_avoid", {"rain2": _one_decimal(rain2)}, _first(f["window_days"]))))

    # heat at the first hottest day
    at = F.col("_hot_at")
    v = _at(days, at)["tmax"]
    step = _step(v, r["heat"])
    out.append(_if(step > 0, _advisory("heat", level_name(step), "general", "heat", {"tmax": _one_decimal(v), "day_index": at, "date": date_of(at)}, F.array(at))))

    # cold at the first coldest day, one level higher in a valley, frost wording near the red threshold
    c = r["cold"]
    at = F.col("_cold_at")
    v = _at(days, at)["tmin"]
    step = _step(v, c, falling=True)
    raised = F.least(F.lit(3), step + F.when(F.col("tpi_2km") <= c["valley_tpi"], 1).otherwise(0))
    name = F.when(v <= c["red"] + c["frost_margin"], "frost").otherwise("cold")
    out.append(_if(step > 0, _advisory(name, level_name(raised), "general", name, {"tmin": _one_decimal(v), "day_index": at, "date": date_of(at)}, F.array(at))))

    # thunderstorm in the convective months: every day at risk, described by the likeliest
    t = r["thunderstorm"]
    at, best = F.col("_storm_at"), F.array_max("_storm")
    sev = F.when(best >= t["orange_prob"], "orange").otherwise("yellow")
    risky = true_positions(F.transform("_storm", lambda x: x.isNotNull()))
    out.append(_if(F.month("on_date").isin(t["months"]) & best.isNotNull(), _advisory("thunderstorm", sev, "general", "thunder", {
        "prob": _whole(100 * best), "thr": str(A.PROBABILITY_MM["moderate"]), "day_index": at, "date": date_of(at)}, risky)))

    # strong wind
    at = F.col("_wind_at")
    v = _at(days, at)["wind"]
    step = _step(v, r["wind"])
    out.append(_if(step > 0, _advisory("wind", level_name(step), "general", "wind", {"wind": _whole(v), "day_index": at, "date": date_of(at)}, F.array(at))))

    # hot and humid: pests and fungi
    bad = F.col("_pest")
    first = _at(days, F.try_element_at(bad, F.lit(1)))
    out.append(_if(F.size(bad) > 0, _advisory("pest_fungal", "yellow", "general", "pest_fungal", {"tmax": _one_decimal(first["tmax"]), "rh": _whole(first["rh"])}, bad)))
    return out


def crop_rules(r: dict) -> list[Column]:
    """Dry spell, sowing and harvest, over prepared rows with crops and ante_obs7."""
    days, crops = F.col("days"), F.col("crops")
    none = F.array().cast(ADVISORY)
    d = r["dry_spell"]
    rain = _sum_first(days, d["window_days"])
    dry = (rain < d["rain_mm"]) & (F.col("_light") <= d["max_prob"])
    sensitive = F.filter(crops, lambda c: c["stage_type"].isin(d["sensitive_stages"]))

    def dry_spell(c: Column) -> Column:
        etc = F.col("_et0") * c["kc"]
        return _advisory("dry_spell", "yellow", "crop", "dry_spell", {
            "rain3": _one_decimal(rain), "etc": _one_decimal(etc), "irr": _whole(F.greatest(F.lit(0.0), etc - d["effective_rain"] * rain)),
            "et0_3day": _one_decimal(F.col("_et0"))}, _first(d["window_days"]), c["crop"])

    out = [F.when(dry, F.transform(sensitive, dry_spell)).otherwise(none)]

    s = r["sowing_window"]
    cum = F.col("ante_obs7") + _sum_first(days, s["window_days"])
    enough = cum >= s["cumulative_mm"]
    sowing = F.month("on_date").isin(s["months"]) & F.exists(crops, lambda c: c["stage_type"] == "sowing") & F.col("ante_obs7").isNotNull()
    out.append(_if(sowing, _advisory("sowing_window", F.when(enough, "green").otherwise("yellow"), "general",
                                     F.when(enough, "sowing_ok").otherwise("sowing_wait"),
                                     {"cum": _whole(cum), "need": str(round(s["cumulative_mm"]))}, _first(s["window_days"]))))

    ripe = F.filter(crops, lambda c: c["stage_type"] == "harvest")
    go = F.transform(ripe, lambda c: _advisory("harvest", "green", "crop", "harvest_ok", {"n": F.col("_dry_run")}, F.col("_dry_days"), c["crop"]))
    stop = F.transform(ripe, lambda c: _advisory("harvest", "yellow", "crop", "harvest_no", {}, F.col("_wet_days"), c["crop"]))
    out.append(F.when(F.col("_dry_run") >= r["harvest"]["dry_days"], go).when(F.size("_wet_days") > 0, stop).otherwise(none))
    return out


def disease_risks(diseases: dict) -> Column:
    """Array of ``struct<model, level, days>``, one entry per disease model, over prepared rows."""
    conditions = _conditions(diseases)
    return F.array(*[risk_level(levels, lambda w: F.col(f"_flags{conditions.index(w)}"), model) for model, levels in diseases.items()])


def disease_rules(risks: Column) -> Column:
    """Moderate and high risks of the diseases of the crops in season."""
    def of_crop(c: Column) -> Column:
        mine = F.filter(risks, lambda m: F.array_contains(c["diseases"], m["model"]) & (m["level"] >= 2))
        return F.transform(mine, lambda m: _advisory(F.concat(F.lit("disease:"), m["model"]), F.when(m["level"] == 3, "orange").otherwise("yellow"),
                                                     "disease", "disease", {"disease": m["model"], "level": m["level"]}, m["days"], c["crop"]))

    # the size test is the common case, and a second use of the risks keeps the optimizer from
    # moving their computation inside the loop over crops
    found = F.size(F.filter(risks, lambda m: m["level"] >= 2)) > 0
    return F.when(found, F.flatten(F.transform(F.col("crops"), of_crop))).otherwise(F.array().cast(ADVISORY))


def evaluate(sequences: DataFrame, crops: DataFrame, parent: str, rules: dict | None = None, diseases: dict | None = None) -> DataFrame:
    """All advisories of every row: adds ``crops``, ``advisories`` and ``overall``.

    ``crops`` comes from :func:`crops_in_season` on the first valid day, in column ``on_date``.
    """
    r, models = rules or A.RULES, diseases or A.DISEASES
    for c in A.CROPS.values():
        unknown = set(c["diseases"]) - set(models)
        if unknown:
            raise KeyError(f"disease models without criteria: {sorted(unknown)}")
    empty = F.array().cast("array<struct<crop_ord:int,ord:int,crop:string,crop_name:string,stage:string,stage_type:string,kc:double,diseases:array<string>>>")
    df = sequences.withColumn("on_date", F.date_add("issue_date", F.col("days")[0]["lead"]))
    df = df.join(crops, [parent, "on_date"], "left").withColumn("crops", F.coalesce("crops", empty))
    # rules cost far more per row than its bytes suggest: spread the rows evenly over as many
    # tasks as the session shuffles into, whatever parents they belong to
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(spread, "issue_date", "latitude", "elev", "days")
    columns = df.columns
    df = _prepare(df, r, models).withColumn("_risks", disease_risks(models))
    weather = weather_rules(r)
    dry_spell, sowing, harvest = crop_rules(r)
    ordered = [*weather[:2], dry_spell, sowing, *weather[2:], harvest, disease_rules(F.col("_risks"))]
    return df.select(*columns, F.concat(*ordered).alias("advisories")).withColumn("overall", overall(F.col("advisories")))


def overall(advisories: Column) -> Column:
    """Worst severity over the weather warnings; advice on operations and diseases does not count."""
    counted = F.filter(advisories, lambda a: ~a["category"].isin(A.OVERALL_EXCLUDED_CATEGORIES) & ~a["rule"].isin(A.OVERALL_EXCLUDED_RULES))
    return level_name(F.coalesce(F.array_max(F.transform(counted, lambda a: level_index(a["severity"]))), F.lit(0)))


def advisory_rows(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """One row per advisory, in rule order."""
    # the outer form keeps the optimizer from evaluating the array a second time for its size
    return evaluated.select(*keys, F.posexplode_outer("advisories").alias("pos", "a")).where("pos is not null").select(*keys, "pos", "a.*")


def register_table_function(spark: SparkSession, evaluated: DataFrame, unit: str, issue: str, name: str = "advisories") -> None:
    """SQL table function ``name(unit, issue)``: the advisories of one unit and issue, one per row, in rule order.

    It is meant for lateral joins, ``FROM t, LATERAL advisories(t.unit, t.issue)``; Spark turns such a join into a
    plain join on unit and issue, so rules run once per evaluated row and as compiled columns. The function reads
    ``evaluated``, the result of :func:`evaluate`, and lasts as long as the session. A unit or issue that is null or
    not in ``evaluated`` has no advisories; rows of ``evaluated`` that repeat a key each give theirs.
    """
    rows = advisory_rows(evaluated, [unit, issue])
    view = f"_{name}_rows"
    rows.createOrReplaceTempView(view)
    types = dict(rows.dtypes)
    columns = ["pos", "rule", "severity", "category", "key", "params", "days", "crop"]
    result = ", ".join(f"`{c}` {types[c]}" for c in columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(of_unit {types[unit]}, of_issue {types[issue]}) RETURNS TABLE ({result}) "
              f"RETURN SELECT {', '.join(f'`{c}`' for c in columns)} FROM {view} WHERE `{unit}` = of_unit AND `{issue}` = of_issue")
