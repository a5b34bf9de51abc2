"""Advisory rules at their thresholds, and the messages made from them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from finegrid.operators import agronomy_values as A
from finegrid.operators import messages as Ms
from finegrid.operators import rules as U
from finegrid.operators.message_values import CATALOG

UNIT = {"latitude": 18.2, "elev": 540.0, "slope_mean": 1.5, "soil_clay_pct": 45.0, "tpi_2km": 0.0, "ante_obs7": None}
BASE = {"rain": 0.0, "tmax": 30.0, "tmin": 22.0, "rh": 70.0, "wind": 10.0}


def advise(spark, cases, block="BARAMATI", issue=dt.date(2026, 7, 10), diseases=None):
    """Advisories of several five-day forecasts at once: case name -> {field: list or value}."""
    rows = []
    for name, case in cases.items():
        unit = {**UNIT, **{k: v for k, v in case.items() if k in UNIT}}
        for i in range(5):
            v = {k: (case[k][i] if isinstance(case.get(k), list) else case.get(k, d)) for k, d in BASE.items()}
            p = case.get("p645")
            rows.append((name, block, issue, i + 1, *[None if v[k] is None else float(v[k]) for k in BASE], None if p is None else float(p), *[unit[k] for k in UNIT]))
    cols = "gp_code string, block_name string, issue_date date, lead_day int, rain_pred double, tmax_pred double, tmin_pred double, rh_pred double, wind_pred double, rain_p_ge_64p5 double, "
    df = spark.createDataFrame(rows, cols + ", ".join(f"{k} double" for k in UNIT))
    seq = U.day_sequences(df, ["gp_code", "issue_date"], ["block_name", *UNIT])
    on = seq.select("block_name", F.date_add("issue_date", 1).alias("on_date"))
    return U.evaluate(seq, U.crops_in_season(on, U.crop_calendar(spark), "block_name", "on_date"), "block_name", diseases=diseases)


def by_rule(df):
    out = {}
    for r in df.collect():
        out[r["gp_code"]] = {a["rule"]: a for a in r["advisories"]}
        out[r["gp_code"]]["overall"] = r["overall"]
    return out


def test_heavy_rain_boundaries(spark):
    levels = {35.4: None, 35.5: "yellow", 64.4: "yellow", 64.5: "orange", 115.5: "orange", 115.6: "red"}
    got = by_rule(advise(spark, {str(mm): {"rain": [0, mm, 0, 0, 0]} for mm in levels} | {"prob": {"rain": 10.0, "p645": 0.65}}))
    for mm, level in levels.items():
        a = got[str(mm)].get("heavy_rain")
        assert (a["severity"] if a else None) == level
        assert a is None or a["days"] == [1]
    assert got["prob"]["heavy_rain"]["severity"] == "red" and got["prob"]["overall"] == "red"


def test_terrain_and_soil(spark):
    wet = {"rain": [30, 25, 10, 0, 0]}
    got = by_rule(advise(spark, {"flat": wet, "steep": {**wet, "slope_mean": 12.0}, "unknown": {**wet, "soil_clay_pct": None}, "double": {"rain": [60, 30, 10, 0, 0]}}))
    assert got["flat"]["waterlogging"]["severity"] == "yellow" and got["double"]["waterlogging"]["severity"] == "orange"
    assert "waterlogging" not in got["steep"] and "waterlogging" not in got["unknown"]


def test_cold_valley_spray_heat_wind(spark):
    got = by_rule(advise(spark, {
        "plain": {"tmin": [6, 8, 9, 9, 9]}, "valley": {"tmin": [6, 8, 9, 9, 9], "tpi_2km": -30.0}, "spray": {"rain": [10, 0, 0, 5, 0], "wind": [10, 25, 8, 8, 8]},
        "stormy": {"wind": 45.0}, "hot": {"tmax": [39, 42, 42, 41, 30], "rh": 50.0}, "humid": {"tmax": [36, 35, 36, 30, 30], "rh": [71, 90, 70, 90, 90]}}))
    order = A.LEVELS.index
    assert order(got["valley"]["frost"]["severity"]) == order(got["plain"]["frost"]["severity"]) + 1
    assert got["spray"]["spray_window"]["days"] == [2, 4]
    assert got["stormy"]["spray_window"]["severity"] == "yellow" and got["stormy"]["wind"]["severity"] == "orange" and got["stormy"]["wind"]["days"] == [0]
    assert got["hot"]["heat"]["severity"] == "orange" and got["hot"]["heat"]["days"] == [1]
    assert got["humid"]["pest_fungal"]["days"] == [0]
    assert got["hot"]["overall"] == "orange"


def test_three_day_sum_ignores_later_days(spark):
    got = by_rule(advise(spark, {"a": {"rain": [1.0, 0.5, 0.5, 40, 40]}}))
    assert got["a"]["dry_spell"]["params"]["rain3"] == "2.0" and got["a"]["dry_spell"]["category"] == "crop"


def test_sowing_needs_antecedent(spark):
    case = {"rain": [10, 10, 10, 0, 0]}
    got = by_rule(advise(spark, {"enough": {**case, "ante_obs7": 40.0}, "short": {**case, "ante_obs7": 5.0}, "unknown": case}))
    assert got["enough"]["sowing_window"]["severity"] == "green" and got["short"]["sowing_window"]["severity"] == "yellow" and "sowing_window" not in got["unknown"]


def test_crop_calendar(spark):
    d = spark.createDataFrame([("maval", dt.date(2026, 7, 20))], "block_name string, on_date date")
    names = {c["crop"] for c in U.crops_in_season(d, U.crop_calendar(spark), "block_name", "on_date").first()["crops"]}
    assert "rice" in names and "sugarcane" not in names
    only = U.crops_in_season(d, U.crop_calendar(spark), "block_name", "on_date", only=["sugarcane"]).first()["crops"]
    assert [c["crop"] for c in only] == ["sugarcane"]


def test_disease_levels(spark):
    seq = spark.createDataFrame([
        ("wet", [(float(r), 28.0, 20.0, 90.0) for r in (12, 3, 0, 0, 0)]), ("dry", [(0.0, 35.0, 22.0, 40.0)] * 5)],
        "k string, days array<struct<rain:double,tmax:double,tmin:double,rh:double>>")
    d = seq.withColumn("s", U.derived_days(F.col("days")))

    def level(model):
        flags = lambda w: U.mask(F.col("s"), U.compile_rule(w))
        return {r["k"]: r["l"] for r in d.select("k", U.risk_level(A.DISEASES[model], flags)["level"].alias("l")).collect()}

    assert level("grape_downy_mildew") == {"wet": 3, "dry": 0}
    assert level("onion_thrips")["dry"] == 3
    with pytest.raises(KeyError):
        advise(spark, {"a": {}}, diseases={"rice_blast": A.DISEASES["rice_blast"]})


def test_messages_fit_and_have_no_placeholders(spark):
    ev = advise(spark, {"a": {"rain": [80, 30, 5, 0, 0]}, "calm": {"rain": 3.0, "tmax": 28.0, "rh": 60.0}})
    b = {r["gp_code"]: r for r in Ms.bulletins(ev, "en", F.concat(F.lit("village "), "gp_code"), "Pune").collect()}
    for r in b.values():
        for part in ("sms", "text", "chat", "voice", "summary"):
            assert r[part] and "{" not in r[part]
        assert len(r["sms"]) <= 160 and len(r["chat"]) <= 1500
    assert "HEAVY RAIN 80.0mm" in b["a"]["sms"] and "Heavy rainfall warning" in b["a"]["text"]
    assert b["a"]["summary"].startswith("Heavy rain is possible; total rainfall over 5 days about 115.0 mm.")
    with pytest.raises(KeyError):
        Ms.bulletins(ev, "mr", F.lit("x"), "Pune")
    assert ev.select(Ms.weather_summary(CATALOG["mr"])).first()[0]


def test_advisories_as_a_table_function(spark):
    """Rows of a lateral call are those of the advisories; unknown and null keys have none; repeated callers get all of theirs."""
    a = "array(named_struct('rule', 'heat', 'severity', 'red', 'category', 'general', 'key', 'k', 'params', map('t', '45'), 'days', array(1), 'crop', cast(null as string)), " \
        "named_struct('rule', 'wind', 'severity', 'yellow', 'category', 'general', 'key', 'w', 'params', map('t', '30'), 'days', array(0, 2), 'crop', cast(null as string)))"
    df = spark.sql(f"SELECT 'u' AS pos_id, DATE '2024-01-01' AS issue, {a} AS advisories UNION ALL SELECT 'v', DATE '2024-01-01', slice({a}, 1, 0) UNION ALL SELECT NULL, DATE '2024-01-01', {a}")
    U.register_table_function(spark, df, "pos_id", "issue")
    spark.createDataFrame([("u",), ("u",), ("v",), ("x",), (None,)], "pos_id string").createOrReplaceTempView("_callers")
    got = spark.sql("SELECT c.pos_id, a.pos, a.rule, a.params['t'] AS t, a.days FROM _callers c, LATERAL advisories(c.pos_id, DATE '2024-01-01') a").collect()
    assert sorted(map(tuple, got)) == sorted([("u", 0, "heat", "45", [1]), ("u", 1, "wind", "30", [0, 2])] * 2)
    assert spark.sql("SELECT rule FROM advisories('u', DATE '2024-01-02')").isEmpty()
