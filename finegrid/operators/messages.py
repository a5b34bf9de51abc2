"""Advisories as texts: rendered rows, summaries, bulletins, short messages, and their fan-out to subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finegrid.functions import text as X
from finegrid.operators import agronomy_values as A
from finegrid.operators.message_values import CATALOG
from finegrid.operators.relational import salted_join
from finegrid.operators.rules import level_index

# Short-message template per advisory.
SMS_KEYS = {"heavy_rain": "sms_heavy_rain", "dry_spell": "sms_dry_spell", "heat": "sms_heat", "cold": "sms_cold", "frost": "sms_cold",
            "wind": "sms_wind", "thunderstorm": "sms_thunder"}
TEXT_KEYS = ["heavy_rain", "waterlogging", "dry_spell", "sowing_ok", "sowing_wait", "spray_ok", "spray_no", "fert_avoid", "heat", "cold", "frost",
             "thunder", "wind", "pest_fungal", "harvest_ok", "harvest_no"]
RENDERED = "array<struct<rule:string,severity:string,crop:string,title:string,text:string,action:string>>"


def template(catalog: dict, key: str) -> str:
    if key not in catalog:
        raise KeyError(f"message '{key}' is missing from the catalogue")
    return catalog[key]


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def _crop_names(crops: dict | None = None) -> dict[str, str]:
    return {k: v["name"] for k, v in (crops or A.CROPS).items()}


def _date_at(i: Column) -> Column:
    return F.date_add(F.col("issue_date"), F.try_element_at(F.col("days"), i + 1)["lead"])


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _values(a: Column, catalog: dict, crop_names: dict[str, str], short: bool, days: int | None = 3):
    """Placeholder values of an advisory: its parameters, day labels and names; short texts name the first ``days`` days (None: all)."""
    names = catalog["day_names"]

    def value_of(name: str) -> Column:
        if name == "day":
            return X.day_label(F.to_date(a["params"]["date"]), names)
        if name == "days":
            if short:
                return F.array_join(F.transform(_first(a["days"], days), lambda i: X.weekday_name(_date_at(i), names)), ",")
            return F.array_join(F.transform(a["days"], lambda i: X.day_label(_date_at(i), names)), ", ")
        if name == "crop":
            return F.coalesce(_lookup(crop_names, a["crop"]), F.lit(""))
        if name == "disease":
            full = _lookup(catalog["disease_names"], a["params"]["disease"])
            return F.split_part(full, F.lit(" ("), F.lit(1)) if short else full
        if name == "level":
            return _lookup(catalog["risk_levels"], a["params"]["level"])
        return F.try_element_at(a["params"], F.lit(name))

    return value_of


def rendered(catalog: dict, crop_names: dict[str, str] | None = None) -> Column:
    """The ``advisories`` of a row as texts, with a "normal" entry in front when nothing is above green."""
    crops = crop_names or _crop_names()

    def of(a: Column) -> Column:
        values = _values(a, catalog, crops, short=False)

        def case(part: str) -> Column:
            out = None
            for k in TEXT_KEYS:
                t = X.render(template(catalog, f"{k}_{part}"), values)
                out = F.when(a["key"] == k, t) if out is None else out.when(a["key"] == k, t)
            return out

        disease = a["category"] == "disease"
        title = F.when(disease, X.render(template(catalog, "disease_title"), values)).otherwise(case("title"))
        body = F.when(disease, "").otherwise(case("text"))
        action = F.when(disease, _lookup(catalog["disease_actions"], a["params"]["disease"])).otherwise(case("action"))
        return F.struct(a["rule"].alias("rule"), a["severity"].alias("severity"), a["crop"].alias("crop"), title.alias("title"), body.alias("text"),
                        action.alias("action"))

    all_rows = F.transform("advisories", of)
    normal = F.array(F.struct(F.lit("normal").alias("rule"), F.lit("green").alias("severity"), F.lit(None).cast("string").alias("crop"),
                              F.lit(template(catalog, "normal_title")).alias("title"), F.lit(template(catalog, "normal_text")).alias("text"), F.lit("").alias("action")))
    calm = ~F.exists("advisories", lambda a: a["severity"] != "green")
    return F.when(calm, F.concat(normal, all_rows)).otherwise(all_rows)


def weather_summary(catalog: dict, summary: dict | None = None) -> Column:
    """Sentence on the rain of the horizon and the temperature ranges, over the ``days`` of a row."""
    th = summary or A.SUMMARY
    days = F.col("days")
    known = F.array_compact(F.transform(days, lambda d: d["rain"]))
    total = F.bround(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), 1)
    wet = F.size(F.filter(known, lambda v: v >= th["rain_day_mm"]))
    peak = F.array_max(known)

    def extreme(field: str, pick) -> Column:
        return F.bround(pick(F.array_compact(F.transform(days, lambda d: d[field]))), 0).cast("int")

    values = {"n": F.size(days), "n_days": wet, "total": total, "tmax_lo": extreme("tmax", F.array_min), "tmax_hi": extreme("tmax", F.array_max),
              "tmin_lo": extreme("tmin", F.array_min), "tmin_hi": extreme("tmin", F.array_max)}
    text = {k: X.render_with(template(catalog, f"summary_{k}"), values) for k in ("heavy", "moderate", "light", "dry", "temp")}
    rain = F.when(peak >= th["heavy_mm"], text["heavy"]).when(peak >= th["moderate_mm"], text["moderate"]).when(wet > 0, text["light"]).otherwise(text["dry"])
    return F.concat(rain, F.lit(" "), text["temp"])


def sms(catalog: dict, name: Column, limit: int = 160, crop_names: dict[str, str] | None = None, days: int | None = 3) -> Column:
    """Short message: highest severity first, whole items only, never longer than ``limit``."""
    crops = crop_names or _crop_names()

    def item(a: Column, pos: Column) -> Column:
        values = _values(a, catalog, crops, short=True, days=days)
        body = None
        for rule, key in SMS_KEYS.items():
            t = X.render(template(catalog, key), values)
            body = F.when(a["rule"] == rule, t) if body is None else body.when(a["rule"] == rule, t)
        body = body.when((a["rule"] == "spray_window") & (a["severity"] == "green"), X.render(template(catalog, "sms_spray_ok"), values))
        body = body.when(a["category"] == "disease", X.render(template(catalog, "sms_disease"), values))
        return F.when(body.isNotNull(), F.struct((-level_index(a["severity"])).alias("rank"), pos.alias("pos"), body.alias("text")))

    items = F.array_sort(F.array_compact(F.transform("advisories", item)))
    texts = F.transform(items, lambda i: i["text"])
    total = F.bround(F.aggregate("days", F.lit(0.0), lambda s, d: s + F.coalesce(d["rain"], F.lit(0.0))), 0).cast("int")
    normal = X.render_with(template(catalog, "sms_normal"), {"n": F.size("days"), "total": total})
    calm = ~F.exists(items, lambda i: i["rank"] < 0)
    return X.pack(X.render_with(template(catalog, "sms_prefix"), {"gp": name}), F.when(calm, F.concat(F.array(normal), texts)).otherwise(texts), limit)


def bulletins(evaluated: DataFrame, lang: str, name: Column, district: str, catalog: dict | None = None, crop_names: dict[str, str] | None = None,
              chat_items: int | None = 4, chat_chars: int | None = 1500, voice_items: int | None = 5) -> DataFrame:
    """Everything a reader of one language needs, per unit and issue: summary, items, short, chat, voice and plain text.

    Channels have their usual limits: advisories and characters of a chat message, advisories read out; None lifts one.
    """
    c = catalog or CATALOG[lang]
    df = evaluated.withColumn("lang", F.lit(lang)).withColumn("items", rendered(c, crop_names).cast(RENDERED))
    df = df.withColumn("summary", weather_summary(c)).withColumn("sms", sms(c, F.initcap(name) if lang == "en" else name, crop_names=crop_names)).withColumn("_name", name)
    label = _lookup(c["levels"], F.col("overall"))
    first, last = (F.date_add("issue_date", d["lead"]).cast("string") for d in (F.col("days")[0], F.element_at("days", -1)))

    def table_line(d: Column) -> Column:
        cells = [F.bround(d[v], 1).cast("string") for v in ("rain", "tmax", "tmin")] + [F.bround(d[v], 0).cast("int").cast("string") for v in ("rh", "wind")]
        day = X.day_label(F.date_add(F.col("issue_date"), d["lead"]), c["day_names"])
        return F.concat(F.rpad(day, 12, " "), *[F.lpad(F.coalesce(v, F.lit("-")), w, " ") for v, w in zip(cells, (12, 16, 16, 12, 14))])

    def lines(keep, body: bool = True) -> Column:
        def line(i: Column) -> Column:
            parts = [F.lit(" - "), i["title"], F.lit(": "), *([i["text"], F.lit(" ")] if body else []), i["action"]]
            return F.rtrim(F.concat(*parts))

        return F.transform(F.filter("items", keep), line)

    general = lines(lambda i: i["crop"].isNull())
    crop = lines(lambda i: i["crop"].isNotNull() & ~i["rule"].startswith("disease:"))
    disease = lines(lambda i: i["rule"].startswith("disease:"), body=False)
    stages = F.array_join(F.transform("crops", lambda k: X.render_with(c["crop_stage_line"], {"crop": k["crop_name"], "stage": k["stage"]})), "; ")
    none = F.array().cast("array<string>")
    head = F.concat(*[f(c[k]) if callable(f) else f for k, f in (("col_date", lambda s: F.lit(f"{s:<12}")), ("col_rain", lambda s: F.lit(f"{s:>12}")),
                    ("col_tmax", lambda s: F.lit(f"{s:>16}")), ("col_tmin", lambda s: F.lit(f"{s:>16}")), ("col_rh", lambda s: F.lit(f"{s:>12}")),
                    ("col_wind", lambda s: F.lit(f"{s:>14}")))])
    L = c
    text = F.concat(
        F.array(F.concat(F.lit(f"{L['bulletin_title']} - "), "_name"), F.concat(F.lit(f"{L['block']}: "), "block_name", F.lit(f" | {L['district']}: {district}")),
                F.concat(F.lit(f"{L['issued']}: "), F.col("issue_date").cast("string"), F.lit(f" | {L['valid']}: "), first, F.lit(" - "), last),
                F.concat(F.lit(f"{L['overall_status']}: "), label), F.lit(""), F.lit(L["weather_forecast"]), head),
        F.transform("days", table_line),
        F.array(F.lit(""), F.concat(F.lit(f"{L['weather_summary']}: "), "summary"), F.lit(""), F.lit(f"{L['general_advisory']}:")), general,
        F.when(F.size("crops") > 0, F.concat(F.array(F.lit(""), F.concat(F.lit(f"{L['crop_advisory']}: "), stages)), crop)).otherwise(none),
        F.when(F.size(disease) > 0, F.concat(F.array(F.lit(""), F.lit(f"{L['disease_advisory']}:")), disease)).otherwise(none),
        F.array(F.lit(""), F.concat(F.lit("SMS: "), "sms"), F.lit(""), F.lit(L["footer"])))
    ordered = F.concat(F.filter("items", lambda i: i["crop"].isNull()), F.filter("items", lambda i: i["crop"].isNotNull() & ~i["rule"].startswith("disease:")),
                       F.filter("items", lambda i: i["rule"].startswith("disease:")))
    shown = F.filter(_first(ordered, chat_items), lambda i: (i["severity"] != "green") | i["rule"].isin("normal", "spray_window"))
    chat_days = F.transform("days", lambda d: F.concat(X.day_label(F.date_add(F.col("issue_date"), d["lead"]), c["day_names"]), F.lit(": "), F.bround(d["rain"], 1).cast("string"),
                                                       F.lit(" mm, "), F.bround(d["tmax"], 1).cast("string"), F.lit("/"), F.bround(d["tmin"], 1).cast("string"), F.lit(" °C")))
    chat = F.concat(F.array(F.concat(F.lit(f"*{L['bulletin_title']}* - "), "_name", F.lit(" ("), "block_name", F.lit(")")), F.concat(F.lit(f"{L['overall_status']}: *"), label, F.lit("*")),
                            F.lit("")), chat_days, F.array(F.lit("")), F.transform(shown, lambda i: F.concat(F.lit("• *"), i["title"], F.lit("* "), i["action"])))
    spoken = F.concat(F.array(F.concat(F.lit(f"{L['bulletin_title']}. {L['gp']} "), "_name", F.lit(".")), F.concat(F.lit(f"{L['overall_status']}: "), label, F.lit(".")), F.col("summary")),
                      F.transform(_first(ordered, voice_items), lambda i: F.trim(F.concat(i["title"], F.lit(". "), i["text"], F.lit(" "), i["action"]))))
    voice = F.replace(F.replace(F.array_join(spoken, "\n"), F.lit("°C"), F.lit(" degree")), F.lit("mm"), F.lit(" millimetre"))
    return df.withColumns({"text": F.array_join(text, "\n"), "chat": F.array_join(chat, "\n") if chat_chars is None else F.substring(F.array_join(chat, "\n"), 1, chat_chars), "voice": voice}).drop("_name")


def fan_out(subscribers: DataFrame, messages: DataFrame, published: DataFrame) -> DataFrame:
    """One outbox row per subscriber and published issue, with the text of the subscriber's channel and its size.

    ``messages`` has gp_code, lang, issue_date, sms, chat, voice.  Issues that are not
    published are removed before the join.
    """
    ready = messages.join(published.select("issue_date"), "issue_date", "left_semi")
    out = salted_join(subscribers, ready, ["gp_code", "lang"], ["subscriber_id"])
    body = F.when(F.col("channel") == "sms", F.col("sms")).when(F.col("channel") == "whatsapp", F.col("chat")).when(F.col("channel") == "ivr", F.col("voice"))
    out = out.withColumn("message", body)
    return out.select("issue_date", "subscriber_id", "gp_code", "channel", "lang", "message", F.length("message").alias("chars"), X.segments(F.col("message")).alias("segments"))


def channel_totals(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("issue_date", "channel").agg(F.count("*").alias("queued"), F.sum("chars").alias("chars"), F.sum("segments").alias("segments"))
