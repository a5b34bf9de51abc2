"""Queries over texts, messages and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from finegrid.functions import text as X
from finegrid.operators import agronomy_values as A
from finegrid.operators import eventlog as Lg
from finegrid.operators import messages as Ms
from finegrid.operators import relational as L
from finegrid.operators.message_values import CATALOG
from finegrid.plans.bindings import sql
from finegrid.plans.registry import query
from finegrid.plans.rule_queries import CROP_CTES, DISEASE_CTES, SEQ, WEATHER, evaluated, sequences

SALT = "salt-for-tests:"
_SPACE_SQL = X.SPACE


@query("text_clean", "F7", f"""
    SELECT doc_id, md5(trim(regexp_replace(text, '{_SPACE_SQL}', ' ', 'g'))) AS clean_md5, upper(lang) AS lang,
      CAST(len(string_split(trim(regexp_replace(text, '{_SPACE_SQL}', ' ', 'g')), ' ')) AS INTEGER) AS words FROM documents""")
def text_clean(t):
    c = X.clean(F.col("text"))
    return t.table("documents").select("doc_id", F.md5(c).alias("clean_md5"), F.upper("lang").alias("lang"), F.size(F.split(c, " ")).alias("words"))


@query("segments", "F11 E5", """
    SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS chars, CAST(CASE WHEN length(text) <= 70 THEN 1 ELSE ceil(length(text) / 67) END AS INTEGER) AS segments FROM conversations""")
def segments(t):
    return t.table("conversations").select("conv_id", "turn", F.length("text").alias("chars"), X.segments(F.col("text")).alias("segments"))


@query("phone_hash", "F12", f"""
    WITH d AS (SELECT c_custkey, regexp_replace(c_name || '-' || CAST(c_custkey * 13 AS VARCHAR), '[^0-9]', '', 'g') AS d FROM customer)
    SELECT c_custkey, CASE WHEN length(d) >= 11 THEN sha256('{SALT}' || d) END AS hash, CASE WHEN length(d) >= 11 THEN right(d, 2) END AS last2 FROM d""")
def phone_hash(t):
    phone = F.concat("c_name", F.lit("-"), (F.col("c_custkey") * 13).cast("string"))
    phone = F.when(F.length(X.digits(phone)) >= 11, phone).otherwise("")
    h, last2 = X.phone_hash(phone, SALT)
    return t.table("customer").select("c_custkey", h.alias("hash"), last2.alias("last2"))


@query("search_units", "P14 T2", """
    SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, CAST(c_custkey AS VARCHAR) AS code FROM customer WHERE contains(upper(c_name), '12') OR starts_with(CAST(c_custkey AS VARCHAR), '12'))
    ORDER BY c_name, code LIMIT 15""")
def search_units(t):
    df = t.table("customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("code"))
    return L.contains_or_prefix(df, "c_name", "code", " 12 ", 15).select("c_custkey", "c_name")


_DAYNAME = "(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[isodow({d})]"


@query("day_labels", "F9 F8", f"""
    SELECT o_orderkey, {_DAYNAME.format(d='o_orderdate')} || ' ' || strftime(o_orderdate, '%d/%m') AS label, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' on ' ||
      {_DAYNAME.format(d='o_orderdate')} || ' (' || o_orderpriority || ')' AS text FROM orders""")
def day_labels(t):
    names, d = CATALOG["en"]["day_names"], F.to_date("o_orderdate")
    text = X.render_with("Order {key} on {day} ({prio})", {"key": F.col("o_orderkey"), "day": X.weekday_name(d, names), "prio": F.col("o_orderpriority")})
    return t.table("orders").select("o_orderkey", X.day_label(d, names).alias("label"), text.alias("text"))


_TOTAL = "round_even(list_sum(list_transform(list_filter(r, lambda v: v IS NOT NULL), lambda v: v)), 1)"
SUMMARY_SQL = f"""CASE WHEN list_max(r) >= 64.5 THEN 'Heavy rain is possible; total rainfall over ' || len(r) || ' days about ' || tot || ' mm.'
      WHEN list_max(r) >= 15.6 THEN 'Moderate rain is likely on ' || wet || ' of the next ' || len(r) || ' days (total ' || tot || ' mm).'
      WHEN wet > 0 THEN 'Light rain is likely on ' || wet || ' of the next ' || len(r) || ' days (total ' || tot || ' mm).'
      ELSE 'Mainly dry weather is expected over the next ' || len(r) || ' days (total ' || tot || ' mm).' END
      || ' Maximum temperature ' || coalesce(CAST(CAST(round_even(list_min(x), 0) AS INTEGER) AS VARCHAR), '-') || '-' || coalesce(CAST(CAST(round_even(list_max(x), 0) AS INTEGER) AS VARCHAR), '-') || ' °C and minimum '
      || coalesce(CAST(CAST(round_even(list_min(n), 0) AS INTEGER) AS VARCHAR), '-') || '-' || coalesce(CAST(CAST(round_even(list_max(n), 0) AS INTEGER) AS VARCHAR), '-') || ' °C.'"""


@query("weather_summary", "A34 F8", sql(f""", sq AS ({SEQ}), s AS (SELECT *, CAST({_TOTAL} AS VARCHAR) AS tot, len(list_filter(r, lambda v: v >= 2.5)) AS wet FROM sq)
    SELECT gp_code, issue_date, {SUMMARY_SQL} AS summary FROM s""", "ufc"))
def weather_summary(t):
    return sequences(t).select("gp_code", "issue_date", Ms.weather_summary(CATALOG["en"]).alias("summary"))


def unit_bulletins(t):
    name = F.concat(F.lit("UNIT "), "gp_code")
    return Ms.bulletins(evaluated(t), "en", name, "Test")


@query("bulletin_text", "R15 R16 F8 F9", sql(f""", sq AS ({SEQ}), {WEATHER},
    lab AS (SELECT w.*, q.x, {_DAYNAME.format(d='(q.issue_date + q.ld[CAST(split_part(w.days, chr(44), 1) AS INTEGER) + 1])')} || ' ' ||
       strftime(q.issue_date + q.ld[CAST(split_part(w.days, chr(44), 1) AS INTEGER) + 1], '%d/%m') AS label FROM weather w JOIN sq q USING (gp_code, issue_date) WHERE w.days <> '')
    SELECT gp_code, issue_date, rule, severity, CASE rule WHEN 'heat' THEN 'Heat stress' WHEN 'cold' THEN 'Cold wave' WHEN 'frost' THEN 'Ground frost risk' WHEN 'wind' THEN 'Strong wind'
        ELSE 'Postpone fertiliser top-dressing' END AS title,
      CASE rule WHEN 'heat' THEN 'Maximum temperature up to ' || detail || ' °C is expected on ' || label || '.' WHEN 'cold' THEN 'Minimum temperature may fall to ' || detail || ' °C on ' || label || '.'
        WHEN 'frost' THEN 'Minimum temperature may fall to ' || detail || ' °C on ' || label || '; low-lying valley fields are most at risk.'
        WHEN 'wind' THEN 'Winds up to ' || detail || ' km/h are expected on ' || label || '.' ELSE detail || ' mm of rain is expected in the next 48 hours.' END AS text
    FROM lab WHERE rule IN ('heat', 'cold', 'frost', 'wind', 'fertiliser')""", "ufc"))
def bulletin_text(t):
    rows = evaluated(t).select("gp_code", "issue_date", F.explode_outer(Ms.rendered(CATALOG["en"])).alias("i")).select("gp_code", "issue_date", "i.rule", "i.severity", "i.title", "i.text")
    return rows.where(F.col("rule").isin("heat", "cold", "frost", "wind", "fertiliser"))


@query("bulletin_full", "R16 A34 J24")
def bulletin_full(t):
    b = unit_bulletins(t)
    return b.select("gp_code", "issue_date", F.length("text").alias("text_chars"), F.length("chat").alias("chat_chars"), F.length("voice").alias("voice_chars"), F.md5("text").alias("text_md5"))


_CROPNAMES = "MAP {" + ", ".join(f"'{k}': '{v['name']}'" for k, v in A.CROPS.items()) + "}"
_DISNAMES = "MAP {" + ", ".join(f"'{k}': '{v.split(' (')[0]}'" for k, v in CATALOG["en"]["disease_names"].items()) + "}"
_DISORD = "MAP {" + ", ".join(f"'{k}': {i}" for i, k in enumerate(A.DISEASES)) + "}"
_CROPORD = "MAP {" + ", ".join(f"'{k}': {i}" for i, k in enumerate(A.CROPS)) + "}"


@query("sms_packed", "F10 R16 T4", sql(f""", sq AS ({SEQ}), {WEATHER}, {CROP_CTES}, {DISEASE_CTES},
    irr AS (SELECT q.gp_code, q.issue_date, CAST(CAST(round_even(greatest(0.0, coalesce(ev.et, 0) * c.kc - 0.8 * q.r3), 0) AS INTEGER) AS VARCHAR) AS v, c.crop FROM sq q JOIN cs c USING (gp_code, issue_date) JOIN ev USING (gp_code, issue_date)),
    tp AS (SELECT gp_code, issue_date, list_position(f, list_max(f)) - 1 AS dix FROM (SELECT gp_code, issue_date, list_transform(ix, lambda i: CASE WHEN pm[i] >= 0.3 AND x[i] >= 32 AND h[i] >= 50 THEN pm[i] END) AS f FROM sq)),
    w AS (SELECT a.*, q.issue_date AS isd, q.ld, CASE WHEN rule = 'thunderstorm' THEN tp.dix ELSE TRY_CAST(split_part(days, ',', 1) AS INTEGER) END AS dix FROM weather a JOIN sq q USING (gp_code, issue_date) LEFT JOIN tp USING (gp_code, issue_date)),
    w2 AS (SELECT *, {_DAYNAME.format(d='(isd + ld[dix + 1])')} || ' ' || strftime(isd + ld[dix + 1], '%d/%m') AS day FROM w),
    it AS (SELECT gp_code, issue_date, severity, CASE rule WHEN 'heavy_rain' THEN 1 WHEN 'spray_window' THEN 5 WHEN 'heat' THEN 7 WHEN 'thunderstorm' THEN 9 WHEN 'wind' THEN 10 ELSE 8 END * 1000 AS pos,
        CASE rule WHEN 'heavy_rain' THEN 'HEAVY RAIN ' || detail || 'mm on ' || day || '. Drain fields, stop spraying & fertiliser.' WHEN 'heat' THEN 'Heat ' || detail || 'C ' || day || ', irrigate evening.'
          WHEN 'thunderstorm' THEN 'Thunderstorm risk ' || day || ', stay safe.' WHEN 'wind' THEN 'Wind ' || detail || 'km/h ' || day || ', no spraying.'
          WHEN 'spray_window' THEN 'Spray on ' || array_to_string(list_transform(string_split(days, ',')[1:3], lambda i: {_DAYNAME.format(d='(isd + ld[CAST(i AS INTEGER) + 1])')}), ',') || '.'
          ELSE 'Cold ' || detail || 'C ' || day || ', protect crops.' END AS txt FROM w2 WHERE rule IN ('heavy_rain', 'heat', 'cold', 'frost', 'thunderstorm', 'wind') OR (rule = 'spray_window' AND severity = 'green')
      UNION ALL SELECT c.gp_code, c.issue_date, c.severity, 3000 + ({_CROPORD})[c.crop], 'Dry 3 days, irrigate ~' || irr.v || 'mm.' FROM cropr c JOIN irr USING (gp_code, issue_date, crop) WHERE c.rule = 'dry_spell'
      UNION ALL SELECT gp_code, issue_date, severity, 13000 + ({_CROPORD})[crop] * 20 + ({_DISORD})[substr(rule, 9)], ({_CROPNAMES})[crop] || ' ' || ({_DISNAMES})[substr(rule, 9)] || ' risk.' FROM disease),
    li AS (SELECT q.gp_code, q.issue_date, q.r, coalesce(list(it.txt ORDER BY list_position(['red', 'orange', 'yellow', 'green'], it.severity), it.pos) FILTER (WHERE it.txt IS NOT NULL), []) AS l,
        coalesce(bool_or(it.severity <> 'green'), false) AS bad FROM sq q LEFT JOIN it USING (gp_code, issue_date) GROUP BY ALL),
    l2 AS (SELECT gp_code, issue_date, list_concat(['Unit ' || gp_code || ': '], CASE WHEN bad THEN l ELSE list_concat(['Weather normal next ' || len(r) || ' days. Rain '
        || CAST(round_even(list_sum(list_transform(r, lambda v: coalesce(v, 0))), 0) AS INTEGER) || 'mm. Continue farm work.'], l) END) AS l FROM li)
    SELECT gp_code, issue_date, trim(list_reduce(l, lambda acc, x: CASE WHEN length(acc) + length(x) + 1 > 160 THEN acc ELSE acc || x || ' ' END)) AS sms FROM l2""", "ufc"))
def sms_packed(t):
    text = Ms.sms(CATALOG["en"], F.initcap(F.concat(F.lit("UNIT "), "gp_code")))
    return evaluated(t).select("gp_code", "issue_date", text.alias("sms"))


MESSAGES = """m AS (SELECT gp_code, d AS issue_date, lang, 'Rain ' || CAST(rain_obs AS VARCHAR) || ' in ' || lang AS sms, repeat('Rain ' || CAST(rain_obs AS VARCHAR) || ' ', 12) AS chat,
      'Unit ' || gp_code || ' rain ' || CAST(rain_obs AS VARCHAR) AS voice FROM obs CROSS JOIN (SELECT unnest(['mr', 'hi', 'en']) AS lang)),
    sub AS (SELECT c_custkey AS subscriber_id, CAST(c_custkey % 150 AS VARCHAR) AS gp_code, (['mr', 'hi', 'en'])[CAST(c_custkey % 3 AS INTEGER) + 1] AS lang, (['sms', 'whatsapp', 'ivr'])[CAST(c_custkey % 4 % 3 AS INTEGER) + 1] AS channel FROM customer),
    pub AS (SELECT DISTINCT d AS issue_date FROM obs WHERE day(d) % 3 = 1),
    o AS (SELECT m.issue_date, s.subscriber_id, s.gp_code, s.channel, s.lang, CASE s.channel WHEN 'sms' THEN sms WHEN 'whatsapp' THEN chat ELSE voice END AS message FROM m JOIN sub s USING (gp_code, lang)
      WHERE m.issue_date IN (SELECT issue_date FROM pub))"""


def outbox(t):
    rain = F.concat(F.lit("Rain "), F.col("rain_obs").cast("string"))
    m = t.obs.select("gp_code", F.col("d").alias("issue_date"), F.explode(F.array(*[F.lit(x) for x in ("mr", "hi", "en")])).alias("lang"), "rain_obs")
    m = m.select("gp_code", "issue_date", "lang", F.concat(rain, F.lit(" in "), "lang").alias("sms"), F.repeat(F.concat(rain, F.lit(" ")), 12).alias("chat"),
                 F.concat(F.lit("Unit "), "gp_code", F.lit(" rain "), F.col("rain_obs").cast("string")).alias("voice"))
    k = F.col("c_custkey")
    subs = t.table("customer").select(k.alias("subscriber_id"), (k % 150).cast("string").alias("gp_code"),
                                      F.element_at(F.array(*[F.lit(x) for x in ("mr", "hi", "en")]), (k % 3).cast("int") + 1).alias("lang"),
                                      F.element_at(F.array(*[F.lit(x) for x in ("sms", "whatsapp", "ivr")]), (k % 4 % 3).cast("int") + 1).alias("channel"))
    published = t.obs.where(F.dayofmonth("d") % 3 == 1).select(F.col("d").alias("issue_date")).distinct()
    return Ms.fan_out(subs, m, published)


@query("message_fanout", "J24", sql(f""", {MESSAGES} SELECT *, CAST(length(message) AS INTEGER) AS chars, CAST(CASE WHEN length(message) <= 70 THEN 1 ELSE ceil(length(message) / 67) END AS INTEGER) AS segments FROM o""", "obs"))
def message_fanout(t):
    return outbox(t)


@query("outbox_totals", "E5 J24 A30", sql(f""", {MESSAGES} SELECT issue_date, channel, CAST(count(*) AS BIGINT) AS queued, CAST(sum(length(message)) AS BIGINT) AS chars,
    CAST(sum(CASE WHEN length(message) <= 70 THEN 1 ELSE ceil(length(message) / 67) END) AS BIGINT) AS segments FROM o GROUP BY 1, 2""", "obs"))
def outbox_totals(t):
    return Ms.channel_totals(outbox(t))


@query("severity_sorted_items", "T4", sql("""
    , it AS (SELECT user_id, list({'s': event_type, 'v': value, 'e': event_id} ORDER BY list_position(['error', 'purchase', 'signup', 'view', 'click'], event_type), event_id)[1:3] AS l
      FROM events_d GROUP BY 1)
    SELECT user_id, array_to_string(list_transform(l, lambda x: x.s || ':' || CAST(x.e AS VARCHAR)), ' ') AS top FROM it""", "events_d"))
def severity_sorted_items(t):
    rank = F.array_position(F.array(*[F.lit(x) for x in ("error", "purchase", "signup", "view", "click")]), F.col("event_type"))
    ranked = t.events_d.select("user_id", rank.alias("rank"), "event_id", "event_type")
    # three rank-limited rows per user reach the list, however many events one user has
    from pyspark.sql import Window
    first = ranked.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("rank", "event_id"))).where("n <= 3")
    items = F.array_sort(F.collect_list(F.struct("n", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("s"))))
    return first.groupBy("user_id").agg(F.array_join(F.transform(items, lambda x: x["s"]), " ").alias("top"))


# --- event logs ---------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'draft' END"
REVIEWS = f"""rv AS (SELECT d AS issue_date, CAST(user_id AS VARCHAR) AS gp_code, {_STATUS} AS status, event_id, props FROM
      (SELECT *, row_number() OVER (PARTITION BY e.user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn, CAST(ts AS DATE) AS d FROM events e) WHERE rn = 1)"""


def reviews(t):
    ev = t.table("events").select(F.to_date("ts").alias("issue_date"), F.col("user_id").cast("string").alias("gp_code"), "ts", "event_id", F.expr(_STATUS).alias("status"), "props")
    return Lg.latest(ev, ["issue_date", "gp_code"], ["ts", "event_id"])


@query("latest_review", "E1", f"WITH {REVIEWS} SELECT issue_date, gp_code, status, event_id FROM rv")
def latest_review(t):
    return reviews(t).select("issue_date", "gp_code", "status", "event_id")


@query("publish_status", "E2", sql(f"""
    , pu AS (SELECT CAST(ts AS DATE) AS issue_date, max(event_id) AS by_event FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT d AS issue_date, CASE WHEN pu.issue_date IS NULL THEN 'draft' ELSE 'published' END AS status, by_event FROM (SELECT DISTINCT d FROM obs) LEFT JOIN pu ON pu.issue_date = d""", "obs"))
def publish_status(t):
    pub = t.events_d.where("event_type = 'purchase'").groupBy(F.col("d").alias("issue_date")).agg(F.max("event_id").alias("by_event"))
    pub = pub.withColumn("status", F.lit("published"))
    return Lg.with_default(t.obs.select(F.col("d").alias("issue_date")).distinct(), pub, ["issue_date"], "status", "draft").select("issue_date", "status", "by_event")


@query("insert_ignore", "E3 Q2", """
    WITH b AS (SELECT user_id, event_type, day(ts) % 10 AS slot, min(event_id) AS event_id, CAST(ts AS DATE) < DATE '2024-01-15' AS old FROM events GROUP BY 1, 2, 3, 5)
    SELECT n.user_id, n.event_type, CAST(n.slot AS INTEGER) AS slot, n.event_id FROM b n WHERE NOT old AND NOT EXISTS (SELECT 1 FROM b o WHERE o.old AND o.user_id = n.user_id AND o.event_type = n.event_type AND o.slot = n.slot)""")
def insert_ignore(t):
    ev = t.events_d.select("user_id", "event_type", (F.dayofmonth("d") % 10).alias("slot"), "event_id", "d")
    out = Lg.insert_ignore(ev.where("d < '2024-01-15'"), ev.where("d >= '2024-01-15'"), ["user_id", "event_type", "slot"], ["event_id"])
    return out.select("user_id", "event_type", "slot", "event_id")


@query("audit_page", "E4 T3", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def audit_page(t):
    return Lg.newest_page(t.table("events").select("event_id", "user_id", "event_type"), ["event_id"], 200)


@query("review_overlay", "J21 F13", sql(f"""
    , {REVIEWS} SELECT o.gp_code, o.d AS issue_date, CASE WHEN rv.status IN ('approved', 'rejected') THEN coalesce(json_extract_string(rv.props, '$.k'), CAST(o.rain_obs AS VARCHAR)) ELSE CAST(o.rain_obs AS VARCHAR) END AS sms,
      CASE WHEN rv.status IN ('approved', 'rejected') THEN rv.status ELSE 'auto' END AS status FROM obs o LEFT JOIN rv ON rv.gp_code = o.gp_code AND rv.issue_date = o.d""", "obs"))
def review_overlay(t):
    texts = t.obs.select("gp_code", F.col("d").alias("issue_date"), F.col("rain_obs").cast("string").alias("sms"))
    return Lg.overlay_reviews(texts, reviews(t), ["gp_code", "issue_date"], {"sms": F.get_json_object("props", "$.k")}).select("gp_code", "issue_date", "sms", "status")
