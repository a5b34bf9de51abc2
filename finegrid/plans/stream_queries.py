"""Streams over the event table, each drained and compared with its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from finegrid.plans.bindings import sql
from finegrid.plans.registry import R, query, r4
from finegrid.streaming import streams as St


BATCHES = 6
_FILES: dict[tuple[str, str], str] = {}


def event_files(t):
    """The event table as files in event order, made once per application; streams take a file per micro-batch."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _FILES:
        e = t.table("events")
        _FILES[key] = St.files_in_order(e, St.slices(e, "ts", BATCHES), "event-files")
    return _FILES[key]


def closed_events(t):
    """The event files and one more with a forecast and an observation of nobody, so late that all that waits comes out."""
    key = t.spark.sparkContext.applicationId, t.sf_dir + "#closed"
    if key not in _FILES:
        e = t.table("events")
        # users of their own, as a null user would be filtered out before the watermark sees the row
        last = e.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 9 days")).alias("ts"), F.inline(F.expr("array(named_struct('user_id', -1L, 'event_type', 'view'), named_struct('user_id', -2L, 'event_type', 'click'))")))
        rows = e.withColumn("n", St.slices(e, "ts", BATCHES)).unionByName(last.withColumn("n", F.lit(BATCHES)), allowMissingColumns=True)
        _FILES[key] = St.files_in_order(rows, F.col("n"), "closed-event-files")
    return St.read_stream(t.spark, _FILES[key], "*.parquet", t.table("events").schema, "ts", files_per_trigger=1)


def events(t):
    schema = t.table("events").schema
    return St.read_stream(t.spark, event_files(t), "*.parquet", schema, "ts", files_per_trigger=1).withColumn("block_lgd", (F.col("user_id") % 5).cast("int"))


# A window that ends after the newest event minus the delay is still open when the stream is drained.
_CLOSED = "CAST({end} AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL {delay}"


@query("stream_daily", "X1 A3", sql(f"""
    , s AS (SELECT CAST(user_id % 5 AS INTEGER) AS block_lgd, d, value FROM events_d)
    SELECT block_lgd, d, CASE WHEN count(*) >= 60 THEN {R('sum(value)')} END AS total, CASE WHEN count(*) >= 60 THEN max(value) END AS highest, CASE WHEN count(*) >= 60 THEN min(value) END AS lowest,
      CAST(count(*) AS BIGINT) AS n FROM s WHERE {_CLOSED.format(end='d + 1', delay='1 HOUR')} GROUP BY 1, 2""", "events_d"))
def stream_daily(t):
    out = St.run_available(St.daily(events(t), ["block_lgd"], "ts", "value", "1 hour", 60), name="daily")
    return out.select("block_lgd", "d", r4("total").alias("total"), "highest", "lowest", "n")


@query("stream_sliding", "X2 A35", sql(f"""
    , e AS (SELECT CAST(user_id % 5 AS INTEGER) AS block_lgd, ts, value, time_bucket(INTERVAL '1 hour', ts) AS h FROM events),
    w AS (SELECT block_lgd, h - k * INTERVAL 1 HOUR AS start, value FROM e CROSS JOIN (SELECT unnest(range(0, 6)) AS k))
    SELECT block_lgd, start, {R('sum(value)')} AS total, max(value) AS max_step, CAST(count(*) AS BIGINT) AS steps FROM w WHERE {_CLOSED.format(end='start + INTERVAL 6 HOURS', delay='1 HOUR')} GROUP BY 1, 2""", "leads"))
def stream_sliding(t):
    out = St.run_available(St.sliding_total(events(t), ["block_lgd"], "ts", "value", "1 hour", "6 hours", "1 hour"), name="sliding")
    return out.select("block_lgd", F.col("start").cast("timestamp_ntz").alias("start"), r4("total").alias("total"), "max_step", "steps")


@query("stream_sessions", "X6", sql(f"""
    , e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 24 HOURS THEN 0 ELSE 1 END AS new FROM events WHERE value >= 20 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
    SELECT user_id, min(ts) AS start, {R('sum(value)')} AS total, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, s HAVING {_CLOSED.format(end='max(ts) + INTERVAL 24 HOURS', delay='1 HOUR').replace('FROM events', 'FROM events WHERE value >= 20')}""", "leads"))
def stream_sessions(t):
    out = St.run_available(St.sessions(events(t), ["user_id"], "ts", "value", 20.0, "24 hours", "1 hour"), name="sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), r4("total").alias("total"), "n")


@query("stream_dedupe", "X4 E3", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events")
def stream_dedupe(t):
    src = events(t).withColumn("d", F.to_date("ts"))
    return St.run_available(St.first_of_each(src, ["user_id", "event_type", "d"], "ts", "2 days"), name="dedupe").select("user_id", "event_type", "d")


@query("stream_latest", "X3 S19", """
    SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_latest(t):
    return St.run_latest(events(t).select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("stream_streak", "X5 W6", sql("""
    , m AS (SELECT gp_code, d, rain_obs < 80 AS ok, d - lag(d) OVER w AS gap, coalesce(lag(rain_obs) OVER w < 80, false) AS before FROM obs WINDOW w AS (PARTITION BY gp_code ORDER BY d)),
    g AS (SELECT *, sum(CASE WHEN ok AND before AND gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY gp_code ORDER BY d) AS s FROM m)
    SELECT gp_code, d, CAST(CASE WHEN ok THEN row_number() OVER (PARTITION BY gp_code, s ORDER BY d) ELSE 0 END AS INTEGER) AS run FROM g""", "obs"))
def stream_streak(t):
    # days come out of order, up to two days late; the last file is a day of nobody that brings out all that waits
    days = t.obs.select("gp_code", "d", "rain_obs")
    mixed = days.withColumn("at", F.date_add("d", (F.xxhash64("gp_code", "d") % 3).cast("int")))
    last = days.agg(F.date_add(F.max("d"), 9).alias("d"))
    rows = mixed.withColumn("n", St.slices(mixed, "at", BATCHES)).unionByName(last.withColumn("n", F.lit(BATCHES)), allowMissingColumns=True)
    path = St.files_in_order(rows.select("gp_code", "d", "rain_obs", "n"), F.col("n"), "days")
    src = St.read_stream(t.spark, path, "*.parquet", days.schema, files_per_trigger=1)
    out = St.run_available(St.streaks(src, "gp_code", "d", F.col("rain_obs") < 80, "3 days"), name="streaks", rocks=True)
    return out.select(F.col("key").alias("gp_code"), F.col("day").alias("d"), "run")


@query("stream_enrich", "X7 J1", sql(f"""
    SELECT e.event_id, u.block_lgd, u.elev, {R('e.value * u.area_km2')} AS volume FROM events e LEFT JOIN unit u ON u.user_id = e.user_id""", "unit"))
def stream_enrich(t):
    units = t.unit.select("user_id", "elev", "area_km2")
    out = St.run_available(St.with_units(events(t), units, "user_id"), name="enrich")
    return out.select("event_id", "block_lgd", "elev", r4(F.col("value") * F.col("area_km2")).alias("volume"))


@query("stream_verify", "X7 J2", """
    SELECT f.event_id AS forecast_id, o.event_id AS observation_id, round(o.value - f.value, 2) AS err FROM events f LEFT JOIN events o ON o.user_id = f.user_id AND o.ts >= f.ts AND o.ts <= f.ts + INTERVAL 1 DAY AND o.event_type = 'click'
    WHERE f.event_type = 'view'""")
def stream_verify(t):
    f = closed_events(t).where("event_type = 'view'").select("user_id", F.col("ts").alias("issued"), F.col("event_id").alias("forecast_id"), F.col("value").alias("fv"))
    o = closed_events(t).where("event_type = 'click'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("observation_id"), F.col("value").alias("ov"))
    j = St.verify_live(f, o, "user_id", "issued", "seen", "1 hour", "1 day").select("forecast_id", "observation_id", (F.col("ov") - F.col("fv")).alias("err"))
    return St.run_available(j, name="verify").select("forecast_id", "observation_id", F.round("err", 2).alias("err"))


@query("stream_late", "X8 U2", sql("""
    , f AS (SELECT user_id, d, event_type = 'purchase' AS is_final, max(value) AS v FROM events_d WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2, 3)
    SELECT user_id, d, coalesce(max(v) FILTER (WHERE is_final), max(v)) AS value, bool_or(is_final) AS is_final FROM f GROUP BY 1, 2""", "events_d"))
def stream_late(t):
    src = events(t).where("event_type in ('purchase', 'view')").select("user_id", F.to_date("ts").alias("d"), (F.col("event_type") == "purchase").alias("is_final"), "value")
    return St.run_latest(src, ["user_id", "d"], ["is_final", "value"], name="late").select("user_id", "d", "value", "is_final")


@query("stream_freshness", "X9", "SELECT CAST(max(ts) AS DATE) AS newest, CAST(DATE '2024-02-05' - CAST(max(ts) AS DATE) AS INTEGER) AS age_days, DATE '2024-02-05' - CAST(max(ts) AS DATE) > 5 AS refresh FROM events")
def stream_freshness(t):
    newest = St.run_available(St.newest_day(events(t).select(F.to_date("ts").alias("d")), "d"), mode="complete", name="fresh")
    return St.freshness(newest, F.to_date(F.lit("2024-02-05")), 5)
