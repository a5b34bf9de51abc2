"""Views that give the test tables the shapes the operators work on.

The tables hold no weather, so each view is plain arithmetic over them.  ``Tables``
builds the views with the DataFrame API; ``CTE`` holds the same definitions as SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finegrid.functions.columns import clip
from finegrid.operators.panel import expand_to_units, persistence_forecast
from finegrid.plans.registry import R, r4

LEADS = [1, 2, 3, 4, 5]


class Tables:
    """Lazy views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events_d(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", F.to_date("ts").alias("d"), "ts", "event_type", "value")

    @cached_property
    def unit(self) -> DataFrame:
        u = F.col("user_id")
        return self.table("events").select("user_id").distinct().select(
            "user_id", u.cast("string").alias("gp_code"), (u % 5).cast("int").alias("block_lgd"),
            (18 + (u % 37).cast("double") * 0.03).alias("latitude"),
            (73.3 + (u % 53).cast("double") * 0.03).alias("longitude"),
            (1 + u % 7).cast("double").alias("area_km2"), (500 + (u * 37) % 900).cast("double").alias("elev"))

    @cached_property
    def obs(self) -> DataFrame:
        """Daily observation per unit; days without events are missing."""
        u = F.col("user_id")
        return (self.events_d.groupBy("user_id", "d").agg(F.round(F.sum("value"), 2).alias("rain_obs"))
                .select("user_id", u.cast("string").alias("gp_code"), (u % 5).cast("int").alias("block_lgd"), "d", "rain_obs"))

    @cached_property
    def pday(self) -> DataFrame:
        """Daily mean per parent."""
        return self.obs.groupBy("block_lgd", "d").agg(r4(F.avg("rain_obs")).alias("v"))

    @cached_property
    def fc(self) -> DataFrame:
        """Persistence forecast panel of the parents."""
        return persistence_forecast(self.pday, LEADS, "v", "fc_rain")

    @cached_property
    def panel(self) -> DataFrame:
        """One row per unit, issue and lead with forecast and observation."""
        obs = self.obs.select("gp_code", F.col("d").alias("valid_date"), "rain_obs")
        return expand_to_units(self.fc, self.unit).join(obs, ["gp_code", "valid_date"], "left")

    @cached_property
    def scored(self) -> DataFrame:
        """Panel with four methods: the model stand-in, its parts and two baselines."""
        p = self.panel.withColumn("pred", r4(F.col("fc_rain") * (0.8 + (F.col("user_id") % 9).cast("double") / 20)))
        return p.withColumn("unseen_gp", F.col("user_id") % 5 + F.col("user_id") % 4 == 3)

    @cached_property
    def vars(self) -> DataFrame:
        """Five variables per unit and day, one per event type."""
        names = {"click": "rain", "view": "tmax", "error": "tmin", "signup": "rh", "purchase": "wind"}
        aggs = [F.round(F.sum(F.when(F.col("event_type") == e, F.col("value"))), 2).alias(v) for e, v in names.items()]
        u = F.col("user_id")
        return (self.events_d.groupBy("user_id", "d").agg(*aggs)
                .withColumn("gp_code", u.cast("string")).withColumn("block_lgd", (u % 5).cast("int")))

    @cached_property
    def wx(self) -> DataFrame:
        """Plausible daily weather per parent."""
        def mean(e):
            return F.avg(F.when(F.col("event_type") == e, F.col("value")))

        return (self.events_d.withColumn("block_lgd", (F.col("user_id") % 5).cast("int")).groupBy("block_lgd", "d").agg(
            r4(F.greatest(F.lit(0.0), (mean("click") - 40) * 1.5)).alias("rain"),
            r4(24 + mean("view") / 3).alias("tmax"), r4(mean("error") / 3).alias("tmin"),
            r4(F.least(F.lit(100.0), mean("signup") * 1.5)).alias("rh"), r4(mean("purchase") / 2).alias("wind")))

    @cached_property
    def ufc(self) -> DataFrame:
        """Unit forecasts for five lead days with rain probabilities and unit attributes."""
        lead = self.wx.select("*", F.explode(F.array(*[F.lit(k) for k in LEADS])).alias("lead_day"))
        lead = lead.withColumn("issue_date", F.date_sub("d", F.col("lead_day")))
        u = F.col("user_id")
        df = expand_to_units(lead.drop("d"), self.unit)
        rain = r4(F.col("rain") * (0.5 + (u % 7).cast("double") / 4))
        df = df.select("gp_code", "user_id", "block_lgd", "latitude", "elev", "issue_date", "lead_day",
                       rain.alias("rain_pred"),
                       r4(F.col("tmax") - (F.col("elev") - 700) * 0.0065).alias("tmax_pred"),
                       r4(F.col("tmin") - (F.col("elev") - 700) * 0.0065).alias("tmin_pred"),
                       clip(F.col("rh") + (u % 11).cast("double"), 0, 100).alias("rh_pred"),
                       r4(F.col("wind") * (0.6 + (u % 5).cast("double") / 5)).alias("wind_pred"),
                       (u % 8).cast("double").alias("slope_mean"), (20 + (u % 6) * 8).cast("double").alias("soil_clay_pct"),
                       ((u % 9) * 8 - 40).cast("double").alias("tpi_2km"))
        for mm, name in ((2.5, "2p5"), (15.6, "15p6"), (64.5, "64p5")):
            df = df.withColumn(f"rain_p_ge_{name}", r4(F.col("rain_pred") / (F.col("rain_pred") + mm)))
        return df

    @cached_property
    def raster(self) -> DataFrame:
        """Rasters of 8 x 8 cells, about one in eleven cells without data."""
        cells = self.table("embeddings").select(F.col("vec_id").alias("t"), F.col("label").alias("zone"),
                                                F.posexplode("embedding").alias("pos", "e"))
        known = (F.col("t") + F.col("pos")) % 11 != 3
        return cells.select("t", "zone", F.floor(F.col("pos") / 8).cast("int").alias("i"), (F.col("pos") % 8).alias("j"),
                            F.when(known, F.col("e").cast("double")).alias("v"))


# name -> (views it builds on, SQL)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "events_d": ((), "SELECT event_id, user_id, CAST(ts AS DATE) AS d, ts, event_type, value FROM events"),
    "unit": ((), """SELECT DISTINCT user_id, CAST(user_id AS VARCHAR) AS gp_code, CAST(user_id % 5 AS INTEGER) AS block_lgd,
        18 + CAST(user_id % 37 AS DOUBLE) * 0.03 AS latitude, 73.3 + CAST(user_id % 53 AS DOUBLE) * 0.03 AS longitude,
        CAST(1 + user_id % 7 AS DOUBLE) AS area_km2, CAST(500 + (user_id * 37) % 900 AS DOUBLE) AS elev FROM events"""),
    "obs": (("events_d",), """SELECT user_id, CAST(user_id AS VARCHAR) AS gp_code, CAST(user_id % 5 AS INTEGER) AS block_lgd,
        d, round(sum(value), 2) AS rain_obs FROM events_d GROUP BY user_id, d"""),
    "pday": (("obs",), f"SELECT block_lgd, d, {R('avg(rain_obs)')} AS v FROM obs GROUP BY block_lgd, d"),
    "leads": ((), "SELECT unnest([1, 2, 3, 4, 5]) AS lead_day"),
    "fc": (("pday", "leads"), """SELECT block_lgd, d AS issue_date, CAST(d + lead_day AS DATE) AS valid_date, lead_day,
        v AS fc_rain FROM pday CROSS JOIN leads"""),
    "panel": (("fc", "unit", "obs"), """SELECT u.user_id, u.gp_code, u.block_lgd, u.latitude, u.longitude, u.area_km2, u.elev,
        f.issue_date, f.valid_date, f.lead_day, f.fc_rain, o.rain_obs
        FROM fc f JOIN unit u ON u.block_lgd = f.block_lgd LEFT JOIN obs o ON o.gp_code = u.gp_code AND o.d = f.valid_date"""),
    "scored": (("panel",), f"""SELECT *, {R('fc_rain * (0.8 + CAST(user_id % 9 AS DOUBLE) / 20)')} AS pred,
        user_id % 5 + user_id % 4 = 3 AS unseen_gp FROM panel"""),
    "vars": (("events_d",), """SELECT user_id, CAST(user_id AS VARCHAR) AS gp_code, CAST(user_id % 5 AS INTEGER) AS block_lgd, d,
        round(sum(value) FILTER (WHERE event_type = 'click'), 2) AS rain,
        round(sum(value) FILTER (WHERE event_type = 'view'), 2) AS tmax,
        round(sum(value) FILTER (WHERE event_type = 'error'), 2) AS tmin,
        round(sum(value) FILTER (WHERE event_type = 'signup'), 2) AS rh,
        round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS wind
        FROM events_d GROUP BY user_id, d"""),
    "wx_raw": (("events_d",), """SELECT CAST(user_id % 5 AS INTEGER) AS block_lgd, d,
        avg(value) FILTER (WHERE event_type = 'click') AS c, avg(value) FILTER (WHERE event_type = 'view') AS vw,
        avg(value) FILTER (WHERE event_type = 'error') AS er, avg(value) FILTER (WHERE event_type = 'signup') AS su,
        avg(value) FILTER (WHERE event_type = 'purchase') AS pu FROM events_d GROUP BY 1, 2"""),
    "wx": (("wx_raw",), f"""SELECT block_lgd, d, {R('greatest(0.0, (c - 40) * 1.5)')} AS rain, {R('24 + vw / 3')} AS tmax,
        {R('er / 3')} AS tmin, {R('least(100.0, su * 1.5)')} AS rh, {R('pu / 2')} AS wind FROM wx_raw"""),
    "ufc_raw": (("wx", "unit", "leads"), f"""SELECT u.gp_code, u.user_id, u.block_lgd, u.latitude, u.elev,
        CAST(w.d - l.lead_day AS DATE) AS issue_date, l.lead_day,
        {R('w.rain * (0.5 + CAST(u.user_id % 7 AS DOUBLE) / 4)')} AS rain_pred,
        {R('w.tmax - (u.elev - 700) * 0.0065')} AS tmax_pred, {R('w.tmin - (u.elev - 700) * 0.0065')} AS tmin_pred,
        CASE WHEN w.rh IS NOT NULL THEN least(100.0, greatest(0.0, w.rh + CAST(u.user_id % 11 AS DOUBLE))) END AS rh_pred,
        {R('w.wind * (0.6 + CAST(u.user_id % 5 AS DOUBLE) / 5)')} AS wind_pred,
        CAST(u.user_id % 8 AS DOUBLE) AS slope_mean, CAST(20 + (u.user_id % 6) * 8 AS DOUBLE) AS soil_clay_pct,
        CAST((u.user_id % 9) * 8 - 40 AS DOUBLE) AS tpi_2km
        FROM wx w CROSS JOIN leads l JOIN unit u ON u.block_lgd = w.block_lgd"""),
    "ufc": (("ufc_raw",), f"""SELECT *, {R('rain_pred / (rain_pred + 2.5)')} AS rain_p_ge_2p5,
        {R('rain_pred / (rain_pred + 15.6)')} AS rain_p_ge_15p6, {R('rain_pred / (rain_pred + 64.5)')} AS rain_p_ge_64p5
        FROM ufc_raw"""),
    "raster": ((), """SELECT t, zone, CAST(pos // 8 AS INTEGER) AS i, CAST(pos % 8 AS INTEGER) AS j,
        CASE WHEN (t + pos) % 11 <> 3 THEN CAST(e AS DOUBLE) END AS v
        FROM (SELECT vec_id AS t, label AS zone, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings)"""),
}


def sql(body: str, *views: str, **local: str) -> str:
    """``body`` with the named views, what they build on, and ``local`` views in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTE[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for v in views:
        visit(v)
    parts = [f"{n} AS ({CTE[n][1]})" for n in order] + [f"{n} AS ({s})" for n, s in local.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
