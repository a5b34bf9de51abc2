"""Queries that write tables below the shared folder and read them back, and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from finegrid.operators import geometry as G
from finegrid.plans.bindings import LEADS, sql
from finegrid.plans.registry import R, query, r4
from finegrid.plans.space_queries import SQUARES, squares
from finegrid.session import scratch_path
from finegrid.sources import features as Ft
from finegrid.sources import geoparquet as Gq
from finegrid.sources import gridfile as Gf
from finegrid.sources import lineage as Ln
from finegrid.sources import tabular as Tb


@query("partitioned_write", "S2 S6 T1", sql("SELECT block_lgd, lead_day, valid_date, fc_rain FROM fc WHERE issue_date = DATE '2024-01-12'", "fc"))
def partitioned_write(t):
    path = scratch_path(t.spark, "fc")
    Tb.write_partitions(t.fc, path, ["issue_date"], ["block_lgd", "lead_day"])
    return Tb.read_forecasts(t.spark, "archive", path, "2024-01-12").select("block_lgd", "lead_day", "valid_date", "fc_rain")


@query("compact_nodes", "S3", sql(f"SELECT block_lgd, CAST(count(*) AS BIGINT) AS n, {R('sum(rain_obs)')} AS total, CAST(1 AS BIGINT) AS origins FROM obs GROUP BY 1", "obs"))
def compact_nodes(t):
    small, large = scratch_path(t.spark, "nodes"), scratch_path(t.spark, "compact")
    t.obs.select("gp_code", "block_lgd", "d", "rain_obs").repartition(8, "d").write.parquet(small)
    Tb.compact(t.spark, small, large, ["block_lgd", "gp_code", "d"], 4)
    back = Tb.read_with_origin(t.spark, large)
    return back.groupBy("block_lgd").agg(F.count("*").alias("n"), r4(F.sum("rain_obs")).alias("total"), F.least(F.lit(1), F.count_distinct("origin")).cast("long").alias("origins"))


@query("csv_stations", "S4 Q7 Q8 J10", sql(f"""
    SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(d - 1 AS DATE) AS valid_date, CASE WHEN user_id % 9 <> 4 AND rain_obs <= 600 THEN rain_obs END AS rain_mm,
      CASE WHEN user_id % 2 = 0 THEN round(rain_obs + 1.5, 2) END AS tmax_c FROM obs""", "obs"))
def csv_stations(t):
    path = scratch_path(t.spark, "stations")
    base = t.obs.join(t.unit.select("gp_code", "latitude", "longitude"), "gp_code").select(
        F.col("user_id").alias("Station_ID"), "latitude", "longitude", F.col("d").alias(" Date"), "rain_obs", "user_id")
    rain = F.when(F.col("user_id") % 9 == 4, F.lit("n/a")).otherwise(F.col("rain_obs").cast("string"))
    even = base.where("user_id % 2 = 0").withColumn("RAIN_MM", rain).withColumn("Tmax_C", F.round(F.col("rain_obs") + 1.5, 2)).drop("rain_obs", "user_id")
    odd = base.where("user_id % 2 = 1").withColumn("rain_mm", rain).drop("rain_obs", "user_id")
    even.write.csv(f"{path}/a", header=True)
    odd.write.csv(f"{path}/b", header=True)
    df = Tb.read_stations(t.spark, [f"{path}/a", f"{path}/b"], morning_day=True)
    return df.select("station_id", "valid_date", "rain_mm", "tmax_c")


@query("forecast_csv", "S5 S6 Q1 Q2 Q3 Q4 Q5 Q6 Q7", sql(f"""
    SELECT block_lgd, lead_day, CAST(DATE '2024-01-20' + lead_day AS DATE) AS valid_date, rain, tmax FROM (
      SELECT CAST(block_lgd AS VARCHAR) AS block_lgd, lead_day, {R('avg(rain)')} AS rain, {R('avg(tmax)')} AS tmax FROM wx CROSS JOIN leads GROUP BY 1, 2)""", "wx", "leads"))
def forecast_csv(t):
    from finegrid.operators.quality import require_forecast
    path = scratch_path(t.spark, "official")
    mean = t.wx.groupBy("block_lgd").agg(*[r4(F.avg(c)).alias(c) for c in ("rain", "tmax", "tmin", "rh", "wind")])
    sheet = mean.withColumn("tmin", F.least("tmin", F.lit(39.0))).withColumn("lead_day", F.explode(F.array(*[F.lit(k) for k in LEADS])))
    sheet.withColumn("tmax", F.col("tmax")).write.csv(path, header=True)
    df = Tb.read_forecasts(t.spark, "csv", path, "2024-01-20")
    parents = t.pday.select(F.col("block_lgd").cast("string").alias("block_lgd")).distinct()
    return require_forecast(df, parents, LEADS).select("block_lgd", "lead_day", "valid_date", "rain", "tmax")


@query("extract_filtered", "S13 S1", """
    SELECT coalesce(CAST(c_custkey AS VARCHAR), c_name) AS gp_code, c_name AS gp_name, c_acctbal FROM customer WHERE c_nationkey = 7""")
def extract_filtered(t):
    src = t.table("customer").withColumn("gp_code_old", F.col("c_name")).withColumn("gpcode", F.col("c_custkey").cast("string"))
    return Tb.extract(src, F.col("c_nationkey") == 7, {"gp_code": ["gpcode", "gp_code_old"], "gp_name": ["c_name", "gpname"]}, ["c_acctbal"])


@query("json_hourly", "S14 F13 Q7", sql(f"""
    , h AS (SELECT CAST(user_id % 5 AS INTEGER) AS node, date_trunc('hour', ts) AS time, round(sum(value), 2) AS s FROM events GROUP BY 1, 2)
    SELECT node, time, lead_day, CASE WHEN hour(time) <> 3 THEN {R('s * lead_day')} END AS rain, {R('s')} AS temp FROM h CROSS JOIN (SELECT unnest([1, 2]) AS lead_day)""", "unit"))
def json_hourly(t):
    h = t.events_d.groupBy((F.col("user_id") % 5).cast("int").alias("node"), F.date_trunc("hour", "ts").alias("time")).agg(F.round(F.sum("value"), 2).alias("s"))
    h = h.withColumn("d", F.to_date("time")).withColumn("bad", F.hour("time") == 3)

    def arr(expr):
        return F.transform(F.col("a"), expr)

    def unreadable_or(k):
        return lambda x: F.when(x["bad"], "null?").otherwise((x["s"] * k).cast("string"))

    day = h.groupBy("node", "d").agg(F.array_sort(F.collect_list(F.struct("time", "s", "bad"))).alias("a"))
    cols = {"time": arr(lambda x: F.date_format(x["time"], "yyyy-MM-dd'T'HH:mm"))}
    for k in (1, 2):
        cols[f"precipitation_previous_day{k}"] = arr(unreadable_or(k))
        cols[f"temperature_2m_previous_day{k}"] = arr(lambda x: x["s"].cast("string"))
    body = F.to_json(F.struct(F.struct(*[c.alias(n) for n, c in cols.items()]).alias("hourly")))
    out = Tb.hourly_rows(day.select("node", body.alias("body")), ["node"], "body", [1, 2])
    return out.select("node", "time", "lead_day", r4("rain").alias("rain"), r4("temp").alias("temp"))


@query("geojson_features", "S15 S16 F17", sql(f"""
    SELECT gp_code, round(area_km2, 2) AS area_km2, {R('radians(e - w) * 6371.0 * (sin(radians(n)) - sin(radians(s))) * 6371.0')} AS km2 FROM sq""", "unit", sq=SQUARES))
def geojson_features(t):
    path = scratch_path(t.spark, "features")
    Ft.feature_lines(squares(t), "ring", ["gp_code", "area_km2"], digits=7).write.text(path)
    df = Ft.read_features(t.spark, path, "gp_code:string,area_km2:double")
    return df.select("gp_code", "area_km2", r4(G.area_km2(df, "shape")).alias("km2"))


@query("geojson_collection", "S15 S16 F17", sql(f"""
    SELECT gp_code, round(area_km2, 2) AS area_km2, 'a "{{[' || gp_code || ']' AS note, {R('radians(e - w) * 6371.0 * (sin(radians(n)) - sin(radians(s))) * 6371.0')} AS km2 FROM sq""", "unit", sq=SQUARES))
def geojson_collection(t):
    # documents of up to 40 features, several to a file, read by ranges that cut through features and texts
    path = scratch_path(t.spark, "collections")
    noted = squares(t).withColumn("note", F.concat(F.lit('a "{['), "gp_code", F.lit("]")))
    lines = Ft.feature_lines(noted.withColumn("doc", F.floor(F.col("gp_code").cast("long") / 40)), "ring", ["gp_code", "area_km2", "note", "doc"], digits=7)
    docs = lines.groupBy(F.get_json_object("value", "$.properties.doc")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("all"))
    docs.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("value")).write.text(path)
    df = Ft.read_features(t.spark, path, "gp_code:string,area_km2:double,note:string", collection=True, range_bytes=1 << 16)
    return df.select("gp_code", "area_km2", "note", r4(G.area_km2(df, "shape")).alias("km2"))


@query("shapes_in_box", "S15 S16 F17", sql(f"""
    SELECT gp_code, {R('radians(e - w) * 6371.0 * (sin(radians(n)) - sin(radians(s))) * 6371.0')} AS km2 FROM sq WHERE w <= 74.2 AND e >= 73.6 AND s <= 18.7 AND n >= 18.2""", "unit", sq=SQUARES))
def shapes_in_box(t):
    # to well-known binary in Parquet and back, pruned by the boxes
    path = scratch_path(t.spark, "shapes")
    Gq.write_shapes(squares(t).select("gp_code", "ring"), path, "ring")
    df = Gq.read_shapes(t.spark, path, box=(73.6, 18.2, 74.2, 18.7))
    return df.select("gp_code", r4(G.area_km2(df, "shape")).alias("km2"))


TEST_LAYOUT = Gf.GridLayout(rows=8, cols=8, ymin=18.0, xmin=73.0, res=0.25, missing=-999.0)
DAYS = 50


@query("grid_file_roundtrip", "S10 S11 D3 S12", sql(f"""
    SELECT 'g' || CAST(t // 50 AS VARCHAR) || '.grd' AS file, CAST(t % 50 AS INTEGER) AS day, i, j, {R('CAST(v AS FLOAT)')} AS value FROM raster""", "raster"))
def grid_file_roundtrip(t):
    path = scratch_path(t.spark, "grids")
    cells = t.raster.select(F.concat(F.lit("g"), F.floor(F.col("t") / DAYS).cast("string"), F.lit(".grd")).alias("file"), (F.col("t") % DAYS).cast("int").alias("day"), "i", "j", F.col("v").alias("value"))
    Gf.save_files(Gf.pack_grid_files(cells, TEST_LAYOUT, lambda name: DAYS), path).count()
    out = Gf.read_grid_files(t.spark, path, TEST_LAYOUT, lambda name: DAYS)
    return out.select("file", "day", "i", "j", r4("value").alias("value"))


@query("fingerprint", "S20")
def fingerprint(t):
    entries = None
    for name in ("events", "lineitem"):
        e = Ln.dataset_entry(Ln.file_digests(t.spark, f"{t.sf_dir}/{name}.parquet"), name, "test tables", "none", "fingerprint")
        entries = e if entries is None else Ln.register(entries, e)
    return entries.select("dataset", "bytes", "files", "sha256")


_ROW_MD5 = "md5(l_orderkey || '|' || l_linenumber || '|' || coalesce(CAST(l_extendedprice AS VARCHAR), ''))"


@query("row_fingerprint", "S20 A11", f"""
    SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr({_ROW_MD5}, 1, 15) AS HUGEINT)) AS VARCHAR) AS first_sum,
      CAST(sum(CAST('0x' || substr({_ROW_MD5}, 18, 15) AS HUGEINT)) AS VARCHAR) AS last_sum FROM lineitem""")
def row_fingerprint(t):
    return Ln.row_fingerprint(t.table("lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("strict_json", "S7", sql("""
    , x AS (SELECT gp_code, d, CASE WHEN user_id % 3 <> 0 THEN rain_obs END AS v FROM obs)
    SELECT '{"gp_code":"' || gp_code || '","d":"' || CAST(d AS VARCHAR) || '","v":' || coalesce(CAST(v AS VARCHAR), 'null') || '}' AS json FROM x""", "obs"))
def strict_json(t):
    u = F.col("user_id") % 3
    bad = F.when(u == 0, F.when(F.col("user_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("rain_obs"))
    return Tb.strict_json(t.obs.select("gp_code", "d", bad.alias("v")))


@query("csv_export", "S8", sql("""
    SELECT p.gp_code, p.issue_date, p.lead_day, round_even(p.fc_rain * 1.2345, 3) AS fc_rain, 'UNIT ' || p.gp_code AS gp_name FROM panel p""", "panel"))
def csv_export(t):
    names = t.unit.select("gp_code", F.concat(F.lit("UNIT "), "gp_code").alias("gp_name"))
    df = t.panel.select("gp_code", "issue_date", "lead_day", (F.col("fc_rain") * 1.2345).alias("fc_rain"), F.col("elev").alias("shap_elev"))
    return Tb.export_rows(df, names, "gp_code", "shap_").select("gp_code", "issue_date", "lead_day", "fc_rain", "gp_name")


@query("csv_template", "S9", sql("SELECT block_lgd, lead_day, CAST(NULL AS VARCHAR) AS rain, CAST(NULL AS VARCHAR) AS tmax FROM (SELECT DISTINCT block_lgd FROM unit) CROSS JOIN leads", "unit", "leads"))
def csv_template(t):
    return Tb.csv_template(t.unit.select("block_lgd").distinct(), "block_lgd", LEADS, ["rain", "tmax"])


@query("issue_payload", "S17", sql("""
    SELECT gp_code, issue_date, array_to_string(list_transform(list(round_even(fc_rain * 1.013::DOUBLE, 2) ORDER BY lead_day), lambda v: CAST(v AS VARCHAR)), ',') AS fr,
      array_to_string(list_transform(list(rain_obs ORDER BY lead_day), lambda v: coalesce(CAST(v AS VARCHAR), 'null')), ',') AS r FROM panel GROUP BY 1, 2""", "panel"))
def issue_payload(t):
    p = Tb.issue_payload(t.panel.withColumn("fc_rain", F.col("fc_rain") * 1.013), "gp_code", {"fr": "fc_rain", "r": "rain_obs"})

    def text(c):
        return F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("null"))), ",").alias(c)

    return p.select("gp_code", "issue_date", text("fr"), text("r"))


@query("issue_index", "S18", sql("SELECT issue_date, issue_date = (SELECT max(issue_date) FROM fc) AS is_latest FROM (SELECT DISTINCT issue_date FROM fc)", "fc"))
def issue_index(t):
    return Tb.issue_index(t.fc)


@query("latest_issue", "S18 S6", sql("SELECT block_lgd, lead_day, fc_rain FROM fc WHERE issue_date = (SELECT max(issue_date) FROM fc)", "fc"))
def latest_issue(t):
    return Tb.pick_issue(t.fc).select("block_lgd", "lead_day", "fc_rain")
