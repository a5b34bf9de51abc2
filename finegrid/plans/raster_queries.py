"""Queries over cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from finegrid.operators import raster as G
from finegrid.operators.relational import salted_join
from finegrid.plans.bindings import sql
from finegrid.plans.registry import R, query, r4

# Weight table over the 8 x 8 cells: one polygon per nation, weights from its suppliers.
WEIGHTS_SQL = """SELECT id, i, j, a / sum(a) OVER (PARTITION BY id) AS weight FROM (SELECT s_nationkey AS id,
    CAST(s_suppkey % 8 AS INTEGER) AS i, CAST((s_suppkey // 8) % 8 AS INTEGER) AS j, sum(abs(s_acctbal) + 1) AS a FROM supplier GROUP BY 1, 2, 3)"""


def weights(t):
    k = F.col("s_suppkey")
    w = t.table("supplier").groupBy(F.col("s_nationkey").alias("id"), (k % 8).cast("int").alias("i"),
                                    (F.floor(k / 8) % 8).cast("int").alias("j")).agg(F.sum(F.abs("s_acctbal") + 1).alias("a"))
    return w.join(w.groupBy("id").agg(F.sum("a").alias("s")), "id").select("id", "i", "j", (F.col("a") / F.col("s")).alias("weight"))


@query("grid_cells", "S21", sql("""
    , b AS (SELECT min(longitude) - 0.1 AS west, min(latitude) - 0.1 AS south, max(longitude) + 0.1 AS east, max(latitude) + 0.1 AS north FROM unit),
    k AS (SELECT CAST(floor((south - 0.025) / 0.05 + 0.5) - 1 AS BIGINT) AS i0, CAST(ceil((north - 0.025) / 0.05 - 0.5) + 1 AS BIGINT) AS i1,
        CAST(floor((west - 0.025) / 0.05 + 0.5) - 1 AS BIGINT) AS j0, CAST(ceil((east - 0.025) / 0.05 - 0.5) + 1 AS BIGINT) AS j1 FROM b),
    r AS (SELECT i0, j0, j1, unnest(generate_series(i0, i1)) AS ki FROM k), c AS (SELECT i0, j0, ki, unnest(generate_series(j0, j1)) AS kj FROM r)
    SELECT CAST(ki - i0 AS INTEGER) AS i, CAST(kj - j0 AS INTEGER) AS j, round(0.025::DOUBLE + ki * 0.05::DOUBLE, 6) AS lat,
      round(0.025::DOUBLE + kj * 0.05::DOUBLE, 6) AS lon, 0.025::DOUBLE AS half FROM c""", "unit"))
def grid_cells(t):
    box = t.unit.agg((F.min("longitude") - 0.1).alias("west"), (F.min("latitude") - 0.1).alias("south"),
                     (F.max("longitude") + 0.1).alias("east"), (F.max("latitude") + 0.1).alias("north"))
    return G.grid_covering(box, 0.05, 0.025)


@query("cube_to_long", "S12", """
    SELECT t, CAST(pos // 8 AS INTEGER) AS i, CAST(pos % 8 AS INTEGER) AS j, round(e, 6) AS value FROM (SELECT vec_id AS t,
      unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings)""")
def cube_to_long(t):
    df = t.table("embeddings").withColumnRenamed("vec_id", "t")
    return G.cube_to_long(df, ["t"], "embedding", 8).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("bbox_crop", "P12", sql("""SELECT t, i, j, v FROM raster WHERE 18 + i * 0.25 BETWEEN 18.3 - 0.125 AND 19.0 + 0.125
    AND 73 + j * 0.25 BETWEEN 73.6 - 0.125 AND 74.4 + 0.125""", "raster"))
def bbox_crop(t):
    c = t.raster.withColumn("lat", 18 + F.col("i") * 0.25).withColumn("lon", 73 + F.col("j") * 0.25)
    return G.crop(c, "lat", "lon", 18.3, 19.0, 73.6, 74.4, 0.25).select("t", "i", "j", "v")


@query("nearest_cell_series", "P13", sql("""
    , p AS (SELECT gp_code, greatest(0, least(7, CAST(round_even((latitude - 18.02) / 0.15, 0) AS INTEGER))) AS i,
        greatest(0, least(7, CAST(round_even((longitude - 73.31) / 0.2, 0) AS INTEGER))) AS j FROM unit)
    SELECT p.gp_code, r.t, r.v FROM p JOIN raster r USING (i, j)""", "unit", "raster"))
def nearest_cell_series(t):
    i, j = G.nearest_cell(F.col("latitude"), F.col("longitude"), 18.02, 73.31, 0.15, 8, 8)
    i2, j2 = G.nearest_cell(F.col("latitude"), F.col("longitude"), 18.02, 73.31, 0.2, 8, 8)
    sites = t.unit.select("gp_code", i.alias("i"), j2.alias("j"))
    return salted_join(sites, t.raster.select("i", "j", "t", "v"), ["i", "j"], ["gp_code"], small_key=["t"]).select("gp_code", "t", "v")


@query("weighted_mean_nullaware", "J6 A1 M8", sql(f"""
    SELECT r.t, w.id, CASE WHEN sum(w.weight) FILTER (WHERE r.v IS NOT NULL) > 0.5 THEN {R('sum(r.v * w.weight) / sum(w.weight) FILTER (WHERE r.v IS NOT NULL)')} END AS v,
      CASE WHEN sum(w.weight) FILTER (WHERE r.v IS NOT NULL) > 0.5 THEN {R('sum(r.v * r.v * w.weight) / sum(w.weight) FILTER (WHERE r.v IS NOT NULL)')} END AS v2
    FROM raster r JOIN w USING (i, j) GROUP BY 1, 2""", "raster", w=WEIGHTS_SQL))
def weighted_mean_nullaware(t):
    cells = t.raster.withColumn("v2", F.col("v") * F.col("v"))
    out = G.weighted_mean(cells, weights(t), ["t", "id"], ["v", "v2"], min_covered=0.5)
    return out.select("t", "id", r4("v").alias("v"), r4("v2").alias("v2"))


@query("weighted_sum_raw", "A2", sql(f"""
    SELECT r.t, w.id, {R('coalesce(sum(r.v * w.weight), 0.0)')} AS v FROM raster r JOIN w USING (i, j) GROUP BY 1, 2""", "raster", w=WEIGHTS_SQL))
def weighted_sum_raw(t):
    return G.weighted_sum(t.raster, weights(t), ["t", "id"], ["v"]).select("t", "id", r4("v").alias("v"))


@query("zonal_stats", "A6 A9", sql(f"""
    SELECT zone, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, CAST(count(v) AS BIGINT) AS n, {R('min(v)')} AS min, {R('max(v)')} AS max,
      {R('quantile_cont(v, 0.9)')} AS p90 FROM raster GROUP BY zone""", "raster"))
def zonal_stats(t):
    out = G.zonal_stats(t.raster, "zone", "v")
    return out.select("zone", *[r4(c).alias(c) for c in ("mean", "std", "min", "max", "p90")], "n")


@query("masked_zonal", "A7 Q8", sql(f"""
    , g AS (SELECT zone, t % 4 AS tile, v FROM raster WHERE (i * 3 + j) % 5 IN (0, 1) AND v IS NOT NULL)
    SELECT zone, {R('avg(v)')} AS mean, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT tile) AS BIGINT) AS tiles FROM g GROUP BY zone""", "raster"))
def masked_zonal(t):
    c = t.raster.withColumn("tile", F.col("t") % 4).withColumn("q", (F.col("i") * 3 + F.col("j")) % 5)
    return G.masked_zonal(c, "zone", "tile", "v", "q", [0, 1]).select("zone", r4("mean").alias("mean"), "n", "tiles")


CLS = "CASE WHEN v < -0.15 THEN 10 WHEN v < 0 THEN 20 WHEN v < 0.15 THEN 30 WHEN v IS NOT NULL THEN 80 END"


@query("class_fractions", "A8", sql(f"""
    , c AS (SELECT zone, {CLS} AS cls FROM raster), k AS (SELECT zone, count(*) AS n, count(cls) AS v, count(*) FILTER (WHERE cls = 10) AS a,
        count(*) FILTER (WHERE cls = 20) AS b, count(*) FILTER (WHERE cls = 30) AS c3, count(*) FILTER (WHERE cls = 80) AS d FROM c GROUP BY 1)
    SELECT zone, {R('v / n')} AS valid_frac, CAST(n AS BIGINT) AS cells, {R('100 * a / v')} AS tree_pct, {R('100 * b / v')} AS shrub_pct,
      {R('100 * c3 / v')} AS crop_pct, {R('100 * d / v')} AS water_pct,
      {R('100 * (a + b) / v')} AS natural_pct FROM k""", "raster"))
def class_fractions(t):
    c = t.raster.withColumn("cls", F.expr(CLS))
    out = G.class_fractions(c, "zone", "cls", {10: "tree", 20: "shrub", 30: "crop", 80: "water"}, {"natural": ["tree", "shrub"]})
    return out.select("zone", r4("valid_frac").alias("valid_frac"), "cells", *[r4(f"{n}_pct").alias(f"{n}_pct") for n in ("tree", "shrub", "crop", "water", "natural")])


@query("focal_tpi", "W15", sql(f"""
    , o AS (SELECT unnest(range(-2, 3)) AS d), m AS (SELECT c.t, c.i, c.j, c.v, sum(n.v) / nullif(count(n.v), 0) AS m FROM raster c
      CROSS JOIN o di CROSS JOIN o dj JOIN raster n ON n.t = c.t AND n.i = least(7, greatest(0, c.i + di.d)) AND n.j = least(7, greatest(0, c.j + dj.d))
      GROUP BY c.t, c.i, c.j, c.v)
    SELECT t, i, j, {R('v - m')} AS tpi FROM m""", "raster"))
def focal_tpi(t):
    return G.position_index(t.raster, "t", "v", 2).select("t", "i", "j", r4("tpi").alias("tpi"))


_N = "(SELECT x.v FROM z x WHERE x.t = c.t AND x.i = least(7, greatest(0, c.i + {a})) AND x.j = least(7, greatest(0, c.j + {b})))"


@query("slope_aspect", "W14 F2", sql(f"""
    , z AS (SELECT t, i, j, v * 100 AS v FROM raster),
    n AS (SELECT c.t, c.i, c.j, n0.v AS a, n1.v AS b, n2.v AS c3, n3.v AS d, n5.v AS f, n6.v AS g, n7.v AS h, n8.v AS k FROM z c
      """ + "\n".join(f"JOIN z n{q} ON n{q}.t = c.t AND n{q}.i = least(7, greatest(0, c.i + {q // 3 - 1})) AND n{q}.j = least(7, greatest(0, c.j + {q % 3 - 1}))"
                      for q in (0, 1, 2, 3, 5, 6, 7, 8)) + f"""),
    g AS (SELECT t, i, j, ((c3 + 2 * f + k) - (a + 2 * d + g)) / 240 AS dx, ((g + 2 * h + k) - (a + 2 * b + c3)) / 240 AS dy FROM n)
    SELECT t, i, j, {R('degrees(atan(sqrt(dx * dx + dy * dy)))')} AS slope,
      CASE WHEN sqrt(dx * dx + dy * dy) >= 1e-6 THEN {R('fmod(degrees(atan2(-dx, dy)) + 360, 360)')} END AS aspect FROM g""", "raster"))
def slope_aspect(t):
    z = t.raster.withColumn("v", F.col("v") * 100)
    return G.slope_aspect(z, "t", "v", 30.0).select("t", "i", "j", r4("slope").alias("slope"), r4("aspect").alias("aspect"))


@query("block_downsample", "W17", sql(f"""
    , c AS (SELECT t, i // 2 AS i, j // 2 AS j, v, {CLS} AS cls FROM raster),
    k AS (SELECT t, i, j, cls, count(*) AS n, row_number() OVER (PARTITION BY t, i, j ORDER BY count(*) DESC, cls) AS rn FROM c WHERE cls IS NOT NULL GROUP BY 1, 2, 3, 4),
    m AS (SELECT t, i, j, avg(v) AS m FROM c GROUP BY 1, 2, 3)
    SELECT m.t, CAST(m.i AS INTEGER) AS i, CAST(m.j AS INTEGER) AS j, {R('m.m')} AS mean, k.cls AS mode FROM m LEFT JOIN k ON k.t = m.t AND k.i = m.i AND k.j = m.j AND k.rn = 1""", "raster"))
def block_downsample(t):
    out = G.block_downsample(t.raster.withColumn("cls", F.expr(CLS)), "t", "v", "cls", 2)
    return out.select("t", "i", "j", r4("mean").alias("mean"), "mode")


@query("row_argmax", "W13", sql(f"""
    SELECT t, i, j, {R('v')} AS peak FROM (SELECT *, row_number() OVER (PARTITION BY t, i ORDER BY v DESC, j) AS rn FROM raster WHERE v IS NOT NULL) WHERE rn = 1""", "raster"))
def row_argmax(t):
    return G.row_argmax(t.raster, "t", "v").select("t", "i", "j", r4("peak").alias("peak"))


@query("rolling_median", "W12 W13", sql(f"""
    SELECT gp_code, d, {R('median(rain_obs) OVER (PARTITION BY gp_code ORDER BY d ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)')} AS med FROM obs""", "obs"))
def rolling_median(t):
    return G.rolling_median(t.obs, ["gp_code"], "d", "rain_obs", 15, "med").select("gp_code", "d", r4("med").alias("med"))


@query("zscore_gradient", "W19", sql(f"""
    , s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM raster)
    SELECT t, i, j, {R('(v - m) / sd')} AS z, {R('''CASE WHEN j = 0 THEN lead(v) OVER w - v WHEN j = 7 THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END''')} AS grad
    FROM raster CROSS JOIN s WINDOW w AS (PARTITION BY t, i ORDER BY j)""", "raster"))
def zscore_gradient(t):
    out = G.row_gradient(G.zscore(t.raster, "v", "z"), "t", "v", "grad")
    return out.select("t", "i", "j", r4("z").alias("z"), r4("grad").alias("grad"))


@query("drop_empty_days", "A41", sql("""
    , q AS (SELECT t, i, j, CASE WHEN t % 7 <> 2 THEN v END AS v FROM raster)
    SELECT t, i, j, v FROM q WHERE t IN (SELECT t FROM q WHERE v IS NOT NULL)""", "raster"))
def drop_empty_days(t):
    return G.drop_empty_steps(t.raster.withColumn("v", F.when(F.col("t") % 7 != 2, F.col("v"))), "t", "v").select("t", "i", "j", "v")


@query("dominant_label", "A31", sql(f"""
    , a AS (SELECT i, j, id, sum(weight) AS a FROM w GROUP BY 1, 2, 3)
    SELECT i, j, id, {R('a / t')} AS share FROM (SELECT *, sum(a) OVER (PARTITION BY i, j) AS t, row_number() OVER (PARTITION BY i, j ORDER BY a DESC, id) AS rn FROM a)
    WHERE rn = 1""", w=WEIGHTS_SQL))
def dominant_label(t):
    return G.dominant_label(weights(t), ["i", "j"], "id", "weight").select("i", "j", "id", r4("share").alias("share"))


@query("paint_parent", "J25 A31", sql(f"""
    , a AS (SELECT i, j, id, sum(weight) AS a FROM w GROUP BY 1, 2, 3),
    dom AS (SELECT i, j, id % 5 AS block_lgd FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY a DESC, id) AS rn FROM a) WHERE rn = 1),
    c AS (SELECT t, i, j, CAST(DATE '2024-01-01' + CAST(t % 30 AS INTEGER) AS DATE) AS d FROM raster)
    SELECT c.t, c.i, c.j, c.d, coalesce(p.v, 0.0) AS v FROM c LEFT JOIN dom USING (i, j) LEFT JOIN pday p ON p.block_lgd = dom.block_lgd AND p.d = c.d""", "raster", "pday", w=WEIGHTS_SQL))
def paint_parent(t):
    dom = G.dominant_label(weights(t), ["i", "j"], "id", "weight").withColumn("block_lgd", F.col("id") % 5)
    cells = t.raster.select("t", "i", "j", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("t") % 30).cast("int")).alias("d"))
    return G.paint_parent(cells, dom, t.pday, ["i", "j"], "block_lgd", "d", "v").select("t", "i", "j", "d", "v")


@query("upwind_max", "J20", sql(f"""
    , h AS (SELECT CAST(floor(latitude / 0.03 + 0.5) AS INTEGER) AS ci, CAST(floor(longitude / 0.03 + 0.5) AS INTEGER) AS cj, avg(elev) AS h FROM unit GROUP BY 1, 2),
    r AS (SELECT gp_code, elev, CAST(floor((latitude + cos(radians(240)) * k * 0.03) / 0.03 + 0.5) AS INTEGER) AS ci,
        CAST(floor((longitude + sin(radians(240)) * k * 0.03) / 0.03 + 0.5) AS INTEGER) AS cj FROM unit CROSS JOIN (SELECT unnest(range(1, 41)) AS k))
    SELECT gp_code, {R('greatest(0.0, coalesce(max(h.h) - r.elev, 0.0))')} AS barrier FROM r LEFT JOIN h USING (ci, cj) GROUP BY gp_code, r.elev""", "unit"))
def upwind_max(t):
    ci, cj = (F.floor(F.col(c) / 0.03 + 0.5).cast("int") for c in ("latitude", "longitude"))
    heights = t.unit.groupBy(ci.alias("ci"), cj.alias("cj")).agg(F.avg("elev").alias("h"))
    out = G.upwind_barrier(t.unit, heights, "gp_code", "latitude", "longitude", "elev", 0.03, 240.0)
    return out.select("gp_code", r4("barrier").alias("barrier"))


@query("components_min_area", "A40", sql("""
    , w AS (SELECT t, i, j, i * 8 + j AS cell FROM raster WHERE v > -0.02),
    e AS (SELECT a.t, a.cell AS a, b.cell AS b FROM w a JOIN w b ON b.t = a.t AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
    RECURSIVE_PART
    c AS (SELECT t, cell, min(root) AS component FROM r GROUP BY 1, 2), s AS (SELECT t, component, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 4)
    SELECT c.t, CAST(c.cell // 8 AS INTEGER) AS i, CAST(c.cell % 8 AS INTEGER) AS j, CAST(c.component AS BIGINT) AS component, CAST(s.n AS DOUBLE) * 0.25 AS area
    FROM c JOIN s USING (t, component)""", "raster").replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "RECURSIVE_PART", "r AS (SELECT t, cell, cell AS root FROM w UNION SELECT r.t, e.b, r.root FROM r JOIN e ON e.t = r.t AND e.a = r.cell),"))
def components_min_area(t):
    water = t.raster.where("v > -0.02")
    out = G.large_components(water, "t", 8, 0.25, 1.0)
    return out.select("t", "i", "j", "component", "area")


@query("wettest_day", "A36", sql(f"""
    , w AS (SELECT block_lgd, d, avg(rain_obs) AS m, row_number() OVER (PARTITION BY block_lgd ORDER BY {R('avg(rain_obs)')} DESC, d) AS rn FROM obs GROUP BY 1, 2)
    SELECT o.gp_code, o.d, o.rain_obs FROM obs o JOIN w ON w.block_lgd = o.block_lgd AND w.d = o.d AND w.rn = 1""", "obs"))
def wettest_day(t):
    mean = t.obs.groupBy("block_lgd", "d").agg(r4(F.avg("rain_obs")).alias("m"))
    best = mean.groupBy("block_lgd").agg(F.min_by("d", F.struct(-F.col("m"), F.col("d"))).alias("d"))
    return t.obs.join(best, ["block_lgd", "d"], "left_semi").select("gp_code", "d", "rain_obs")
