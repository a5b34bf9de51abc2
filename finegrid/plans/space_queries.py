"""Queries over polygons, points, lines, encoders and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from finegrid.functions import columns as C
from finegrid.functions import scores as S
from finegrid.operators import baselines as B
from finegrid.operators import encode as E
from finegrid.operators import geometry as G
from finegrid.operators import panel as P
from finegrid.operators import rescale as M
from finegrid.operators import verify as V
from finegrid.plans.bindings import sql
from finegrid.plans.panel_queries import rounded
from finegrid.plans.registry import R, query, r4
from finegrid.session import checkpointed, scratch_path
from finegrid.sources import features as Ft

# Unit polygons are squares of 0.024 degrees around the unit; parents' polygons are
# made of the same squares; points come from the customer table.
HALF = 0.012
SQUARES = "SELECT gp_code, block_lgd, area_km2, longitude - 0.012 AS w, latitude - 0.012 AS s, longitude + 0.012 AS e, latitude + 0.012 AS n FROM unit"
POINTS = """SELECT c_custkey AS pid, 73.2803 + CAST(c_custkey * 131 % 1640 AS DOUBLE) / 1000 AS x, 17.9803 + CAST(c_custkey * 71 % 1150 AS DOUBLE) / 1000 AS y FROM customer"""


def squares(t):
    ring = G.rectangle_ring(F.col("longitude"), F.col("latitude"), HALF, HALF)
    return t.unit.select("gp_code", "block_lgd", "area_km2", ring.alias("ring"))


def points(t):
    k = F.col("c_custkey")
    return t.table("customer").select(k.alias("pid"), (73.2803 + (k * 131 % 1640).cast("double") / 1000).alias("x"),
                                      (17.9803 + (k * 71 % 1150).cast("double") / 1000).alias("y"))


PIECES = """SELECT q.gp_code, CAST(ci AS BIGINT) AS ci, CAST(cj AS BIGINT) AS cj,
    radians(least(q.e, cj * 0.1::DOUBLE + 0.05) - greatest(q.w, cj * 0.1::DOUBLE - 0.05)) * 6371.0
    * (sin(radians(least(q.n, ci * 0.1::DOUBLE + 0.05))) - sin(radians(greatest(q.s, ci * 0.1::DOUBLE - 0.05)))) * 6371.0 AS a
    FROM sq q CROSS JOIN (SELECT unnest(range(178, 195)) AS ci) CROSS JOIN (SELECT unnest(range(731, 752)) AS cj)
    WHERE least(q.e, cj * 0.1::DOUBLE + 0.05) > greatest(q.w, cj * 0.1::DOUBLE - 0.05) AND least(q.n, ci * 0.1::DOUBLE + 0.05) > greatest(q.s, ci * 0.1::DOUBLE - 0.05)"""


@query("polygon_grid_weights", "J7 D2 F17", sql(f"""
    , p AS ({PIECES}), k AS (SELECT * FROM p QUALIFY a / sum(a) OVER (PARTITION BY gp_code) >= 1e-6)
    SELECT gp_code, ci, cj, {R('a / sum(a) OVER (PARTITION BY gp_code)')} AS weight FROM k""", "unit", sq=SQUARES))
def polygon_grid_weights(t):
    return G.polygon_grid_weights(squares(t), "gp_code", "ring", 0.1).select("gp_code", "ci", "cj", r4("weight").alias("weight"))


@query("polygon_area", "F17", sql(f"""
    SELECT gp_code, {R('radians(e - w) * 6371.0 * (sin(radians(n)) - sin(radians(s))) * 6371.0')} AS km2 FROM sq""", "unit", sq=SQUARES))
def polygon_area(t):
    return squares(t).select("gp_code", r4(G.area_km2(squares(t), "ring")).alias("km2"))


SHARED = """SELECT q.gp_code, b.b_code, radians(least(q.e, b.e) - greatest(q.w, b.w)) * 6371.0 * (sin(radians(least(q.n, b.n))) - sin(radians(greatest(q.s, b.s)))) * 6371.0 AS a
    FROM sq q JOIN b ON b.w < q.e AND b.e > q.w AND b.s < q.n AND b.n > q.s"""
# equal shares would make the choice depend on the last bit, so the choice is compared where it is clear
CHOICE = f"""SELECT gp_code, CASE WHEN n2 IS NULL OR a - n2 > 1e-6 THEN b_code END AS b_code, {R('a / t')} AS overlap_frac, 'largest_overlap' AS assignment_method
    FROM (SELECT *, sum(a) OVER g AS t, row_number() OVER (g ORDER BY a DESC, b_code) AS rn, lead(a) OVER (g ORDER BY a DESC, b_code) AS n2 FROM v WHERE a > 1e-9 WINDOW g AS (PARTITION BY gp_code)) WHERE rn = 1"""


@query("largest_overlap", "J8", sql(f"""
    , b AS (SELECT gp_code AS b_code, w + 0.009 AS w, s + 0.004 AS s, e + 0.009 AS e, n + 0.004 AS n FROM sq), v AS ({SHARED})
    {CHOICE}""", "unit", sq=SQUARES))
def largest_overlap(t):
    moved = t.unit.select(F.col("gp_code").alias("b_code"), G.rectangle_ring(F.col("longitude") + 0.009, F.col("latitude") + 0.004, HALF, HALF).alias("ring"))
    return clear_choice(squares(t), moved)


def clear_choice(a, b):
    """`largest_overlap` with its polygon where the second best is clearly smaller."""
    shared = checkpointed(G.overlap_areas(a, "gp_code", b, "b_code", "ring", 0.03))
    out = G.largest_overlap(a, "gp_code", b, "b_code", "ring", 0.03, shared)
    two = shared.groupBy("gp_code").agg(F.slice(F.sort_array(F.collect_list("a"), asc=False), 1, 2).alias("a2"))
    clear = (F.col("assignment_method") == "largest_overlap") & ((F.size("a2") < 2) | (F.get("a2", F.lit(0)) - F.get("a2", F.lit(1)) > 1e-6))
    return out.join(two, "gp_code", "left").select("gp_code", F.when(clear, F.col("b_code")).alias("b_code"), r4("overlap_frac").alias("overlap_frac"), "assignment_method")


@query("overlap_with_fallback", "J8", sql(f"""
    , b AS (SELECT gp_code AS b_code, w + 0.009 AS w, s + 0.004 AS s, e + 0.009 AS e, n + 0.004 AS n FROM sq WHERE CAST(gp_code AS BIGINT) % 11 = 0), v AS ({SHARED}), o AS ({CHOICE}),
    c AS (SELECT gp_code, unnest([w, e, e, w]) AS x, unnest([s, s, n, n]) AS y FROM sq WHERE gp_code NOT IN (SELECT gp_code FROM o)),
    d AS (SELECT gp_code, min(sqrt(greatest(b.w - x, x - b.e, 0.0) ** 2 + greatest(b.s - y, y - b.n, 0.0) ** 2)) AS dist FROM c CROSS JOIN b GROUP BY 1)
    SELECT gp_code, b_code, overlap_frac, assignment_method FROM o UNION ALL SELECT gp_code, NULL, 0.0, CASE WHEN dist IS NULL THEN 'none' ELSE 'nearest' END FROM d""", "unit", sq=SQUARES))
def overlap_with_fallback(t):
    moved = t.unit.where(F.col("user_id") % 11 == 0).select(F.col("gp_code").alias("b_code"), G.rectangle_ring(F.col("longitude") + 0.009, F.col("latitude") + 0.004, HALF, HALF).alias("ring"))
    return clear_choice(squares(t), moved)


# Every unit's square with a hole in it, and a second, smaller square to the north-east.
HOLED = "SELECT *, longitude AS x, latitude AS y FROM unit"


def holed(t):
    ring = lambda dx, dy, h: G.rectangle_ring(F.col("longitude") + dx, F.col("latitude") + dy, h, h)
    parts = F.array(F.array(ring(0.0, 0.0, 0.012), ring(0.003, -0.002, 0.005)), F.array(ring(0.019, 0.02, 0.004)))
    return t.unit.select("gp_code", parts.alias("shape"))


BOX_KM2 = "(radians(2 * {h}) * 6371.0 * (sin(radians(y + {dy} + {h})) - sin(radians(y + {dy} - {h}))) * 6371.0)"
IN_BOX = "(abs(p.x - h.x - {dx}) < {h} AND abs(p.y - h.y - {dy}) < {h})"


@query("polygons_with_holes", "J7 J10 S15 S16 F17 A33", sql(f"""
    , hit AS (SELECT h.gp_code, count(*) AS n FROM pt p JOIN h ON {IN_BOX.format(dx=0.0, dy=0.0, h=0.012)} AND NOT {IN_BOX.format(dx=0.003, dy=-0.002, h=0.005)}
      OR {IN_BOX.format(dx=0.019, dy=0.02, h=0.004)} GROUP BY 1)
    SELECT h.gp_code, 2 AS parts, {R(BOX_KM2.format(dy=0.0, h=0.012) + ' - ' + BOX_KM2.format(dy=-0.002, h=0.005) + ' + ' + BOX_KM2.format(dy=0.02, h=0.004))} AS km2,
      {R(BOX_KM2.format(dy=0.0, h=0.012) + ' - ' + BOX_KM2.format(dy=-0.002, h=0.005) + ' + ' + BOX_KM2.format(dy=0.02, h=0.004))} AS in_cells, coalesce(hit.n, 0) AS points
    FROM h LEFT JOIN hit USING (gp_code)""", "unit", pt=POINTS, h=HOLED))
def polygons_with_holes(t):
    # out to text, one part after the other, and back: what is measured has been written, read and dissolved
    path = scratch_path(t.spark, "holes")
    parts = holed(t).select("gp_code", F.posexplode("shape").alias("no", "shape"))
    Ft.feature_lines(parts, "shape", ["gp_code", "no"], digits=9).write.text(path)
    shapes = checkpointed(G.dissolve(Ft.read_features(t.spark, path, "gp_code:string,no:int"), "gp_code", "no", [], "shape"))
    cells = G.cell_areas(shapes, "gp_code", "shape", 0.01).groupBy("gp_code").agg(F.sum("a").alias("in_cells"))
    hits = G.points_in_polygons(points(t), "x", "y", shapes, "gp_code", "shape", 0.05, count="points")
    out = shapes.join(cells, "gp_code").join(hits, "gp_code", "left")
    return out.select("gp_code", F.col("parts").cast("int").alias("parts"), r4(G.area_km2(shapes, "shape")).alias("km2"), r4("in_cells").alias("in_cells"), F.coalesce("points", F.lit(0)).cast("long").alias("points"))


@query("representative_inside", "F17", sql("SELECT gp_code, TRUE AS inside FROM unit", "unit"))
def representative_inside(t):
    p = holed(t).withColumn("p", G.representative_point(F.col("shape")))
    return p.select("gp_code", G.shape_contains(F.col("shape"), F.col("p.x"), F.col("p.y")).alias("inside"))


@query("dissolve_union", "A33 F17", sql("""
    , c AS (SELECT DISTINCT block_lgd, user_id % 53 AS i, user_id % 37 AS j FROM unit), b AS (SELECT block_lgd, count(*) AS n FROM c GROUP BY 1),
    s AS (SELECT a.block_lgd, count(*) AS k FROM c a JOIN c b ON a.block_lgd = b.block_lgd AND (b.i = a.i + 1 AND b.j = a.j OR b.i = a.i AND b.j = a.j + 1) GROUP BY 1)
    SELECT block_lgd, CAST(n * 9 AS DOUBLE) AS area, CAST(12 * n - 6 * coalesce(k, 0) AS DOUBLE) AS perimeter FROM b LEFT JOIN s USING (block_lgd)""", "unit"))
def dissolve_union(t):
    # every unit as a square of a lattice, dissolved into its parent
    x, y = (F.col("user_id") % 53 * 3).cast("double"), (F.col("user_id") % 37 * 3).cast("double")
    cells = t.unit.select("block_lgd", x.alias("x"), y.alias("y")).distinct().select("block_lgd", G.rectangle_ring(F.col("x"), F.col("y"), 1.5, 1.5).alias("ring"))
    sides = G.edges(G.union_shapes(cells, "block_lgd", "ring"), "block_lgd", "ring")
    return sides.groupBy("block_lgd").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"))


@query("points_repeated", "J10", sql("""
    SELECT p.pid, min(q.gp_code) AS gp_code, CAST(any_value(k.n) AS BIGINT) AS n FROM pt p CROSS JOIN (SELECT 3 AS n) k LEFT JOIN sq q ON p.x > q.w AND p.x < q.e AND p.y > q.s AND p.y < q.n GROUP BY 1""", "unit", sq=SQUARES, pt=POINTS))
def points_repeated(t):
    three = points(t).withColumn("copy", F.explode(F.lit([1, 2, 3]))).drop("copy")
    return G.point_in_polygon(three, "x", "y", squares(t), "gp_code", "ring", 0.05).groupBy("pid", "gp_code").agg(F.count("*").alias("n"))


@query("stations_in_units", "J10 S4", sql("""
    , st AS (SELECT pt.pid AS sid, x, y, o_orderkey FROM pt JOIN orders ON o_custkey = pt.pid),
    u AS (SELECT pid AS sid, min(gp_code) AS gp_code FROM pt LEFT JOIN sq q ON x > q.w AND x < q.e AND y > q.s AND y < q.n GROUP BY 1)
    SELECT sid, gp_code, count(*) AS rows, gp_code IS NULL AS outside FROM st JOIN u USING (sid) GROUP BY 1, 2""", "unit", sq=SQUARES, pt=POINTS))
def stations_in_units(t):
    rows = t.table("orders").select(F.col("o_custkey").alias("pid")).join(points(t), "pid").withColumnRenamed("pid", "sid")
    inside, outside = G.stations_in_units(rows, "sid", "x", "y", squares(t), "gp_code", "ring", 0.05)
    found = inside.groupBy("sid", "gp_code").agg(F.count("*").alias("rows")).withColumn("outside", F.lit(False))
    return found.unionByName(outside.select("sid", F.lit(None).cast("string").alias("gp_code"), "rows", F.lit(True).alias("outside")))


@query("point_in_polygon", "J10", sql("""
    SELECT p.pid, min(q.gp_code) AS gp_code FROM pt p LEFT JOIN sq q ON p.x > q.w AND p.x < q.e AND p.y > q.s AND p.y < q.n GROUP BY 1""", "unit", sq=SQUARES, pt=POINTS))
def point_in_polygon(t):
    return G.point_in_polygon(points(t), "x", "y", squares(t), "gp_code", "ring", 0.05).select("pid", "gp_code")


@query("locate_with_cap", "J11", sql(f"""
    , d AS (SELECT p.pid, q.gp_code, sqrt(greatest(q.w - p.x, p.x - q.e, 0.0) ** 2 + greatest(q.s - p.y, p.y - q.n, 0.0) ** 2) AS dist FROM pt p CROSS JOIN sq q),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY {R('dist')}, gp_code) AS rn FROM d WHERE dist <= 0.045) WHERE rn = 1)
    SELECT p.pid, CASE WHEN b.dist IS NULL THEN 'none' WHEN b.dist = 0 THEN 'contains' ELSE 'nearest' END AS how, {R('b.dist')} AS distance
    FROM pt p LEFT JOIN b USING (pid)""", "unit", sq=SQUARES, pt=POINTS))
def locate_with_cap(t):
    out = G.locate(points(t), "pid", "x", "y", squares(t), "gp_code", "ring", 0.045)
    return out.select("pid", "how", r4("distance").alias("distance"))


@query("nearest_fill", "J9", sql(f"""
    , u AS (SELECT gp_code, latitude, longitude, CASE WHEN elev < 1100 THEN elev END AS v FROM unit),
    d AS (SELECT a.gp_code, b.v, row_number() OVER (PARTITION BY a.gp_code ORDER BY round((a.latitude - b.latitude) ** 2 + (a.longitude - b.longitude) ** 2, 9), b.gp_code) AS rn
          FROM u a JOIN u b ON b.v IS NOT NULL WHERE a.v IS NULL)
    SELECT u.gp_code, coalesce(u.v, d.v) AS v FROM u LEFT JOIN d ON d.gp_code = u.gp_code AND d.rn = 1""", "unit"))
def nearest_fill(t):
    # exact thousandths keep equal distances equal
    u = t.unit.select("gp_code", (F.col("user_id") % 37 * 30).cast("double").alias("y"), (F.col("user_id") % 53 * 30).cast("double").alias("x"),
                      F.when(F.col("elev") < 1100, F.col("elev")).alias("v"))
    return G.nearest_fill(u, "gp_code", "x", "y", "v").select("gp_code", "v")


XY = """SELECT gp_code, block_lgd, user_id, CAST(user_id % 53 * 3 AS DOUBLE) AS x, CAST(user_id % 37 * 3 AS DOUBLE) AS y FROM unit"""


@query("idw_knn", "J12 M2", sql(f"""
    , t AS (SELECT gp_code, latitude, longitude, elev AS v FROM uu WHERE user_id % 5 <> 2), w AS (SELECT gp_code, latitude, longitude FROM uu WHERE user_id % 5 = 2),
    d AS (SELECT w.gp_code, t.v, sqrt((radians(w.longitude - t.longitude) * 6371.0 * cos(radians(18.5))) ** 2 + (radians(w.latitude - t.latitude) * 6371.0) ** 2) AS dist, t.gp_code AS tid FROM w CROSS JOIN t),
    r AS (SELECT *, row_number() OVER (PARTITION BY gp_code ORDER BY dist, tid) AS rn FROM d)
    SELECT gp_code, {R('sum(v / greatest(dist, 0.5) ** 2) / sum(1 / greatest(dist, 0.5) ** 2)')} AS v, CAST(count(*) AS BIGINT) AS neighbours FROM r WHERE rn <= 8 GROUP BY 1""", "unit",
    uu="SELECT * REPLACE (latitude + user_id * user_id % 1009 * 0.000001::DOUBLE AS latitude) FROM unit"))
def idw_knn(t):
    # moved off the lattice, so that no two distances are equal
    u = t.unit.withColumn("v", F.col("elev")).withColumn("latitude", F.col("latitude") + (F.col("user_id") * F.col("user_id") % 1009) * 0.000001)
    out = E.idw_knn(u.where("block_lgd = 2"), u.where("block_lgd <> 2"), "gp_code", "latitude", "longitude", "v", 18.5)
    return out.select("gp_code", r4("v").alias("v"), "neighbours")


PARENT_POINTS = "SELECT block_lgd AS parent, avg(latitude) AS latitude, avg(longitude) AS longitude FROM unit GROUP BY 1"
IDW_SQL = f"""
    , pp AS ({PARENT_POINTS}), w AS (SELECT u.gp_code, pp.parent, 1 / greatest(sqrt((radians(u.longitude - pp.longitude) * 6371.0 * cos(radians(18.5))) ** 2
        + (radians(u.latitude - pp.latitude) * 6371.0) ** 2), 1.0) ** 2 AS w FROM unit u CROSS JOIN pp),
    f AS (SELECT * REPLACE (CASE WHEN NOT (block_lgd = 3 AND lead_day = 2) THEN fc_rain END AS fc_rain) FROM fc),
    k AS (SELECT p.gp_code, p.valid_date, p.lead_day, sum(w.w * f.fc_rain) / sum(w.w) FILTER (WHERE f.fc_rain IS NOT NULL) AS idw FROM panel p JOIN w USING (gp_code)
      JOIN f ON f.block_lgd = w.parent AND f.valid_date = p.valid_date AND f.lead_day = p.lead_day GROUP BY 1, 2, 3)"""


def idw_all(t):
    parents = t.unit.groupBy(F.col("block_lgd").alias("parent")).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    fcs = t.fc.withColumn("fc_rain", F.when(~((F.col("block_lgd") == 3) & (F.col("lead_day") == 2)), F.col("fc_rain"))).withColumnRenamed("block_lgd", "parent")
    rows = t.panel.select("gp_code", "valid_date", "lead_day", "latitude", "longitude")
    return B.idw_of_parents(rows, "gp_code", "latitude", "longitude", parents, fcs, "fc_rain", "idw", 18.5)


@query("idw_all_parents", "J13", sql(IDW_SQL + f" SELECT gp_code, valid_date, lead_day, {R('idw')} AS idw FROM k", "panel"))
def idw_all_parents(t):
    return idw_all(t).select("gp_code", "valid_date", "lead_day", r4("idw").alias("idw"))


@query("baseline_idw", "M6 A20", sql(IDW_SQL + f"""
    SELECT p.lead_day, CAST(count(*) AS BIGINT) AS n, {R('sqrt(avg((k.idw - p.rain_obs) ** 2))')} AS rmse, {R('avg(k.idw - p.rain_obs)')} AS bias
    FROM panel p JOIN k USING (gp_code, valid_date, lead_day) WHERE p.rain_obs IS NOT NULL GROUP BY 1""", "panel"))
def baseline_idw(t):
    m = t.panel.join(idw_all(t), ["gp_code", "valid_date", "lead_day"])
    c = S.continuous(F.col("rain_obs"), F.col("idw"))
    return m.groupBy("lead_day").agg(c["n"].alias("n"), r4(c["rmse"]).alias("rmse"), r4(c["bias"]).alias("bias"))


@query("baseline_grid_reference", "M8 P13 A1", sql(f"""
    , gridded AS (SELECT CAST(floor(u.latitude / 0.1 + 0.5) AS BIGINT) AS ci, CAST(floor(u.longitude / 0.1 + 0.5) AS BIGINT) AS cj, o.d, avg(o.rain_obs) AS g
        FROM obs o JOIN unit u USING (gp_code) GROUP BY 1, 2, 3),
    p AS ({PIECES}), k AS (SELECT * FROM p QUALIFY a / sum(a) OVER (PARTITION BY gp_code) >= 1e-6),
    m AS (SELECT k.gp_code, g.d, CASE WHEN sum(k.a) > 1e-9 THEN sum(k.a * g.g) / sum(k.a) END AS grid_ref FROM k JOIN gridded g USING (ci, cj) GROUP BY 1, 2)
    SELECT o.gp_code, o.d, o.rain_obs, {R('m.grid_ref')} AS grid_ref FROM obs o LEFT JOIN m USING (gp_code, d)""", "obs", "unit", sq=SQUARES))
def baseline_grid_reference(t):
    from finegrid.operators.raster import weighted_mean
    cell = [F.floor(F.col("latitude") / 0.1 + 0.5).alias("i"), F.floor(F.col("longitude") / 0.1 + 0.5).alias("j")]
    gridded = t.obs.join(t.unit.select("gp_code", *cell), "gp_code").groupBy("i", "j", "d").agg(F.avg("rain_obs").alias("grid_ref"))
    w = G.polygon_grid_weights(squares(t), "gp_code", "ring", 0.1).select("gp_code", F.col("ci").alias("i"), F.col("cj").alias("j"), "weight")
    ref = weighted_mean(gridded, w, ["gp_code", "d"], ["grid_ref"])
    return t.obs.join(ref, ["gp_code", "d"], "left").select("gp_code", "d", "rain_obs", r4("grid_ref").alias("grid_ref"))


SEGMENTS = """SELECT s_suppkey AS tid, 73.30037 + CAST(s_suppkey * 37 % 150 AS DOUBLE) / 100 AS ax, 18.00029 + CAST(s_suppkey * 53 % 110 AS DOUBLE) / 100 AS ay,
    73.30037 + CAST(s_suppkey * 37 % 150 AS DOUBLE) / 100 + CAST(s_suppkey % 9 - 4 AS DOUBLE) / 50 AS ex,
    18.00029 + CAST(s_suppkey * 53 % 110 AS DOUBLE) / 100 + CAST(s_suppkey % 7 - 3 AS DOUBLE) / 50 AS ey FROM supplier"""


def segments(t):
    k = F.col("s_suppkey")
    ax, ay = 73.30037 + (k * 37 % 150).cast("double") / 100, 18.00029 + (k * 53 % 110).cast("double") / 100
    return t.table("supplier").select(k.alias("tid"), ax.alias("ax"), ay.alias("ay"), (ax + (k % 9 - 4).cast("double") / 50).alias("bx"),
                                      (ay + (k % 7 - 3).cast("double") / 50).alias("by"))


@query("line_distance", "J16", sql(f"""
    , d AS (SELECT u.gp_code, s.*, (s.ex - s.ax) ** 2 + (s.ey - s.ay) ** 2 AS l2, u.longitude AS x, u.latitude AS y FROM unit u CROSS JOIN sg s),
    f AS (SELECT *, CASE WHEN l2 = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / nullif(l2, 0))) END AS f FROM d)
    SELECT gp_code, {R('min(sqrt((x - ax - f * (ex - ax)) ** 2 + (y - ay - f * (ey - ay)) ** 2))')} AS dist FROM f GROUP BY 1""", "unit", sg=SEGMENTS))
def line_distance(t):
    return G.line_distance(t.unit, "gp_code", "longitude", "latitude", segments(t)).select("gp_code", r4("dist").alias("dist"))


@query("line_side", "J16 W12", sql("""
    , v AS (SELECT latitude AS la, avg(longitude) AS lo FROM unit GROUP BY 1), s AS (SELECT la, lo, lead(la) OVER (ORDER BY la) AS lb, lead(lo) OVER (ORDER BY la) AS lob FROM v),
    p AS (SELECT p.pid, p.x, CASE WHEN p.y < (SELECT min(la) FROM v) THEN (SELECT arg_min(lo, la) FROM v) WHEN p.y >= (SELECT max(la) FROM v) THEN (SELECT arg_max(lo, la) FROM v)
      ELSE (SELECT max(s.lo + (s.lob - s.lo) * (p.y - s.la) / (s.lb - s.la)) FROM s WHERE p.y >= s.la AND p.y < s.lb) END AS lx FROM pt p)
    SELECT pid, CAST(CASE WHEN x >= lx THEN 1 ELSE -1 END AS INTEGER) AS side FROM p""", "unit", pt=POINTS))
def line_side(t):
    crest = t.unit.groupBy("latitude").agg(F.avg("longitude").alias("longitude"))
    return G.side_of_line(points(t), "pid", "x", "y", crest, "latitude", "longitude", 0.2)


@query("line_density", "J17", sql(f"""
    , l AS (SELECT *, sqrt((ex - ax) ** 2 + (ey - ay) ** 2) AS len, greatest(1, CAST(ceil(sqrt((ex - ax) ** 2 + (ey - ay) ** 2) / 0.005) AS INTEGER)) AS n FROM sg),
    m AS (SELECT ax, ay, ex, ey, len, n, unnest(range(0, n)) AS k FROM l),
    c AS (SELECT ax + (k + 0.5) / n * (ex - ax) AS x, ay + (k + 0.5) / n * (ey - ay) AS y, len / n AS len FROM m)
    SELECT q.gp_code, {R('coalesce(sum(c.len), 0)')} AS length, {R('coalesce(sum(c.len), 0) / q.area_km2')} AS density FROM sq q
    LEFT JOIN c ON c.x > q.w AND c.x < q.e AND c.y > q.s AND c.y < q.n GROUP BY q.gp_code, q.area_km2""", "unit", sg=SEGMENTS, sq=SQUARES))
def line_density(t):
    out = G.line_density(segments(t), squares(t), "gp_code", "ring", "area_km2", 0.005, 0.05)
    return out.select("gp_code", r4("length").alias("length"), r4("density").alias("density"))


@query("dissolve_parts", "A33 P4", """
    WITH p AS (SELECT l_orderkey AS code, l_linenumber, l_partkey, l_comment FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS l_comment FROM lineitem)),
    f AS (SELECT code, l_linenumber, l_partkey, l_comment, row_number() OVER (PARTITION BY code ORDER BY l_linenumber, l_partkey, l_comment) AS rn,
        count(*) OVER (PARTITION BY code) AS parts FROM p WHERE regexp_full_match(CAST(code AS VARCHAR), '[0-9]+'))
    SELECT code, l_comment AS flag, CAST(parts AS BIGINT) AS parts FROM f WHERE rn = 1""")
def dissolve_parts(t):
    from finegrid.operators.quality import split_by_pattern
    li = t.table("lineitem").select(F.col("l_orderkey").alias("code"), "l_linenumber", "l_partkey", F.col("l_returnflag").alias("flag"))
    good, _ = split_by_pattern(li, "code", r"^[0-9]+$")
    parts = good.withColumn("ord", F.struct("l_linenumber", "l_partkey", "flag"))
    return G.dissolve(parts, "code", "ord", ["flag"])


@query("cell_reaggregation", "A25 J15", sql(f"""
    , p AS ({PIECES}), w0 AS (SELECT p.gp_code, ci, cj, p.a / sum(p.a) OVER (PARTITION BY p.gp_code) * q.area_km2 AS a FROM p JOIN sq q USING (gp_code)),
    w AS (SELECT *, a / sum(a) OVER (PARTITION BY ci, cj) AS wc, sum(a) OVER (PARTITION BY ci, cj) / 40 AS cover FROM w0),
    g AS (SELECT w.ci, w.cj, s.valid_date, s.lead_day, sum(s.pred * w.wc) AS pred, sum(s.fc_rain * w.wc) AS copy FROM scored s JOIN w USING (gp_code) WHERE w.cover > 0.06 GROUP BY 1, 2, 3, 4),
    i AS (SELECT CAST(floor(u.latitude / 0.1 + 0.5) AS BIGINT) AS ci, CAST(floor(u.longitude / 0.1 + 0.5) AS BIGINT) AS cj, CAST(o.d + 1 AS DATE) AS d, avg(o.rain_obs) AS y
      FROM obs o JOIN unit u USING (gp_code) GROUP BY 1, 2, 3)
    SELECT CAST(count(*) AS BIGINT) AS n, {R('sqrt(avg((pred - y) ** 2))')} AS rmse_pred, {R('sqrt(avg((copy - y) ** 2))')} AS rmse_copy
    FROM g JOIN i ON i.ci = g.ci AND i.cj = g.cj AND i.d = g.valid_date + 1""", "scored", sq=SQUARES))
def cell_reaggregation(t):
    w = G.polygon_grid_weights(squares(t), "gp_code", "ring", 0.1).join(t.unit.select("gp_code", "area_km2"), "gp_code").withColumn("a", F.col("weight") * F.col("area_km2"))
    cell_total = w.groupBy("ci", "cj").agg(F.sum("a").alias("t")).where(F.col("t") / 40 > 0.06)
    w = w.join(cell_total, ["ci", "cj"]).select("gp_code", "ci", "cj", (F.col("a") / F.col("t")).alias("wc"))
    agg = t.scored.join(w, "gp_code").groupBy("ci", "cj", "valid_date", "lead_day").agg(F.sum(F.col("pred") * F.col("wc")).alias("pred"), F.sum(F.col("fc_rain") * F.col("wc")).alias("copy"))
    cell = [F.floor(F.col("latitude") / 0.1 + 0.5).alias("ci"), F.floor(F.col("longitude") / 0.1 + 0.5).alias("cj")]
    grid = t.obs.join(t.unit.select("gp_code", *cell), "gp_code").groupBy("ci", "cj", F.date_add("d", 1).alias("date")).agg(F.avg("rain_obs").alias("y"))
    m = agg.withColumn("date", F.date_add("valid_date", 1)).join(grid, ["ci", "cj", "date"])
    a, b = S.continuous(F.col("y"), F.col("pred")), S.continuous(F.col("y"), F.col("copy"))
    return m.agg(a["n"].alias("n"), r4(a["rmse"]).alias("rmse_pred"), r4(b["rmse"]).alias("rmse_copy"))


# --- encoders -----------------------------------------------------------------------------

RES = "res AS (SELECT gp_code, block_lgd, CAST(valid_date >= DATE '2024-01-16' AS INTEGER) AS season, valid_date, rain_obs - fc_rain AS r FROM panel WHERE rain_obs IS NOT NULL)"


def residuals(t):
    return t.panel.where("rain_obs is not null").select("gp_code", "block_lgd", (F.col("valid_date") >= "2024-01-16").cast("int").alias("season"),
                                                        "valid_date", (F.col("rain_obs") - F.col("fc_rain")).alias("r"))


@query("bias_shrunk", "A5", sql(f"""
    , g AS (SELECT gp_code, block_lgd, season, sum(r) AS s, count(*) AS n FROM res GROUP BY 1, 2, 3), b AS (SELECT block_lgd, season, avg(r) AS m FROM res GROUP BY 1, 2)
    SELECT gp_code, season, {R('n / (n + 20.0) * (s / n) + (1 - n / (n + 20.0)) * m')} AS bias FROM g JOIN b USING (block_lgd, season)""", "panel", res=RES[8:-1]))
def bias_shrunk(t):
    return rounded(E.shrunken_bias(residuals(t), "gp_code", "block_lgd", "season", "r"), ["bias"])


@query("bias_oof", "M2 W9", sql(f"""
    , fold AS (SELECT valid_date, CAST(ntile(5) OVER (ORDER BY valid_date) AS INTEGER) AS fold FROM (SELECT DISTINCT valid_date FROM res)),
    f AS (SELECT res.*, fold.fold FROM res JOIN fold USING (valid_date)), q AS (SELECT DISTINCT gp_code, block_lgd, season, fold FROM f),
    g AS (SELECT q.gp_code, q.season, q.fold, q.block_lgd, sum(f.r) AS s, count(f.r) AS n FROM q LEFT JOIN f ON f.gp_code = q.gp_code AND f.season = q.season AND f.fold <> q.fold GROUP BY 1, 2, 3, 4),
    b AS (SELECT x.block_lgd, x.season, x.fold, avg(f.r) AS m FROM (SELECT DISTINCT block_lgd, season, fold FROM f) x JOIN f ON f.block_lgd = x.block_lgd AND f.season = x.season AND f.fold <> x.fold GROUP BY 1, 2, 3)
    SELECT g.gp_code, g.season, g.fold, CASE WHEN n > 0 THEN {R('n / (n + 20.0) * (s / nullif(n, 0)) + (1 - n / (n + 20.0)) * m')} END AS bias
    FROM g LEFT JOIN b ON b.block_lgd = g.block_lgd AND b.season = g.season AND b.fold = g.fold""", "panel", res=RES[8:-1]))
def bias_oof(t):
    res = residuals(t)
    df = res.join(P.time_folds(res, "valid_date", 5), "valid_date")
    return rounded(E.out_of_fold_bias(df, "gp_code", "block_lgd", "season", "fold", "r"), ["bias"])


@query("bias_parent_season_lead", "M4 J14", sql(f"""
    , b AS (SELECT block_lgd, lead_day, avg(rain_obs - fc_rain) AS b FROM panel WHERE rain_obs IS NOT NULL AND block_lgd <> 4 GROUP BY 1, 2)
    SELECT p.gp_code, p.valid_date, p.lead_day, {R('p.fc_rain + coalesce(b.b, 0)')} AS corrected FROM panel p LEFT JOIN b USING (block_lgd, lead_day)""", "panel"))
def bias_parent_season_lead(t):
    table = E.parent_season_lead_bias(t.panel.where("block_lgd <> 4"), ["block_lgd", "lead_day"], "rain_obs", "fc_rain")
    out = E.with_bias(t.panel, table, ["block_lgd", "lead_day"], "fc_rain", "corrected")
    return out.select("gp_code", "valid_date", "lead_day", r4("corrected").alias("corrected"))


@query("clim_ratio_month", "J19 M5 A37", sql(f"""
    , m AS (SELECT gp_code, block_lgd, CAST(day(d) % 12 + 1 AS INTEGER) AS mon, avg(rain_obs) AS c FROM obs GROUP BY 1, 2, 3), pm AS (SELECT block_lgd, mon, avg(c) AS c FROM m GROUP BY 1, 2)
    SELECT p.gp_code, p.valid_date, p.lead_day, {R('m.c')} AS clim_month, {R('(m.c + 1) / (pm.c + 1)')} AS ratio, {R('p.fc_rain * (m.c + 1) / (pm.c + 1)')} AS clim_rain,
      {R('p.fc_rain - 0.0065 * (p.elev - 700)')} AS lapse
    FROM panel p LEFT JOIN m ON m.gp_code = p.gp_code AND m.mon = month(p.valid_date) LEFT JOIN pm ON pm.block_lgd = p.block_lgd AND pm.mon = month(p.valid_date)""", "panel"))
def clim_ratio_month(t):
    mon = (F.dayofmonth("d") % 12 + 1).alias("mon")
    months = list(range(1, 13))
    unit_m = t.obs.groupBy("gp_code", "block_lgd", mon).agg(F.avg("rain_obs").alias("c"))
    wide = unit_m.groupBy("gp_code").agg(*[F.max(F.when(F.col("mon") == m, F.col("c"))).alias(f"clim_m{m:02d}") for m in months])
    parent = unit_m.groupBy("block_lgd", "mon").agg(F.avg("c").alias("c"))
    pwide = parent.groupBy("block_lgd").agg(*[F.max(F.when(F.col("mon") == m, F.col("c"))).alias(f"blk_m{m:02d}") for m in months])
    df = t.panel.join(wide, "gp_code", "left").join(pwide, "block_lgd", "left")
    df = df.withColumn("cm", P.month_pick(df, [f"clim_m{m:02d}" for m in months], "valid_date")).withColumn("pm", P.month_pick(df, [f"blk_m{m:02d}" for m in months], "valid_date"))
    ratio = B.climate_ratio(F.col("cm"), F.col("pm"))
    return df.select("gp_code", "valid_date", "lead_day", r4("cm").alias("clim_month"), r4(ratio).alias("ratio"),
                     r4(B.climatology("rain", F.col("fc_rain"), ratio, F.col("elev"))).alias("clim_rain"),
                     r4(B.climatology("tmax", F.col("fc_rain"), ratio, F.col("elev") - 700)).alias("lapse"))


@query("month_pick", "J19", sql(f"""
    , m AS (SELECT gp_code, CAST(day(d) % 12 + 1 AS INTEGER) AS mon, avg(rain_obs) AS c FROM obs GROUP BY 1, 2)
    SELECT o.gp_code, o.d, {R('m.c')} AS normal FROM obs o LEFT JOIN m ON m.gp_code = o.gp_code AND m.mon = month(o.d)""", "obs"))
def month_pick(t):
    months = list(range(1, 13))
    m = t.obs.groupBy("gp_code", (F.dayofmonth("d") % 12 + 1).alias("mon")).agg(F.avg("rain_obs").alias("c"))
    wide = m.groupBy("gp_code").agg(*[F.max(F.when(F.col("mon") == k, F.col("c"))).alias(f"m{k:02d}") for k in months])
    df = t.obs.select("gp_code", "d").join(wide, "gp_code", "left")
    return df.select("gp_code", "d", r4(P.month_pick(df, [f"m{k:02d}" for k in months], "d")).alias("normal"))


@query("month_totals", "A37", sql(f"""
    , m AS (SELECT gp_code, CAST(day(d) % 12 + 1 AS INTEGER) AS mon, avg(rain_obs) AS c FROM obs GROUP BY 1, 2)
    SELECT gp_code, {R('sum(c)')} AS annual, {R('coalesce(sum(c) FILTER (WHERE mon BETWEEN 6 AND 9), 0)')} AS jjas FROM m GROUP BY 1""", "obs"))
def month_totals(t):
    m = t.obs.groupBy("gp_code", (F.dayofmonth("d") % 12 + 1).alias("mon")).agg(F.avg("rain_obs").alias("c"))
    return m.groupBy("gp_code").agg(r4(F.sum("c")).alias("annual"), r4(F.coalesce(F.sum(F.when(F.col("mon").between(6, 9), F.col("c"))), F.lit(0.0))).alias("jjas"))


@query("contrast", "W16", sql(f"""
    SELECT u.gp_code, {R('u.elev - p.e')} AS elev_diff, {R('u.elev / p.e')} AS elev_ratio FROM unit u JOIN (SELECT block_lgd, sum(elev * area_km2) / sum(area_km2) AS e FROM unit GROUP BY 1) p USING (block_lgd)""", "unit"))
def contrast(t):
    parent = t.unit.groupBy("block_lgd").agg((F.sum(F.col("elev") * F.col("area_km2")) / F.sum("area_km2")).alias("e"))
    return t.unit.join(parent, "block_lgd").select("gp_code", r4(F.col("elev") - F.col("e")).alias("elev_diff"), r4(F.col("elev") / F.col("e")).alias("elev_ratio"))


CONS = "(SELECT block_lgd, issue_date, lead_day, sum(pred * area_km2) / sum(area_km2) AS m FROM scored WHERE pred IS NOT NULL GROUP BY 1, 2, 3)"


@query("conserve_rain", "M1", sql(f"""
    SELECT s.gp_code, s.issue_date, s.lead_day, {R('greatest(0.0, CASE WHEN c.m > 1e-6 THEN s.pred * s.fc_rain / c.m ELSE s.fc_rain END)')} AS mass
    FROM scored s JOIN {CONS} c USING (block_lgd, issue_date, lead_day)""", "scored"))
def conserve_rain(t):
    return M.conserve(t.scored, "pred", "fc_rain", "area_km2", "mass", True).select("gp_code", "issue_date", "lead_day", r4("mass").alias("mass"))


@query("conserve_additive", "M1", sql(f"""
    SELECT s.gp_code, s.issue_date, s.lead_day, {R('s.pred + (s.fc_rain - c.m)')} AS mass FROM scored s JOIN {CONS} c USING (block_lgd, issue_date, lead_day)""", "scored"))
def conserve_additive(t):
    return M.conserve(t.scored, "pred", "fc_rain", "area_km2", "mass", False).select("gp_code", "issue_date", "lead_day", r4("mass").alias("mass"))


@query("conservation_report", "A27", sql(f"""
    , g AS (SELECT m - fc_rain AS diff, CASE WHEN abs(fc_rain) > 0.5 THEN abs((m - fc_rain) / fc_rain) END AS rel FROM {CONS} c JOIN fc USING (block_lgd, issue_date, lead_day))
    SELECT {R('avg(abs(diff))')} AS mean_abs_departure, {R('avg(diff)')} AS mean_departure, {R('quantile_cont(rel, 0.5)')} AS median_abs_relative,
      CAST(count(*) AS BIGINT) AS n_parent_forecasts FROM g""", "scored"))
def conservation_report(t):
    out = V.conservation_report(t.scored, "pred", "fc_rain", "area_km2")
    return rounded(out, ["mean_abs_departure", "mean_departure", "median_abs_relative"])


@query("perfect_prognosis_frame", "M19 J3", sql(f"""
    , b AS (SELECT block_lgd, d AS issue_date, d AS valid_date, v AS fc_rain FROM pday), p AS (SELECT gp_code, d, rain_obs FROM obs),
    e AS (SELECT gp_code, d, tmax FROM vars), tr AS (SELECT gp_code, d, p.rain_obs, e.tmax FROM p FULL JOIN e USING (gp_code, d))
    SELECT u.gp_code, b.valid_date, b.fc_rain, tr.rain_obs, tr.tmax FROM b JOIN unit u USING (block_lgd) LEFT JOIN tr ON tr.gp_code = u.gp_code AND tr.d = b.valid_date""",
    "pday", "unit", "vars"))
def perfect_prognosis_frame(t):
    fc = t.pday.select("block_lgd", F.col("d").alias("valid_date"), F.col("v").alias("fc_rain"))
    truth = t.obs.select("gp_code", "d", "rain_obs").join(t.vars.select("gp_code", "d", "tmax"), ["gp_code", "d"], "full_outer")
    df = P.expand_to_units(fc, t.unit).join(truth.withColumnRenamed("d", "valid_date"), ["gp_code", "valid_date"], "left")
    return df.select("gp_code", "valid_date", "fc_rain", "rain_obs", "tmax")


@query("plane_distance", "F3", sql(f"""
    SELECT a.gp_code, {R('sqrt((radians(a.longitude - 73.9) * 6371.0 * cos(radians(18.5))) ** 2 + (radians(a.latitude - 18.5) * 6371.0) ** 2)')} AS km FROM unit a""", "unit"))
def plane_distance(t):
    x, y = C.plane_xy(F.col("latitude"), F.col("longitude"), 18.5)
    x0, y0 = C.plane_xy(F.lit(18.5), F.lit(73.9), 18.5)
    return t.unit.select("gp_code", r4(F.hypot(x - x0, y - y0)).alias("km"))
