"""Polygons, points and lines as tables, joined through integer cell keys.

A ring is ``array<struct<x: double, y: double>>`` (x = longitude, y = latitude), open or closed.  A polygon column
holds a ring, an array of rings (the outer one, then holes), or an array of such polygons; a point is inside where it
is inside an odd number of rings.  Geometry meets geometry only inside a shared cell, so no join compares all pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from finegrid.functions.columns import EARTH_RADIUS_KM, equal_area_xy, ring_area, ring_contains, segment_distance
from finegrid.session import checkpointed, stored


def _cell(v: Column, res: float, origin: float = 0.0) -> Column:
    """Number of the cell whose centre ``origin + k * res`` is nearest."""
    return F.floor((v - origin) / res + 0.5)


def rectangle_ring(x: Column, y: Column, half_x: float | Column, half_y: float | Column) -> Column:
    hx, hy = (h if isinstance(h, Column) else F.lit(float(h)) for h in (half_x, half_y))
    corners = [(x - hx, y - hy), (x + hx, y - hy), (x + hx, y + hy), (x - hx, y + hy)]
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])


def _depth(kind: DataType) -> int:
    return 1 + _depth(kind.elementType) if isinstance(kind, ArrayType) else 0


def with_shape(df: DataFrame, ring: str) -> DataFrame:
    """``df`` with its polygon column as an array of polygons, each an array of rings."""
    c = F.col(ring)
    for _ in range(3 - _depth(df.schema[ring].dataType)):
        c = F.array(c)
    return df.withColumn(ring, F.when(F.col(ring).isNotNull(), c))


def shape_contains(shape: Column, x: Column, y: Column) -> Column:
    return F.aggregate(F.flatten(shape), F.lit(False), lambda odd, ring: odd != ring_contains(ring, x, y))


def area_km2(df: DataFrame, ring: str) -> Column:
    """Area of the polygon column of ``df`` in an equal-area plane, holes taken off."""
    def flat(p):
        x, y = equal_area_xy(p["y"], p["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    def area(polygon):
        rings = F.transform(polygon, lambda r: ring_area(F.transform(r, flat)))
        return 2 * F.coalesce(rings[0], F.lit(0.0)) - F.aggregate(rings, F.lit(0.0), lambda s, v: s + v)

    c = F.col(ring)
    for _ in range(3 - _depth(df.schema[ring].dataType)):
        c = F.array(c)
    return F.aggregate(F.transform(c, area), F.lit(0.0), lambda s, v: s + v)


def representative_point(shape: Column) -> Column:
    """``struct(x, y)`` surely inside a shape (an array of polygons), holes and parts minded; null if it encloses nothing.

    The scan line lies in the middle of the widest gap between heights of vertices, the point in the middle of the
    widest stretch of that line inside.
    """
    def following(r: Column) -> Column:
        return F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))

    rings = F.flatten(shape)
    sides = F.flatten(F.transform(rings, lambda r: F.zip_with(r, following(r), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))))
    heights = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["y"])))
    gaps = F.zip_with(F.slice(heights, 1, F.size(heights) - 1), F.slice(heights, 2, F.size(heights) - 1), lambda a, b: F.struct((b - a).alias("gap"), ((a + b) / 2).alias("y")))

    def on_line(y: Column) -> Column:
        met = F.filter(sides, lambda s: (s["y1"] > y) != (s["y2"] > y))
        xs = F.array_sort(F.transform(met, lambda s: s["x1"] + (y - s["y1"]) * (s["x2"] - s["x1"]) / (s["y2"] - s["y1"])))
        # crossings pair up: the outside ends at the even ones
        inner = F.filter(F.transform(xs, lambda x, i: F.when((i % 2 == 1) & (i > 0), F.struct((x - F.get(xs, i - 1)).alias("w"), ((x + F.get(xs, i - 1)) / 2).alias("x")))), lambda s: s.isNotNull())
        return F.struct(F.array_max(inner)["x"].alias("x"), y.alias("y"))

    y = F.when(F.size(heights) > 1, F.array_max(gaps)["y"])
    return F.when(y.isNotNull(), F.transform(F.array(y), on_line)[0])


def edges(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """``(key, x1, y1, x2, y2)``: the sides of all rings, outer rings turning left and holes right.

    With that, sums over the sides of ``x dy`` give areas with the holes taken off, part by part.
    """
    rings = with_shape(polygons.select(key, ring), ring).select(key, F.explode(ring).alias("polygon")).select(key, F.posexplode("polygon").alias("no", "ring"))

    def next_of(r: Column) -> Column:
        return F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))

    r, x0, y0 = F.col("ring"), F.col("ring")[0]["x"], F.col("ring")[0]["y"]
    twice = F.aggregate(F.zip_with(r, next_of(r), lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0)), F.lit(0.0), lambda s, v: s + v)
    turned = F.when((twice > 0) == (F.col("no") == 0), r).otherwise(F.reverse(r))
    sides = rings.where(F.size("ring") > 2).select(key, turned.alias("r")).select(key, F.explode(F.zip_with("r", next_of(F.col("r")), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))).alias("e"))
    return sides.select(key, "e.*").where("x1 <> x2 OR y1 <> y2")


def _cut(sides: DataFrame, a: str, b: str, cell: str, res: float, origin: float) -> DataFrame:
    """Sides cut where coordinate ``a`` (``b`` follows) passes from cell to cell; ``cell`` numbers the pieces."""
    a1, a2, b1, b2 = F.col(f"{a}1"), F.col(f"{a}2"), F.col(f"{b}1"), F.col(f"{b}2")
    low, high = _cell(F.least(a1, a2), res, origin), _cell(F.greatest(a1, a2), res, origin)
    out = sides.withColumn(cell, F.explode(F.sequence(low, high)))
    floor, ceiling = F.lit(origin) + (F.col(cell) - 0.5) * res, F.lit(origin) + (F.col(cell) + 0.5) * res
    cut = {}
    for n, (ca, cb) in (("1", (a1, b1)), ("2", (a2, b2))):
        at = F.least(F.greatest(ca, floor), ceiling)
        along = F.coalesce(F.try_divide(at - a1, F.nullif(a2 - a1, F.lit(0.0))), F.lit(0.0 if n == "1" else 1.0))
        cut[f"{a}{n}"], cut[f"{b}{n}"] = at, F.when(at == ca, cb).otherwise(b1 + (b2 - b1) * along)
    return out.select(*[c if c not in cut else cut[c].alias(c) for c in out.columns])


# --- covering of polygons by cells -----------------------------------------------------------

#: Inner runs are cut into stretches of 2 ** level cells, up to this level.
LEVELS = 16


def covering(polygons: DataFrame, key: str, ring: str, res: float, origin: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Border cells and inner stretches of every polygon; their rows grow with its outline, not with its area or box.

    Border cells ``(key, ci, cj, sides, odd)`` hold the sides that cross them, and whether their centre is inside.
    Inner stretches ``(key, ci, level, at)`` are runs of ``2 ** level`` cells of a row, from ``at << level`` on, that lie
    wholly inside and need no test.  What is inside follows from the sides that cross a row's centre line further
    east, a running count over the row's border cells, so no outline is tested as a whole.
    """
    side = F.struct("x1", "y1", "x2", "y2").alias("side")
    rows = _cut(edges(polygons, key, ring).select("*", side), "y", "x", "ci", res, origin)
    pieces = _cut(rows, "x", "y", "cj", res, origin)
    cy, cx = F.lit(origin) + F.col("ci") * res, F.lit(origin) + F.col("cj") * res
    # a side counts in the one cell of the row where it crosses the centre line
    crosses = (F.col("side.y1") > cy) != (F.col("side.y2") > cy)
    at = F.col("side.x1") + (cy - F.col("side.y1")) * F.try_divide(F.col("side.x2") - F.col("side.x1"), F.col("side.y2") - F.col("side.y1"))
    here = crosses & (_cell(at, res, origin) == F.col("cj"))
    border = pieces.groupBy(key, "ci", "cj").agg(F.collect_set("side").alias("sides"), F.sum(here.cast("int")).alias("n"), F.sum((here & (at > cx)).cast("int")).alias("own"))
    row = Window.partitionBy(key, "ci").orderBy("cj")
    east = F.coalesce(F.sum("n").over(row.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    border = border.select(key, "ci", "cj", "sides", ((east + F.col("own")) % 2 == 1).alias("odd"), ((east + F.col("n")) % 2 == 1).alias("west_in"), F.lag("cj").over(row).alias("last"))
    runs = border.where("west_in AND cj - last > 1").select(key, "ci", (F.col("last") + 1).alias("a"), F.col("cj").alias("z"))
    return border.select(key, "ci", "cj", "sides", "odd"), _stretches(runs)


def _stretches(runs: DataFrame) -> DataFrame:
    """Runs ``[a, z)`` of a row as stretches ``(level, at)`` of aligned powers of two, at most two of each level."""
    # of level n, the cells that touch the run's ends: [ceil(a / 2 ** n), floor(z / 2 ** n)); odd ends have no pair to join
    levels = f"transform(sequence(0, {LEVELS - 1}), n -> named_struct('n', n, 'lo', shiftright(CAST(a AS BIGINT) + shiftleft(1L, n) - 1, n), 'hi', shiftright(CAST(z AS BIGINT), n)))"
    low = "CASE WHEN s.lo < s.hi AND (s.lo & 1) <> 0 THEN named_struct('level', s.n, 'at', s.lo) END"
    high = "CASE WHEN s.lo < s.hi AND (s.hi & 1) <> 0 AND NOT ((s.lo & 1) <> 0 AND s.lo + 1 = s.hi) THEN named_struct('level', s.n, 'at', s.hi - 1) END"
    first, last = f"shiftright(CAST(a AS BIGINT) + {2 ** LEVELS - 1}, {LEVELS})", f"shiftright(CAST(z AS BIGINT), {LEVELS})"
    whole = f"CASE WHEN {first} < {last} THEN transform(sequence({first}, {last} - 1), x -> named_struct('level', {LEVELS}, 'at', x)) ELSE array() END"
    found = F.expr(f"concat(filter(flatten(transform({levels}, s -> array({low}, {high}))), s -> s IS NOT NULL), {whole})")
    keep = [c for c in runs.columns if c not in ("a", "z")]
    return runs.select(*keep, F.explode(found).alias("s")).select(*keep, "s.level", "s.at")


def in_stretches(cells: DataFrame, stretches: DataFrame, key: str, total: str | None = None) -> DataFrame:
    """Rows of ``cells`` (with ``ci``, ``cj``) with the key of every stretch that holds their cell, by equality of stretch numbers.

    With ``total``, that column summed over the cells of a stretch first: rows ``(key, total)``, one per stretch that holds any.
    """
    levels = sorted(r[0] for r in stretches.select("level").distinct().collect())  # LEVELS + 1 numbers at most
    each = cells.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("at", F.expr("shiftright(cj, level)"))
    if total is not None:
        return each.groupBy("ci", "level", "at").agg(F.sum(total).alias(total)).join(stretches, ["ci", "level", "at"]).select(key, total)
    return each.join(stretches, ["ci", "level", "at"]).select(*cells.columns, key)


def _odd_in_cell(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Whether a point is inside, from a border cell's ``sides`` and centre: crossings on the way there, along the row and then the column."""
    def across(s: Column) -> Column:
        at = s["x1"] + (y - s["y1"]) * F.try_divide(s["x2"] - s["x1"], s["y2"] - s["y1"])
        return ((s["y1"] > y) != (s["y2"] > y)) & ((at > x) != (at > cx))

    def along(s: Column) -> Column:
        at = s["y1"] + (cx - s["x1"]) * F.try_divide(s["y2"] - s["y1"], s["x2"] - s["x1"])
        return ((s["x1"] > cx) != (s["x2"] > cx)) & ((at > y) != (at > cy))

    n = F.size(F.filter("sides", lambda s: F.coalesce(across(s), F.lit(False)))) + F.size(F.filter("sides", lambda s: F.coalesce(along(s), F.lit(False))))
    return (n % 2 == 1) != F.col("odd")


def holders(places: DataFrame, x: str, y: str, cover: tuple[DataFrame, DataFrame], key: str, res: float) -> DataFrame:
    """Rows of ``places`` with the key of every polygon that holds them; only border cells are tested, against their own sides."""
    border, stretches = cover
    cells = places.withColumn("ci", _cell(F.col(y), res)).withColumn("cj", _cell(F.col(x), res))
    tested = cells.join(border, ["ci", "cj"]).where(_odd_in_cell(F.col(x), F.col(y), F.col("cj") * res, F.col("ci") * res))
    return tested.select(*places.columns, key).unionByName(in_stretches(cells, stretches, key).select(*places.columns, key))


# --- polygon and grid ---------------------------------------------------------------------

def cell_areas(polygons: DataFrame, key: str, ring: str, res: float, origin: float = 0.0) -> DataFrame:
    """``(key, ci, cj, a)``: area (km2, equal-area plane) of each polygon in every cell that it meets, one row per cell.

    Sides are cut at cell borders.  In a row of cells, a piece of height ``dy`` adds its own strip to its cell and the
    whole width times ``dy`` to all cells west of it; cells between two outlines get that sum alone, so neither
    outlines nor inner cells are tested against each other, and a long outline is spread over rows of sides.
    """
    sides = _cut(edges(polygons, key, ring), "y", "x", "ci", res, origin).where("y1 <> y2")
    sides = _cut(sides, "x", "y", "cj", res, origin)
    (x1, y1), (x2, y2) = equal_area_xy(F.col("y1"), F.col("x1")), equal_area_xy(F.col("y2"), F.col("x2"))
    west = F.radians(F.lit(origin) + (F.col("cj") - 0.5) * res) * EARTH_RADIUS_KM
    width = math.radians(res) * EARTH_RADIUS_KM
    met = sides.groupBy(key, "ci", "cj").agg(F.sum(((x1 + x2) / 2 - west) * (y2 - y1)).alias("own"), F.sum(y2 - y1).alias("dy"))
    row = Window.partitionBy(key, "ci").orderBy("cj")
    met = met.withColumn("east", F.coalesce(F.sum("dy").over(row.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))).withColumn("last", F.lag("cj").over(row))
    inner = (F.col("east") + F.col("dy")) * width
    between = met.where((F.col("cj") - F.col("last") > 1) & (inner > width * width * 1e-9))
    filled = between.select(key, "ci", F.explode(F.sequence(F.col("last") + 1, F.col("cj") - 1)).alias("cj"), inner.alias("a"))
    return met.select(key, "ci", "cj", (F.col("own") + F.col("east") * width).alias("a")).where("a > 0").unionByName(filled)


def polygon_grid_weights(polygons: DataFrame, key: str, ring: str, res: float, origin: float = 0.0) -> DataFrame:
    """Share of each polygon in every grid cell it meets; shares of a polygon sum to 1, one row per polygon and cell.

    Pieces below a millionth of the polygon are dropped before the shares are taken.
    """
    pieces = cell_areas(polygons, key, ring, res, origin)
    total = pieces.groupBy(key).agg(F.sum("a").alias("_t"))
    kept = pieces.join(total, key).where(F.col("a") / F.col("_t") >= 1e-6).drop("_t")
    total = kept.groupBy(key).agg(F.sum("a").alias("_t"))
    return kept.join(total, key).select(key, "ci", "cj", F.round(F.lit(origin) + F.col("ci") * res, 6).alias("lat"),
                                        F.round(F.lit(origin) + F.col("cj") * res, 6).alias("lon"),
                                        "a", (F.col("a") / F.col("_t")).alias("weight"))


def without_cells(polygons: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Polygons that meet no cell of the grid."""
    return polygons.join(weights.select(key).distinct(), key, "left_anti")


def overlap_areas(a: DataFrame, a_key: str, b: DataFrame, b_key: str, ring: str, res: float) -> DataFrame:
    """``(a_key, b_key, a)``: exact shared area (km2, equal-area plane) of polygons that share any.

    The region below a side, taken with the side's direction, summed over all sides makes the polygon; so the shared
    area is the sum, over sides of both that lie over one another, of the area below the lower of the two.  Pairs of
    polygons meet in the cells (width ``res``) of their coverings, their sides in strips of that width.
    """
    def strips(df: DataFrame, key: str, name: str) -> DataFrame:
        cut = _cut(edges(df, key, ring).where("x1 <> x2"), "x", "y", "strip", res, 0.0).where("x1 <> x2")
        x1, y1 = equal_area_xy(F.col("y1"), F.col("x1"))
        x2, y2 = equal_area_xy(F.col("y2"), F.col("x2"))
        east = F.col("x2") > F.col("x1")  # outer rings turn left: their upper sides run west
        ends = F.when(east, F.struct(x1.alias("p"), y1.alias("u"), x2.alias("q"), y2.alias("v"))).otherwise(F.struct(x2.alias("p"), y2.alias("u"), x1.alias("q"), y1.alias("v")))
        return cut.select(key, "strip", F.when(east, -1.0).otherwise(1.0).alias(f"{name}s"), ends.alias(name))

    # polygons that share any area meet in a border cell of both, or one has a border cell well inside the other
    (a_border, a_inner), (b_border, b_inner) = _cover(a, a_key, ring, res), _cover(b, b_key, ring, res)
    a_cells, b_cells = a_border.select(a_key, "ci", "cj"), b_border.select(b_key, "ci", "cj")
    met = a_cells.join(b_cells, ["ci", "cj"]).select(a_key, b_key)
    pairs = met.unionByName(in_stretches(a_cells, b_inner, b_key).select(a_key, b_key)).unionByName(in_stretches(b_cells, a_inner, a_key).select(a_key, b_key)).distinct()
    both = pairs.join(strips(a, a_key, "f"), a_key).join(strips(b, b_key, "g"), [b_key, "strip"])
    lo, hi = F.greatest("f.p", "g.p"), F.least("f.q", "g.q")
    at = lambda side, x: F.col(f"{side}.u") + (F.col(f"{side}.v") - F.col(f"{side}.u")) * (x - F.col(f"{side}.p")) / (F.col(f"{side}.q") - F.col(f"{side}.p"))
    over = both.select(a_key, b_key, (F.col("fs") * F.col("gs")).alias("sign"), (hi - lo).alias("w"), at("f", lo).alias("f0"), at("f", hi).alias("f1"), at("g", lo).alias("g0"), at("g", hi).alias("g1"), F.least("f.u", "f.v", "g.u", "g.v").alias("least")).where("w > 0")
    # below the lower of two lines: that of the means, less the triangle pair where they cross
    d0, d1 = F.col("f0") - F.col("g0"), F.col("f1") - F.col("g1")
    crossed = F.when(d0 * d1 < 0, (d0 * d0 + d1 * d1) / (F.abs(d0) + F.abs(d1)) / 2).otherwise((F.abs(d0) + F.abs(d1)) / 2)
    below = F.col("w") * ((F.col("f0") + F.col("f1") + F.col("g0") + F.col("g1")) / 2 - crossed) / 2
    shared = over.groupBy(a_key, b_key).agg(F.sum(F.col("sign") * below).alias("a"))
    return shared.where(F.col("a") > 1e-9)


def largest_overlap(a: DataFrame, a_key: str, b: DataFrame, b_key: str, ring: str, res: float, shared: DataFrame | None = None) -> DataFrame:
    """For each polygon of ``a`` the polygon of ``b`` that shares most of it, its share of all that is shared, and how it was found.

    ``assignment_method`` is ``largest_overlap``, or ``nearest`` with share 0 where nothing is shared: then the polygon
    of ``b`` whose outline is nearest to a corner.  Only an empty ``b`` leaves a polygon without (``none``).
    ``shared`` hands over :func:`overlap_areas` where it is at hand already.
    """
    per = checkpointed(overlap_areas(a, a_key, b, b_key, ring, res)) if shared is None else shared
    best = per.groupBy(a_key).agg(F.min(F.struct((-F.col("a")).alias("_m"), F.col(b_key))).alias("_b"), F.sum("a").alias("_t"))
    best = best.select(a_key, F.col(f"_b.{b_key}").alias(b_key), (-F.col("_b._m") / F.col("_t")).alias("overlap_frac"), F.lit("largest_overlap").alias("assignment_method"))
    lost = checkpointed(a.join(best, a_key, "left_anti").select(a_key, ring))
    if lost.isEmpty():
        return best
    corners = edges(lost, a_key, ring).select(F.col(a_key).alias("_a"), F.col("x1").alias("x"), F.col("y1").alias("y")).withColumn("qid", F.struct("_a", "x", "y"))
    outlines = edges(b, b_key, ring).select(F.col(b_key).alias("tid"), F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"))
    near = nearest_k(corners, outlines, 1).groupBy(F.col("qid._a").alias(a_key)).agg(F.min(F.struct("dist", "tid")).alias("_n"))
    method = F.when(F.col("_n").isNull(), "none").otherwise("nearest")
    return best.unionByName(lost.select(a_key).join(near, a_key, "left").select(a_key, F.col("_n.tid").alias(b_key), F.lit(0.0).alias("overlap_frac"), method.alias("assignment_method")))


# --- points -------------------------------------------------------------------------------

def points_in_polygons(points: DataFrame, x: str, y: str, polygons: DataFrame, key: str, ring: str, res: float, count: str | None = None, weight: str | None = None) -> DataFrame:
    """Every point with every polygon that holds it; points outside all are left out.

    With ``count``, one row ``(key, count)`` per polygon that holds any: pairs are never listed. A cell's points are
    tested once per different course of sides through it, and counts go to the polygons that have it.  ``weight`` names
    a column of the points that is summed instead.
    """
    cover = _cover(polygons, key, ring, res)
    if count is None:
        return holders(points, x, y, cover, key, res)
    places = _spread(points.select(F.col(x).alias("_x"), F.col(y).alias("_y"), *([] if weight is None else [F.col(weight).alias("_w")])).groupBy("_x", "_y").agg((F.count("*") if weight is None else F.sum("_w")).alias("_n")))
    cells = places.withColumn("ci", _cell(F.col("_y"), res)).withColumn("cj", _cell(F.col("_x"), res))
    border = stored(cover[0].withColumn("sides", F.array_sort("sides")), "border")
    course = border.groupBy("ci", "cj", "sides", "odd").agg(F.min(key).alias("_c"))
    tested = cells.join(course, ["ci", "cj"]).where(_odd_in_cell(F.col("_x"), F.col("_y"), F.col("cj") * res, F.col("ci") * res)).groupBy("ci", "cj", "_c").agg(F.sum("_n").alias("_n"))
    on_border = border.join(course, ["ci", "cj", "sides", "odd"]).select(key, "ci", "cj", "_c").join(tested, ["ci", "cj", "_c"]).select(key, "_n")
    full = in_stretches(cells.groupBy("ci", "cj").agg(F.sum("_n").alias("_n")), cover[1], key, "_n").select(key, "_n")
    return on_border.unionByName(full).groupBy(key).agg(F.sum("_n").alias(count))


def point_in_polygon(points: DataFrame, x: str, y: str, polygons: DataFrame, key: str, ring: str, res: float) -> DataFrame:
    """Every point with the polygon that holds it (the least key if several do), else NULL.

    Places are looked up once and joined back, so points in one place cost one test and stay as many rows.
    """
    places = _spread(points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).distinct())
    found = holders(places, "_x", "_y", _least(_cover(polygons, key, ring, res), key), key, res).groupBy("_x", "_y").agg(F.min(key).alias(key))
    return points.join(found, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left").drop("_x", "_y")


def _spread(places: DataFrame) -> DataFrame:
    """Places over as many tasks as the session shuffles into: tests cost far more per row than its bytes suggest."""
    return places.repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_x", "_y")


def _least(cover: tuple[DataFrame, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """A covering for those who ask for the least key only: polygons that run alike through a cell, or fill the same stretch, answer alike."""
    border, stretches = cover
    return (border.groupBy("ci", "cj", F.array_sort("sides").alias("sides"), "odd").agg(F.min(key).alias(key)),
            stretches.groupBy("ci", "level", "at").agg(F.min(key).alias(key)))


def _cover(polygons: DataFrame, key: str, ring: str, res: float) -> tuple[DataFrame, DataFrame]:
    border, stretches = covering(polygons.select(key, ring), key, ring, res)
    return border, checkpointed(stretches)


def stations_in_units(stations: DataFrame, key: str, x: str, y: str, units: DataFrame, unit: str, ring: str, res: float) -> tuple[DataFrame, DataFrame]:
    """Rows of the stations inside a unit, with the unit; and the stations outside all units, with their number of rows."""
    placed = point_in_polygon(stations, x, y, units, unit, ring, res)
    outside = placed.where(F.col(unit).isNull()).groupBy(key).agg(F.count("*").alias("rows"))
    return placed.where(F.col(unit).isNotNull()), outside


def locate(points: DataFrame, point_id: str, x: str, y: str, polygons: DataFrame, key: str, ring: str, cap: float) -> DataFrame:
    """The polygon that holds a point, else the nearest one within ``cap``, else nothing.

    With cells as wide as the cap, the nearest place of an outline in reach lies in the 3 x 3 cells around the point,
    and so does a side that is listed there.  Points in one place are looked up once, and polygons whose sides run
    alike through a cell, of which only the least key can be answered, are tested once.
    """
    border, stretches = _least(_cover(polygons, key, ring, cap), key)
    border = stored(border, "border")
    pts = _spread(points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).distinct())
    inside = holders(pts, "_x", "_y", (border, stretches), key, cap).select("_x", "_y", key, F.lit(0.0).alias("d"))
    around = lambda c, v: F.explode(F.sequence(_cell(v, cap) - 1, _cell(v, cap) + 1)).alias(c)
    # side by side, so that distances are compiled code; of polygons with a side in common the least key is enough
    lines = border.select("ci", "cj", key, F.explode("sides").alias("s")).groupBy("ci", "cj", "s").agg(F.min(key).alias(key)).select("ci", "cj", key, "s.*")
    near = pts.select("*", around("ci", F.col("_y"))).select("*", around("cj", F.col("_x"))).join(lines, ["ci", "cj"])
    d = segment_distance(F.col("_x"), F.col("_y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    pair = near.select("_x", "_y", key, d.alias("d")).where(F.col("d") <= cap).unionByName(inside)
    best = pair.groupBy("_x", "_y").agg(F.min(F.struct(F.col("d"), F.col(key))).alias("_b"))
    found = points.join(best, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left")
    how = F.when(F.col("_b").isNull(), "none").when(F.col("_b.d") == 0, "contains").otherwise("nearest")
    return found.select(point_id, F.col(f"_b.{key}").alias(key), how.alias("how"), F.col("_b.d").alias("distance"))


def _search_cells(targets: DataFrame, k: int, fan: int) -> tuple[list[float], list[tuple[int, int]]]:
    """Cell widths from the whole extent down to cells that hold few targets each, and the (at most four) widest cells.

    One row of counts and extents, then one row per trial width, reach the driver.
    """
    s = targets.agg(F.count("*").alias("n"), F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"),
                    F.max("my").alias("y1")).first()
    if not s["n"]:
        return [1.0], [(0, 0)]
    extent = max(s["x1"] - s["x0"], s["y1"] - s["y0"], 1e-9)
    depth = max(0, math.ceil(math.log(max(1.0, s["n"] / (4 * k)), fan * fan)))
    while depth < 12:
        size = extent / fan**depth
        crowd = targets.groupBy(F.floor(F.col("my") / size), F.floor(F.col("mx") / size)).agg(F.count("*").alias("n"))
        if crowd.agg(F.max("n")).first()[0] <= 64 * k:
            break
        depth += 1
    # widest cells are numbered like the parents of the finest ones, whatever rounding did to the widths
    finest, ratio = extent / fan**depth, fan**depth
    rows = range(math.floor(s["y0"] / finest) // ratio, math.floor(s["y1"] / finest) // ratio + 1)
    cols = range(math.floor(s["x0"] / finest) // ratio, math.floor(s["x1"] / finest) // ratio + 1)
    return [extent / fan**i for i in range(depth + 1)], [(i, j) for i in rows for j in cols]


def nearest_k(queries: DataFrame, targets: DataFrame, k: int, fan: int = 4) -> DataFrame:
    """The ``k`` nearest targets of every query as rows ``(qid, tid, dist, pos)``; ties go to the lesser ``tid``.

    ``queries`` has qid, x, y; ``targets`` has tid and a segment ax, ay, bx, by (a point
    repeats its coordinates).  The search walks down a pyramid of cells that know their
    target count and bounding box.  On each level a query keeps only cells that can still
    hold one of its k nearest: those not farther than the distance within which the
    nearest boxes surely hold k targets.  So a query carries a handful of cells, however
    the targets cluster, and meets targets only in the finest cells left.
    """
    # among targets in one place only the k least ids can win; the rank filter runs before the shuffle too
    place = Window.partitionBy("ax", "ay", "bx", "by").orderBy("tid")
    src = targets.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r")
    src = src.withColumn("mx", (F.col("ax") + F.col("bx")) / 2).withColumn("my", (F.col("ay") + F.col("by")) / 2)
    spots = queries.select("x", "y").distinct()
    sizes, widest = _search_cells(src, k, fan)
    finest = sizes[-1]
    src = src.withColumn("ci", F.floor(F.col("my") / finest)).withColumn("cj", F.floor(F.col("mx") / finest))
    boxes = src.groupBy("ci", "cj").agg(
        F.count("*").alias("n"), F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"),
        F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"))
    levels = [boxes]
    for _ in sizes[1:]:
        up = levels[0].groupBy(F.floor(F.col("ci") / fan).alias("ci"), F.floor(F.col("cj") / fan).alias("cj")).agg(
            F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        levels.insert(0, up)
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("pi"), F.lit(j).cast("long").alias("pj")) for i, j in widest])
    cand = spots.withColumn("c", F.explode(cells)).select("x", "y", "c.pi", "c.pj")
    for level in levels[1:]:
        child = level.withColumn("pi", F.floor(F.col("ci") / fan)).withColumn("pj", F.floor(F.col("cj") / fan))
        pair = cand.join(child, ["pi", "pj"])
        zero = F.lit(0.0)
        dmin = F.hypot(F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), zero),
                       F.greatest(F.col("y0") - F.col("y"), F.col("y") - F.col("y1"), zero))
        dmax = F.hypot(F.greatest(F.col("x1") - F.col("x"), F.col("x") - F.col("x0")), F.greatest(F.col("y1") - F.col("y"), F.col("y") - F.col("y0")))
        pair = pair.select("x", "y", "ci", "cj", "n", dmin.alias("dmin"), dmax.alias("dmax"))
        per_query = Window.partitionBy("x", "y")
        upto = F.sum("n").over(per_query.orderBy("dmax").rangeBetween(Window.unboundedPreceding, 0))
        pair = pair.withColumn("_sure", F.when(upto >= k, F.col("dmax")))
        pair = pair.withColumn("_sure", F.min("_sure").over(per_query))
        cand = pair.where(F.col("_sure").isNull() | (F.col("dmin") <= F.col("_sure") * (1 + 1e-12))).select(
            "x", "y", F.col("ci").alias("pi"), F.col("cj").alias("pj"))
    d = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    pairs = cand.select("x", "y", F.col("pi").alias("ci"), F.col("pj").alias("cj")).join(src, ["ci", "cj"]).select("x", "y", "tid", d.alias("dist"))
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("dist", "tid"))
    best = pairs.withColumn("pos", rank).where(F.col("pos") <= k)
    return queries.select("qid", "x", "y").join(best, ["x", "y"]).select("qid", "tid", "dist", "pos")


def points_as_targets(df: DataFrame, tid: str, x: str, y: str) -> DataFrame:
    px, py = F.col(x), F.col(y)
    return df.select(F.col(tid).alias("tid"), px.alias("ax"), py.alias("ay"), px.alias("bx"), py.alias("by"))


def nearest_fill(df: DataFrame, key: str, x: str, y: str, value: str) -> DataFrame:
    """Missing values taken from the nearest row that has one."""
    known = df.where(F.col(value).isNotNull())
    gaps = df.where(F.col(value).isNull()).select(F.col(key).alias("qid"), F.col(x).alias("x"), F.col(y).alias("y"))
    near = nearest_k(gaps, points_as_targets(known, key, x, y), 1).select(F.col("qid").alias(key), F.col("tid").alias("source"))
    donor = known.select(F.col(key).alias("source"), F.col(value).alias("_v"))
    filled = near.join(donor, "source").select(key, "source", "_v")
    return df.join(filled, key, "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")


# --- lines --------------------------------------------------------------------------------

def line_distance(points: DataFrame, point_id: str, x: str, y: str, segments: DataFrame) -> DataFrame:
    """Distance of every point to the nearest segment (segments: tid, ax, ay, bx, by)."""
    q = points.select(F.col(point_id).alias("qid"), F.col(x).alias("x"), F.col(y).alias("y"))
    return nearest_k(q, segments, 1).select(F.col("qid").alias(point_id), F.col("tid").alias("segment"), "dist")


def side_of_line(points: DataFrame, point_id: str, x: str, y: str, vertices: DataFrame, lat: str, lon: str, bucket: float) -> DataFrame:
    """+1 for points at or east of a south-north line, -1 west of it; the end longitudes extend beyond both ends.

    ``vertices`` has one row per latitude.  Each stretch is entered in the latitude
    buckets it spans, so a point meets only the stretches of its own bucket.
    """
    order = Window.orderBy(lat)  # one traced line: one vertex per raster row
    parts = vertices.select(F.col(lat).alias("la"), F.col(lon).alias("lo"), F.lead(lat).over(order).alias("lb"), F.lead(lon).over(order).alias("lob"))
    ends = vertices.agg(F.struct(F.min_by(lon, lat).alias("lo0"), F.min(lat).alias("la0"), F.max_by(lon, lat).alias("lo1"), F.max(lat).alias("la1"))).scalar()
    parts = parts.where("lb is not null").withColumn("_b", F.explode(F.sequence(F.floor(F.col("la") / bucket), F.floor(F.col("lb") / bucket))))
    p = points.select(point_id, x, y).withColumn("_b", F.floor(F.col(y) / bucket))
    inside = (F.col(y) >= F.col("la")) & (F.col(y) < F.col("lb"))
    at = F.when(inside, F.col("lo") + (F.col("lob") - F.col("lo")) * (F.col(y) - F.col("la")) / (F.col("lb") - F.col("la")))
    hit = p.join(parts, "_b", "left").groupBy(point_id, x, y).agg(F.max(at).alias("_x"))
    hit = hit.withColumn("_e", ends)
    line_x = F.coalesce(F.when(F.col(y) < F.col("_e.la0"), F.col("_e.lo0")), F.when(F.col(y) >= F.col("_e.la1"), F.col("_e.lo1")), F.col("_x"))
    return hit.select(point_id, F.when(F.col(x) >= line_x, 1).otherwise(-1).alias("side"))


def line_density(segments: DataFrame, polygons: DataFrame, key: str, ring: str, area: str, step: float, res: float) -> DataFrame:
    """Length of lines inside each polygon per unit area; lines are cut into pieces of at most ``step``.

    A piece counts in every polygon that holds its middle, however many overlap there.
    """
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    n = F.greatest(F.lit(1), F.ceil(length / step).cast("int"))
    cut = segments.withColumn("_n", n).withColumn("_len", length / n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = (F.col("_k") + 0.5) / F.col("_n")
    mid = cut.select("tid", "_k", "_len", (F.col("ax") + f * (F.col("bx") - F.col("ax"))).alias("mx"), (F.col("ay") + f * (F.col("by") - F.col("ay"))).alias("my"))
    total = points_in_polygons(mid, "mx", "my", polygons, key, ring, res, count="length", weight="_len")
    out = polygons.select(key, area).join(total, key, "left").withColumn("length", F.coalesce("length", F.lit(0.0)))
    return out.select(key, "length", (F.col("length") / F.col(area)).alias("density"))


# --- polygon records ----------------------------------------------------------------------

def _followed(sides: DataFrame, key: str) -> DataFrame:
    """``sides`` (key, id, x1 .. y2) with the ``next`` side of its outline: of those that start where it ends, the one most to the left.

    So pieces that touch in one corner become outlines of their own.
    """
    ahead = sides.select(F.col(key).alias("_k"), F.col("id").alias("next"), F.col("x1").alias("_x"), F.col("y1").alias("_y"), (F.col("x2") - F.col("x1")).alias("_u"), (F.col("y2") - F.col("y1")).alias("_v"))
    met = sides.join(ahead, (F.col(key) == F.col("_k")) & (F.col("x2") == F.col("_x")) & (F.col("y2") == F.col("_y")))
    u, v = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.atan2(u * F.col("_v") - v * F.col("_u"), u * F.col("_u") + v * F.col("_v"))
    # straight back (half a turn) is the last choice, whichever sign rounding gives it
    left = F.when(F.abs(turn) > math.pi - 1e-9, F.lit(-math.pi)).otherwise(turn)
    return met.groupBy("id").agg(F.max_by("next", F.struct(left, F.col("next"))).alias("next"))


def outlines(sides: DataFrame, key: str, max_rounds: int = 64) -> DataFrame:
    """``(key, ring)`` for every closed outline of directed sides ``(key, x1, y1, x2, y2)``, by pointer jumping.

    First the least id of every outline goes round it, then every side learns how far it is from that one; both by
    pointers that double their reach, so rounds grow with the logarithm of the longest outline, whatever shape holds it.
    Each round is one join of two numbers per side.
    """
    given = stored(sides.distinct().withColumn("id", F.monotonically_increasing_id()), "sides")
    follow = _followed(given, key)
    now = stored(follow.select("id", F.col("next").alias("to"), F.least("id", "next").alias("least")), "round")
    step = now.select("id", F.col("to").alias("next"))
    mark = None
    for _ in range(max_rounds):
        there = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        now = stored(now.join(there, "to").select("id", F.col("to2").alias("to"), F.least("least", "least2").alias("least")), "round")
        seen = now.agg(F.sum(F.col("least").cast("decimal(38,0)"))).first()[0]
        if seen == mark:
            break
        mark = seen
    leader = now.select("id", F.col("least").alias("ring"))
    now = stored(step.join(leader, "id").select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.lit(1).cast("long").alias("far")), "round")
    for _ in range(max_rounds):
        if now.where("to IS NOT NULL").limit(1).count() == 0:
            break
        there = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        now = stored(now.join(there, "to", "left").select("id", "ring", F.col("to2").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far")), "round")
    placed = given.join(now.select("id", "ring", "far"), "id")
    point = F.struct((-F.col("far")).alias("at"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    ordered = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rings = placed.groupBy(key, F.col("ring").alias("_r")).agg(ordered.alias("ring"))
    first = F.array_position("ring", F.array_min("ring")).cast("int")  # outlines begin at their least corner
    return rings.select(key, F.concat(F.slice("ring", first, F.size("ring")), F.slice("ring", 1, first - 1)).alias("ring"))


def union_shapes(parts: DataFrame, key: str, ring: str) -> DataFrame:
    """``(key, ring)``: the union of all parts of a key as an array of polygons, each its outer ring and then its holes.

    Parts may share borders but not overlap, and a shared border has the same vertices in both.  Sides that occur in
    both directions cancel; what is left is stitched into outlines (`outlines`).  Those that turn left are outer
    rings; a hole goes to the least outer ring that holds it.  A key without any area has no row.
    """
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    low, high = F.struct("x1", "y1"), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    net = edges(parts, key, ring).groupBy(key, F.when(forward, low).otherwise(high).alias("p"), F.when(forward, high).otherwise(low).alias("q")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("n")).where("n <> 0")
    from_, to = F.when(F.col("n") > 0, F.col("p")).otherwise(F.col("q")), F.when(F.col("n") > 0, F.col("q")).otherwise(F.col("p"))
    rest = net.select(key, from_["x1"].alias("x1"), from_["y1"].alias("y1"), to["x1"].alias("x2"), to["y1"].alias("y2"))
    r = F.col("ring")
    turned = F.aggregate(F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda a, b: (a["x"] - r[0]["x"]) * (b["y"] - r[0]["y"]) - (b["x"] - r[0]["x"]) * (a["y"] - r[0]["y"])), F.lit(0.0), lambda s, v: s + v)
    rings = stored(outlines(rest, key).withColumn("twice", turned).withColumn("no", F.monotonically_increasing_id()), "rings")
    outer, holes = rings.where("twice > 0"), rings.where("twice < 0")
    spot = holes.select(F.col(key).alias("_k"), F.col("ring").alias("_hole"), F.col("no").alias("_no"), representative_point(F.array(F.array("ring"))).alias("_p"), F.col("twice").alias("_t"))
    held = outer.join(spot, (F.col(key) == F.col("_k")) & (F.col("twice") > -F.col("_t"))).where(ring_contains(F.col("ring"), F.col("_p.x"), F.col("_p.y")))
    owner = held.groupBy("_no").agg(F.min_by(F.struct("no", "_hole"), "twice").alias("o")).groupBy(F.col("o.no").alias("no")).agg(F.array_sort(F.collect_list("o._hole")).alias("_holes"))
    polygon = F.concat(F.array("ring"), F.coalesce("_holes", F.array().cast(f"array<{rings.schema['ring'].dataType.simpleString()}>")))
    return outer.join(owner, "no", "left").groupBy(key).agg(F.array_sort(F.collect_list(polygon)).alias(ring))


def dissolve(parts: DataFrame, key: str, order: str, attributes: list[str], ring: str | None = None) -> DataFrame:
    """One record per polygon: the attributes of its first part, the number of parts, and with ``ring`` the union of their shapes (`union_shapes`).

    Texts and records can't be kept in a hash aggregate, so Spark sorts for them.  Parts are dealt by polygon first: they
    are sorted once, in partitions of the shuffle, and not also in every scan task, whose rows grow with few bytes.
    """
    rows = parts.select(key, order, *[a for a in attributes if a not in (key, order)]).repartition(F.col(key)) if attributes else parts
    records = rows.groupBy(key).agg(*[F.min_by(a, order).alias(a) for a in attributes], F.count("*").alias("parts"))
    return records if ring is None else records.join(union_shapes(parts, key, ring), key, "left")


__all__ = ["area_km2", "cell_areas", "covering", "dissolve", "edges", "largest_overlap", "line_density", "line_distance", "locate",
           "holders", "in_stretches", "nearest_fill", "nearest_k", "outlines", "overlap_areas", "point_in_polygon", "points_as_targets", "points_in_polygons", "polygon_grid_weights", "rectangle_ring", "representative_point", "shape_contains",
           "side_of_line", "stations_in_units", "union_shapes", "with_shape", "without_cells"]
