"""Cell tables ``(t, i, j, value)``: weighting to polygons, zonal and focal statistics, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from finegrid.functions.scores import null_aware_mean
from finegrid.operators.relational import exact_quantiles
from finegrid.session import checkpointed


# --- grids and cubes ----------------------------------------------------------------------

def grid_covering(bbox: DataFrame, res: float, origin: float = 0.0) -> DataFrame:
    """Cells whose centres sit on ``origin + k * res`` and whose edges cover each bounding box.

    ``bbox`` has west, south, east and north; the result numbers rows (i, south to
    north) and columns (j, west to east) from 0 and gives centres and half width.
    """
    def first(lo: str) -> Column:
        return F.floor((F.col(lo) - origin) / res + 0.5) - 1

    def last(hi: str) -> Column:
        return F.ceil((F.col(hi) - origin) / res - 0.5) + 1

    b = bbox.select(first("south").alias("i0"), last("north").alias("i1"), first("west").alias("j0"), last("east").alias("j1"))
    rows = b.select("i0", "j0", "j1", F.explode(F.sequence("i0", "i1")).alias("ki"))
    cells = rows.select("i0", "j0", "ki", F.explode(F.sequence("j0", "j1")).alias("kj"))
    return cells.select((F.col("ki") - F.col("i0")).cast("int").alias("i"), (F.col("kj") - F.col("j0")).cast("int").alias("j"),
                        F.round(F.lit(origin) + F.col("ki") * res, 6).alias("lat"), F.round(F.lit(origin) + F.col("kj") * res, 6).alias("lon"),
                        F.lit(res / 2).alias("half"))


def cube_to_long(df: DataFrame, keys: list[str], values: str, n_cols: int) -> DataFrame:
    """One row per cell of a flattened (row-major) field."""
    flat = df.select(*keys, F.posexplode(values).alias("pos", "value"))
    return flat.select(*keys, F.floor(F.col("pos") / n_cols).cast("int").alias("i"), (F.col("pos") % n_cols).alias("j"), "value")


def crop(cells: DataFrame, lat: str, lon: str, south: float, north: float, west: float, east: float, res: float) -> DataFrame:
    """Cells whose centre lies in the box widened by half a cell: a plain range filter, so it is pushed down."""
    h = res / 2
    return cells.where(F.col(lat).between(south - h, north + h) & F.col(lon).between(west - h, east + h))


def nearest_cell(lat: Column, lon: Column, lat0: float, lon0: float, res: float, n_rows: int, n_cols: int) -> tuple[Column, Column]:
    """Row and column of the cell nearest to a point, clamped to the grid."""
    def index(v: Column, v0: float, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.bround((v - v0) / res).cast("int")))

    return index(lat, lat0, n_rows), index(lon, lon0, n_cols)


def drop_empty_steps(cells: DataFrame, step: str, value: str) -> DataFrame:
    """Without the time steps at which every cell is missing."""
    return cells.join(cells.where(F.col(value).isNotNull()).select(step).distinct(), step, "left_semi")


# --- polygons -----------------------------------------------------------------------------

def weighted_mean(cells: DataFrame, weights: DataFrame, by: list[str], values: list[str], min_covered: float = 1e-9) -> DataFrame:
    """Mean per polygon and time step over known cells, weights renormalised, all values in one pass.

    The join is on integer cell numbers; products are summed before the shuffle.
    """
    joined = cells.join(weights, ["i", "j"])
    return joined.groupBy(*by).agg(*[null_aware_mean(F.col(v), F.col("weight"), min_covered).alias(v) for v in values])


def weighted_sum(cells: DataFrame, weights: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Plain weighted sum: a missing cell lowers the result and an all-missing polygon gives 0."""
    joined = cells.join(weights, ["i", "j"])
    return joined.groupBy(*by).agg(*[F.coalesce(F.sum(F.col(v) * F.col("weight")), F.lit(0.0)).alias(v) for v in values])


def zonal_stats(cells: DataFrame, zone: str, value: str) -> DataFrame:
    """Mean, population deviation, count, extremes and exact 90th percentile of known cells."""
    stats = cells.groupBy(zone).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"),
                                    F.min(value).alias("min"), F.max(value).alias("max"))
    return stats.join(exact_quantiles(cells, [zone], value, {"p90": 0.9}), zone, "left")


def masked_zonal(cells: DataFrame, zone: str, tile: str, value: str, quality: str, accepted: list[int]) -> DataFrame:
    """Zonal mean of cells with an accepted quality code; tile sums are combined."""
    good = cells.where(F.col(quality).isin(accepted) & F.col(value).isNotNull())
    tiles = good.groupBy(zone, tile).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return tiles.groupBy(zone).agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"), F.count("*").alias("tiles"))


def class_fractions(cells: DataFrame, zone: str, cls: str, classes: dict[int, str], composites: dict[str, list[str]]) -> DataFrame:
    """Percentage of each class among valid cells, composite classes, and the valid share of all cells."""
    counts = cells.groupBy(zone, cls).agg(F.count("*").alias("_n"))
    valid = F.sum(F.when(F.col(cls).isNotNull(), F.col("_n")).otherwise(0))
    pct = [(100.0 * F.sum(F.when(F.col(cls) == code, F.col("_n")).otherwise(0)) / F.greatest(F.lit(1), valid)).alias(f"{n}_pct")
           for code, n in classes.items()]
    wide = counts.groupBy(zone).agg((valid / F.sum("_n")).alias("valid_frac"), F.sum("_n").alias("cells"), *pct)
    for name, parts in composites.items():
        wide = wide.withColumn(f"{name}_pct", sum((F.col(f"{p}_pct") for p in parts), F.lit(0.0)))
    return wide


def dominant_label(weights: DataFrame, cell: list[str], label: str, area: str) -> DataFrame:
    """Label with the largest area in each cell (the smaller label on a tie) and its share."""
    per = weights.groupBy(*cell, label).agg(F.sum(area).alias("_a"))
    best = per.groupBy(*cell).agg(F.max(F.struct(F.col("_a"), (-F.col(label)).alias("_l"))).alias("_b"), F.sum("_a").alias("_t"))
    return best.select(*cell, (-F.col("_b._l")).alias(label), (F.col("_b._a") / F.col("_t")).alias("share"))


def paint_parent(cells: DataFrame, cell_parent: DataFrame, parent_day: DataFrame, cell: list[str], parent: str, day: str,
                 value: str) -> DataFrame:
    """Parent value on every cell of its dominant parent; 0 outside and where the value is missing."""
    return (cells.join(cell_parent.select(*cell, parent), cell, "left").join(parent_day.select(parent, day, value), [parent, day], "left")
            .withColumn(value, F.coalesce(value, F.lit(0.0))))


# --- focal operators ----------------------------------------------------------------------

def _edge(value: Column, shift, w: Window, marker: str) -> Column:
    """Neighbour along a window; beyond the edge the cell itself (edge replication)."""
    return F.when(shift(F.col(marker)).over(w).isNull(), value).otherwise(shift(value).over(w))


def slope_aspect(cells: DataFrame, step: str, value: str, res: float) -> DataFrame:
    """Slope and downslope aspect in degrees from the 3 x 3 neighbourhood (Horn 1981).

    Rows count from north to south.  Two windows, along rows and along columns, hold
    one line of cells each.
    """
    along_row, along_col = Window.partitionBy(step, "i").orderBy("j"), Window.partitionBy(step, "j").orderBy("i")
    z = F.col(value)
    df = cells.withColumn("_w", _edge(z, F.lag, along_row, "j")).withColumn("_e", _edge(z, F.lead, along_row, "j"))
    df = df.withColumn("_r", F.struct("_w", value, "_e"))
    df = df.withColumn("_n", _edge(F.col("_r"), F.lag, along_col, "i")).withColumn("_s", _edge(F.col("_r"), F.lead, along_col, "i"))

    def g(row: str, side: str) -> Column:
        return F.col(f"{row}.{side}")

    dzdx = ((g("_n", "_e") + 2 * F.col("_e") + g("_s", "_e")) - (g("_n", "_w") + 2 * F.col("_w") + g("_s", "_w"))) / (8 * res)
    dzdy = ((g("_s", "_w") + 2 * g("_s", value) + g("_s", "_e")) - (g("_n", "_w") + 2 * g("_n", value) + g("_n", "_e"))) / (8 * res)
    df = df.withColumn("_dx", dzdx).withColumn("_dy", dzdy)
    steep = F.hypot("_dx", "_dy")
    aspect = F.pmod(F.degrees(F.atan2(-F.col("_dx"), F.col("_dy"))) + 360.0, F.lit(360.0))
    return df.select(step, "i", "j", F.degrees(F.atan(steep)).alias("slope"), F.when(steep >= 1e-6, aspect).alias("aspect"))


def box_mean(cells: DataFrame, step: str, value: str, radius: int, out: str) -> DataFrame:
    """Mean of known cells in a square box; the border line is repeated beyond the edge.

    Separable: a moving sum along rows, then along columns.
    """
    def moving(df: DataFrame, line: str, pos: str, cols: list[str]) -> DataFrame:
        w = Window.partitionBy(step, line).orderBy(pos)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        box = w.rangeBetween(-radius, radius)
        before = F.greatest(F.lit(0), radius - (F.col(pos) - F.min(pos).over(whole)))
        after = F.greatest(F.lit(0), radius - (F.max(pos).over(whole) - F.col(pos)))
        sums = [(F.sum(c).over(box) + before * F.first(c).over(whole) + after * F.last(c).over(whole)).alias(c) for c in cols]
        return df.select(*[c for c in df.columns if c not in cols], *sums)

    v = F.col(value)
    df = cells.select(step, "i", "j", v, F.coalesce(v, F.lit(0.0)).alias("_s"), v.isNotNull().cast("double").alias("_n"))
    df = moving(moving(df, "i", "j", ["_s", "_n"]), "j", "i", ["_s", "_n"])
    return df.select(step, "i", "j", value, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias(out))


def position_index(cells: DataFrame, step: str, value: str, radius: int, out: str = "tpi") -> DataFrame:
    """Height above the mean of the surrounding box."""
    return box_mean(cells, step, value, radius, "_m").withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def block_downsample(cells: DataFrame, step: str, value: str, cls: str, factor: int) -> DataFrame:
    """Mean value and most frequent class (the smaller on a tie) of ``factor`` x ``factor`` blocks."""
    coarse = cells.withColumn("i", F.floor(F.col("i") / factor).cast("int")).withColumn("j", F.floor(F.col("j") / factor).cast("int"))
    per = coarse.groupBy(step, "i", "j", cls).agg(F.sum(value).alias("_s"), F.count(value).alias("_m"), F.count("*").alias("_n"))
    best = F.max(F.when(F.col(cls).isNotNull(), F.struct(F.col("_n"), (-F.col(cls)).alias("_c"))))
    out = per.groupBy(step, "i", "j").agg(F.sum("_s").alias("_s"), F.sum("_m").alias("_m"), best.alias("_b"))
    return out.select(step, "i", "j", F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).alias("mean"), (-F.col("_b._c")).alias("mode"))


def row_argmax(cells: DataFrame, step: str, value: str) -> DataFrame:
    """Column of the greatest value in every raster row (the first one on a tie)."""
    best = cells.where(F.col(value).isNotNull()).groupBy(step, "i").agg(F.max(F.struct(F.col(value), (-F.col("j")).alias("_j"))).alias("_b"))
    return best.select(step, "i", (-F.col("_b._j")).alias("j"), F.col(f"_b.{value}").alias("peak"))


def rolling_median(df: DataFrame, keys: list[str], order: str, value: str, size: int, out: str) -> DataFrame:
    """Centred median over ``size`` rows, shrinking at the ends; at most ``size`` values are gathered per row."""
    half = size // 2
    near = F.array_sort(F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)))
    df = df.withColumn("_a", near)
    n = F.size("_a")
    lo, hi = F.floor((n - 1) / 2).cast("int") + 1, F.floor(n / 2).cast("int") + 1
    return df.withColumn(out, F.when(n > 0, (F.try_element_at("_a", lo) + F.try_element_at("_a", hi)) / 2)).drop("_a")


def zscore(df: DataFrame, value: str, out: str) -> DataFrame:
    """Standard score against the whole column."""
    stats = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))).scalar()
    df = df.withColumn("_s", stats)
    return df.withColumn(out, F.when(F.col("_s.sd") > 0, (F.col(value) - F.col("_s.m")) / F.col("_s.sd"))).drop("_s")


def row_gradient(cells: DataFrame, step: str, value: str, out: str) -> DataFrame:
    """Central difference along a raster row, one-sided at both ends."""
    w = Window.partitionBy(step, "i").orderBy("j")
    z, prev, nxt = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    first, last = F.lag("j").over(w).isNull(), F.lead("j").over(w).isNull()
    return cells.withColumn(out, F.when(first, nxt - z).when(last, z - prev).otherwise((nxt - prev) / 2))


def upwind_barrier(points: DataFrame, heights: DataFrame, key: str, lat: str, lon: str, own: str, cell: float,
                   from_deg: float, steps: int = 40) -> DataFrame:
    """Greatest height along ``steps`` cells towards the upwind side, above the point's own height (never below 0).

    ``heights`` has integer ``ci, cj`` (cell numbers of latitude and longitude) and ``h``.
    """
    ray = points.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ci = F.floor((F.col(lat) + F.cos(F.radians(F.lit(from_deg))) * F.col("_d") * cell) / cell + 0.5).cast("int")
    cj = F.floor((F.col(lon) + F.sin(F.radians(F.lit(from_deg))) * F.col("_d") * cell) / cell + 0.5).cast("int")
    hit = ray.select(key, own, ci.alias("ci"), cj.alias("cj")).join(heights, ["ci", "cj"], "left")
    best = hit.groupBy(key, own).agg(F.max("h").alias("_h"))
    return best.select(key, F.greatest(F.lit(0.0), F.coalesce(F.col("_h") - F.col(own), F.lit(0.0))).alias("barrier"))


# --- connected components -----------------------------------------------------------------

def _tile_labels(tile: int):
    """Arrow function: positions of one tile's cells (``row * tile + column``) to the least position of each piece."""
    none = tile * tile

    def label(pos: np.ndarray) -> np.ndarray:
        ii, jj = pos // tile, pos % tile
        ii, jj = ii - ii.min() + 1, jj - jj.min() + 1  # only the box around the cells, with a rim
        ids = np.full((ii.max() + 2, jj.max() + 2), none, dtype="int32")
        ids[ii, jj] = pos
        inner = ids[1:-1, 1:-1]
        empty = inner == none
        while True:
            low = np.minimum.reduce([inner, ids[:-2, 1:-1], ids[2:, 1:-1], ids[1:-1, :-2], ids[1:-1, 2:]])
            low[empty] = none
            if np.array_equal(low, inner):
                return ids[ii, jj]
            inner[:] = low

    @F.pandas_udf(ArrayType(IntegerType()))
    def labels(tiles: pd.Series) -> pd.Series:
        return tiles.map(lambda p: label(np.asarray(p, dtype="int32")))

    return labels


def components(cells: DataFrame, step: str, row_stride: int, tile: int = 256) -> DataFrame:
    """Component (least cell number) of every cell of ``(step, i, j)`` under edge neighbourhood.

    Tiles of fixed size are labelled in parallel, so a group never holds more than
    ``tile`` squared cells.  Only touching labels of neighbouring tiles remain, and
    those are merged by repeated minimum propagation with label shortcuts.
    """
    i, j, size = F.col("i").cast("int"), F.col("j").cast("int"), F.lit(tile)
    df = cells.select(F.col(step).cast("long").alias("t"), F.floor(i / size).cast("int").alias("ti"), F.floor(j / size).cast("int").alias("tj"),
                      (F.pmod(i, size) * tile + F.pmod(j, size)).alias("p"))
    packed = df.groupBy("t", "ti", "tj").agg(F.collect_set("p").alias("p"))
    zipped = packed.withColumn("l", _tile_labels(tile)("p")).select("t", "ti", "tj", F.explode(F.arrays_zip("p", "l")).alias("z"))

    def number(pos: str) -> Column:
        row, col = F.floor(F.col(pos) / tile) + F.col("ti") * tile, F.col(pos) % tile + F.col("tj") * tile
        return row.cast("long") * row_stride + col

    local = zipped.select("t", (F.floor(F.col("z.p") / tile) + F.col("ti") * tile).cast("int").alias("i"), (F.col("z.p") % tile + F.col("tj") * tile).alias("j"),
                          number("z.l").alias("label"))
    local = checkpointed(local)
    rim = local.where(((F.col("i") + 1) % tile == 0) | ((F.col("j") + 1) % tile == 0))
    nb = rim.select("t", F.col("label").alias("a"), F.explode(F.array(F.struct((F.col("i") + 1).alias("i"), F.col("j")),
                                                                     F.struct(F.col("i"), (F.col("j") + 1).alias("j")))).alias("p"))
    nb = nb.select("t", "a", "p.i", "p.j").join(local.withColumnRenamed("label", "b"), ["t", "i", "j"]).where("a <> b")
    edges = checkpointed(nb.select("t", "a", "b").union(nb.select("t", F.col("b"), F.col("a"))).distinct().toDF("t", "a", "b"))
    if edges.isEmpty():
        return local.select(F.col("t").alias(step), "i", "j", F.col("label").alias("component"))
    merged = _merge_labels(edges)
    out = local.join(merged, (local["t"] == merged["mt"]) & (local["label"] == merged["a"]), "left")
    return out.select(F.col("t").alias(step), "i", "j", F.coalesce("root", "label").alias("component"))


def _merge_labels(edges: DataFrame) -> DataFrame:
    """Root (least reachable label) of every label that occurs in ``edges``."""
    roots = edges.select("t", "a").distinct().withColumn("root", F.col("a"))
    while True:
        far = edges.join(roots.select("t", F.col("a").alias("b"), F.col("root").alias("_r")), ["t", "b"]).groupBy("t", "a").agg(F.min("_r").alias("_r"))
        step = roots.join(far, ["t", "a"], "left").select("t", "a", "root", F.least("root", "_r").alias("new"))
        jump = step.select("t", F.col("a").alias("new"), F.col("new").alias("_up"))
        step = step.join(jump, ["t", "new"], "left").select("t", "a", "root", F.least("new", "_up").alias("new"))
        step = checkpointed(step)
        if step.where("new < root").isEmpty():
            return step.select(F.col("t").alias("mt"), "a", "root")
        roots = step.select("t", "a", F.col("new").alias("root"))


def large_components(cells: DataFrame, step: str, row_stride: int, cell_area: float, min_area: float, tile: int = 256) -> DataFrame:
    """Cells of components with at least ``min_area``, with the component's area."""
    comp = components(cells, step, row_stride, tile)
    size = comp.groupBy(step, "component").agg((F.count("*") * F.lit(cell_area)).alias("area")).where(F.col("area") >= min_area)
    return comp.join(size, [step, "component"])
