"""General table operators: keep-one-per-key, upserts, exact ranks, quantiles and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finegrid.session import stored

#: Rows of one key that a task takes before the key is spread over several.
ROWS_PER_TASK = 1_000_000
#: Least rows of a key for every copy of its rows of the small side.
ROWS_PER_COPY = 500
#: Where both sides of a join are dealt: pieces for every task, least joined rows of a piece, and rows of a side that travel as one
#: (Spark holds all that a pair of such packs makes before it hands it on).
PIECES_PER_TASK, ROWS_PER_PIECE, ROWS_PER_PACK = 16, 2_000, 64


def keep_one(df: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """The row of each key with the greatest (or least) ``order`` values; ties go by the other columns that have an order.

    A rank cut at 1: every task keeps one row per key before the shuffle, so copies of a hot key don't travel.
    """
    rest = [f.name for f in df.schema.fields if f.name not in (*order, *keys) and "map<" not in f.dataType.simpleString()]
    by = [F.col(c).desc_nulls_last() if last else F.col(c).asc_nulls_first() for c in (*order, *rest)]
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_first = 1").drop("_first")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a row of ``new`` replaces the rows of ``old`` with the same key."""
    both = (old.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)), allowMissingColumns=True))
    return keep_one(both, keys, ["_rank"]).drop("_rank")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def bucket_of_md5(digest: Column) -> Column:
    """Order-preserving bucket (0..4095) of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], row_key: list[str], rows_per_task: int = ROWS_PER_TASK, small_key: list[str] | None = None) -> DataFrame:
    """Inner join in which a key of ``large`` is spread over as many partitions as its rows need.

    Rows are counted per key; a key with few rows stays whole and costs no copy of ``small``, a
    larger one gets a partition, and a copy of its rows of ``small``, for every so many rows.  ``row_key`` tells rows
    of a key apart; ``small`` should be the side with fewer rows per key.  Joined rows may be many more than either
    side's bytes tell, so a key of over ``ROWS_PER_COPY`` rows is dealt further, up to the tasks that the session
    shuffles into, and those tasks are not merged.

    With ``small_key``, which tells rows of ``small`` apart, both sides are dealt, see `_product`: for sides of which
    either may have many rows per key.
    """
    if small_key is not None:
        return _product(large, small, keys, row_key, small_key, rows_per_task)
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.least(F.lit(tasks), F.ceil(F.count("*") / F.lit(ROWS_PER_COPY)))
    salts = F.greatest(F.ceil(F.count("*") / F.lit(rows_per_task)), dealt).cast("int")
    counted = large.groupBy(*keys).agg(salts.alias("_salts"))
    spread = large.join(counted, keys).withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.col("_salts")).cast("int")).drop("_salts")
    repeated = small.join(counted, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    place = [*keys, "_salt"]
    return spread.repartition(tasks, *place).join(repeated.repartition(tasks, *place), place).drop("_salt")


def _product(large: DataFrame, small: DataFrame, keys: list[str], row_key: list[str], small_key: list[str], rows_per_task: int) -> DataFrame:
    """Inner join of sides that both may have many rows per key, so that what it makes is far more than what it reads.

    A key's joined rows are a rectangle, which is cut into pieces: in all about ``PIECES_PER_TASK`` for every task that
    the session shuffles into, a key's by its share of all joined rows.  Rows of one side are copied once per piece
    along the other; a key is cut along both sides so that the copies are fewest.  As the pieces don't grow with the
    tables, what is shuffled grows as they do, not with their product.

    Rows travel in packs of about ``ROWS_PER_PACK``, opened after the join.  All rows of a pack of ``large`` meet one row
    of ``small`` after the other, so that in a column file values of ``small`` are runs, and those of ``large`` repeat.
    """
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = large.groupBy(*keys).agg(F.count("*").alias("_n")).join(small.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
    counts = stored(both, "counts")  # as a table its size is known: few keys are sent to both sides, which need no shuffle for it
    n, m = F.col("_n").cast("double"), F.col("_m").cast("double")
    total = counts.agg(F.sum(n * m)).scalar()
    pieces = F.greatest(F.ceil(n / rows_per_task), F.ceil(F.least(n * m / ROWS_PER_PIECE, n * m / total * (PIECES_PER_TASK * tasks))))
    along = F.greatest(F.lit(1), F.least(F.col("_pieces"), F.ceil(m / ROWS_PER_PACK), F.round(F.sqrt(F.col("_pieces") * m / n))))
    cuts = counts.withColumn("_pieces", pieces).withColumn("_along", along.cast("int"))
    cuts = cuts.withColumn("_across", F.least(F.ceil(n / ROWS_PER_PACK), F.ceil(F.col("_pieces") / F.col("_along"))).cast("int"))

    def opened(df: DataFrame, name: str, of: list[str]) -> DataFrame:
        each = F.explode(name).alias(of[0]) if len(of) == 1 else F.inline(name)
        return df.select(*[c for c in df.columns if c != name], each)

    def packs(df: DataFrame, by: list[str], size: str, cut: str, copies: str, place: str, copy: str, name: str) -> DataFrame:
        number = F.pmod(F.xxhash64(*by), F.ceil(F.col(size) / ROWS_PER_PACK).cast("int")).cast("int").alias("_pack")
        rest = [c for c in df.columns if c not in keys]
        packed = df.join(cuts, keys).groupBy(*keys, cut, copies, number).agg(F.collect_list(F.struct(*rest)).alias(name))
        if len(rest) == 1:  # plain values are opened faster than records
            packed = packed.withColumn(name, F.col(name)[rest[0]])
        return packed.select(*keys, name, F.pmod("_pack", cut).alias(place), F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(copy)).repartition(tasks, *keys, "_row", "_column")

    rows = packs(large, row_key, "_n", "_across", "_along", "_row", "_column", "_larges")
    columns = packs(small, small_key, "_m", "_along", "_across", "_column", "_row", "_smalls")
    rest, other = ([c for c in df.columns if c not in keys] for df in (large, small))
    met = rows.join(columns, [*keys, "_row", "_column"]).select(*keys, "_larges", "_smalls")
    return opened(opened(met, "_smalls", other), "_larges", rest).select(*keys, *rest, *other)


def dealt(df: DataFrame, keys: list[str], rows_per_task: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` over the tasks that the session shuffles into, which are not merged, however few their bytes.

    With ``rows_per_task`` rows are counted, and larger tables get a task for every so many rows.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows_per_task:
        tasks = max(tasks, -(-df.count() // rows_per_task))
    return df.repartition(tasks, *keys)


def exact_rank(df: DataFrame, keys: list[str], order: list[str], bucket: Column, first: int | None = None) -> DataFrame:
    """Adds ``rank`` (1-based row number per key) and ``total`` without sorting a whole key in one task.

    ``bucket`` must never decrease along ``order``.  Rows are counted per (key,
    bucket), the counts become offsets, and only one bucket is sorted at a time.
    With ``first`` only the rows up to that rank are kept, and later buckets are not sorted.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                           F.sum("_n").over(per_key).alias("total"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    counts = counts if first is None else counts.where(F.col("_offset") < first)
    ranked = df.join(counts, [*keys, "_bucket"]).withColumn("rank", F.row_number().over(within) + F.col("_offset")).drop("_bucket", "_offset")
    return ranked if first is None else ranked.where(F.col("rank") <= first)


def _below(edges: Column, v: Column, depth: int) -> Column:
    """How many of ``2 ** depth - 1`` ascending edges lie below ``v``: a binary search of compiled comparisons."""
    found = F.lit(0)
    for step in (2**k for k in reversed(range(depth))):
        found = found + (edges[found + (step - 1)] < v).cast("int") * step
    # never NULL: otherwise a null check of the whole search would be pushed into the scan
    return F.coalesce(found, F.lit(0))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], depth: int = 6) -> DataFrame:
    """Exact linearly interpolated quantiles per key, also for keys too large for one task.

    Equal values collapse into counts first; approximate split points then divide the
    distinct values of a key into buckets, and only the buckets that hold a wanted
    rank are sorted.  ``qs`` maps an output column to its quantile.  Without keys the
    whole table is one group.  A bucket holds about one in ``2 ** depth`` of the distinct
    values of a key; raise ``depth`` for keys with more than some hundred million of them.
    """
    v = F.col(value)
    freq = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    splits = 2**depth
    steps = [i / splits for i in range(1, splits)]
    edges = freq.groupBy(*keys).agg(F.percentile_approx(value, steps, 2000).alias("_edges"), F.sum("_n").alias("_total"))
    if keys:
        placed = freq.join(edges, keys)
    else:  # no key, no join: one row of edges as a scalar
        whole = freq.agg(F.struct(F.percentile_approx(value, steps, 2000).alias("_edges"), F.sum("_n").alias("_total"))).scalar()
        placed = freq.withColumn("_whole", whole).select(value, "_n", "_whole.*")
    placed = placed.withColumn("_bucket", _below(F.col("_edges"), v, depth)).drop("_edges")
    counts = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    rows = placed.join(counts, [*keys, "_bucket"])
    bounds = [(f(F.lit(q) * (F.col("_total") - 1)).cast("long")) for q in qs.values() for f in (F.floor, F.ceil)]
    wanted = [(b >= F.col("_start")) & (b < F.col("_start") + F.col("_m")) for b in bounds]
    any_wanted = wanted[0]
    for w in wanted[1:]:
        any_wanted = any_wanted | w
    within = Window.partitionBy(*keys, "_bucket").orderBy(value)
    hi = F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_start")
    rows = rows.where(any_wanted).withColumn("_hi", hi)
    aggs = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_total") - 1)
        for side, b in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            holds = (b.cast("long") < F.col("_hi")) & (b.cast("long") >= F.col("_hi") - F.col("_n"))
            aggs.append(F.max(F.when(holds, v)).alias(f"_{name}_{side}"))
    out = rows.groupBy(*keys, "_total").agg(*aggs)
    cols = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_total") - 1)
        lo, up = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (up - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows chosen by a digest of seed and key: the same rows on every run, however large ``n`` is."""
    marked = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_one", F.lit(1))
    return exact_rank(marked, ["_one"], ["_h", key], bucket_of_md5(F.col("_h")), first=n).select(*df.columns)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def contains_or_prefix(df: DataFrame, name: str, code: str, text: str, limit: int = 20) -> DataFrame:
    """Rows whose name contains the text (any case) or whose code starts with it."""
    q = text.strip().upper()
    hit = F.upper(name).contains(q) | F.col(code).startswith(q)
    return df.where(hit).orderBy(name, code).limit(limit)
