"""Mixing sources to target weights: hash-random order within a source, prefix sums of words, a cut at the exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finegrid.llm.common import n_words, saved

#: Weights of the sources in code point order, over and over.
WEIGHTS = (5, 2, 1)
#: Words of the mix per word of all sources, and the most that one document may be repeated.
SHARE, REPEATS = 1.5, 2
#: Expected keys of one range of a source; one task sorts a range.
RANGE_KEYS = 1000


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``(id, source, size, key)`` of every row: words of the whole text (null: 0) and the hash-random place in its source."""
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _key(F.col(id_col), seed).alias("key"))


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Target of each row of ``(source, source_size, rows)``, which holds one row per source.

    All sources share ``share`` times the total by weight; a target stops at ``repeats`` times its source's size and
    the excess is shared anew by weight.  With sources in the order of that limit by weight, the common level is the
    largest of (what the limits before leave) / (weights from here on), so no iteration is needed.
    """
    numbered = by_source.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1)
    rows = numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    leveled = rows.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    return leveled.select("source", "source_no", "source_size", "rows", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source that says what the mix takes: ``full`` epochs, then all documents before the cut, then ``cut_words`` of it.

    Documents stand in the order (key, id, size) within their source.  A source is cut into ranges of the hash key
    that hold about ``RANGE_KEYS`` documents each, so a source with a third of all rows is sorted by many tasks; the
    sums of ranges give each range its offset.  Rows with the same id and size count as one place, and share what
    the cut leaves evenly.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aims = saved(targets(by_source, weights, share, repeats).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
                 .withColumn("rest", F.floor(F.col("target") - F.col("full") * F.col("source_size")).cast("long")), "targets")
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("rows") / RANGE_KEYS) / F.lit(float(1 << 32))).cast("long")
    places = (sized.join(aims.select("source", "source_no", "rows", "rest"), sized["source"].eqNullSafe(aims["source"])).filter("rest > 0 AND size > 0")
              .select("source_no", part.alias("part"), "key", "id", "size", "rest").groupBy("source_no", "part", "key", "id", "size", "rest").agg(F.count("*").alias("n")))
    places = saved(places, "places")
    ranges = places.groupBy("source_no", "part").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    offsets = ranges.select("source_no", "part", "words", F.coalesce(F.sum("words").over(Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    at_cut = places.join(offsets, ["source_no", "part"]).filter("offset <= rest AND rest < offset + words")  # one range per source
    inside = Window.partitionBy("source_no", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    cuts = (at_cut.withColumn("before", before).filter("before <= rest AND rest < before + size * n")
            .select("source_no", F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("before")) / F.col("n")).cast("long").alias("cut_words")))
    return saved(aims.drop("rest", "rows").join(cuts, "source_no", "left"), "mix")


def taken(sized: DataFrame, mix: DataFrame) -> DataFrame:
    """``sized`` rows with their source's size and target and the words that the mix takes, repeats counted."""
    at, cut = F.struct("key", "id", "size"), F.struct(F.col("cut_key").alias("key"), F.col("cut_id").alias("id"), F.col("cut_size").alias("size"))
    extra = F.when(F.col("cut_key").isNull() | (F.col("size") == 0), F.lit(0)).when(at < cut, F.col("size")).when(at.eqNullSafe(cut), F.col("cut_words")).otherwise(F.lit(0))
    rows = sized.join(mix.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return rows.withColumn("taken", (F.col("full") * F.col("size") + extra).cast("long"))


def mix_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row of ``df``.

    Sizes are numbers of words (null text: 0).  Sources stand in code point order, null last.  Repeated rows come
    back as often as they are there; texts without words take nothing; an empty table gives an empty one.  Reruns
    give the same rows, as the order is a hash of ``seed`` and the id.
    """
    sized = saved(sizes(df, id_col, text_col, source_col, seed), "sizes")
    return taken(sized, plan(sized)).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = None, seed: int = 0) -> DataFrame:
    """The mix itself: a row of ``df`` for every time that it is taken, the last one cut behind a word where the budget ends.

    Columns are those of ``df``; ``chars_col``, if given, is set to the length of the text.  Texts are not
    shuffled: every row is decided by its source's row of the plan, which holds one row per source.
    """
    mix = plan(saved(sizes(df, id_col, text_col, source_col, seed), "sizes"))
    names = df.columns
    held = df.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _key(F.col(id_col), seed).alias("key"))
    times = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    out = taken(held, mix).filter("taken > 0").withColumn("time", F.explode(times)).withColumn("words", F.least("size", F.col("taken") - F.col("time") * F.col("size")))
    text = F.col("row")[text_col]
    first = F.expr(r"regexp_extract(row.`%s`, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', words, '}+'), 0)" % text_col)
    cut = F.when(F.col("words") < F.col("size"), first).otherwise(text)
    out = out.withColumn("cut", cut)
    new = {text_col: F.col("cut")} | ({chars_col: F.length("cut").cast("long")} if chars_col else {})
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])


SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
numbered AS (SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2.0::DOUBLE * s AS most FROM numbered),
levels AS (SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY most / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
aims AS (SELECT *, least(most, w * max(level) OVER ()) AS target FROM levels),
goals AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole FROM aims),
rests AS (SELECT *, floor(target - whole * s) AS rest FROM goals),
places AS (SELECT no, rest, key, doc_id, size, count(*) AS n FROM sized JOIN rests ON sized.source IS NOT DISTINCT FROM rests.source WHERE size > 0 GROUP BY ALL),
sums AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY no ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM places)
SELECT d.doc_id, d.size, r.s::BIGINT AS source_size, r.target,
  (r.whole * d.size + CASE WHEN d.size = 0 THEN 0 WHEN p.before + p.size * p.n <= r.rest THEN d.size WHEN p.before < r.rest THEN floor((r.rest - p.before) / p.n) ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN sums p ON p.no = r.no AND p.key = d.key AND p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.size = d.size
"""
