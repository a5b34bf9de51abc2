"""Personal data: base patterns, and terms of their texts that give them away, judged by corpus co-occurrence.

A term discloses an entity as far as ``PMI(entity; term) / IC(entity)`` goes: 1 if the term never occurs without the
entity, 0 if it tells nothing about it.  Terms from ``generalise_at`` on are generalised, from ``remove_at`` on removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finegrid.llm.common import saved

#: Base kinds in the order in which spans of one start are listed, and their patterns.  A match of the first two can
#: start only where a run starts or the last match ended; the look-behind spares the other starts of a long run, and
#: possessive repeats keep long runs off the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Holds of every text with a base span, and is cheap to see.
SIGN = r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[\x20-]?[0-9]){13}|\+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
TERM = r"\p{L}{2,}"
#: Ties that chance would make with this probability or more don't count, at any number of texts.
CHANCE = 0.01
GENERALISE_AT, REMOVE_AT = 0.8, 0.95


def _luhn(digits: Column) -> Column:
    def add(total, i):
        one = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        two = one * 2
        return total + F.when(i % 2 == 1, one).when(two > 9, two - 9).otherwise(two)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: Column, match: Column, digits: Column) -> Column:
    """Whether a match of the pattern stays: octets, card number, length of a phone number."""
    n = F.length(digits)
    return (F.when(kind == "ip", match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
            .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(10, 15)).otherwise(True))


def base_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per base span of the whole texts, and one with a null kind for every row of ``df``.

    Columns: ``rid`` (the row), ``id``, ``content`` (a hash of the text), ``kind``, ``start``, ``end`` (code points, end
    exclusive) and ``entity`` (kind and value without case and separators).  Texts end here: what is shuffled are matches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = [F.when(F.contains(text, F.lit("@")) if kind == "email" else F.lit(True), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(kind) for kind, p in PATTERNS.items()]
    rows = rows.select("rid", "id", F.xxhash64(text).alias("content"), text.alias("text"), *found)

    def matches(kind: str) -> Column:
        gaps = F.split(F.col("text"), PATTERNS[kind], -1)
        full = F.zip_with(F.slice(gaps, F.lit(1), F.size(kind)), F.col(kind), lambda g, m: F.struct(F.lit(KINDS.index(kind)).alias("no"), F.length(g).alias("gap"), m.alias("match")))
        return F.when(F.size(kind) > 0, full)

    none = F.array().cast("array<struct<no:int,gap:int,match:string>>")
    every = F.concat(*[F.coalesce(matches(kind), none) for kind in KINDS])
    each = rows.select("rid", "id", "content", every.alias("every")).select("rid", "id", "content", F.posexplode_outer("every").alias("place", "m")).select("rid", "id", "content", "place", "m.*")
    order = Window.partitionBy("rid", "no").orderBy("place")
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("no") + 1)
    digits = F.regexp_replace("match", "[^0-9]", "")
    each = each.withColumn("kind", F.when(F.col("no").isNotNull(), F.when(_holds(kind, F.col("match"), digits), kind)))
    value = F.when(F.col("kind").isin("card", "phone"), digits).otherwise(F.lower("match"))
    spans = each.filter("kind IS NOT NULL").select("rid", "id", "content", "no", "kind", "start", "end", F.concat_ws(":", "kind", value).alias("entity"))
    return spans.unionByName(each.filter("no IS NULL OR place = 0").select("rid", "id", "content").withColumns({c: F.lit(None).cast(spans.schema[c].dataType) for c in ("no", "kind", "start", "end", "entity")}))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _signed(df: DataFrame, text_col: str) -> DataFrame:
    """``(content, text)`` of the rows that show a sign of personal data; every text with a base span is among them."""
    text = _text(text_col)
    return df.filter(F.contains(text, F.lit("@")) | text.rlike(SIGN)).select(F.xxhash64(text).alias("content"), text.alias("text"))


def _chance(total: Column) -> Column:
    """Upper bound of the probability that ``both`` texts or more of ``with_entity`` hold a term of ``with_term`` out of ``total`` texts.

    Markov's inequality on the ways to take ``j`` of the texts that hold both; exact where every text of the term or
    of the entity holds both (up to 32 texts; beyond, ``j`` stays 32, which is still a bound).
    """
    j = F.least(F.col("both"), F.lit(32))
    one = lambda i: F.log((F.col("with_entity") - i) * (F.col("with_term") - i) / ((total - i) * (F.col("both") - i)))
    return F.exp(F.aggregate(F.sequence(F.lit(0).cast("long"), j - 1), F.lit(0.0), lambda s, i: s + one(i)))


def disclosing(df: DataFrame, base: DataFrame, text_col: str = "text", chance: float = CHANCE, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """``(content, term, disclosure)``: terms of each text that are tied to an entity of it from ``generalise_at`` on and not by chance.

    Counts are distinct texts of the whole table: with the entity, with the term, with both, wherever they stand.
    Entities of the same texts (all those of one text only, say) have the same counts and are judged as one; they are
    told apart by two hashes of their sets of texts.
    """
    contents = saved(base.filter("kind IS NULL").groupBy("content").agg(F.count("*").alias("copies")), "contents")
    n = contents.count()
    total = F.lit(n)
    held = base.filter("kind IS NOT NULL").select("content", "entity").distinct()
    texts = F.struct(F.count("*").alias("n"), F.bit_xor("content").alias("a"), F.bit_xor(F.xxhash64("content", F.lit(1))).alias("b"))
    entities = held.groupBy("entity").agg(texts.alias("texts"))
    groups = held.join(entities, "entity").select("content", F.xxhash64("texts").alias("group"), F.col("texts.n").alias("with_entity")).distinct()
    groups = saved(groups, "groups")
    most = groups.agg(F.max("with_entity")).first()[0] or 0
    # as both <= with_entity, a term of more texts than this is below generalise_at with every entity
    rare = _texts_with_terms(df, contents, text_col).filter(F.col("with_term") <= most * (n / max(most, 1)) ** (1 - generalise_at) * (1 + 1e-9))
    words = _signed(df, text_col).select("content", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("term"))
    pairs = words.join(rare, "term").distinct().join(groups, "content").filter(F.col("with_term") <= F.col("with_entity") * F.pow(total / F.col("with_entity"), F.lit(1 - generalise_at)) * (1 + 1e-9))
    pairs = saved(pairs, "pairs")
    scored = pairs.groupBy("group", "term").agg(F.count("*").alias("both"), F.first("with_entity").alias("with_entity"), F.first("with_term").alias("with_term"))
    pmi = F.log2(F.col("both") * total / (F.col("with_entity") * F.col("with_term")))
    scored = scored.withColumn("disclosure", F.try_divide(pmi, F.log2(total / F.col("with_entity")))).filter(F.col("disclosure") >= generalise_at)
    ties = scored.filter(_chance(total) < chance).select("group", "term", "disclosure")
    return pairs.select("content", "group", "term").join(ties, ["group", "term"]).groupBy("content", "term").agg(F.max("disclosure").alias("disclosure"))


def occurrences(df: DataFrame, base: DataFrame, ties: DataFrame, text_col: str = "text") -> DataFrame:
    """``(content, start, end, disclosure)``: every place of a tied term in its texts that touches no base span."""
    rows = _signed(df, text_col).join(ties.select("content").distinct(), "content", "left_semi").withColumn("rid", F.monotonically_increasing_id())
    words, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    each = rows.select("rid", "content", F.posexplode(F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.struct(F.length(g).alias("gap"), w.alias("term")))).alias("place", "t"))
    each = each.select("rid", "content", "place", "t.*").withColumn("end", F.sum(F.col("gap") + F.length("term")).over(Window.partitionBy("rid").orderBy("place")).cast("int"))
    each = each.withColumn("start", F.col("end") - F.length("term")).join(ties, ["content", "term"]).select("content", "start", "end", "disclosure").distinct()
    bases = base.filter("kind IS NOT NULL").select("content", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(None).cast("double").alias("disclosure")).distinct()
    both = each.unionByName(bases.join(ties.select("content").distinct(), "content", "left_semi"))
    of_base = lambda c: F.when(F.col("disclosure").isNull(), F.col(c))
    before, after = Window.partitionBy("content").orderBy("start"), Window.partitionBy("content").orderBy(F.desc("start"))
    both = both.withColumn("reached", F.max(of_base("end")).over(before)).withColumn("next", F.min(of_base("start")).over(after))
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return both.filter(F.col("disclosure").isNotNull() & free).select("content", "start", "end", "disclosure")


def _texts_with_terms(df: DataFrame, contents: DataFrame, text_col: str) -> DataFrame:
    """``(term, with_term)``: distinct texts that hold a term.  Each of several copies of a text counts its share, so only copied texts are looked up."""
    text = _text(text_col)
    rows = df.select(F.xxhash64(text).alias("content"), text.alias("text")).join(contents.filter("copies > 1"), "content", "left")
    words = rows.select((1 / F.coalesce("copies", F.lit(1))).alias("share"), F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+", -1))).alias("term"))
    return words.groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("with_term"))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chance: float = CHANCE, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """``(id, content, spans)`` for every row: all spans as an array of ``(start, no, end, kind)`` in order.

    Kinds are those of ``PATTERNS``, then ``term`` (to generalise) and ``revealing`` (to remove); terms never touch base
    spans.  Null counts as empty and has no spans; repeated rows come back as often as they are there, but further
    copies of one text lend a tie no support.  An empty table gives an empty one.
    """
    base = saved(base_spans(df, id_col, text_col), "base")
    ties = saved(disclosing(df, base, text_col, chance, generalise_at), "disclosing")
    own = occurrences(df, base, ties, text_col)
    strong = F.col("disclosure") >= remove_at
    term = own.select("content", F.struct("start", F.when(strong, len(KINDS) + 1).otherwise(len(KINDS)).alias("no"), "end", F.when(strong, "revealing").otherwise("term").alias("kind")).alias("span"))
    terms = term.groupBy("content").agg(F.collect_list("span").alias("terms"))
    bases = base.groupBy("rid").agg(F.first("id").alias("id"), F.first("content").alias("content"), F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "no", "end", "kind"))).alias("bases"))
    every = F.concat(F.col("bases"), F.coalesce(F.col("terms"), F.array()))
    return bases.join(terms, "content", "left").select("id", "content", F.array_sort(every).alias("spans"))


def listing(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Per row: number of spans of each base kind, the digest of the base spans, and all spans as ``kind:start:end``."""
    found = spans(df, id_col, text_col, **thresholds)
    base = F.filter("spans", lambda s: s["no"] < len(KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias(id_col), *map(count, KINDS), F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, **thresholds) -> DataFrame:
    """``df`` with personal data out of its texts: ``[EMAIL]`` and so on for base spans, ``[TERM]`` for generalised terms, nothing for removed ones.

    Spans that overlap go as one.  All columns stay; ``chars_col``, if given, is set to the length of the new text.
    Spans are joined, by id and a hash of the text, to those texts that show a sign of personal data; the others
    come through unchanged and are not shuffled.
    """
    found = spans(df, id_col, text_col, **thresholds).filter(F.size("spans") > 0).dropDuplicates(["id", "content"])
    each = found.select("id", "content", F.posexplode("spans").alias("place", "s")).select("id", "content", "place", "s.*")
    order = Window.partitionBy("id", "content").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("cut", F.coalesce(F.max("end").over(order), F.lit(0)))
    label = F.when((F.col("start") < F.col("cut")) | (F.col("kind") == "revealing"), "").otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    piece = F.struct("place", F.col("cut").alias("from"), F.greatest(F.col("start") - F.col("cut"), F.lit(0)).alias("size"), label.alias("label"))
    pieces = saved(each.groupBy("id", "content").agg(F.array_sort(F.collect_list(piece)).alias("__pieces"), F.max("end").alias("__rest")).withColumnRenamed("id", "__id").withColumnRenamed("content", "__content"), "pieces")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sign = F.contains(text, F.lit("@")) | text.rlike(SIGN)
    both = df.filter(sign).join(pieces, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__content")), "left")
    parts = F.transform("__pieces", lambda p: F.concat(F.substring(text, (p["from"] + 1).cast("int"), p["size"].cast("int")), p["label"]))
    new = F.when(F.col("__pieces").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(parts, ""), F.substring(text, (F.col("__rest") + 1).cast("int"), F.length(text))))

    def out(rows: DataFrame, value: Column) -> DataFrame:
        changed = {text_col: F.col("__new")} | ({chars_col: F.coalesce(F.length("__new"), F.lit(0)).cast("long")} if chars_col else {})
        return rows.withColumn("__new", value).select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns])

    return out(both, new).unionByName(out(df.filter(~sign), F.col(text_col)))
