"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finegrid.llm.common import pieces, saved, type_of, utf8
from finegrid.llm.graph import components

BITS = 64
SEED = 42
#: Distinct fingerprints that share a block key and are compared pair by pair; larger keys take the exact way round (`_through_midpoints`).
PAIR_LIMIT = 32


def fingerprint(text: bytes, words_per_shingle: int = 4) -> int:
    """SimHash of a UTF-8 text: a bit is set if it is set in over half the XXH64 values of the word shingles.

    A-Z are lower-cased, words are separated by ASCII white space.  Fewer words than a shingle: the whole
    sequence is the one shingle; no words: 0.  Long texts pass in pieces, with the last words carried over.
    """
    from xxhash import xxh64_digest

    carry: list[bytes] = []
    ones, total = np.zeros(BITS, np.int64), 0
    for part in pieces(text.lower()):
        words = carry + part.split()
        if len(words) >= words_per_shingle:
            joined = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[:-1]]
            k = words_per_shingle - 1
            for lo in range(0, len(words) - k, 1 << 16):
                hi = min(lo + (1 << 16), len(words) - k)
                digests = b"".join([xxh64_digest(joined[a:z - 1], SEED) for a, z in zip(starts[lo:hi], ends[lo + k:hi + k])])
                ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                total += hi - lo
            carry = words[-k:] if k else []
        else:
            carry = words
    if not total and carry:
        return int.from_bytes(xxh64_digest(b" ".join(carry), SEED), "big")
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """``(id, content, fp)``: a hash and the fingerprint of every row's whole text, signed; null counts as empty."""

    def run(batches):
        for batch in batches:
            got = np.fromiter((fingerprint(t, words_per_shingle) for t in utf8(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.view(np.int64))], ["id", "content", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), text.alias("text")).mapInArrow(run, f"id {type_of(df, id_col)}, content long, fp long")


def blocks_for(n: int, differ: int) -> int:
    """Least number of blocks for which a key is expected to hold under 1/8 other fingerprint among ``n``."""
    for m in range(differ + 1, BITS // 2):
        if n < 2 ** (BITS * (m - differ) / m - 3):
            return m
    return BITS // 2


def _masks(blocks: int, differ: int) -> list[int]:
    """Bit masks of every choice of ``blocks - differ`` blocks; two fingerprints that differ in ``differ`` bits agree under one of them."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(c) - ((sum(c) >> (BITS - 1)) << BITS) for c in combinations(whole, blocks - differ)]


def _through_midpoints(hot: DataFrame, differ: int) -> DataFrame:
    """Edges among fingerprints whose block keys are too common for pairs; ``differ`` must be even.

    Two fingerprints differ in at most ``2 r`` bits exactly if some value lies within ``r`` bits of both, and all
    fingerprints within ``r`` bits of one value are within ``2 r`` of each other.  Every fingerprint meets its
    neighbouring values and links to the least fingerprint there: no pairs, and no value holds more than one row
    in (number of neighbours) of the table.
    """
    near = hot.select("fp", F.col("fp").alias("mid"))
    wide = hot.select("fp", F.col("fp").alias("mid"), F.lit(-1).alias("bit"))
    for _ in range(differ // 2):
        wide = wide.select("fp", "mid", F.explode(F.sequence(F.col("bit") + 1, F.lit(BITS))).alias("bit")).filter(F.col("bit") < BITS)
        wide = wide.select("fp", F.col("mid").bitwiseXOR(F.expr("shiftleft(1L, bit)")).alias("mid"), "bit")
        near = near.unionByName(wide.select("fp", "mid"))
    return near.selectExpr("fp AS u", "min(fp) OVER (PARTITION BY mid) AS v").filter("u <> v").distinct()


def links(distinct: DataFrame, differ: int = 4, blocks: int | None = None, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges ``(u, v)`` that connect all fingerprints of ``distinct(fp)`` that differ in at most ``differ`` bits.

    Fingerprints meet under every choice of ``blocks - differ`` blocks; keys with up to ``pair_limit`` fingerprints
    are joined and verified pair by pair, the fingerprints of larger keys meet in their midpoints.  Both ways are
    exact, so ``blocks`` and ``pair_limit`` change the work only.
    """
    if differ % 2 or differ < 2:
        raise ValueError("differ must be an even number of bits")
    blocks = blocks or blocks_for(distinct.count(), differ)
    masks = _masks(blocks, differ)
    assert len(masks) == comb(blocks, differ)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key"))
    shared = saved(keys.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    met = saved(keys.join(shared, ["choice", "key"]), "met")
    few = met.filter(F.col("n") <= pair_limit).select("choice", "key", "fp")
    pairs = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), ["choice", "key"]).filter("u > v AND bit_count(u ^ v) <= %d" % differ)
    hot = met.filter(F.col("n") > pair_limit).select("fp").distinct()
    return pairs.select("u", "v").distinct().unionByName(_through_midpoints(hot, differ))


def _classified(df: DataFrame, id_col: str, text_col: str, differ: int, words_per_shingle: int) -> DataFrame:
    """``(id, content, fp, root, component_id)`` for every row; equal fingerprints are reduced to one before any link is sought."""
    fps = saved(fingerprints(df, id_col, text_col, words_per_shingle), "fingerprints")
    first = saved(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(first.select("fp"), differ))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = saved(named.join(least, "root").select("fp", "root", "component_id"), "classes")
    return fps.join(classes, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", differ: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row; component_id is the least id that links reach, itself included.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows come back as often as they are
    there; a null id never is a component_id unless the whole component has null ids; an empty table gives an
    empty one.  Other columns are not read.  A group of copies costs no pairs.
    """
    found = _classified(df, id_col, text_col, differ, words_per_shingle)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", differ: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """``df`` with one row of each component: that with the least id (a null id last), then the least hash of the text; all columns stay.

    Rows that repeat both are folded to the one with the least other columns; rows that share an id only are told
    apart by their texts.
    """
    found = _classified(df, id_col, text_col, differ, words_per_shingle)
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "content")).alias("c")
    keep = found.groupBy("root").agg(least).select(F.col("c.id").alias("__id"), F.col("c.content").alias("__content"))
    copies = found.groupBy(F.col("id").alias("__i"), F.col("content").alias("__c")).agg(F.count("*").alias("__n")).filter("__n > 1")
    keep = saved(keep.join(copies, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__content") == F.col("__c")), "left").select("__id", "__content", F.coalesce("__n", F.lit(1)).alias("__n")), "kept")
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    kept = df.withColumn("__text", text).join(keep, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__content")))
    if keep.filter("__n > 1").isEmpty():
        return kept.select(*df.columns)
    folded = kept.filter("__n > 1").groupBy("__id", "__content").agg(F.min(F.struct(*df.columns)).alias("__row"))
    return kept.filter("__n = 1").select(*df.columns).unionByName(folded.select(*[F.col("__row")[c].alias(c) for c in df.columns]))
