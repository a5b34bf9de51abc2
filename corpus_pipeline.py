"""From raw documents to token ids: toxic documents go, near-duplicates go, personal data goes, sources are mixed, texts are encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finegrid.llm import byte_bpe, disclosure, mixing, simhash, toxicity
from finegrid.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model, fitted on the labelled ones among ``docs``, predicts to be toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links connect: that with the least id."""
    return simhash.drop_near_duplicates(docs)


def drop_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without personal data and the terms that give it away; ``n_chars`` follows."""
    return disclosure.sanitised(docs, chars_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, the last of a source cut at its budget; ``n_chars`` follows."""
    return mixing.mixed(docs, chars_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and proof that they decode to its text: ``(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256)``."""
    vocabulary = byte_bpe.default_vocabulary()
    back = byte_bpe.encode_and_decode(docs.select("doc_id", "source", "text"), *vocabulary)
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary")
    return back.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("personal_data", drop_personal_data),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the compression distance of the first stage; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
