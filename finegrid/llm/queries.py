"""The registered queries of this subpackage, over whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finegrid.llm import bitsliced, byte_bpe, conversations, disclosure, mixing, multiindex, packing, pages, simhash, token_files, toxicity, warc, whitening
from finegrid.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.default_vocabulary()
    ids = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary).drop("text")
    back = byte_bpe.decode(ids, *vocabulary)
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    folder = token_files.new_folder(docs)
    files = token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.documents(files, folder)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_near_dedup, op2_byte_bpe, op3_token_id_files, op4_mix_sources, op5_warc, op6_personal_data, op7_toxicity, op8_main_text, op9_exact_top_k, op10_multi_index, op11_whitening, op12_best_fit_packing, op13_conversation_repair)}
ORACLE_SQL: dict[str, str] = {"op4_mix_sources": mixing.SQL, "op9_exact_top_k": bitsliced.SQL}
