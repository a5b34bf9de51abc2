"""What a data set is made of: bytes, digests, rows, source and licence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finegrid.operators.relational import upsert


def file_digests(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """SHA-256 of every file below ``path``; files are read in chunks by the tasks, whatever their size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in frames:
            sums = []
            for uri in pdf["path"]:
                system, p = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
                h = hashlib.sha256()
                with system.open_input_stream(p) as f:
                    while block := f.read(chunk):
                        h.update(block)
                sums.append(h.hexdigest())
            yield pdf.assign(sha256=sums)

    return files.mapInPandas(digest, "path string, length long, sha256 string")


def row_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free digest of the rows, whatever files hold them: sums of both ends of each row's MD5.

    A row is its values as text, joined by ``|``, a missing one being empty; sums are exact and the same in any engine.
    """
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), part(1).alias("first_sum"), part(18).alias("last_sum"))


def dataset_entry(digests: DataFrame, dataset: str, source: str, licence: str, produced_by: str, rows: Column | None = None) -> DataFrame:
    """One manifest row: total bytes, number of files, and a digest of the digests of the files.

    Digests are sorted and hashed in 4,096 groups by their first three digits, and the groups' digests once more, so
    no task holds all of them.
    """
    groups = digests.groupBy(F.substring("sha256", 1, 3).alias("g")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "")
    return groups.agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.sha2(joined, 256).alias("sha256")).select(
        F.lit(dataset).alias("dataset"), F.lit(source).alias("source"), F.lit(licence).alias("licence"), F.lit(produced_by).alias("produced_by"), "bytes", "files", "sha256",
        (rows if rows is not None else F.lit(None).cast("long")).alias("rows"))


def register(manifest: DataFrame, entry: DataFrame) -> DataFrame:
    """Manifest in which the entry of the same data set is replaced."""
    return upsert(manifest, entry, ["dataset"])
