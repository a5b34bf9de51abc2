"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finegrid.session import scratch_path

#: White space that separates words in every contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
CUT = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back.

    Cuts the lineage, survives lost executors, and tells the planner the table's real size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def utf8(texts) -> Iterator[bytes]:
    """The UTF-8 bytes of an Arrow string column, one value at a time; null is empty."""
    for value in texts:
        buffer = value.as_buffer()
        yield b"" if buffer is None else buffer.to_pybytes()


def pieces(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """``data`` in order, cut before ASCII white space that follows another byte, near every ``size`` bytes.

    A run without white space stays whole, however long.
    """
    start, end = 0, len(data)
    while end - start > size:
        found = CUT.search(data, start + size)
        if not found:
            break
        yield data[start:found.start() + 1]
        start = found.start() + 1
    yield data[start:]


def local_file(spark: SparkSession, path: str, most: int = 1 << 26) -> Broadcast:
    """A vocabulary file of the driver, sent to the executors; larger than ``most`` bytes is an error."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return spark.sparkContext.broadcast(data)


def with_column(df: DataFrame, source: str, into: str, kind: str, make: Callable[[pa.Array], pa.Array], rows: int) -> DataFrame:
    """``df`` with column ``into`` made from ``source`` in Arrow batches of at most ``rows`` rows; no shuffle."""
    return with_columns(df, [(source, into, kind, make)], rows)


def with_columns(df: DataFrame, steps: list[tuple[str, str, str, Callable[[pa.Array], pa.Array]]], rows: int) -> DataFrame:
    """``df`` after several `with_column` in a row, ``(source, into, kind, make)`` each, in one pass of one worker.

    A pass per column would keep a worker per column, and send what is between them to Spark and back.
    """
    schema, plan = df.schema, []
    for source, into, kind, make in steps:
        at, kept = schema.names.index(source), [i for i, c in enumerate(schema.names) if c != into]
        plan.append((at, kept, make))
        schema = T.StructType([*(schema.fields[i] for i in kept), *T._parse_datatype_string(f"{into} {kind}").fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                columns = batch.slice(lo, rows).columns
                for at, kept, make in plan:
                    columns = [*(columns[i] for i in kept), make(columns[at])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def filesystem(uri: str):
    """The file system and the path of a folder that all executors share; any store that Arrow can open."""
    from pyarrow import fs

    if uri.startswith("file:/"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def kept_in_worker(key, make: Callable):
    """``make()`` once per Python worker and ``key``; later tasks of the worker get the same object.

    Functions travel to executors by value, so a global of this package would last for one task only.
    """
    store = vars(sys.modules.setdefault("finegrid_worker_store", types.ModuleType("finegrid_worker_store")))
    if key not in store:
        store[key] = make()
    return store[key]
