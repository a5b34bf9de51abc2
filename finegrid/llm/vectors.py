"""What the vector searches share: clean vectors, copies folded, blocks of rows and of queries, the best of a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Beyond this a component counts as not finite.
HUGE = 1e300


def usable(vector: Column) -> Column:
    """Neither null nor empty, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > HUGE))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector, dim)`` of the rows that take part; vectors as doubles, rows without an id left out."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull()).filter(usable(F.col("vector"))).withColumn("dim", F.size("vector"))


def folded(rows: DataFrame, keep: int) -> DataFrame:
    """Per different vector its ``keep`` least ids, each once: no query can list more of one vector.

    Tasks fold their own rows before the shuffle, so a vector of a third of all rows costs ``keep`` rows per task.
    """
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    copies = F.row_number().over(Window.partitionBy("vector", "id").orderBy("id"))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= keep).withColumn("__copy", copies).filter("__copy = 1").drop("__rank", "__copy")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def in_blocks(rows: DataFrame, size: int, index: Callable[[np.ndarray], bytes] = lambda vectors: b"", keep_vectors: bool = True) -> DataFrame:
    """``(block, dim, ids, vectors, index)``: up to ``size`` rows of one dimension, in the order of their ids.

    ``ids`` and ``vectors`` are raw numbers, ``index`` is what the function of that name makes of a block's vectors.
    Rows are dealt out evenly, as many to a task as make a block.
    """

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        part, made = TaskContext.get().partitionId(), 0

        def out(dim: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float64)
            made += 1
            block = {"block": pa.array([(part << 32) + made], pa.int64()), "dim": pa.array([dim], pa.int32())}
            data = {"ids": ids.astype(np.int64).tobytes(), "vectors": vectors.tobytes() if keep_vectors else b"", "index": index(vectors)}
            return pa.RecordBatch.from_pydict(block | {k: pa.array([v], pa.binary()) for k, v in data.items()})

        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(dims)):
                at = pa.array(np.flatnonzero(dims == dim))
                ids, vectors = batch.column(0).take(at).to_numpy(zero_copy_only=False), matrix(batch.column(1).take(at), dim)
                if dim in held:
                    ids, vectors = np.concatenate([held[dim][0], ids]), np.concatenate([held[dim][1], vectors])
                while len(ids) >= size:
                    yield out(dim, ids[:size], vectors[:size])
                    ids, vectors = ids[size:], vectors[size:]
                held[dim] = ids, vectors
        for dim, (ids, vectors) in sorted(held.items()):
            if len(ids):
                yield out(dim, ids, vectors)

    dealt = rows.select("id", "vector", "dim").repartition(max(1, -(-rows.count() // size)))
    return dealt.mapInArrow(run, "block long, dim int, ids binary, vectors binary, index binary")


def against(blocks: DataFrame, queries: DataFrame, search: Callable[[dict, dict], Iterator[tuple]], score: str) -> DataFrame:
    """``search`` of every block of queries in every block of rows of its dimension: ``(query_id, vec_id, score)``.

    Both tables of blocks meet on the pair of their numbers, so the pairs are dealt out evenly, each to one task;
    ``search`` gets two blocks as dicts and yields arrays of query ids, row ids and scores, a few per query.
    """
    numbers = lambda df, name: df.groupBy("dim").agg(F.collect_list("block").alias(name))  # noqa: E731  a number per block
    left = blocks.join(numbers(queries, "theirs"), "dim").withColumn("q", F.explode("theirs")).select("dim", F.col("block").alias("r"), "q", "ids", "vectors", "index")
    right = queries.join(numbers(blocks, "theirs"), "dim").withColumn("r", F.explode("theirs")).select("dim", "r", F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("index").alias("q_index"))
    pairs = left.join(right, ["dim", "r", "q"]).select("dim", "ids", "vectors", "index", "q_ids", "q_vectors", "q_index")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                data = [batch.column(k)[i].as_buffer() for k in range(1, 7)]
                row, query = ({"dim": dim, "ids": np.frombuffer(d[0], np.int64), "vectors": np.frombuffer(d[1], np.float64).reshape(-1, dim), "index": d[2]} for d in (data[:3], data[3:]))
                for q, v, s in search(row, query):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
