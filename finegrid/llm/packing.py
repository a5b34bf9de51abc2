"""Best-fit packing of documents into sequences of a fixed length by the sum-of-squares rule.

A document's token ids, with an end id, are one piece, or several where they are longer than a sequence.  Each piece
goes where the squared counts of open sequences per gap become smallest; a sequence is opened only if no open one has
room.  Tasks pack their own share of the pieces from the longest down; sequences that a task leaves open are then
packed like pieces of their own, in rounds that get smaller.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finegrid.llm.common import local_file, saved, type_of, utf8
from finegrid.llm.token_files import word_encoder

CAPACITY = 2048
#: Pieces that a task packs; a task leaves about one sequence more than it must, so more pieces waste less.
PER_TASK = 1 << 16


class SumOfSquares:
    """Open sequences by their gap; ``place`` says which one takes a piece, and where in it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        # Filling a gap changes the sum of squares by 1 - 2 N[gap], moving one from gap g to h by 2 + 2 (N[h] - N[g]):
        # with -1/2 for the gap 0 of full sequences, whose number doesn't count, N[h] - N[g] orders both alike.
        self.count = np.zeros(capacity + 1)
        self.count[0] = -0.5
        self.there = np.full(capacity + 1, -np.inf)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n = 0

    def place(self, size: int) -> tuple[int, int]:
        """``(sequence, offset)``; of gaps that do equally well the smallest is taken."""
        change = self.count[:self.capacity - size + 1] - self.there[size:]
        at = int(change.argmin())
        if change[at] < np.inf:
            gap = at + size
            sequence = self.open[gap].pop()
            self._add(gap, -1)
        else:
            gap, sequence = self.capacity, self.n
            self.n += 1
        if gap > size:
            self.open[gap - size].append(sequence)
            self._add(gap - size, 1)
        return sequence, self.capacity - gap

    def _add(self, gap: int, n: int) -> None:
        self.count[gap] += n
        self.there[gap] = self.count[gap] if self.count[gap] else -np.inf


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(start, ids)`` of a document: whole if it fits, else cut into full sequences and a last piece."""
    for start in range(0, len(ids), capacity):
        yield start, ids[start:start + capacity]


def cut(df: DataFrame, tokenizer_file: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])`` of every document: its whole text's ids, ``end_id`` after them, cut where they exceed ``capacity``.

    A null text counts as empty and gives the end id alone; a null id stays null; repeated rows give pieces each;
    other columns are not read; an empty table gives an empty one.  No shuffle.  ``ids`` is an array of ints.
    """
    definition = local_file(df.sparkSession, tokenizer_file)
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches):
        encoder = word_encoder(definition.value)
        tail = np.array([end_id], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                at, piece, start, found = [], [], [], []
                for i, ids in enumerate(encoder.encode(list(utf8(rows.column(1))))):
                    for k, (s, part) in enumerate(pieces_of(np.concatenate([ids, tail]), capacity)):
                        at.append(i)
                        piece.append(k)
                        start.append(s)
                        found.append(part)
                columns = [rows.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(p) for p in found], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([p.astype(np.int32) for p in found], pa.list_(pa.int32()))] if keep_ids else []), names)

    schema = f"`{id_col}` {type_of(df, id_col)}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _packed(items: DataFrame, size_col: str, capacity: int, tasks: int, turn: int) -> DataFrame:
    """``items`` with ``__bin`` and ``__offset``: each task packs the rows that it was dealt, the largest first."""
    at = items.columns.index(size_col)

    def run(batches):
        rule, first = SumOfSquares(capacity), (turn << 58) + (TaskContext.get().partitionId() << 32)
        for batch in batches:
            placed = [rule.place(size) for size in batch.column(at).to_pylist()]
            bins = pa.array([first + b for b, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, bins, pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "__bin", "__offset"])

    dealt = items.repartition(tasks).sortWithinPartitions(F.col(size_col).desc())
    return saved(dealt.mapInArrow(run, items.schema.add("__bin", "long").add("__offset", "long")), "packed")


def pack(items: DataFrame, size_col: str = "length", capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: rows of one sequence lie in it without a gap, from 0, ``capacity`` at most.

    Sizes are whole numbers from 1 to ``capacity``, anything else is an error.  Rows are dealt out evenly, whatever
    they hold, ``per_task`` to a task, so repeated rows are no hot key; an empty table gives an empty one.  Columns
    named like the two new ones are replaced.  Of each task's result, only the open sequences travel on.
    """
    items = items.select(*[c for c in items.columns if c not in ("sequence_id", "offset")])
    size = F.col(size_col).cast("long")
    n, wrong = items.agg(F.count("*"), F.count(F.when(~F.coalesce((size >= 1) & (size <= capacity), F.lit(False)), 1))).first()
    if wrong:
        raise ValueError(f"{wrong} rows have no size from 1 to {capacity}")
    tasks = max(1, -(-n // per_task))
    first = _packed(items, size_col, capacity, tasks, 0)
    rounds, now, rows = [], first, n
    while tasks > 1 and len(rounds) < 31:
        left = now.groupBy("__bin").agg(F.sum(size_col if now is first else "__level").alias("__level")).filter(F.col("__level") < capacity)
        left = saved(left.withColumnRenamed("__bin", "__was"), "open")
        n = left.count()
        if n > 0.9 * rows:  # nothing more to gain: the open sequences hardly go together
            break
        rows, tasks = n, max(1, -(-n // per_task))
        now = _packed(left, "__level", capacity, tasks, len(rounds) + 1)
        rounds.append(now.select("__was", F.col("__bin").alias("__next"), F.col("__offset").alias("__shift")))
    found = first
    for moved in rounds:  # a sequence that is full by then has no row there
        found = found.join(moved, found["__bin"] == moved["__was"], "left").withColumn("__offset", F.col("__offset") + F.coalesce("__shift", F.lit(0))).withColumn("__bin", F.coalesce("__next", "__bin")).drop("__was", "__next", "__shift")
    return found.withColumnRenamed("__bin", "sequence_id").withColumnRenamed("__offset", "offset")


def packed_documents(df: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY, per_task: int = PER_TASK, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places: ``(id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``; see `cut` and `pack`."""
    return pack(saved(cut(df, tokenizer_file, end_id, capacity, keep_ids, id_col, text_col), "pieces"), "length", capacity, per_task)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``(sequence_id, length, ids, starts)``, ``starts`` giving where each piece begins; ``placed`` has ``ids``.

    A group holds one sequence, so its size is bounded by the capacity.
    """
    part = F.struct("offset", "ids")
    ordered = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(part)).alias("p"))
    return ordered.select("sequence_id", "length", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))
