"""Whitening of embeddings: blockwise QR of the centred rows, then singular values and directions of the small factor.

The covariance itself is never formed: its eigenvalues are the squared singular values of the centred rows over their
number, found by `bidiagonal` from the triangular factor that tasks reduce their rows to.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finegrid.llm.bidiagonal import EPS, right_singular
from finegrid.llm.common import saved

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this are held at it.
LARGEST = float(1 << 62)
#: Rows that a task turns into numbers at once, and partial results that one task of a round joins.
ROWS, FAN = 4096, 32


def entries(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` of every entry."""
    held = lambda c: F.least(F.greatest(c * scale, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.transform(vector, lambda c: F.floor(held(c)).cast("long") + F.lit(shift))


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)`` of the rows whose vector is neither null nor empty and has finite entries only."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return rows.filter(~bad).select("id", entries(F.col("v")).alias("x"))


def _by_length(batches, column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """``(part of a batch, length, places in it, rows as int64)``, some thousand rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            lengths = np.array([len(v) for v in part.column(column)])
            for dim in map(int, np.unique(lengths)):
                at = np.flatnonzero(lengths == dim)
                yield part, dim, at, part.column(column).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def reduced(rows: DataFrame, start: Callable[[], object], add: Callable[[object, int, np.ndarray], object], join: Callable[[object, object], object], dump: Callable[[object], bytes], load: Callable[[bytes], object]) -> dict[int, object]:
    """``{length: result}``: tasks reduce their rows of ``x``, then rounds of tasks join `FAN` results each, until one is left."""

    def out(held: dict[int, object]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"dim": pa.array(list(held), pa.int32()), "data": pa.array([dump(s) for s in held.values()], pa.binary())})

    def first(batches):
        held: dict[int, object] = {}
        for _, dim, _, x in _by_length(batches, 0):
            held[dim] = add(held.get(dim) if dim in held else start(), dim, x)
        yield out(held)

    def again(batches):
        held: dict[int, object] = {}
        for batch in batches:
            for dim, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                state = load(data.as_buffer().to_pybytes())
                held[dim] = join(held[dim], state) if dim in held else state
        yield out(held)

    now = saved(rows.select("x").mapInArrow(first, "dim int, data binary"), "partial")
    parts = now.count()
    while parts > 1:
        parts = -(-parts // FAN)
        now = saved(now.repartition(parts).mapInArrow(again, "dim int, data binary"), "partial")
    return {r["dim"]: load(bytes(r["data"])) for r in now.collect()}  # one per length of vectors


def _sums(x: np.ndarray) -> list[int]:
    return (x if int(np.abs(x).max(initial=0)) < (1 << 62) // max(1, len(x)) else x.astype(object)).sum(axis=0).tolist()


def totals(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """``{length: (n, sums)}``, exact at any size."""
    add = lambda s, dim, x: (s[0] + len(x), [a + b for a, b in zip(s[1] or [0] * dim, _sums(x))])
    join = lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1])])
    return reduced(rows, lambda: (0, []), add, join, lambda s: json.dumps(s).encode(), lambda b: tuple(json.loads(b)))


def moved(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` without rounding: int64, or Python's integers where they don't fit."""
    most = max(map(abs, sums), default=0) + n * int(np.abs(x).max(initial=0))
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(d: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; null beyond 64 bits."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) < 1 << 31 and (int(np.abs(d).max(initial=0)) ** 2) * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (d.astype(object) ** 2).sum(axis=1).tolist()]


def factors(rows: DataFrame, known: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """``{length: R}`` with ``R'R = Y'Y`` for the centred rows ``Y``, a block of rows at a time under the factor so far."""

    def fold(r: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, y]), mode="r")

    def add(r, dim, x):
        n, sums = known[dim]
        return fold(np.zeros((0, dim)) if r is None else r, moved(x, n, sums).astype(float) / n)

    dump = lambda r: np.array(r.shape, "<i8").tobytes() + r.astype("<f8").tobytes()
    load = lambda b: np.frombuffer(b, "<f8", offset=16).reshape(np.frombuffer(b, "<i8", 2))
    return reduced(rows, lambda: None, add, fold, dump, load)


def directions(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """``(eigenvalues, unit vectors, trace)`` of the covariance; eigenvalues that are rounding only become 0."""
    full = np.zeros((r.shape[1], r.shape[1]))
    full[:len(r)] = r
    values, vectors = right_singular(full, most)
    values[values <= values[:1].sum() * (len(full) * EPS) ** 2] = 0.0
    return values / n, vectors, float((r * r).sum()) / n


Fitted = dict[int, tuple[int, list[int], np.ndarray, np.ndarray, float]]


def fit(rows: DataFrame, most: int) -> Fitted:
    """``{length: (n, sums, eigenvalues, vectors, trace)}`` of the different vectors ``x``."""
    known = totals(rows)
    return {dim: (*known[dim], *directions(r, known[dim][0], most)) for dim, r in factors(rows, known).items()}


def projected(x: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """``(n x - S, whitened)``; a component without variance is NaN."""
    n, sums, values, vectors, _ = model
    d = moved(x, n, sums)
    with np.errstate(invalid="ignore", divide="ignore"):
        return d, (d.astype(float) / n) @ vectors.T / np.where(values > 0, np.sqrt(values), np.nan)


def identity_errors(rows: DataFrame, models: Fitted) -> dict[int, float | None]:
    """Per length the largest absolute entry of the whitened rows' covariance minus the identity, over components with variance.

    Every block is centred on its own mean and blocks are joined by their means, so nothing cancels.
    """

    def moments(dim, x):
        w = projected(x, models[dim])[1][:, models[dim][2] > 0]
        mean = w.mean(axis=0)
        return len(w), mean, (w - mean).T @ (w - mean)

    def join(a, b):
        if a is None:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def load(data):
        k = int(np.frombuffer(data, "<f8", 1, 8)[0])
        v = np.frombuffer(data, "<f8", offset=16)
        return int(np.frombuffer(data, "<f8", 1)[0]), v[:k], v[k:].reshape(k, k)

    dump = lambda s: np.concatenate([[s[0], len(s[1])], s[1], s[2].ravel()]).astype("<f8").tobytes()
    got = reduced(rows, lambda: None, lambda s, dim, x: join(s, moments(dim, x)), join, dump, load)
    return {dim: float(np.abs(m / n - np.eye(len(m))).max()) if len(m) else None for dim, (n, _, m) in got.items()}


def whitened(df: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row per row of ``df`` and component.

    Entries become whole numbers; sums, ``n`` and deviations are over the different vectors and exact (a deviation
    beyond 64 bits is null).  Rows whose vector is null, empty or holds a null or non-finite entry are left out;
    repeated rows and rows with a null id come back as they are, each with its components; vectors of another length
    are fitted among themselves; an empty table gives an empty one.  There are ``components`` components, or as many
    as a vector has entries; one without variance has a null ``whitened``, and ``explained`` is null if there is no
    variance at all.  Other columns are not read.  Only sums and factors of a vector's length reach the driver.
    """
    rows = saved(clean(df, id_col, vector_col), "entries")
    different = saved(rows.select("x").distinct(), "different")
    models = fit(different, components)
    errors = identity_errors(different, models)
    id_type = df.schema[id_col].dataType.simpleString()
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for part, dim, at, x in _by_length(batches, 1):
            n, _, values, _, trace = models[dim]
            k, m = len(values), len(at)
            d, w = projected(x, models[dim])
            ids = part.column(0).take(pa.array(np.repeat(at, k)))
            share = np.tile(values / trace if trace else np.full(k, np.nan), m)
            nan_to_null = lambda v: pa.array(v, pa.float64(), from_pandas=True)
            deviation = pa.array(squares(d), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviation, nan_to_null(w.ravel()), nan_to_null(share), pa.array([errors[dim]] * (m * k), pa.float64())], names)

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
