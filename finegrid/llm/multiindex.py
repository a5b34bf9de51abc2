"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by a codebook of its own; a cell is a pair of centroids.  A query
visits cells in the order of the summed distance of its halves to the two centroids, with a heap, until the visited
cells hold a share of all rows; the entries of those cells are reranked by the cosine of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finegrid.llm.common import saved
from finegrid.llm.vectors import against, best, clean, folded, in_blocks

#: Rows that the codebooks are fitted on at most, and those that a length of vectors needs for codebooks of its own.
SAMPLE_ROWS, LEAST_ROWS = 20_000, 64
CENTROIDS = 32
#: Share of all rows that the visited cells hold at least; recall of the five nearest stands in the README.
SHARE = 0.65
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
#: Rows whose products differ by less may differ in the last bits only, so all of them are reranked.
CLOSE = 1e-9

Codebooks = dict[int, tuple[np.ndarray, np.ndarray]]


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from ``k`` different rows; fewer centers if there are fewer different rows."""
    different = np.unique(x, axis=0)
    centers = different[np.random.default_rng(seed).permutation(len(different))[:k]].copy()
    for _ in range(rounds):
        near = _squares(x, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = -(-x.shape[1] // 2)
    return x[:, :cut], x[:, cut:]


def fit(rows: DataFrame, centroids: int = CENTROIDS, most: int = SAMPLE_ROWS) -> Codebooks:
    """Two codebooks per length of vectors, fitted on the driver on at most ``most`` rows in the order of a hash of their id.

    A length with under ``LEAST_ROWS`` rows in the sample gets one cell for all its vectors.
    """
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("dim", "vector").toArrow()
    dims = sample.column("dim").to_numpy()
    books: Codebooks = {}
    for dim in map(int, np.unique(dims)):
        at = np.flatnonzero(dims == dim)
        if len(at) >= LEAST_ROWS:
            x = unit(np.array(sample.column("vector").take(pa.array(at)).to_pylist(), float))
            first, second = halves(x)
            books[dim] = k_means(first, centroids), k_means(second, centroids)
    return books


def _books(books: Codebooks, dim: int) -> tuple[np.ndarray, np.ndarray]:
    first, second = halves(np.zeros((1, dim)))
    return books.get(dim, (first, second))


def cells(vectors: np.ndarray, books: Codebooks) -> np.ndarray:
    one, two = _books(books, vectors.shape[1])
    first, second = halves(unit(vectors))
    return _squares(first, one).argmin(axis=1) * len(two) + _squares(second, two).argmin(axis=1)


def visits(first: np.ndarray, second: np.ndarray, counts: np.ndarray, least: float) -> list[int]:
    """Cells in the order of ``first[i] + second[j]`` until they hold ``least`` rows; ``counts`` by cell.

    Pair (i, j) of the sorted distances enters the heap when (i - 1, j) or (i, j - 1) has left it, so only the rim
    of what was visited waits there.
    """
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by_first].tolist(), second[by_second].tolist()
    heap, waiting, out, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        cell = int(by_first[i]) * len(b) + int(by_second[j])
        out.append(cell)
        held += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in waiting:
                waiting.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return out


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """In double precision, one row like another, so that equal vectors get equal scores."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def search(row: dict, query: dict, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries of the cells that each query visits, cell by cell; then the ``k`` best of each query and what ties with them, reranked."""
    ids, vectors, cell = row["ids"], row["vectors"], np.frombuffer(row["index"], np.int32)
    masks = np.frombuffer(query["index"], np.uint8).reshape(len(query["ids"]), -1)
    mine, theirs = unit(query["vectors"]), unit(vectors)
    scores = np.full((len(mine), len(theirs)), -np.inf)
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0, True])
    for a, z in zip(starts[:-1], starts[1:]):
        entries, c = order[a:z], int(cell[order[a]])
        asking = np.flatnonzero(masks[:, c >> 3] >> (c & 7) & 1)
        if len(asking):
            scores[np.ix_(asking, entries)] = mine[asking] @ theirs[entries].T
    found: tuple[list, list, list] = ([], [], [])
    for q, query_id in enumerate(query["ids"].tolist()):
        line = scores[q]
        line[ids == query_id] = -np.inf
        seen = np.flatnonzero(line > -np.inf)
        if not len(seen):
            continue
        bound = np.partition(line[seen], -k)[-k] if len(seen) > k else -np.inf
        near = seen[line[seen] >= bound - CLOSE]
        exact = cosines(query["vectors"][q], vectors[near])
        chosen = np.lexsort((ids[near], -exact))[:k]
        found[0].extend([query_id] * len(chosen))
        found[1].extend(ids[near[chosen]].tolist())
        found[2].extend(exact[chosen].tolist())
    yield np.array(found[0], np.int64), np.array(found[1], np.int64), np.array(found[2], np.float64)


def nearest(df: DataFrame, k: int = 5, every: int = 50, share: float = SHARE, centroids: int = CENTROIDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows whose id is divisible by ``every``, the ``k`` largest cosines found.

    Every row but the query's own is a candidate; ties go to the smaller id.  Vectors that are null, empty, zero or
    hold a null or non-finite component take no part, nor do rows without an id; vectors meet those of their own
    length only; repeated rows count once; an empty table gives an empty one.  Every row is indexed, but of copies of
    one vector only the ``k + 1`` least ids, as no query can list more.  Codebooks and the number of rows by cell, at
    most ``centroids ** 2`` per length, go through the driver.
    """
    rows = saved(clean(df, id_col, vector_col).filter(F.exists("vector", lambda x: x != 0)), "vectors")
    books = fit(rows, centroids)
    blocks = saved(in_blocks(saved(folded(rows, k + 1), "folded"), ROW_BLOCK, lambda v: cells(v, books).astype(np.int32).tobytes()), "index")

    def count(batches):
        for batch in batches:
            for dim, index in zip(batch.column(0).to_pylist(), batch.column(1)):
                cell, n = np.unique(np.frombuffer(index.as_buffer(), np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell), pa.array(n.astype(np.int64))], ["dim", "cell", "n"])

    known = sorted(books)
    held = blocks.select("dim", "index").filter(F.col("dim").isin(known)).mapInArrow(count, "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n"))
    counts = {dim: np.zeros(len(books[dim][0]) * len(books[dim][1]), np.int64) for dim in known}
    for r in held.collect():
        counts[r["dim"]][r["cell"]] = r["n"]

    def masks(vectors: np.ndarray) -> bytes:
        dim = vectors.shape[1]
        one, two = _books(books, dim)
        rows_of = counts.get(dim, np.ones(1, np.int64))
        first, second = halves(unit(vectors))
        to_first, to_second = _squares(first, one), _squares(second, two)
        visited = np.zeros((len(vectors), len(rows_of)), np.uint8)
        for q in range(len(vectors)):
            visited[q, visits(to_first[q], to_second[q], rows_of, share * rows_of.sum())] = 1
        return np.packbits(visited, axis=1, bitorder="little").tobytes()

    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "vector"])
    queries = saved(in_blocks(saved(asked, "queries"), QUERY_BLOCK, masks), "asked")
    return best(against(blocks, queries, lambda row, query: search(row, query, k), "double"), k)
