"""Exact top-k by inner product over a bit-sliced index.

A block of rows keeps, for each attribute and each bit of its quantised values, a bitmap over the rows.  A query adds
the bitmaps that the set bits of its own values name, column by column of equal weight, with full adders on whole
bitmaps.  The sums come out bit-sliced as well; the best rows are picked from the most significant slice down, and
the rows that tie at the boundary are resolved by id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finegrid.llm.common import saved
from finegrid.llm.vectors import against, best, clean, folded, in_blocks

#: Values are floor(SCALE * x).
SCALE = 256
ROW_BLOCK, QUERY_BLOCK = 65536, 128
EXACT = 2.0**53  # from here on every double is whole


def _integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers; as Python's, where 64 bits don't do."""
    if not values.size or np.abs(values).max() < EXACT:
        return values.astype(np.int64)
    return np.array([[int(v) for v in row] for row in values], object)


def _bitmap(bits: np.ndarray) -> np.ndarray:
    """Packed 64-bit words, row 0 in the lowest bit of the first."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)]).view(np.uint64)


def slices(values: np.ndarray) -> bytes:
    """Index of a block: per attribute its least value, its number of bits, and a bitmap per bit of (value - least)."""
    whole = _integers(values)
    head, maps = [], []
    for column in whole.T:
        least = min(column.tolist())
        above = column - least
        width = int(max(above.tolist())).bit_length()
        head.append((str(least).encode(), width))
        for b in range(width):
            maps.append(_bitmap(((above >> b) & 1).astype(np.uint8)))
    text = b",".join(b"%s:%d" % h for h in head)
    return struct.pack("<I", len(text)) + text + b"".join(m.tobytes() for m in maps)


def _read(index, n: int) -> tuple[list[int], list[int], np.ndarray]:
    data = memoryview(index)
    size = struct.unpack("<I", data[:4])[0]
    pairs = [p.split(b":") for p in bytes(data[4:4 + size]).split(b",")]
    words = -(-n // 64)
    maps = np.frombuffer(bytes(data[4 + size:]), np.uint64).reshape(-1, words)
    return [int(a) for a, _ in pairs], [int(w) for _, w in pairs], maps


def add(columns: dict[int, list[int]], maps: np.ndarray) -> dict[int, np.ndarray]:
    """Bit slices of the sum of weighted bitmaps: ``columns[w]`` lists the maps that count ``2 ** w`` each."""
    out: dict[int, np.ndarray] = {}
    carries: dict[int, list[np.ndarray]] = {}
    w, last = min(columns, default=0), max(columns, default=-1)
    while w <= last or w in carries:
        parts = carries.pop(w, [])
        if columns.get(w):
            parts.append(maps[columns[w]])
        if parts:
            here = np.concatenate(parts) if len(parts) > 1 else parts[0]
            up: list[np.ndarray] = []
            while len(here) > 2:
                k = len(here) // 3
                a, b, c = here[:k], here[k:2 * k], here[2 * k:3 * k]
                half = a ^ b
                up.append((a & b) | (half & c))
                here = np.concatenate([half ^ c, here[3 * k:]])
            if len(here) == 2:
                up.append(here[:1] & here[1:])
                here = here[:1] ^ here[1:]
            out[w] = here[0]
            if up:
                carries.setdefault(w + 1, []).extend(up)
        w += 1
    return out


def _rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=n))


def top(sums: dict[int, np.ndarray], candidates: np.ndarray, k: int, n: int) -> list[int]:
    """Rows with the ``k`` highest sums, most significant slice first; the boundary's ties in row order."""
    sure, open_ = np.zeros_like(candidates), candidates
    for w in sorted(sums, reverse=True):
        with_bit = open_ & sums[w]
        both = sure | with_bit
        count = int(np.bitwise_count(both).sum())
        if count >= k:
            open_ = with_bit
            if count == k:
                return _rows(both, n).tolist()
        else:
            sure, open_ = both, open_ & ~sums[w]
    chosen = _rows(sure, n).tolist()
    return chosen + _rows(open_, n)[:k - len(chosen)].tolist()


def search(row: dict, query: dict, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids, n = row["ids"], len(row["ids"])
    least, widths, maps = _read(row["index"], n)
    first = np.concatenate([[0], np.cumsum(widths)]).astype(int)
    maps = np.concatenate([maps, ~maps])  # a negative value adds the complement
    negative = int(first[-1])
    whole = _bitmap(np.ones(n, np.uint8))
    found: tuple[list, list, list] = ([], [], [])
    for query_id, values in zip(query["ids"].tolist(), _integers(query["vectors"]).tolist()):
        columns: dict[int, list[int]] = {}
        fixed = 0
        for d, value in enumerate(values):
            fixed += value * least[d]
            size, shift = abs(value), 0
            if value < 0:
                fixed -= size * ((1 << widths[d]) - 1)
            base = int(first[d]) + (negative if value < 0 else 0)
            while size:
                if size & 1:
                    for b in range(widths[d]):
                        columns.setdefault(shift + b, []).append(base + b)
                size >>= 1
                shift += 1
        sums = add(columns, maps)
        candidates = whole
        own = np.flatnonzero(ids == query_id)
        if len(own):
            mask = np.zeros(n, np.uint8)
            mask[own] = 1
            candidates = whole & ~_bitmap(mask)
        for r in top(sums, candidates, k, n):
            score = fixed + sum(1 << w for w, s in sums.items() if int(s[r >> 6]) >> (r & 63) & 1)
            found[0].append(query_id)
            found[1].append(int(ids[r]))
            found[2].append(max(-(1 << 63), min((1 << 63) - 1, score)))
    yield tuple(np.array(f, np.int64) for f in found)


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows whose id is divisible by ``every``, the ``k`` rows of highest inner product.

    Components count as ``floor(256 * x)``.  Every row but the query's own is a candidate, ties go to the smaller id.
    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without an id;
    vectors meet those of their own length only; repeated rows count once; scores that 64 bits don't hold are cut to
    their ends; an empty table gives an empty one.  Of copies of one vector only the ``k + 1`` least ids are indexed,
    as no query can list more.
    """
    # floor() gives a long, which large components would overflow
    floor = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    whole = clean(df, id_col, vector_col).withColumn("vector", F.transform("vector", lambda x: floor(x * SCALE)))
    rows = saved(whole, "vectors")
    blocks = saved(in_blocks(saved(folded(rows, k + 1), "folded"), ROW_BLOCK, slices, keep_vectors=False), "index")
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "vector"])
    queries = saved(in_blocks(saved(asked, "queries"), QUERY_BLOCK), "asked")
    return best(against(blocks, queries, lambda row, query: search(row, query, k), "long"), k)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
