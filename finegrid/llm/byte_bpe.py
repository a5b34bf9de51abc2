"""Byte-level BPE: whole texts to token ids with the tiktoken library and a local rank file, and back to raw bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from finegrid.llm.common import kept_in_worker, local_file, utf8, with_columns

#: Texts longer than this many characters are encoded in pieces.
PIECE = 1 << 20
ROWS = 256
#: Before white space that follows anything else the pattern always starts a new match, as no alternative holds
#: white space behind another character, and none looks back.
SAFE = re.compile(r"\S(?=[ \t\r\n])")


def ranks_of(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}


def _encoding(lines: bytes, pattern: str):
    import tiktoken

    return kept_in_worker(("tiktoken", lines, pattern), lambda: tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks_of(lines), special_tokens={}))


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in order, cut only where a match of the pattern is bound to start; a run without white space stays whole."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start:found.end()]
        start = found.end()
    yield text[start:] if start else text


def encode_text(text: str, encoding, size: int = PIECE) -> np.ndarray:
    """Ids of one text, equal to ``encoding.encode_ordinary(text)``."""
    if len(text) <= size:
        return np.array(encoding.encode_ordinary(text), np.int32)
    return np.concatenate([np.array(encoding.encode_ordinary(p), np.int32) for p in safe_pieces(text, size)])


def _encoding_step(spark: SparkSession, rank_file: str, pattern: str, text_col: str, into: str):
    lines = local_file(spark, rank_file)

    def column(texts: pa.Array) -> pa.Array:
        encoding = _encoding(lines.value, pattern)
        return pa.array([encode_text(t.decode("utf-8"), encoding) for t in utf8(texts)], pa.list_(pa.int32()))

    return text_col, into, "array<int>", column


def _decoding_step(spark: SparkSession, rank_file: str, pattern: str, ids_col: str, into: str):
    lines = local_file(spark, rank_file)

    def column(ids: pa.Array) -> pa.Array:
        back: Callable = _encoding(lines.value, pattern).decode_bytes
        return pa.array([back(x or []) for x in ids.to_pylist()], pa.binary())

    return ids_col, into, "binary", column


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the token ids of every whole text in ``into`` (array<int>); special tokens are ordinary text.

    A null or empty text gives an empty array.  Other columns stay; one called ``into`` is replaced.  The rank file
    is read on the driver and broadcast (refused above 64 MB).  Every row is independent: no shuffle.
    """
    return with_columns(df, [_encoding_step(df.sparkSession, rank_file, pattern, text_col, into)], ROWS)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of the ids of each row in ``into`` (binary); they need not be valid UTF-8.

    Null ids give no bytes; an id that the rank file lacks is an error.  Other columns stay.
    """
    return with_columns(df, [_decoding_step(df.sparkSession, rank_file, pattern, ids_col, into)], ROWS)


def encode_and_decode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", into: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encode`, then `decode` of its ids, in one pass: one worker and one vocabulary per task instead of two."""
    spark = df.sparkSession
    return with_columns(df, [_encoding_step(spark, rank_file, pattern, text_col, into), _decoding_step(spark, rank_file, pattern, into, decoded)], ROWS)


def default_vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public 50k vocabulary, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
