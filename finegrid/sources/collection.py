"""Large feature collections read by ranges of bytes, so that one document is work for many tasks.

A byte range of JSON can't tell whether it starts inside a text. Each range therefore works out where it would end
for each of the three ways to start; these few numbers per range, put in order, give every range its true start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 16 << 20
OUTSIDE, INSIDE, ESCAPED = range(3)  # outside texts, inside one, after a backslash in one
_BEFORE = (b"", b'"', b'"\\')  # what brings a reader into that state
_TEXT = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*(?:(")|(\\?)\Z)', re.DOTALL)
_STEP = np.zeros(256, "int8")
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_LEVEL = 2  # features stand in an array of the document


def scan(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of the brackets outside texts, the step in depth at each, and the state after ``data``."""
    end = OUTSIDE

    def blank(m: re.Match) -> bytes:
        nonlocal end
        end = OUTSIDE if m[1] else ESCAPED if m[2] else INSIDE
        return b" " * (m.end() - m.start())

    rest = np.frombuffer(_TEXT.sub(blank, _BEFORE[state] + data), "uint8")[len(_BEFORE[state]):]
    step = _STEP[rest]
    at = np.flatnonzero(step)
    return at, step[at].astype("int64"), end


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")
    return system.open_input_file(name)


def _outline(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per range and way to start: the state at its end and the change in depth."""
    for pdf in frames:
        found = []
        for r in pdf.itertuples(index=False):
            with _open(r.path) as f:
                data = f.read_at(r.size, r.at)
            ways = [scan(data, s) for s in (OUTSIDE, INSIDE, ESCAPED)]
            found.append((r.path, r.at, r.size, [w[2] for w in ways], [int(w[1].sum()) for w in ways]))
        yield pd.DataFrame(found, columns=["path", "at", "size", "ends", "steps"])


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """State and depth at the start of each range of one file: one small row per range, in order."""
    pdf = pdf.sort_values("at")
    state, depth, out = OUTSIDE, 0, []
    for r in pdf.itertuples(index=False):
        out.append((r.path, r.at, r.size, state, depth))
        state, depth = int(r.ends[state]), depth + int(r.steps[state])
    return pd.DataFrame(out, columns=["path", "at", "size", "state", "depth"])


def _rest(f, at: int, state: int, depth: int, block: int = 1 << 20) -> bytes:
    """What a feature that began before ``at`` still has to come."""
    parts = []
    while data := f.read_at(block, at):
        place, step, state = scan(data, state)
        level = depth + np.cumsum(step)
        closed = np.flatnonzero(level == _LEVEL)
        if closed.size:
            return b"".join([*parts, data[:place[closed[0]] + 1]])
        parts.append(data)
        at, depth = at + len(data), int(level[-1]) if level.size else depth
    raise ValueError("the document ends inside a feature")


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The objects that begin in each range at the depth of features, as texts."""
    for pdf in frames:
        for r in pdf.itertuples(index=False):
            with _open(r.path) as f:
                data = f.read_at(r.size, r.at)
                place, step, state = scan(data, r.state)
                level = r.depth + np.cumsum(step)
                begins = place[(step > 0) & (level == _LEVEL + 1)]
                closes = place[(step < 0) & (level == _LEVEL)]
                # what begins at the depth of features, objects or not, ends in the order of its beginning
                closes = closes[np.searchsorted(closes, begins[0]):] if begins.size else closes[:0]
                texts = [data[a:b + 1] for a, b in zip(begins, closes)]
                if begins.size > closes.size:
                    texts.append(data[begins[-1]:] + _rest(f, r.at + len(data), state, int(level[-1])))
            found = [(r.path, r.at + int(a), t.decode("utf-8", "replace")) for a, t in zip(begins, texts) if t.startswith(b"{")]
            yield pd.DataFrame(found, columns=["path", "at", "value"])


def split_collection(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(path, at, value): every object that stands in an array of a document, with its place in bytes, as JSON text.

    ``path`` names a file or folder of JSON documents, one or several to a file, in UTF-8 and not compressed. No task
    holds more than one range and one feature. Results are alike for every ``range_bytes``. Empty files give no rows;
    a document that breaks off inside a feature is an error.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    places = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("at"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = places.select("path", "at", F.least(F.lit(range_bytes).cast("long"), F.col("length") - F.col("at")).alias("size")).repartition(tasks, "path", "at")
    outline = ranges.mapInPandas(_outline, "path string, at long, size long, ends array<int>, steps array<long>")
    starts = outline.groupBy("path").applyInPandas(_starts, "path string, at long, size long, state int, depth long")
    return starts.repartition(tasks, "path", "at").mapInPandas(_features, "path string, at long, value string")
