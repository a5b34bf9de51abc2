"""Toxic documents by compression distance: which of two zstandard dictionaries, of toxic and of ordinary text, packs a window better."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finegrid.llm.common import kept_in_worker, pieces, utf8, with_column

#: Labelled rows that a model is fitted on at most, and the longest text among them; scoring has no such bounds.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 200_000
#: Lengths of the byte strings whose class frequencies are compared, next to whole words; all count a word's borders.
GRAMS = (4, 6, 8)
#: Least toxic rows that hold a telling byte string, least likelihood ratio.
LEAST_ROWS, EVIDENCE = 3, 20.0
DICTIONARY = 12_000
#: Windows whose distance a worker remembers; the memory is emptied when it is full.
REMEMBERED = 200_000
#: Every byte is spelt as three, so that packed lengths, which are whole bytes, resolve a match of a few letters.
SPELT = [bytes([c, (31 * c + 101) % 256, (5 * c + 77) % 256]) for c in range(256)]
#: Matches are sought up to some bytes before the end of the input only.
TAIL = bytes(range(3, 19))
STEPS = (3, 4, 5, 6, 8, 10)


def _spell(data: bytes) -> bytes:
    return b"".join(map(SPELT.__getitem__, data))


def windows(text: bytes) -> Iterable[list[bytes]]:
    """A whole text's windows: its words in lower case (A-Z), each packed by itself with its borders."""
    for part in pieces(text.lower()):
        yield part.split()


def _grams(word: bytes, size: int) -> set[bytes]:
    """The byte strings of one length in a word with its borders; the whole word for 0."""
    word = b" " + word + b" "
    return {word[i:i + size] for i in range(len(word) - size + 1)} if size else {word}


def _ratio(k: int, n: int, m: int, o: int) -> float:
    """Likelihood ratio of ``k`` of ``n`` toxic against ``m`` of ``o`` ordinary rows; 0 where they don't exceed them."""
    if not o or k * o <= m * n:
        return 0.0
    p = (k + m) / (n + o)
    part = lambda seen, expected: seen * math.log(seen / expected) if seen else 0.0
    return 2 * (part(k, n * p) + part(n - k, n * (1 - p)) + part(m, o * p) + part(o - m, o * (1 - p)))


class Vocabularies:
    """Rows as the words of each, kept as one byte string a row and read as a set: sets of all rows at once take some ten times the texts."""

    def __init__(self) -> None:
        self.rows: list[bytes] = []

    def add(self, words: set[bytes]) -> None:
        self.rows.append(b" ".join(words))

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[set[bytes]]:
        return (set(row.split()) for row in self.rows)


def _telling(toxic: Vocabularies, ordinary: Vocabularies) -> list[bytes]:
    """Byte strings that toxic rows (sets of words) hold more often than ordinary rows, by likelihood ratio.

    Of strings that share their letters (as many in a row as the shortest have) only the best one stays, the longest
    of equals.  One length is counted at a time, and of ordinary rows only what toxic rows hold often enough.
    """
    found = []
    for size in (*GRAMS, 0):
        k = Counter()
        for words in toxic:
            k.update(set().union(*(_grams(w, size) for w in words)))
        k = {g: c for g, c in k.items() if c >= LEAST_ROWS}
        often, m, own = set(k), Counter(), {}
        for words in ordinary:
            for w in words.difference(own):
                own[w] = tuple(_grams(w, size) & often)
            m.update(set().union(*map(own.__getitem__, words)))
            if len(own) > REMEMBERED:
                own.clear()
        found += [(v, len(g), g) for g, c in k.items() if (v := _ratio(c, len(toxic), m[g], len(ordinary))) > EVIDENCE]
    kept, held = [], set()
    for _, _, g in sorted(set(found), key=lambda x: (-x[0], -x[1], x[2])):
        own = {g[i:i + GRAMS[0]] for i in range(max(len(g) - GRAMS[0], 0) + 1)}
        if held.isdisjoint(own):
            kept.append(g)
            held |= own
    return kept


def _content(words: Iterable[bytes]) -> bytes:
    """Dictionary of the first words that fit, the best ones last, where offsets are short."""
    kept, size = [], 0
    for word in words:
        size += len(word) + 1
        if size > DICTIONARY:
            break
        kept.append(word)
    return _spell(b" " + b" ".join(reversed(kept)) + b" ")


def _contents(toxic: Vocabularies, ordinary: Vocabularies) -> tuple[bytes, bytes]:
    """Both dictionaries: words that hold telling strings, each string's most common one before the next ones; common words that hold none."""
    telling = _telling(toxic, ordinary)
    holds = {g: [] for g in telling}
    seen, common = (Counter(w for row in rows for w in row) for rows in (toxic, ordinary))
    for w in sorted(seen, key=lambda w: (-seen[w], w)):
        for g in telling:
            if g in b" " + w + b" ":
                holds[g].append(w)
    turns = dict.fromkeys(w for turn in zip_longest(*holds.values()) for w in turn if w is not None)
    plain = (w for w in sorted(common, key=lambda w: (-common[w], w)) if not any(g in b" " + w + b" " for g in telling))
    return _content(turns), _content(plain)


class Distance:
    """Bytes by which a window packs better with the toxic than with the ordinary dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        how = z.ZstdCompressionParameters.from_level(3, strategy=z.STRATEGY_LAZY, min_match=6, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.toxic, self.ordinary = (z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (toxic, ordinary))
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            data = _spell(b" " + word + b" ") + TAIL
            known[word] = len(self.ordinary.compress(data)) - len(self.toxic.compress(data))
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def features(self, text: bytes) -> list[float]:
        """Of a whole text: the largest distance, how many windows lie beyond each step, what lies beyond the first one, the length, the shares beyond each step."""
        most, beyond, total, n = 0, [0] * len(STEPS), 0, 0
        for words in windows(text):
            if words:
                d = self.of(words)
                most, n = max(most, int(d.max())), n + len(d)
                beyond = [b + int((d >= s).sum()) for b, s in zip(beyond, STEPS)]
                total += int(np.maximum(d - STEPS[0], 0).sum())
        return [float(most), *(math.log1p(b) for b in beyond), math.log1p(total), math.log1p(n), float(most > STEPS[-1]), *(math.sqrt(b / max(n, 1)) for b in beyond)]


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a logistic calibration of the distances; a few kilobytes, sent to the executors with the task."""

    toxic: bytes
    ordinary: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def scores(self, texts: Iterable[bytes]) -> np.ndarray:
        distance = kept_in_worker(("toxicity", self.toxic, self.ordinary), lambda: Distance(self.toxic, self.ordinary))
        x = np.array([distance.features(t) for t in texts], float).reshape(-1, len(self.center))
        z = np.clip(((x - self.center) / self.scale) @ np.array(self.weights[1:]) + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is not penalised but for a trace."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Model from ``(text, 1 if toxic)``: byte strings that toxic rows have more of against common words of ordinary rows.

    Two thirds of the rows make the dictionaries, the others calibrate the distances, as strings that are in a
    dictionary by chance are in its own rows more than in new ones.  Without rows of both classes every score is
    that of the prior.
    """
    learn, check = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    own = (Vocabularies(), Vocabularies())
    for text, toxic in learn:
        own[toxic].add({w for part in windows(text) for w in part})
    contents = _contents(own[1], own[0])
    distance = Distance(*contents)
    x = np.array([distance.features(t) for t, _ in check], float).reshape(len(check), 2 * len(STEPS) + 4)
    y = np.array([toxic for _, toxic in check], float)
    if not len(x):
        return Model(*contents, (0.0,) * x.shape[1], (1.0,) * x.shape[1], (-30.0,) + (0.0,) * x.shape[1])
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return Model(*contents, tuple(center), tuple(scale), tuple(_logistic((x - center) / scale, y)))


def sample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE_ROWS) -> list[tuple[bytes, int]]:
    """At most ``most`` labelled rows, in the order of a hash of their id; never of held-out ids.

    The chosen ids are broadcast, as their number is bounded, so no text is shuffled.  Rows without a label or an id
    take no part, nor do texts over ``SAMPLE_BYTES``.
    """
    chosen = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)")
              .filter(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id", "__label").limit(most))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (df.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).filter(F.octet_length(text) <= SAMPLE_BYTES)
            .select(F.xxhash64("__id").alias("h"), "__id", text.alias("t"), "__label").orderBy("h", "__id", "t", "__label").limit(most))
    return [(r["t"].encode("utf-8"), r["__label"]) for r in rows.toLocalIterator()]


def held_out(doc_id: Column) -> Column:
    """True for the ids whose labels no model may see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def scored(df: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the score (0 to 1) of every whole text in ``into``; null counts as empty; other columns stay.  No shuffle."""
    return with_column(df, text_col, into, "double", lambda texts: pa.array(model.scores(utf8(texts))), 512)


def predictions(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row; a null id is not held out; an empty table gives an empty one."""
    model = fit(sample(df, labels, id_col, text_col, label_col))
    out = scored(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``df`` without the rows that the model predicts to be toxic; all columns stay."""
    model = fit(sample(df, labels, id_col, text_col, label_col))
    return scored(df, model, text_col, "__toxic").filter("__toxic < 0.5").select(*df.columns)
