"""Token-id files: every id in the fewest bits that the vocabulary needs, in blocks of a fixed number of ids.

A file holds one run of documents::

    magic | blocks | doc ids | doc id is set | ends of documents | block offsets | trailer

A block packs ``block_ids`` ids (the last one fewer), id ``i`` in bits ``i * bits`` and up, least significant bit
first.  ``ends[k]`` is the number of ids up to and with document ``k``, so a document's ids are found with two
numbers of the footer and read from the blocks that they touch.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finegrid.llm.common import filesystem, kept_in_worker, local_file, pieces, saved, utf8
from finegrid.session import scratch_path

MAGIC = b"FGIDS\x00\x01\x00"
TRAILER = "<QQQII8s"
BLOCK_IDS = 1 << 16
#: Words whose ids a worker remembers; the memory is emptied when it is full, which changes the work only.
REMEMBERED = 1_000_000
JOINED = 200


# --- bits -----------------------------------------------------------------------------------------------------------

def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` one after another, ``bits`` bits each; eight ids fill ``bits`` whole bytes."""
    n = len(ids)
    eights = np.zeros((-(-n // 8), 8), np.uint64)
    eights.reshape(-1)[:n] = ids
    out = np.zeros((len(eights), bits + 8), np.uint8)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        value = eights[:, j] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, first + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :bits].tobytes()[:-(-n * bits // 8)]


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block, all at once."""
    eights = -(-n // 8)
    raw = np.zeros((eights, bits + 8), np.uint8)
    flat = np.zeros(eights * bits, np.uint8)
    flat[:len(data)] = np.frombuffer(data, np.uint8)[:len(flat)]
    raw[:, :bits] = flat.reshape(eights, bits)
    out = np.empty((eights, 8), np.uint32)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        value = np.zeros(eights, np.uint64)
        for k in range((shift + bits + 7) // 8):
            value |= raw[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


# --- files ----------------------------------------------------------------------------------------------------------

class Writer:
    """Writes one file block by block; only the table of documents is kept until the end."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.waiting: list[np.ndarray] = []
        self.waits = self.n_ids = 0
        self.doc_ids, self.is_set, self.ends, self.offsets = [], [], [], [len(MAGIC)]
        stream.write(MAGIC)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= least and at < len(ids):
            data = pack(ids[at:at + self.block_ids], self.bits)
            self.stream.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
            at += self.block_ids
        self.waiting = [ids[at:]]
        self.waits = max(0, len(ids) - at)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id needs more bits than the file has")
        self.waiting.append(ids)
        self.waits += len(ids)
        self.n_ids += len(ids)
        self.doc_ids.append(doc_id or 0)
        self.is_set.append(doc_id is not None)
        self.ends.append(self.n_ids)
        if self.waits >= self.block_ids:
            self._flush(self.block_ids)

    def close(self) -> None:
        self._flush(1)
        foot = self.offsets[-1]
        for values, kind in ((self.doc_ids, "<i8"), (self.is_set, "u1"), (self.ends, "<u8"), (self.offsets, "<u8")):
            self.stream.write(np.array(values, kind).tobytes())
        self.stream.write(struct.pack(TRAILER, len(self.ends), self.n_ids, foot, self.bits, self.block_ids, MAGIC))


class Reader:
    """Random access to a file: the footer is read at once, blocks when they are asked for."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.seek(0, os.SEEK_END)
        stream.seek(size - struct.calcsize(TRAILER))
        n, self.n_ids, foot, self.bits, self.block_ids, magic = struct.unpack(TRAILER, stream.read(struct.calcsize(TRAILER)))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        stream.seek(foot)
        take = lambda count, kind: np.frombuffer(stream.read(count * np.dtype(kind).itemsize), kind)
        self.doc_ids, self.is_set, self.ends = take(n, "<i8"), take(n, "u1"), take(n, "<u8")
        self.offsets = take(-(-self.n_ids // self.block_ids) + 1, "<u8")

    def block(self, b: int) -> np.ndarray:
        self.stream.seek(int(self.offsets[b]))
        return unpack(self.stream.read(int(self.offsets[b + 1] - self.offsets[b])), self.bits, min(self.block_ids, self.n_ids - b * self.block_ids))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        got = np.concatenate([self.block(b) for b in range(first, last + 1)])
        return got[start - first * self.block_ids:stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def parts(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """``(document's place, ids, it ends here)`` block after block, so that long documents need no memory."""
        k = at = 0
        n = len(self.ends)
        for b in range(len(self.offsets) - 1):
            ids = self.block(b)
            low, high = b * self.block_ids, b * self.block_ids + len(ids)
            while k < n and int(self.ends[k]) <= high:
                yield k, ids[at - low:int(self.ends[k]) - low], True
                at = int(self.ends[k])
                k += 1
            if at < high:
                yield k, ids[at - low:], False
                at = high
        while k < n:
            yield k, np.zeros(0, np.uint32), True
            k += 1


# --- the tokenizers library -----------------------------------------------------------------------------------------

class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space, as its own library gives them.

    Neither its normaliser nor its pattern looks across white space, so a text's ids are those of its words in a
    row.  The ids of words are remembered.  New words go to the library many at a time, parted by a mark that is
    one token of its own; words of letters that the normaliser would leave alone skip it.
    """

    MARK = "|"

    def __init__(self, definition: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_str(definition.decode("utf-8"))
        self.plain = Tokenizer(self.full.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        [self.mark] = self._library(self.full, self.MARK)
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _library(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without the offsets

    def _learn(self, tokenizer, words: list[str]) -> None:
        for lo in range(0, len(words), JOINED):
            part = words[lo:lo + JOINED]
            ids = np.array(self._library(tokenizer, f" {self.MARK} ".join(part)), "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("the mark isn't one token of its own")
            data = ids.tobytes()
            for word, a, z in zip(part, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)]):
                self.known[word.encode("utf-8")] = data[a:z]

    def remember(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        simple, other = [], []
        for word in words.difference(self.known):
            text = word.decode("utf-8")
            if self.MARK in text:
                self.known[word] = np.array(self._library(self.full, text), "<u4").tobytes()
            elif text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                simple.append(text)
            else:
                other.append(text)
        self._learn(self.plain, simple)
        self._learn(self.full, other)

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each UTF-8 text, ``<u4``.  Lower-casing A-Z first is what the normaliser does anyway."""
        split = [[p.split() for p in pieces(t.lower())] for t in texts]
        self.remember(set().union(*(words for parts in split for words in parts)))
        for parts in split:
            yield np.frombuffer(b"".join([b"".join(map(self.known.__getitem__, words)) for words in parts]), "<u4")


def word_encoder(definition: bytes) -> WordEncoder:
    """A worker's encoder of this definition; it stays for later tasks."""
    return kept_in_worker(("words", definition), lambda: WordEncoder(definition))


# --- tables ---------------------------------------------------------------------------------------------------------

def write(df: DataFrame, folder: str, tokenizer_file: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes every whole text and writes the ids, with ``end_id`` after each document, to files below ``folder``.

    Files are in ascending order of the (integer) id column, null first; rows that share an id are ordered by a
    digest of the text.  A null text counts as empty.  Returns ``(part, path, docs, ids)`` per file, ``part``
    giving their order.  Rows are dealt out by range, so no task sees more than its share, a repeated id included.
    A task writes under a name of its own and renames it when it is whole, so a repeated task does no harm.  An
    empty table gives no files.
    """
    definition = local_file(df.sparkSession, tokenizer_file)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        encoder = word_encoder(definition.value)
        bits = bits_for(max(encoder.full.get_vocab_size(), (end_id or 0) + 1))
        part = TaskContext.get().partitionId()
        store, top = filesystem(folder)
        own, path = f"{top}/.part-{part:06d}-{uuid.uuid4().hex}", f"{top}/part-{part:06d}.ids"
        out = writer = None
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(list(utf8(rows.column(1))))):
                    if writer is None:
                        out = store.open_output_stream(own)
                        writer = Writer(out, bits, block_ids)
                    writer.add(doc_id, np.concatenate([ids, tail]))
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "docs": pa.array([len(writer.ends)], pa.int64()), "ids": pa.array([writer.n_ids], pa.int64())})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("id"), tie).sortWithinPartitions(F.col("id"), tie)
    return saved(ordered.mapInArrow(run, "part int, path string, docs long, ids long"), "files")


def documents(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back, block by block: per document its id, ``start`` (ids before it in all files), ``n_tokens`` and ``ids_crc32``.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    jobs = files.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def run(batches):
        store, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as stream:
                    reader = Reader(stream)
                    sums = np.zeros(len(reader.ends), np.int64)
                    for k, ids, _ in reader.parts():
                        sums[k] = zlib.crc32(ids.astype("<u4").tobytes(), int(sums[k]))
                    ends = reader.ends.astype(np.int64)
                    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, mask=reader.is_set == 0), pa.array(starts + start), pa.array(ends - starts), pa.array(sums)], ["id", "start", "n_tokens", "ids_crc32"])

    spread = jobs.select("path", "before").repartition(max(1, files.count()))
    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def new_folder(df: DataFrame) -> str:
    return scratch_path(df.sparkSession, "token-ids")
