"""WARC archives: records written as one gzip stream per file, normalised to a member per record with a sidecar index, read back.

The normaliser is for archives whose whole file is one gzip stream, in which no record can be reached without
inflating all before it.  It inflates the stream once, rewrites every record as a gzip member of its own, and writes
``offset, length, type, uri`` of each member to a sidecar.  It works in pieces of bounded size, whatever a record holds.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finegrid.llm.common import filesystem, saved
from finegrid.session import scratch_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Every record's date is fixed, so that a repeated task writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PIECE = 1 << 18
GZIP = 31
#: Members of the archives that the normaliser makes, and the streams that it reads.
LEVEL, STREAM_LEVEL = 6, 1


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def header(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"Content-Length: %d" % length]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def one_line(text: str | None) -> str:
    """A header's value: white space that would end the line becomes a space."""
    return " ".join((text or "").split())


def urn(number: int | None) -> str:
    return f"<urn:page:{'' if number is None else number}>"


def number_of(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(number: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """A response with its payload, or a revisit that names the record with the same payload and leaves it out."""
    block = HTTP if refers_to is not None else HTTP + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(number)), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(uri)),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE)]
    yield header(fields, len(block))
    yield block
    yield b"\r\n\r\n"


class Inflated:
    """A gzip file as one stream of bytes, however many members it has; reads ahead by a piece."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.inflater, self.buffer, self.ended = raw, zlib.decompressobj(GZIP), bytearray(), False

    def _more(self) -> bool:
        while not self.ended:
            data = self.inflater.unconsumed_tail or self.raw.read(PIECE)
            if not data and not self.inflater.eof:
                self.ended = True
                break
            if self.inflater.eof:
                data = self.inflater.unused_data or data
                if not data:
                    self.ended = True
                    break
                self.inflater = zlib.decompressobj(GZIP)
            got = self.inflater.decompress(data, PIECE)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a header")
                return None
        out = bytes(self.buffer[:at + len(mark)])
        del self.buffer[:at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.buffer[:n])
            del self.buffer[:len(part)]
            n -= len(part)
            yield part


def fields_of(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC header")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def normalise(raw: BinaryIO, out: BinaryIO, level: int = LEVEL) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Rewrites the archive ``raw`` to ``out`` with a member per record; yields each member's offset, length and header."""
    stream, offset = Inflated(raw), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = fields_of(head.lstrip(b"\r\n"))
        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        size = 0
        for part in chain([head.lstrip(b"\r\n")], stream.take(int(fields["content-length"])), stream.take(4)):
            data = packer.compress(part)
            out.write(data)
            size += len(data)
        data = packer.flush()
        out.write(data)
        yield offset, size + len(data), fields
        offset += size + len(data)


def read_member(archive: BinaryIO, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header and payload (behind the HTTP header) of the record at ``offset``: random access through the sidecar."""
    archive.seek(offset)
    data = zlib.decompress(archive.read(length), GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# --- tables ---------------------------------------------------------------------------------------------------------

def with_originals(df: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``df(id, url, payload)`` with ``digest`` (hex SHA-1) and ``refers_to``: the least id with the same payload, null for the response itself.

    Payloads under ``least_bytes`` bytes are all responses.  Groups of equal payloads are reduced before the shuffle
    and only those with several rows are joined back, by their digest and length.  Rows that repeat an id with its
    payload are folded by url and unfolded again, the first one being the response.  Rows without an id refer to others, but none refers to
    them; where all are without, all are responses.
    """
    rows = df.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    keys = rows.filter(F.col("size") >= least_bytes).select("id", "digest", "size")
    groups = saved(keys.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n"), "groups")
    twice = saved(keys.join(groups, ["digest", "size"]).filter("id = first").groupBy("digest", "size").agg(F.min("id").alias("twice"), F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")
    named = rows.join(groups, ["digest", "size"], "left").join(twice, ["digest", "size"], "left")
    repeated = F.col("id").eqNullSafe(F.col("twice")) & F.col("twice").isNotNull()
    columns = ["id", "url", "payload", "digest"]
    once = named.filter(~repeated).select(*columns, F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    copies = named.filter(repeated).groupBy("digest", "size", "id", "url", "first").agg(F.any_value("payload").alias("payload"), F.count("*").alias("n"))
    copies = copies.withColumn("no", F.row_number().over(Window.partitionBy("digest", "size", "id").orderBy("url"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return once.unionByName(copies.select(*columns, F.when((F.col("no") > 1) | (F.col("copy") > 1), F.col("first")).alias("refers_to")))


def write(df: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of ``df(id, url, payload, digest, refers_to)``, one gzip stream per task; ``(name, records)`` per file."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        store, top = filesystem(folder)
        name = f"{TaskContext.get().partitionId():06d}"
        own, path, n, out = f"{top}/.{name}-{uuid.uuid4().hex}", f"{top}/{name}.warc.gz", 0, None
        packer = zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, GZIP)
        for batch in batches:
            for number, url, payload, digest, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                out = out or store.open_output_stream(own)
                for part in record(number, url, payload.as_buffer().to_pybytes(), base32(bytes.fromhex(digest)), refers_to):
                    out.write(packer.compress(part))
                n += 1
        if out:
            out.write(packer.flush())
            out.close()
            store.move(own, path)
            yield pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([n], pa.int64())})

    return saved(df.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "name string, records long"), "archives")


def normalise_all(archives: DataFrame, folder: str) -> DataFrame:
    """Normalises every archive of ``write`` or of another writer: ``name.warc.gz`` -> ``name.members.warc.gz`` and ``name.idx``.

    A task takes an archive at a time, writes under names of its own and renames the index last, so what has an index
    is whole; a lost task's archive is simply done again.
    """

    def run(batches):
        store, top = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                mark, n = uuid.uuid4().hex, 0
                with store.open_input_stream(f"{top}/{name}.warc.gz", compression=None) as raw, store.open_output_stream(f"{top}/.{name}-{mark}.warc.gz", compression=None) as out, store.open_output_stream(f"{top}/.{name}-{mark}.idx") as index:
                    for offset, length, fields in normalise(raw, out):
                        index.write(f"{offset}\t{length}\t{fields['warc-type']}\t{fields.get('warc-target-uri', '')}\n".encode())
                        n += 1
                store.move(f"{top}/.{name}-{mark}.warc.gz", f"{top}/{name}.members.warc.gz")
                store.move(f"{top}/.{name}-{mark}.idx", f"{top}/{name}.idx")
                yield pa.RecordBatch.from_pydict({"name": [name], "members": pa.array([n], pa.int64())})

    return saved(_spread(archives.select("name")).mapInArrow(run, "name string, members long"), "members")


def read(members: DataFrame, folder: str) -> DataFrame:
    """``(id, url, type, refers_to, digest, size, payload)`` of every record, each reached through the sidecar; a payload that doesn't match its digest is an error."""

    def run(batches):
        store, top = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{name}.idx") as index:
                    lines = index.read().decode("utf-8").split("\n")[:-1]
                with store.open_input_file(f"{top}/{name}.members.warc.gz") as archive:
                    for lo in range(0, len(lines), 256):
                        found = []
                        for line in lines[lo:lo + 256]:
                            offset, length, _, _ = line.split("\t", 3)
                            fields, payload = read_member(archive, int(offset), int(length))
                            digest = fields["warc-payload-digest"].removeprefix("sha1:")
                            response = fields["warc-type"] == "response"
                            if response and base32(hashlib.sha1(payload).digest()) != digest:
                                raise ValueError(f"{name}: the payload at {offset} doesn't match its digest")
                            found.append((number_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], number_of(fields.get("warc-refers-to")), digest, len(payload) if response else None, payload if response else None))
                        columns = list(zip(*found))
                        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "url", "type", "refers_to", "digest", "size", "payload"])

    return _spread(members.select("name")).mapInArrow(run, "id long, url string, type string, refers_to long, digest string, size long, payload binary")


def _spread(files: DataFrame) -> DataFrame:
    """A task per file."""
    return files.repartition(max(1, files.count()))


def archived(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes an archive of ``df``, normalises it and reads it back: per row ``(id, payload_bytes, payload_digest, record_type, refers_to)``.

    The id must be an integer, the payload text (taken as UTF-8) or binary; null counts as empty.  A revisit holds no
    payload, so its length is that of the response that it refers to.  Repeated rows come back as often as they are
    there, an empty table gives an empty one, other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    folder = scratch_path(df.sparkSession, "warc")
    members = normalise_all(write(with_originals(rows, least_bytes), folder), folder)
    records = saved(read(members, folder).drop("payload", "url"), "records")
    whole = records.filter("type = 'response'")
    sizes = whole.select(F.col("id").alias("refers_to"), "digest", "size").filter("refers_to IS NOT NULL")
    again = records.filter("type = 'revisit'").drop("size").join(sizes, ["refers_to", "digest"])
    return whole.unionByName(again).select(F.col("id").alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
