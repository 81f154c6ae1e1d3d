"""WARC archives in Zstandard form: one frame a record, compressed with a dictionary that leads the file.

A file starts with a skippable frame that holds the dictionary (itself compressed); every record follows as a frame of
its own. The reader takes the dictionary from that frame, so a file can be read wherever it is copied, and checks
what it reads: frames that end early, frames of another dictionary, WARC and HTTP headers, lengths, line ends, digests.
"""
from __future__ import annotations

import base64
import hashlib
import os
import struct
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takt.llm.common import hashed_share, settled
from takt.llm.token_files import place
from takt.sources.runs import shared_folder

# Fixed values of the formats: frame magics, WARC version, revisit profile.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"

LEAST_REVISIT = 0  # payloads of fewer bytes are written out each time
DATE = "1970-01-01T00:00:00Z"  # the table has no time of capture
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 512, 8192, 1 << 16, 3
FILE_BYTES, CHUNK, BATCH_BYTES = 1 << 30, 1 << 16, 1 << 24
SPREAD = 256  # buckets that the rows of one payload are dealt to
MANIFEST = "path string, records long, bytes long"
RECORD = "path string, offset long, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    if not (name.startswith("<urn:x-page:") and name.endswith(">")):
        raise ValueError(f"record id {name!r}")
    held = name[len("<urn:x-page:"):-1]
    return None if held == "none" else int(held)


def clean_uri(url: str | None, page_id: int | None) -> str:
    """A url that fits a header line: blanks, control characters and all beyond ASCII as percent codes."""
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else record_id(page_id)[1:-1]


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A whole record. A revisit keeps the HTTP headers, the payload's length among them, and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {clean_uri(url, page_id)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return BREAK.join([VERSION, *(line.encode() for line in lines), b"", block, b"", b""])


def fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines by lower-case name; a line without a name, or a name twice, is an error."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        key = name.strip().lower().decode()
        if not colon or not key or key in out:
            raise ValueError(f"header line {line[:80]!r}")
        out[key] = value.strip().decode()
    return out


def head_and_rest(data: bytes, what: str) -> tuple[list[bytes], bytes]:
    end = data.find(BREAK * 2)
    if end < 0:
        raise ValueError(f"{what} headers without an end")
    return data[:end].split(BREAK), data[end + 4:]


def parsed(data: bytes) -> dict:
    """The fields of one record, checked: version, headers, lengths, line ends, digests of block and payload."""
    lines, rest = head_and_rest(data, "WARC")
    if lines[0] not in VERSIONS:
        raise ValueError(f"version {lines[0][:20]!r}")
    head = fields(lines[1:])
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(head)
    if missing:
        raise ValueError(f"headers lack {sorted(missing)}")
    if not head["content-length"].isascii() or not head["content-length"].isdigit() or len(rest) != int(head["content-length"]) + 4:
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {head['content-length']}")
    block, end = rest[:-4], rest[-4:]
    if end != BREAK * 2:
        raise ValueError("record without its two line ends")
    if head.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise ValueError("block digest")
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"record type {kind!r}")
    status, payload = head_and_rest(block, "HTTP")
    length = int(fields(status[1:])["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("payload length or digest")
    if kind == "revisit" and (payload or head.get("warc-profile") != PROFILE):
        raise ValueError("revisit with a payload or of an unknown profile")
    return {"record_type": kind, "page_id": page_of(head["warc-record-id"]), "target_uri": head.get("warc-target-uri"), "payload_bytes": length,
            "payload_digest": digest, "refers_to": page_of(head["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


class ArchiveWriter:
    """Writes one file record by record. It gets its name when whole, so a lost or repeated task leaves a whole file or none."""

    def __init__(self, path: str, dictionary: bytes | None, level: int = LEVEL):
        self.system, self.path = place(path)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.trial = f"{self.path}.{uuid.uuid4().hex}"
        self.sink = self.system.open_output_stream(self.trial, compression=None)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.records = self.bytes = 0
        if dictionary:
            held = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.pack.compress(data))
        self.records += 1

    def close(self) -> None:
        self.sink.close()
        self.system.move(self.trial, self.path)


class ArchiveReader:
    """Reads one file as a stream, a frame at a time; memory holds one record and one chunk."""

    def __init__(self, path: str):
        system, inner = place(path)
        self.path, self.source = path, system.open_input_stream(inner, compression=None)
        self.held, self.at = b"", 0
        self.dictionary_id = 0
        self.unpack = zstandard.ZstdDecompressor()
        self._fill(8)
        if len(self.held) >= 8 and struct.unpack("<I", self.held[:4])[0] == DICTIONARY_FRAME:
            size = struct.unpack("<I", self.held[4:8])[0]
            self._fill(8 + size)
            if len(self.held) < 8 + size:
                raise ValueError(f"{path}: dictionary frame ends early")
            data = self.held[8:8 + size]
            self._drop(8 + size)
            if data[:4] == FRAME:
                data = self.unpack.decompressobj().decompress(data)
            if data[:4] != DICTIONARY:
                raise ValueError(f"{path}: leading frame holds no dictionary")
            made = zstandard.ZstdCompressionDict(data)
            self.dictionary_id = made.dict_id()
            self.unpack = zstandard.ZstdDecompressor(dict_data=made)

    def _fill(self, n: int) -> None:
        while len(self.held) < n and (more := self.source.read(max(CHUNK, n - len(self.held)))):
            self.held += more

    def _drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def frames(self) -> Iterator[tuple[int, bytes]]:
        """(offset, content) of every record frame."""
        while True:
            self._fill(18)
            if not self.held:
                return
            start = self.at
            try:
                if self.held[:4] != FRAME or zstandard.get_frame_parameters(self.held[:18]).dict_id != self.dictionary_id:
                    raise ValueError("no frame of this file's dictionary")
                step, parts = self.unpack.decompressobj(), []
                while True:
                    parts.append(step.decompress(self.held))
                    if step.eof:
                        self._drop(len(self.held) - len(step.unused_data))
                        break
                    self._drop(len(self.held))
                    self._fill(1)
                    if not self.held:
                        raise ValueError("frame ends early")
            except (ValueError, zstandard.ZstdError) as error:
                raise ValueError(f"{self.path} at {start}: {error}") from error
            yield start, b"".join(parts)

    def records(self) -> Iterator[tuple[int, dict]]:
        for start, data in self.frames():
            try:
                yield start, parsed(data)
            except (ValueError, KeyError) as error:
                raise ValueError(f"{self.path} at {start}: {error}") from error


def trained(pages: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary from records of at most ``sample`` pages (by hash) and ``chars`` characters of each.

    It only changes how well records shrink, never what is in them. Too few bytes to learn from give none; the files then have no
    leading frame.
    """
    rows = hashed_share(pages, pages.count(), sample, "page_id", "url").select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, chars).alias("html")).limit(sample).collect()
    try:
        return zstandard.train_dictionary(size, [record(r["page_id"], r["url"], r["html"].encode(), None, False) for r in rows], k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def decided(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, first) of every page: first is the smallest page_id with the same payload of ``least`` bytes or more, else its own.

    The pages of one payload, however many, are dealt to buckets. A bucket shrinks to its smallest page_id before the shuffle,
    and pages meet the result by payload and bucket, so no task holds all pages of a frequent payload.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = own.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html")).withColumn(
        "bucket", F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)).cast("int"))
    lows = keyed.where(F.col("size") >= least).groupBy("sha", "size", "bucket").agg(F.min("page_id").alias("low"))
    firsts = lows.select("sha", "size", "bucket", F.min("low").over(Window.partitionBy("sha", "size")).alias("low"))
    return keyed.join(firsts, ["sha", "size", "bucket"], "left").select(
        "page_id", "url", "html", F.when(F.col("size") >= least, F.col("low")).otherwise(F.col("page_id")).alias("first"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, level: int = LEVEL, file_bytes: int = FILE_BYTES, dictionary: bytes | None = None) -> DataFrame:
    """Write a record a page below folder; returns (path, records, bytes) of every file, written once."""
    dictionary = dictionary or trained(pages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer, done = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for page_id, url, html, first in zip(*(b.column(i) for i in range(4))):
                if writer and writer.bytes >= file_bytes:
                    writer.close()
                    done.append(writer)
                    writer = None
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/pages-{part:06d}-{number:04d}-{uuid.uuid4().hex[:8]}.warc.zst", dictionary, level)
                    number += 1
                page_id, first = page_id.as_py(), first.as_py()
                writer.add(record(page_id, url.as_py(), html.as_py().encode(), first, page_id != first))
        if writer:
            writer.close()
            done.append(writer)
        yield pa.RecordBatch.from_pylist([{"path": w.path, "records": w.records, "bytes": w.bytes} for w in done],
                                         schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return settled(decided(pages, least).mapInArrow(run, MANIFEST))


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files (a table with a path column), one task a file; payload (binary, NULL for revisits) only where asked for."""
    schema = RECORD + (", payload binary" if payloads else "")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for offset, found in ArchiveReader(path).records():
                    held += len(found["payload"] or b"") if payloads else 64
                    rows.append({"path": path, "offset": offset, **found})
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, schema)


def archived(pages: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Write pages as archives in folder (a new one in the shared folder by default) and report what they hold.

    Per page, from the files: page_id, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to. NULL html is an
    empty payload. Of pages with equal payloads, those with the smallest page_id are responses (more than one only where
    that page_id repeats), the others revisit it; pages without a page_id come last, and are responses if none of their payload's has one. A
    NULL url is replaced by the record's own name. An empty table writes no file and gives no row. Other columns are not read.
    """
    files = write_archives(pages, folder or shared_folder(pages.sparkSession), **settings)
    return read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS low FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM p JOIN f ON f.html = p.html"""
