"""WARC archives under Zstandard: a dictionary in the leading skippable frame, then one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import tables as t

# Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

MIN_PAYLOAD = 1000
ARCHIVE_BYTES = 4 << 20  # of compressed records, from which the next archive is begun
DICTIONARY_BYTES, SAMPLE_RECORDS = 16 << 10, 64  # each task's dictionary comes from its first records, 8 KB of each at most
RECORDS = "record_type string, page_id long, refers_to long, uri string, payload_digest string, payload_bytes long, payload binary"


def record_uri(page_id: int | None) -> str:
    """Record ids that can be told from page ids: the 64 bits of the id (and a flag for null)."""
    low = 0 if page_id is None else page_id & (2**64 - 1)
    return f"urn:uuid:{uuid.UUID(int=(1 if page_id is None else 0) << 64 | low)}"


def page_of(record_id: str) -> int | None:
    value = uuid.UUID(record_id.removeprefix("urn:uuid:")).int
    low = value & (2**64 - 1)
    return None if value >> 64 else low - 2**64 if low >> 63 else low


def one_line(x: str) -> str:
    return " ".join(x.split())


def write_record(record_type: str, record_id: str, uri: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record. A revisit has no payload; its digest and length are those of the payload referred to."""
    block = HTTP_HEAD + (payload if record_type == "response" else b"")
    head = [
        ("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", one_line(uri)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple:
    """The fields of one record; ValueError where headers, lengths or digests don't fit."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise ValueError(f"not a WARC record: {raw[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"a header line without a colon: {line[:80]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"a record without {', '.join(sorted(missing))}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the block with its end has {len(rest)} bytes")
    block = rest[:n]
    if (want := fields.get("warc-block-digest")) and want != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("the block digest doesn't fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(fields["x-payload-length"])
    refers = fields.get("warc-refers-to", "").strip("<>") or None
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't fit its length or digest")
    if kind == "revisit" and (payload or refers is None):
        raise ValueError("a revisit with a payload or without what it refers to")
    return kind, page_of(fields["warc-record-id"].strip("<>")), page_of(refers) if refers else None, fields.get("warc-target-uri"), digest, size, payload if kind == "response" else None


def dictionary_from(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary; where the samples are too few or too short for one, none."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


def archive_head(dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    if dictionary is None:
        return b""
    body = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


def read_archive(raw: bytes) -> Iterator[tuple]:
    """The records of an archive, a frame at a time."""
    view, at, dictionary = memoryview(raw), 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", raw, 4)[0]
        body = bytes(view[8 : 8 + size])
        if len(body) != size:
            raise ValueError("the archive ends inside its dictionary")
        body = zstandard.ZstdDecompressor().decompress(body) if body[:4] == ZSTD_FRAME else body
        dictionary, at = zstandard.ZstdCompressionDict(body), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(raw):
        frame, parts, step = decoder.decompressobj(), [], 1 << 12
        while not frame.eof:  # in slices, as what a frame leaves of its last one is copied
            if at >= len(raw):
                raise ValueError("the archive ends inside a frame")
            parts.append(frame.decompress(view[at : at + step]))
            at, step = min(at + step, len(raw)), min(2 * step, 1 << 20)
        at -= len(frame.unused_data)
        yield read_record(b"".join(parts))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Archives of this task's records; each try writes files of its own names, and only rows of the try that ended well name them."""
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        waiting: list[bytes] = []
        out, names, squeeze, head = io.BytesIO(), [], None, b""
        count = 0

        def close() -> None:
            nonlocal out, count
            if count:
                name = f"{uuid.uuid4().hex}.warc.zst"
                with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(head + out.getvalue())
                names.append((name, count, len(head) + out.tell()))
                out, count = io.BytesIO(), 0

        def put(record: bytes) -> None:
            nonlocal count
            out.write(squeeze.compress(record))
            count += 1
            if out.tell() >= ARCHIVE_BYTES:
                close()

        def begin() -> None:
            nonlocal squeeze, head
            dictionary = dictionary_from([w[:8192] for w in waiting])
            head = archive_head(dictionary)
            squeeze = zstandard.ZstdCompressor(level=3, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=3)
            for w in waiting:
                put(w)
            waiting.clear()

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "uri", "html", "digest", "size", "first_id", "revisit")]
            for page, uri, html, digest, size, first, revisit in zip(*columns):
                body = html.as_buffer().to_pybytes() if html.is_valid and not revisit.as_py() else b""
                record = write_record("revisit" if revisit.as_py() else "response", record_uri(page.as_py()), uri.as_py() or "", digest.as_py(), size.as_py(), body, record_uri(first.as_py()) if revisit.as_py() else None)
                if squeeze is None:
                    waiting.append(record)
                    if len(waiting) >= SAMPLE_RECORDS:
                        begin()
                else:
                    put(record)
        if waiting:
            begin()
        close()
        cols = zip(*names) if names else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["name", "records", "bytes"])

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for record in read_archive(content.as_buffer().to_pybytes()):
                rows.append(record)
                held += len(record[-1] or b"") + 300
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def write_warc(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page into archives below folder (a URI that executors share).

    The payload is the html in UTF-8; null counts as empty. Of records with equal payloads of min_payload bytes
    or more, the one with the largest id is a response and the others are revisits of it; rows that share that
    id as well are responses. All others are responses. A null id never is the one referred to unless all are null.
    Other columns are ignored. Returns the archives written: name, records, bytes.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    groups = rows.where(F.col("size") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("c")).where("c > 1 and first_id is not null").select("digest", "first_id")
    groups = t.staged(groups, "payloads")
    rows = rows.join(groups, "digest", "left").withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    rows = rows.withColumn("html", F.when(F.col("revisit"), None).otherwise(F.col("html")))
    return t.staged(rows.mapInArrow(_writer(folder), "name string, records long, bytes long"), "archives")


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that write_warc has listed, each checked: header, length and digests.

    refers_to is the page that a revisit points to; payload is null for revisits.
    """
    found = archives.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(archives.select("name"), "name", "left_semi")
    return named.select("content").mapInArrow(_reader, RECORDS)
