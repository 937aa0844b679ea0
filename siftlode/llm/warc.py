"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES, so a reader fetches one frame for a record. A bundle
ends in a seek table: a skippable frame with the sizes of all frames, then their number and a magic number (the public
Zstandard seekable format). An index maps each record to its bundle, its frame, and its offset in the decompressed frame.

Of records with equal payloads of MIN_REVISIT bytes or more, that with the smallest id is written in full and the
others as ``revisit`` records that name it. Tasks write bundles under names that no other attempt uses; the index is written by
Spark's committer, so it names the bundles of the attempts that counted, and a bundle left by a lost task is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, maybe_broadcast, ship, work_dir

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 29
MIN_REVISIT = 100
LEVEL = 3
#: Time stamp of the records, a parameter so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

ship(__name__)


def record_id(page_id: int | None) -> str:
    """A URN that depends on the page's id only."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'page:{page_id}'.encode()).digest()[:16])}"


def _safe(value: str) -> bytes:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record; a revisit holds no payload, but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <" + record_id(page_id).encode() + b">",
        b"WARC-Date: " + date.encode(),
        *([] if url is None else [b"WARC-Target-URI: " + _safe(url)]),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"X-Page-ID: " + (b"" if page_id is None else b"%d" % page_id),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if revisit:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: <" + record_id(refers_to).encode() + b">",
            b"X-Refers-To-Page: " + (b"" if refers_to is None else b"%d" % refers_to),
        ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """headers (lower-case names), and payload (None for a revisit), of a record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b": ")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    headers["payload-length"] = sizes[0].decode()
    return {"headers": headers, "payload": None if headers["warc-type"] == "revisit" else payload}


class BundleWriter:
    """Writes records to one bundle; ``add`` says where a record is: (frame, offset in the frame, length)."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.sink, self.frame_bytes, self.written = sink, frame_bytes, 0
        self.zip, self.buffer, self.frames = zstandard.ZstdCompressor(level=level), bytearray(), []

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.buffer and len(self.buffer) + len(record) > self.frame_bytes:
            self._end_frame()
        at = (len(self.frames), len(self.buffer), len(record))
        self.buffer += record
        return at

    def _end_frame(self) -> None:
        data = self.zip.compress(bytes(self.buffer))
        self.sink.write(data)
        self.frames.append((len(data), len(self.buffer)))
        self.written += len(data)
        self.buffer = bytearray()

    def close(self) -> None:
        if self.buffer:
            self._end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the bundle has no seek table")
        entry = 12 if flags & 0x80 else 8
        source.seek(size - 9 - entry * frames)
        raw = source.read(entry * frames)
        self.sizes = [struct.unpack_from("<II", raw, entry * i) for i in range(frames)]
        self.starts = np.concatenate([[0], np.cumsum([c for c, _ in self.sizes])]).astype(np.int64)

    def frame(self, number: int) -> bytes:
        packed, full = self.sizes[number]
        self.source.seek(int(self.starts[number]))
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=full)


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, revisit, refers_to): what is to be written for each row.

    Payloads are the html in UTF-8, null as empty. Payloads under MIN_REVISIT bytes are always written in full. Rows
    that repeat the smallest id of their payload are all written in full. Rows with a null id give way to any id;
    among themselves they are all written in full.
    """
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = materialise(p.where(F.octet_length("payload") >= MIN_REVISIT).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("d", "first"))
    # as a table, so that a join that is not by broadcast may split a payload that a third of all pages share
    j = p.join(maybe_broadcast(first, first.count()), F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_bundles(records: DataFrame, out_dir: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write ``records`` (as ``decide`` gives them) to bundles below ``out_dir``; the index: page_id, record_id, bundle,
    frame, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = name = None
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                page, url, payload, digest, revisit, refers = (b.column(k)[i].as_py() for k in range(6))
                if writer is None:
                    store, base = fs.FileSystem.from_uri(out_dir)
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None), frame_bytes)
                at = writer.add(build_record(page, url, payload.encode("utf-8", "surrogatepass"), digest, refers, revisit))
                rows.append((page, record_id(page), name, *at))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["page_id", "record_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return records.mapInArrow(run, "page_id long, record_id string, bundle string, frame int, offset long, length long")


def read_records(index: DataFrame, out_dir: str, payloads: bool = False) -> DataFrame:
    """Read the records that ``index`` names, frame by frame: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and, if asked for, payload. A response's digest is that of the bytes read, checked against its header.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out_dir)
        open_name = reader = None
        at, data = (None, -1), b""
        for b in batches:
            out = []
            for name, frame, offset, length in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
                if name != open_name:
                    if reader is not None:
                        reader.source.close()
                    path = f"{base}/{name}"
                    reader, open_name = BundleReader(store.open_input_file(path), store.get_file_info(path).size), name
                if at != (name, frame):
                    at, data = (name, frame), reader.frame(frame)
                r = parse_record(data[offset : offset + length])
                h, body = r["headers"], r["payload"]
                digest = h["warc-payload-digest"].removeprefix("sha256:")
                size = int(h["payload-length"])
                if body is not None and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"the payload of record {h['warc-record-id']} is damaged")
                number = lambda x: int(x) if x else None
                out.append((number(h["x-page-id"]), h.get("warc-target-uri"), h["warc-type"], number(h.get("x-refers-to-page")), size, digest, body)[: 6 + payloads])
            cols = zip(*out, strict=True) if out else [[]] * (6 + payloads)
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 6 + payloads]
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][: 6 + payloads]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)
        if reader is not None:
            reader.source.close()

    whole = index.select("bundle", "frame", "offset", "length").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return whole.mapInArrow(run, schema)


def archive(pages: DataFrame, out_dir: str | None = None) -> tuple[DataFrame, str]:
    """Write all of ``pages``; (index, folder of the bundles). The folder is in the shared one unless it is given."""
    out_dir = out_dir or work_dir(pages.sparkSession)
    index = materialise(write_bundles(decide(pages), f"{out_dir}/bundles"), f"{out_dir}/index")
    return index, f"{out_dir}/bundles"


def round_trip(pages: DataFrame, out_dir: str | None = None) -> DataFrame:
    """Archive ``pages`` and read everything back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    One row a row of ``pages``; null html is an empty payload; a null url has no header and comes back null; line
    breaks in a url come back as %0D and %0A; an empty table gives an empty one.
    """
    index, where = archive(pages, out_dir)
    return read_records(index, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
