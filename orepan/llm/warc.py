"""WARC archives as seekable zstandard bundles, with revisit records for repeated payloads.

A bundle is a row of independent zstandard frames, each holding whole WARC records, then two
skippable frames (so that any zstandard reader can unpack the bundle as one WARC stream)::

    frame 0 | frame 1 | ... | record map | seek table

* seek table: per frame its compressed and its unpacked size, the number of frames and a magic, in the
  layout of the published seekable format, found from the end of the file;
* record map: per record its WARC record id and page id, frame, offset in the unpacked frame, and length.

So a record is read by its id, unpacking one frame of about ``frame_bytes``.  A record id stands for the page
id, the payload, the URL and the kind of record; only rows that repeat all of them share one.

Of rows with equal payloads of at least ``least_bytes`` that with the largest id is a response and the
others are revisits of it.  Equality is by SHA-1 and length.  Null html is the empty payload.  Rows with
a null id are revisits of a row with an id if there is one, else responses; rows that repeat an id are
written each, and those that share the largest id are all responses.  An empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, open_fs, shared_dir, written

# Fixed values of the seekable zstandard format.
SKIPPABLE_MAP = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("unpacked", "<u4")])
RECORD = np.dtype([("record", "V16"), ("null", "u1"), ("page_id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("size", "<u4")])

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id, digest: str, url, refers_to=None) -> uuid.UUID:
    """Of a response the id does not depend on the URL, as revisits name it by page and payload alone."""
    role = "response" if refers_to is None and page_id is not None else f"{url}|{refers_to}"
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}|{digest}|{role}")


def record(page_id, url, payload: bytes | None, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record; ``payload`` None makes a revisit."""
    block = HTTP if payload is None else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest, url, refers_to)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, digest, None)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    return fields, block[len(HTTP) :]


def decide(pages: DataFrame, *, least_bytes: int = 1000, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", broadcast_rows: int = 500_000) -> DataFrame:
    """``page_id, url, html, payload_digest, payload_bytes, refers_to`` (null: a response)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.col(url_col) if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    # only repeated payloads need a look-up; sums before the shuffle keep one huge group small
    large = F.col("payload_bytes") >= least_bytes
    last = rows.where(large).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where("c > 1 and last is not null").drop("c")
    last = written(last, "repeated")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("last")), F.col("last"))
    decided = lambda df: df.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "payload_digest", "payload_bytes", refers.alias("refers_to"))
    on = ["payload_digest", "payload_bytes"]
    if last.count() <= broadcast_rows:  # about 100 bytes a row; the payloads then stay where they are
        return decided(rows.join(F.broadcast(last), on, "left"))
    # small and null payloads match nothing, so they don't meet in one task either
    small = rows.where(~large).withColumn("last", F.lit(None).cast("long"))
    return decided(rows.where(large).join(last.hint("merge"), on, "left").unionByName(small))


class _Bundle:
    def __init__(self, path: str, name: str, frame_bytes: int):
        import zstandard

        self.fs, root = open_fs(path)
        self.fs.create_dir(root, recursive=True)
        self.uri, self.final, self.own = f"{path}/{name}", f"{root}/{name}", f"{root}/.{uuid.uuid4().hex}"
        self.out, self.packer, self.most = self.fs.open_output_stream(self.own), zstandard.ZstdCompressor(level=3), frame_bytes
        self.open, self.at, self.frames, self.records, self.size = [], 0, [], [], 0

    def add(self, record: uuid.UUID, page_id, raw: bytes) -> None:
        if self.at and self.at + len(raw) > self.most:
            self.cut()
        self.records.append((record.bytes, page_id is None, page_id or 0, len(self.frames), self.at, len(raw)))
        self.open.append(raw)
        self.at += len(raw)

    def cut(self) -> None:
        packed = self.packer.compress(b"".join(self.open))
        self.out.write(packed)
        self.frames.append((len(packed), self.at))
        self.size += len(packed)
        self.open, self.at = [], 0

    def close(self) -> pa.RecordBatch:
        if self.at:
            self.cut()
        table = self.packer.compress(np.array(self.records, dtype=RECORD).tobytes())
        seek = np.array(self.frames, dtype=ENTRY).tobytes() + FOOTER.pack(len(self.frames), 0, SEEK_MAGIC)
        for magic, data in ((SKIPPABLE_MAP, table), (SKIPPABLE_SEEK, seek)):
            self.out.write(struct.pack("<II", magic, len(data)) + data)
        self.out.close()
        self.fs.move(self.own, self.final)
        return pa.RecordBatch.from_arrays([pa.array([self.uri]), pa.array([len(self.records)], pa.int64()), pa.array([self.size], pa.int64())], ["path", "records", "packed_bytes"])


def write_bundles(decided: DataFrame, path: str, *, frame_bytes: int = 256 << 10, bundle_bytes: int = 128 << 20) -> DataFrame:
    """Write bundles below ``path``; one row per bundle: ``path, records, packed_bytes``.

    A task writes under a name of its own and moves the finished bundle, so a repeated task leaves
    one bundle of that name.
    """

    def run(batches):
        from pyspark import TaskContext

        part, number, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for page_id, url, html, digest, size, refers in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    out = _Bundle(path, f"part-{part:06d}-{number:04d}.warc.zst", frame_bytes)
                out.add(record_id(page_id, digest, url, refers), page_id, record(page_id, url, None if html is None else html.encode(), digest, size, refers))
                if out.size >= bundle_bytes:
                    yield out.close()
                    out, number = None, number + 1
        if out is not None:
            yield out.close()

    return written(map_arrow(decided, run, "path string, records long, packed_bytes long"), "warc-manifest")


class Bundle:
    """Random access: ``Bundle(uri).read(page_id)`` unpacks one frame."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = open_fs(uri)
        self.f, self.unpack = fs.open_input_file(path), zstandard.ZstdDecompressor()
        end = self.f.size()
        n, _, magic = FOOTER.unpack(self.f.read_at(FOOTER.size, end - FOOTER.size))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{uri}: no seek table")
        at = end - FOOTER.size - n * ENTRY.itemsize
        self.frames = np.frombuffer(self.f.read_at(n * ENTRY.itemsize, at), dtype=ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        skip, size = struct.unpack("<II", self.f.read_at(8, int(self.starts[-1])))
        if skip != SKIPPABLE_MAP:
            raise ValueError(f"{uri}: no record map")
        self.records = np.frombuffer(self.unpack.decompress(self.f.read_at(size, int(self.starts[-1]) + 8)), dtype=RECORD)

    def frame(self, i: int) -> bytes:
        return self.unpack.decompress(self.f.read_at(int(self.frames["packed"][i]), int(self.starts[i])), max_output_size=int(self.frames["unpacked"][i]))

    def _at(self, r) -> bytes:
        return self.frame(int(r["frame"]))[int(r["offset"]) : int(r["offset"]) + int(r["size"])]

    def read(self, page_id: int | None) -> list[bytes]:
        """The records of a page id, or of the rows without one."""
        own = self.records["null"] == 1 if page_id is None else (self.records["null"] == 0) & (self.records["page_id"] == page_id)
        return [self._at(r) for r in self.records[own]]

    def read_record(self, record: uuid.UUID) -> list[bytes]:
        return [self._at(r) for r in self.records[self.records["record"] == np.void(record.bytes)]]


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(manifest: DataFrame) -> DataFrame:
    """What the archives hold, one row per record; digests of responses are taken from the payload read."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                bundle, rows, raw, at = Bundle(uri), [], b"", -1
                for r in bundle.records:
                    if r["frame"] != at:
                        at = int(r["frame"])
                        raw = bundle.frame(at)
                    fields, payload = parse(raw[int(r["offset"]) : int(r["offset"]) + int(r["size"])])
                    page = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
                    if fields["WARC-Type"] == "response":
                        rows.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
                    else:
                        rows.append((page, int(fields["X-Payload-Length"]), base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), "revisit", int(fields["X-Refers-To-Page"])))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in READ.split(", ")])

    n = max(1, manifest.count())
    return map_arrow(manifest.select("path").repartition(n), run, READ)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_bundles(write_bundles(decide(pages), shared_dir(spark, "warc")))
