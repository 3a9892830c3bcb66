"""Token-ID files: one zstandard frame per document under a shared, trained dictionary.

A file holds, in ascending document order::

    magic | frame of document 0 | frame of document 1 | ... | index | tail

* A frame is the document's ids as little-endian unsigned 32-bit integers, compressed on its own
  with the dictionary, so one short document is read by one seek.
* The index (itself one frame) has per document: id, frame offset, frame length, number of ids.
* The tail (fixed size) has the index's offset and length, the number of documents, the SHA-256 of
  the dictionary, and the magic again.  A reader with another dictionary stops at once.

Texts that are null count as empty: such a document has the end id alone.  Rows with a null id take
the place before all others.  Repeated ids keep all their rows, next to each other; an id that has more rows
than a file should hold lies in several files, one after the other.  An empty table gives no file.
"""

from __future__ import annotations

import hashlib
import math
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import map_arrow, open_fs, shared_dir, written
from .tokens import encoder

MAGIC = b"TOKZ0001"
TAIL = struct.Struct("<QQQ32s8s")
INDEX = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("n", "<u4")])


def train_dictionary(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 600, most_chars: int = 20_000, dict_bytes: int = 64_000
) -> bytes:
    """A zstandard dictionary from at most ``sample_docs`` whole documents of a hash order over all rows.

    The sample is bounded (``sample_docs`` texts, none longer than ``most_chars`` characters) since a
    dictionary only lowers the size of the files; every document is then written whole.
    """
    import zstandard

    # of many rows only about three times the sample is sorted, so that tasks send the driver little
    one_in = docs.count() // (3 * sample_docs) + 1
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("dictionary"))
    rows = (
        docs.where(F.length(text_col).between(1, most_chars) & (F.pmod(h, F.lit(one_in)) == 0))
        .select(h.alias("h"), F.col(text_col).alias("t"))
        .orderBy("h", "t")
        .limit(sample_docs)
        .collect()
    )
    samples = [x for x in encoder(vocabulary).encode_many([r.t for r in rows]) if len(x) >= 8]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(dict_bytes, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform text for a dictionary
        return b""


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


NO_ID = -(1 << 63)


def id_quantiles(d: DataFrame, n: int) -> np.ndarray:
    """``n`` - 1 borders of equal parts of the ids, in two steps: ranges first, then each range by a task of its own.

    A null id counts as the smallest.  An id with many rows is a border several times.
    """
    top = math.isqrt(n - 1) + 1
    own = -(-n // top)
    ids = d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    share = lambda k: [i / k for i in range(1, k)]
    coarse = np.array(ids.agg(F.percentile_approx("id", share(top), 50 * top).alias("q")).first().q if top > 1 else [], dtype=np.int64)

    def ranges(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            first, last = (np.searchsorted(coarse, ids, side=s) for s in ("left", "right"))
            # rows of an id that is a border belong to the ranges on both sides in turn
            part = first + np.arange(len(ids)) % (last - first + 1)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column(0)], ["part", "id"])

    parts = map_arrow(ids, ranges, "part int, id long")
    if own > 1:
        fine = {r.part: r.q for r in parts.groupBy("part").agg(F.percentile_approx("id", share(own), 50 * own).alias("q")).collect()}
    else:
        fine = {}
    return np.sort(np.concatenate([coarse, *(np.array(q, dtype=np.int64) for q in fine.values())]))


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None, file_bytes: int = 64 << 20, level: int = 3
) -> DataFrame:
    """Encode every whole text and write token files below ``path``, in ascending id order.

    Texts are read once and become compressed frames at once; only the frames are shuffled.  File
    borders come from quantiles of the ids alone, so no task holds more than about ``file_bytes`` of
    text's frames: an id that several borders fall on is dealt over their files by its frames.  A task writes to a name of its own and then moves the file, so tasks that run
    twice leave one file.

    Returns one row per file: ``file_no, path, docs, tokens, dict_sha256``.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary, id_col=id_col, text_col=text_col) if dictionary is None else dictionary
    digest = hashlib.sha256(dictionary).digest()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("n")).first()
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total.b or 0) // file_bytes + 1)
    cuts = id_quantiles(d, n_files) if n_files > 1 and total.n else np.empty(0, dtype=np.int64)

    def frames(batches):
        import zstandard

        enc, tail = encoder(vocabulary), np.asarray([end_id], dtype="<u4").tobytes()
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True)
        for batch in batches:
            ids = batch.column(0)
            place = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            first, last = (np.searchsorted(cuts, place, side=s) for s in ("left", "right"))
            n, out = [], []
            for x in enc.encode_many(batch.column(1).to_pylist()):
                x += tail
                n.append(len(x) // 4)
                out.append(packer.compress(x))
            files = first + np.array([zlib.crc32(x) for x in out], dtype=np.int64) % (last - first + 1)
            yield pa.RecordBatch.from_arrays([pa.array(files.astype(np.int32)), ids, pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["file_no", "doc_id", "n", "frame"])

    coded = map_arrow(d, frames, "file_no int, doc_id long, n long, frame binary")
    # equal rows are alike, so any order among them gives the same file
    placed = coded.repartitionById(max(1, len(cuts) + 1), F.col("file_no")).sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first(), F.crc32("frame"), "n")

    def write(batches):
        out = None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for file_no, doc_id, n, frame in zip(*cols):
                if out is None or out.file_no != file_no:
                    if out is not None:
                        yield out.close()
                    out = _Writer(path, file_no, dictionary, digest)
                out.add(doc_id, n, frame)
        if out is not None:
            yield out.close()

    return written(map_arrow(placed, write, "file_no int, path string, docs long, tokens long, dict_sha256 string"), "token-manifest")


class _Writer:
    def __init__(self, path: str, file_no: int, dictionary: bytes, digest: bytes):
        self.fs, root = open_fs(path)
        self.fs.create_dir(root, recursive=True)
        self.uri, self.file_no, self.digest = f"{path}/part-{file_no:06d}.tokz", file_no, digest
        self.final, self.own = f"{root}/part-{file_no:06d}.tokz", f"{root}/.{uuid.uuid4().hex}"
        self.out, self.at, self.index, self.tokens = self.fs.open_output_stream(self.own), 0, [], 0
        self._put(MAGIC)

    def _put(self, data: bytes):
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id, n, frame):
        self.index.append((doc_id is None, doc_id or 0, self.at, len(frame), n))
        self.tokens += n
        self._put(frame)

    def close(self):
        import zstandard

        packed = zstandard.ZstdCompressor(level=3).compress(np.array(self.index, dtype=INDEX).tobytes())
        at = self.at
        self._put(packed)
        self._put(TAIL.pack(at, len(packed), len(self.index), self.digest, MAGIC))
        self.out.close()
        self.fs.move(self.own, self.final)
        row = [[self.file_no], [self.uri], [len(self.index)], [self.tokens], [self.digest.hex()]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file_no", "path", "docs", "tokens", "dict_sha256"])


class TokenFile:
    """Random access to one file: ``TokenFile(uri, dictionary)[i]`` reads one frame."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        fs, path = open_fs(uri)
        self.f = fs.open_input_file(path)
        end = self.f.size()
        at, size, self.n, digest, magic = TAIL.unpack(self.f.read_at(TAIL.size, end - TAIL.size))
        if magic != MAGIC or self.f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: written with another dictionary")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.f.read_at(size, at)), dtype=INDEX)
        self._unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def raw(self, i: int) -> bytes:
        e = self.index[i]
        return self._unpack.decompress(self.f.read_at(int(e["size"]), int(e["offset"])))

    def __getitem__(self, i: int) -> np.ndarray:
        return np.frombuffer(self.raw(i), dtype="<u4")

    def find(self, doc_id: int) -> list[int]:
        """Places of a document id in this file; ids ascend."""
        ids = self.index["doc_id"][self.index["null"] == 0]
        nulls = len(self.index) - len(ids)
        return list(range(nulls + int(np.searchsorted(ids, doc_id, "left")), nulls + int(np.searchsorted(ids, doc_id, "right"))))


def read_token_files(manifest: DataFrame, dictionary: bytes, *, with_ids: bool = True) -> DataFrame:
    """Read every document back: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    ``start`` counts the ids of all documents before it over all files: the files' own totals are
    summed (one row per file), the rest is a running sum inside each file.
    """
    files = manifest.withColumn("base", F.sum("tokens").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1))).select("file_no", "path", F.coalesce("base", F.lit(0)).alias("base"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema.add("ids", T.BinaryType())

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(uri, dictionary)
                for lo in range(0, f.n, 2000):
                    part, raws = f.index[lo : lo + 2000], [f.raw(i) for i in range(lo, min(lo + 2000, f.n))]
                    n = np.array([len(x) // 4 for x in raws], dtype=np.int64)
                    start = base + np.cumsum(n) - n
                    base += int(n.sum())
                    cols = [pa.array(part["doc_id"], mask=part["null"] == 1), pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in raws], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array(raws, pa.binary())] if with_ids else []), [c.name for c in schema])

    # files are dealt out again since a few small manifest parts would put them on a few tasks
    n = manifest.count()
    return map_arrow(files.repartitionById(max(1, n), F.col("file_no")).select("path", "base"), read, schema)


def token_round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write ``docs`` as token files below the shared folder and return what the files hold."""
    dictionary = train_dictionary(docs, vocabulary)
    manifest = write_token_files(docs, shared_dir(spark, "tokens"), vocabulary, end_id=end_id, dictionary=dictionary)
    return read_token_files(manifest, dictionary, with_ids=False)


def vocabulary_path(name: str) -> str:
    """A public vocabulary file; ``ORE_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("ORE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
