"""Language-model scores by deleted interpolation of n-gram estimates.

The model mixes three maximum-likelihood estimates of a token w after a token v::

    p(w | v) = a[b] * c(v w) / c(v)  +  b[b] * c(w) / N  +  g[b] / (V + 1)

with weights that depend on the bucket b of log2 c(v).  The weights are learned by expectation
maximisation on held-out counts: one fold of the learning texts is deleted from the counts and
scored with the rest.

How the counts travel.  The input is cut into parts of ``part_bytes`` of text, which are written
once so that every later step sees the same parts.  A part sends each of its distinct n-grams once,
with its count, as sorted and delta-coded blocks to the bucket of the n-gram's hash.  A bucket adds
up and answers each part with what the others have, in the order the part sent its n-grams, so an
answer holds no keys and is mostly zeros.  So the shuffles carry distinct n-grams of parts, no task
or driver ever holds the corpus' counts, and all texts count.  There is a bucket for every ``bucket_bytes`` of
text, so a task's memory stays the same however large the input is; a part sends a bucket no block if it has no
n-gram of it, so blocks never outnumber the parts' distinct n-grams.

Null and blank texts have the end token alone.  Repeated rows count as often as they stand there.
Rows with a null id learn and score like others (``learn`` decides; a null there means no).  An empty
table gives no rows.  N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import struct
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

END = b"\n"  # no word holds it
BUCKETS = 41


class _Hashes(dict):
    """word -> its 64-bit hash as bytes; fills itself, keeps a bounded number."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh64_intdigest

        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 7).to_bytes(8, "little")
        return h


_HASHES = _Hashes()


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram keys, bigram keys, and tokens per text (words, then the end)."""
    hashes, end, blobs, lengths = _HASHES, _HASHES[END], [], []
    for t in texts:
        words = t.lower().split()
        blobs.append(b"".join(map(hashes.__getitem__, words)) + end)
        lengths.append(len(words) + 1)
    uni = np.frombuffer(b"".join(blobs), dtype="<u8")
    before = np.empty_like(uni)
    before[1:] = uni[:-1]
    before[0] = int.from_bytes(end, "little")  # after an end comes the next text's first token
    mixed = before * np.uint64(0x9E3779B97F4A7C15)
    mixed = ((mixed << np.uint64(31)) | (mixed >> np.uint64(33))) ^ uni
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return uni, mixed ^ (mixed >> np.uint64(29)), np.array(lengths, dtype=np.int64)


def _shuffled(x: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unshuffled(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def _block(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    import zstandard

    raw = struct.pack("<I", len(keys)) + _shuffled(np.diff(keys, prepend=np.uint64(0)))
    return zstandard.ZstdCompressor(level=1).compress(raw + b"".join(_shuffled(c.astype("<u4")) for c in counts))


def _unblock(raw: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, at = struct.unpack_from("<I", raw)[0], 4
    out = [np.cumsum(_unshuffled(raw[at : at + 8 * n], n, "<u8"), dtype=np.uint64)]
    at += 8 * n
    while n and at < len(raw):
        out.append(_unshuffled(raw[at : at + 4 * n], n, "<u4").astype(np.int64))
        at += 4 * n
    return out


def _counts(*counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(_shuffled(c.astype("<u4")) for c in counts))


def _uncounts(raw: bytes, kinds: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    size = len(raw) // kinds
    return [_unshuffled(raw[k * size : (k + 1) * size], size // 4, "<u4").astype(np.int64) for k in range(kinds)]


def _pack_docs(ids: list, learn: list, texts: list[bytes]) -> bytes:
    import zstandard

    table = pa.table({"id": pa.array(ids, pa.int64()), "learn": pa.array(learn, pa.bool_()), "text": pa.array(texts, pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def _unpack_docs(raw: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)).read_all()


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands in learning texts (maybe never)."""
    distinct, counts = np.unique(keys[learn], return_counts=True)
    rest = np.setdiff1d(keys[~learn], distinct)
    if not len(rest):
        return distinct, counts
    all_keys = np.concatenate([distinct, rest])
    order = np.argsort(all_keys, kind="stable")
    return all_keys[order], np.concatenate([counts, np.zeros(len(rest), np.int64)])[order]


PARTS = "part long, fold boolean, docs binary"
BLOCKS = "bucket int, part long, fold boolean, block binary"


def _split(batches, part_bytes: int):
    """Cut the task's rows into parts; those of the fold are kept apart."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    held: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}

    def part(fold):
        nonlocal number
        rows, number = held[fold], number + 1
        held[fold], size[fold] = [], 0
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([fold]), pa.array([_pack_docs(*zip(*rows))], pa.binary())], ["part", "fold", "docs"])

    for batch in batches:
        for doc_id, learn, fold, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            held[fold].append((doc_id, learn, text))
            size[fold] += len(text) + 16
            if size[fold] >= part_bytes:
                yield part(fold)
    for fold in held:
        if held[fold]:
            yield part(fold)


def _send(batches, buckets: int):
    """The distinct n-grams of each part, by bucket."""
    for batch in batches:
        for number, fold, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            docs = _unpack_docs(raw)
            uni, bi, n = _keys(docs.column("text").to_pylist())
            learns = np.repeat(docs.column("learn").to_numpy(), n)
            counted = [_counted(uni, learns), _counted(bi, learns)]
            edges = [np.searchsorted(((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1)) for k, _ in counted]
            out = []
            for b in range(buckets):
                if any(e[b] < e[b + 1] for e in edges):
                    blocks = [_block(k[e[b] : e[b + 1]], c[e[b] : e[b + 1]]) for (k, c), e in zip(counted, edges)]
                    out.append((b, number, fold, struct.pack("<I", len(blocks[0])) + b"".join(blocks)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "part", "fold", "block"])


def _pair(block: bytes) -> tuple[list, list]:
    (first,) = struct.unpack_from("<I", block)
    return _unblock(block[4 : 4 + first]), _unblock(block[4 + first :])


REPLIES = "part long, fold boolean, bucket int, block binary, tokens long, fold_tokens long, distinct long"


def _answer(batches):
    """Add up each bucket and answer its parts; rows come sorted by bucket."""
    at, parts = None, []

    def close():
        tokens = fold_tokens = distinct = 0
        replies = [[] for _ in parts]
        for kind in (0, 1):
            own = [p[2][kind] for p in parts]
            keys, inverse = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
            counts = np.concatenate([x[1] if len(x) > 1 else np.empty(0, np.int64) for x in own])
            in_fold = np.repeat([p[1] for p in parts], [len(x[0]) for x in own])
            total = np.bincount(inverse, counts, len(keys)).astype(np.int64)
            folded = np.bincount(inverse, counts * in_fold, len(keys)).astype(np.int64)
            if kind == 0:
                tokens, fold_tokens, distinct = int(total.sum()), int(folded.sum()), int((total > 0).sum())
            lo = 0
            for i, x in enumerate(own):
                where = inverse[lo : lo + len(x[0])]
                lo += len(x[0])
                mine = counts[lo - len(x[0]) : lo]
                # how many the others have; a part of the fold also hears of the fold's other parts
                replies[i].append(_counts(total[where] - mine, *([folded[where] - mine] if parts[i][1] else [])))
        rows = [(p[0], p[1], at, struct.pack("<I", len(r[0])) + r[0] + r[1], None, None, None) for p, r in zip(parts, replies)] + [(None, None, None, None, tokens, fold_tokens, distinct)]
        types = (pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "fold", "bucket", "block", "tokens", "fold_tokens", "distinct"])

    for batch in batches:
        for bucket, part, fold, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket != at and parts:
                yield close()
                parts = []
            at = bucket
            parts.append((part, fold, _pair(block)))
    if parts:
        yield close()


def _lookup(keys: np.ndarray, learn: np.ndarray, replies: list[list[np.ndarray]], fold: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """For every token: its n-gram's count over the corpus, and (in a fold part) over the fold."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    own = np.bincount(inverse[learn], minlength=len(distinct))  # what the part knows itself
    count = own + np.concatenate([r[0] for r in replies])
    return count[inverse], (own + np.concatenate([r[1] for r in replies]))[inverse] if fold else None


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0: unseen; else 1 + floor(log2(count)), at most ``BUCKETS`` - 1."""
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


def _estimates(c2, c1, c_before, tokens, distinct):
    """The three estimates of each token, and its context's bucket."""
    p2 = np.divide(c2, c_before, out=np.zeros(len(c2)), where=c_before > 0)
    return p2, c1 / max(tokens, 1), np.full(len(c1), 1.0 / (distinct + 1)), bucket_of(c_before)


def _before(counts: np.ndarray, starts: np.ndarray, end_count: int) -> np.ndarray:
    out = np.empty_like(counts)
    out[1:] = counts[:-1]
    out[starts] = end_count
    return out


def _by_part(batches, work):
    """Rows come sorted by part, replies in bucket order before documents; ``work(fold, replies, docs)`` per part."""
    at, replies = None, ([], [])
    for batch in batches:
        for part, fold, block, docs in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if part != at:
                at, replies = part, ([], [])
            if block is not None:
                (first,) = struct.unpack_from("<I", block)
                for k, x in enumerate((block[4 : 4 + first], block[4 + first :])):
                    replies[k].append(_uncounts(x, 2 if fold else 1))
            if docs is not None:
                yield from work(fold, replies, _unpack_docs(docs))


def _prepared(fold, replies, docs):
    texts = docs.column("text").to_pylist()
    uni, bi, n = _keys(texts)
    learn = np.repeat(docs.column("learn").to_numpy(), n)
    starts = np.cumsum(n) - n
    c1, f1 = _lookup(uni, learn, replies[0], fold)
    c2, f2 = _lookup(bi, learn, replies[1], fold)
    return n, starts, c1, f1, c2, f2


STEP = 4  # steps an octave in the held-out histogram


def _heldout(batches, tokens: int, fold_tokens: int, distinct: int):
    """Held-out histogram: tokens of the fold by bucket and by the two ratios to the uniform estimate."""

    def work(fold, replies, docs):
        n, starts, c1, f1, c2, f2 = _prepared(fold, replies, docs)
        end = starts + n - 1
        kept, kept_end = c1 - f1, int((c1 - f1)[end[0]])
        p2, p1, p0, bucket = _estimates(c2 - f2, kept, _before(kept, starts, kept_end), tokens - fold_tokens, distinct)
        steps = [np.where(p > 0, np.round(STEP * np.log2(np.maximum(p, 1e-300) / p0)), -(1 << 12)).astype(np.int64) for p in (p2, p1)]
        cell = (bucket << 28) | ((steps[0] + (1 << 13)) << 14) | (steps[1] + (1 << 13))
        cells, count = np.unique(cell, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(count)], ["cell", "n"])

    yield from _by_part(batches, work)


def learn_weights(histogram: list[tuple[int, int]], rounds: int = 60) -> np.ndarray:
    """Mixture weights (bucket, estimate) by expectation maximisation on the held-out histogram."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    if not histogram:
        weights[1:] = (0.3, 0.6, 0.1)
        return weights
    cell, n = (np.array(x, dtype=np.int64) for x in zip(*histogram))
    bucket, mask = cell >> 28, (1 << 14) - 1
    steps = [(cell >> 14 & mask) - (1 << 13), (cell & mask) - (1 << 13)]
    ratio = np.stack([*(np.where(s == -(1 << 12), 0.0, 2.0 ** (s / STEP)) for s in steps), np.ones(len(n))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * ratio
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        # one pseudo token an estimate, so that none is ever ruled out
        total = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1) + (1.0, 1.0, 1.0)
        total[0, 0] = 0
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


SCORES = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(batches, tokens: int, distinct: int, weights: np.ndarray):
    def work(fold, replies, docs):
        n, starts, c1, _, c2, _ = _prepared(fold, replies, docs)
        end_count = int(c1[starts[0] + n[0] - 1])
        p2, p1, p0, bucket = _estimates(c2, c1, _before(c1, starts, end_count), tokens, distinct)
        w = weights[bucket]
        mixed = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        base = np.log10((c1 + 1) / (tokens + distinct + 1))
        sums = [np.add.reduceat(x, starts) for x in ((c1 > 0).astype(np.int64), base, mixed)]
        cols = [docs.column("id").combine_chunks(), docs.column("learn").combine_chunks(), pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), tokens)), pa.array(sums[1]), pa.array(sums[2])]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORES.split(", ")])

    yield from _by_part(batches, work)


def score_texts(docs: DataFrame, *, learn: Column, fold: Column, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 8 << 20, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Score every text by the model learned from the rows where ``learn`` holds.

    ``fold``: which of those rows are deleted from the counts while the weights are learned.
    Returns ``doc_id, learn, n_tokens, n_known, train_tokens, base_score, score``.
    """
    spark = docs.sparkSession
    learns = F.coalesce(learn, F.lit(False))
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), learns.alias("learn"), (learns & F.coalesce(fold, F.lit(False))).alias("fold"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    parts = written(map_arrow(d, partial(_split, part_bytes=part_bytes), PARTS), "lm-parts")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() * part_bytes // bucket_bytes))
    asked = map_arrow(parts, partial(_send, buckets=buckets), BLOCKS).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    replies = written(map_arrow(asked, _answer, REPLIES), "lm-replies")
    stats = replies.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "fold_tokens", "distinct"))).first()
    tokens, fold_tokens, distinct = (int(x) for x in stats)

    none = F.lit(None)
    rows = replies.where("part is not null").select("part", "fold", "bucket", "block", none.cast("binary").alias("docs")).unionByName(parts.select("part", "fold", none.cast("int").alias("bucket"), none.cast("binary").alias("block"), "docs"))
    # replies first in bucket order, then the part's documents
    together = lambda x: x.repartition(F.col("part")).sortWithinPartitions("part", F.col("bucket").asc_nulls_last()).drop("bucket")
    histogram = map_arrow(together(rows.where("fold")), partial(_heldout, tokens=tokens, fold_tokens=fold_tokens, distinct=distinct), "cell long, n long")
    # at most BUCKETS times the square of the ratio steps cells, whatever the input
    weights = learn_weights([tuple(r) for r in histogram.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()])
    return map_arrow(together(rows), partial(_score, tokens=tokens, distinct=distinct, weights=weights), SCORES)
