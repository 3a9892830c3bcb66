"""SimHash near-duplicate groups with bit-sliced comparison.

1. ``fingerprints``: 64 bits per whole text from the XXH64 hashes of its word shingles.
2. ``links``: distinct fingerprints are dealt to buckets by bit blocks.  Of radius + 1 blocks two
   fingerprints at that radius agree on one at least, so the buckets lose no link.  Large buckets
   are dealt again over cells of two salts each, so every pair still meets in one cell and no task
   holds a whole hot bucket.  In a bucket the fingerprints lie as 64 bit planes; the distances of
   64 pairs are counted at once by carry-save counters, and rows whose pairs all exceed the radius
   are given up between planes.  Each bucket gives only a spanning forest of its links, so the rows
   grow with the number of fingerprints and not with the pairs.
3. ``components``: the forest's connected components by alternating large and small stars.

Wider fingerprints (``words``) are dealt by 16-bit blocks, of which texts above the similarity that the
radius stands for share one with high probability (0.91 at 0.8, 0.98 at 0.85, 0.998 at 0.9 for 512 bits).

Null and blank texts have fingerprint zero and are grouped like any other.  Texts with fewer words
than a shingle have one shingle of all words.  Repeated rows stay; rows whose id is null keep a
fingerprint, and have the component of an equal fingerprint if some row with an id has it, else
null.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a UTF-8 text; A-Z are lowered, words end at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    if n <= k:
        return np.array([xxh64_intdigest(joined, seed)], dtype="<u8")
    size = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(size)
    starts, ends = (ends - size)[: n - k + 1].tolist(), (ends - 1)[k - 1 :].tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends)], dtype="<u8")


#: Odd multipliers that make further hashes of one.
MIXERS = tuple(np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF) for i in range(64))


def text_fingerprint(text: bytes, k: int, words: int = 1, seed: int = 42) -> np.ndarray:
    """``words`` times 64 bits: each bit is 1 if set in over half the shingles' hashes."""
    return bits_of(shingle_hashes(text, k, seed), words)


def bits_of(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits set in over half of ``hashes`` and of further hashes made of them."""
    out = np.zeros(words, dtype="<u8")
    for i in range(words if len(hashes) else 0):
        h = hashes
        if i:  # a further hash, mixed from the first
            h = hashes * MIXERS[i]
            h = (h ^ (h >> np.uint64(32))) * MIXERS[0]
            h ^= h >> np.uint64(29)
        bits = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(h), 1 << 16):
            bits += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, *, k: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row: the bits as a signed long, or as bytes where ``words`` is over 1."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            fps = [text_fingerprint(t.as_py(), k, words) for t in batch.column(1)]
            fp = pa.array(np.concatenate(fps).view(np.int64) if fps else [], pa.int64()) if words == 1 else pa.array([x.tobytes() for x in fps], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return map_arrow(d, run, f"doc_id long, fp {'long' if words == 1 else 'binary'}")


def _planes(x: np.ndarray) -> np.ndarray:
    """Rows of uint64 words -> bit planes; plane p holds bit p of every row, 64 rows a word."""
    wide = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), dtype="<u8")
    wide[: len(x)] = x
    bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


class Counters:
    """Carry-save counters: bit i of ``low[k]`` is bit k of lane i's count; ``over`` is sticky."""

    def __init__(self, shape, bits: int):
        self.low = [np.zeros(shape, dtype=np.uint64) for _ in range(bits)]
        self.over = np.zeros(shape, dtype=np.uint64)

    def add(self, x: np.ndarray) -> None:
        for k in range(len(self.low)):
            carry = self.low[k] & x
            self.low[k] ^= x
            x = carry
        self.over |= x

    def keep(self, rows: np.ndarray) -> None:
        self.low = [c[rows] for c in self.low]
        self.over = self.over[rows]

    def above(self, radius: int) -> np.ndarray:
        """Lanes whose count exceeds ``radius``."""
        more, equal = np.zeros_like(self.over), np.full_like(self.over, FULL)
        for k in reversed(range(len(self.low))):
            bit = FULL if radius >> k & 1 else np.uint64(0)
            more |= equal & self.low[k] & ~bit
            equal &= ~(self.low[k] ^ bit)
        return more | self.over


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with at most ``radius`` differing bits between ``left[i]`` and ``right[j]``, bit-sliced."""
    planes, bits = _planes(right), max(1, radius.bit_length())
    found_i, found_j = [], []
    for lo in range(0, len(left), 1024):
        rows = np.arange(lo, min(lo + 1024, len(left)))
        state = Counters((len(rows), planes.shape[1]), bits)
        for p in range(len(planes)):
            own = np.where((left[rows, p // 64] >> np.uint64(p % 64)) & np.uint64(1), FULL, np.uint64(0))
            state.add(planes[p][None, :] ^ own[:, None])
            if p % 8 == 7:  # rows that are over the radius in every lane are given up
                alive = ~(state.over == FULL).all(axis=1)
                if not alive.all():
                    rows = rows[alive]
                    state.keep(alive)
                    if not len(rows):
                        break
        if len(rows):
            i, j = np.nonzero(_lanes(~state.above(radius), len(right)))
            found_i.append(rows[i])
            found_j.append(j)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def near_lanes(x: np.ndarray, radius: int) -> np.ndarray:
    """For already paired lanes (``x``: their exclusive or): which hold at most ``radius`` set bits."""
    planes = _planes(x)
    state = Counters(planes.shape[1], max(1, radius.bit_length()))
    for p in range(len(planes)):
        state.add(planes[p])
        if p % 16 == 15 and (state.over == FULL).all():
            return np.zeros(len(x), dtype=bool)
    return _lanes(~state.above(radius), len(x))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component among ``n`` nodes with links ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        # the larger root of each link is hung below the smaller one, then all paths are shortened
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def _bucket_edges(bucket: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int, dense: int = 64):
    """Spanning forest edges of sorted buckets.  Lanes at the same shift share one bit-sliced pass."""
    n = len(fp)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    sizes = np.diff(cut)
    a, b = [], []
    end = np.repeat(cut[1:], sizes)
    small = np.repeat(sizes <= dense, sizes)
    at = np.arange(n)
    shift, rows = 1, at[small]
    while len(rows := rows[rows + shift < end[rows]]):
        ok = near_lanes(fp[rows] ^ fp[rows + shift], radius)
        a.append(rows[ok])
        b.append(rows[ok] + shift)
        shift += 1
    for lo, hi in zip(cut[:-1][sizes > dense], cut[1:][sizes > dense]):
        i, j = near_pairs(fp[lo:hi], fp[lo:hi], radius)
        up = i < j
        label = forest(hi - lo, i[up], j[up])
        moved = np.flatnonzero(label != np.arange(hi - lo))
        a.append(lo + label[moved])
        b.append(lo + moved)
    a, b = np.concatenate(a) if a else at[:0], np.concatenate(b) if b else at[:0]
    label = forest(n, a, b)
    moved = np.flatnonzero(label != at)
    return node[label[moved]], node[moved]


def links(distinct: DataFrame, *, radius: int = 3, blocks: int | None = None, cell: int = 1024) -> DataFrame:
    """Links ``a, b`` (a < b) that connect all fingerprints within ``radius``, as forests per bucket.

    ``distinct``: ``node, fp``, one row per fingerprint.  With ``blocks`` m > radius, a bucket is
    one choice of m - radius blocks; more blocks give more and smaller buckets.
    """
    if dict(distinct.dtypes)["fp"] == "binary":
        # 16-bit blocks; texts as alike as asked for agree on one of them but for a small share of pairs
        size = "cast(length(fp) div 2 as int)"
        rows = distinct.select("node", "fp", F.expr(f"inline(transform(sequence(1, {size}), i -> struct(i as band, xxhash64(substring(fp, 2 * i - 1, 2)) as value)))"))
        return _compared(rows, radius, cell)
    n = distinct.count()
    m = blocks or (radius + 1 if n < 2_000_000 else radius + 2 if n < 500_000_000 else radius + 3)
    edges = [round(64 * i / m) for i in range(m + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(m)]
    from itertools import combinations

    chosen = [sum(masks[i] for i in c) for c in combinations(range(m), m - radius)]
    signed = [x - (1 << 64) if x >> 63 else x for x in chosen]
    keys = F.array(*(F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(x)).alias("value")) for k, x in enumerate(signed)))
    return _compared(distinct.select("node", "fp", F.inline(keys)), radius, cell)


def _dealt(rows: DataFrame, cell: int, part_by: str = "fp", more: tuple[str, ...] = (), shingles=None) -> DataFrame:
    """Rows (``node, fp, band, value`` and ``more``) by bucket; buckets over ``cell`` rows are dealt over cells,
    and so are those over ``CELL_SHINGLES`` where rows hold ``shingles``."""
    parts = F.ceil(F.count("*") / cell)
    if shingles is not None:
        parts = F.greatest(parts, F.least(F.ceil(F.sum(shingles) / CELL_SHINGLES), F.count("*")))
    hot = rows.groupBy("band", "value").agg(parts.cast("int").alias("parts")).where("parts > 1")
    spread = rows.join(hot, ["band", "value"], "left")
    own = F.pmod(F.xxhash64(part_by), F.col("parts"))
    # a row of part p goes to the cells (p, q) of every q, as the smaller and the larger of both
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda q: F.struct(F.least(own, q).alias("x"), F.greatest(own, q).alias("y")))
    )
    dealt = spread.select("node", "fp", "band", "value", *more, F.explode(cells).alias("c")).select("node", "fp", F.xxhash64("band", "value", "c.x", "c.y").alias("bucket"), *more)
    # buckets whose hashes clash are compared too, which finds nothing false
    return dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket", "node")


def _compared(rows: DataFrame, radius: int, cell: int) -> DataFrame:
    """Compare the rows (``node, fp, band, value``) of each bucket; buckets over ``cell`` rows in cells."""
    dealt = _dealt(rows, cell)
    run = lambda batches: _by_bucket(batches, lambda cols: _edge_batch(*cols, radius))
    return map_arrow(dealt, run, "a long, b long").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_bucket(batches, edges, least: int = 5_000):
    """``edges`` of the columns (``bucket, node, fp`` and further ones) of whole buckets, of ``least`` rows and more."""
    held = None
    for batch in _larger(batches, least):
        fp = batch.column(1)
        fp = np.frombuffer(b"".join(fp.to_pylist()), dtype="<u8") if pa.types.is_binary(fp.type) else fp.to_numpy().view(np.uint64)
        cols = [batch.column(2).to_numpy(), batch.column(0).to_numpy(), fp.reshape(batch.num_rows, -1), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[3:])]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        last = np.searchsorted(cols[0], cols[0][-1], "left")
        held = [c[last:] for c in cols]
        if last:
            yield edges([c[:last] for c in cols])
    if held is not None:
        yield edges(held)


def _larger(batches, least: int):
    """Batches put together to at least ``least`` rows, as one bit-sliced pass serves many rows."""
    part, n = [], 0
    for batch in batches:
        part.append(batch)
        n += batch.num_rows
        if n >= least:
            yield pa.Table.from_batches(part).combine_chunks().to_batches()[0]
            part, n = [], 0
    if n:
        yield pa.Table.from_batches(part).combine_chunks().to_batches()[0]


def _edge_batch(bucket, node, fp, radius):
    a, b = _bucket_edges(bucket, node, fp, radius)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _nearest_candidates(bucket, node, fp, group, apart, radius: int, dense: int = 64):
    """For each row of sorted buckets the next and the last row before it that may still be linked to it.

    Such a pair lies within ``radius``, in two groups, and was not found apart before.  A row without any
    has none left; paths instead of stars leave no node with many pairs.
    """
    n = len(node)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    sizes = np.diff(cut)
    after, before = np.full(n, n), np.full(n, -1)
    some = np.fromiter((len(x) > 0 for x in apart), bool, n)
    hard = {x: set(apart[x].tolist()) for x in np.flatnonzero(some).tolist()}

    def take(i, j):
        """Pairs i < j, by growing distance of rows for each i and j."""
        ok = group[i] != group[j]
        i, j = i[ok], j[ok]
        ask = np.flatnonzero(some[i] & some[j])
        held = ask[np.fromiter((node[j[x]] in hard[i[x]] for x in ask.tolist()), bool, len(ask))]
        i, j = np.delete(i, held), np.delete(j, held)
        np.minimum.at(after, i, j)
        np.maximum.at(before, j, i)

    end = np.repeat(cut[1:], sizes)
    rows = np.arange(n)[np.repeat(sizes <= dense, sizes)]
    shift = 1
    while len(rows := rows[rows + shift < end[rows]]):
        ok = near_lanes(fp[rows] ^ fp[rows + shift], radius)
        take(rows[ok], rows[ok] + shift)
        shift += 1
    for lo, hi in zip(cut[:-1][sizes > dense], cut[1:][sizes > dense]):
        i, j = near_pairs(fp[lo:hi], fp[lo:hi], radius)
        up = i < j
        take(lo + i[up], lo + j[up])
    i, j = np.flatnonzero(after < n), np.flatnonzero(before >= 0)
    return node[np.r_[i, before[j]]], node[np.r_[after[i], j]]


def _candidates(nodes: DataFrame, radius: int, cell: int) -> DataFrame:
    """Pairs ``a, b`` to be checked next: for each of ``nodes`` (``node, fp, keys, grp, apart``) some, if any is left."""
    rows = nodes.select("node", "fp", "grp", "apart", F.posexplode("keys").alias("band", "value"))
    dealt = _dealt(rows, cell, "node", ("grp", "apart"))

    def edges(cols):
        a, b = _nearest_candidates(*cols, radius)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    return map_arrow(dealt, lambda batches: _by_bucket(batches, edges), "a long, b long").distinct()


BANDS, ROWS = 20, 5


def band_keys(hashes: np.ndarray, seed: int = 42) -> np.ndarray:
    """``BANDS`` keys of a set of hashes, each of ``ROWS`` least values under further hashes; none of an empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    factors = np.random.default_rng(seed).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, FULL)
    for lo in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[lo : lo + 4096, None] * factors).min(axis=0))
    key = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ least[r::ROWS]) * MIXERS[3]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def set_prints(texts: DataFrame, *, k: int, words: int) -> DataFrame:
    """``node, fp, keys`` of ``node, text``: fingerprint and band keys of the set of shingles, repeats counted once."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)) for t in batch.column(1)]
            fps, keys = [bits_of(x, words).tobytes() for x in sets], [band_keys(x) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["node", "fp", "keys"])

    return map_arrow(texts.select("node", F.col("text").cast("binary").alias("text")), run, "node long, fp binary, keys array<long>")


def shingle_sets(docs: DataFrame, *, k: int) -> DataFrame:
    """``node, shingles`` of ``node, text``: the set of the hashes of the word shingles."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return map_arrow(docs.select("node", F.col("text").cast("binary").alias("text")), run, "node long, shingles array<long>")


def _alike_edges(bucket, node, fp, group, sets, radius: int, similarity: float, dense: int = 64):
    """Spanning forest edges of sorted buckets: rows of two groups within ``radius`` whose ``sets`` are alike, exactly."""
    n = len(node)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    sizes, at = np.diff(cut), np.arange(n)
    end = np.repeat(cut[1:], sizes)
    left, right = [at[:0]], [at[:0]]
    rows, shift = at[np.repeat(sizes <= dense, sizes)], 1
    while len(rows := rows[rows + shift < end[rows]]):
        ok = rows[near_lanes(fp[rows] ^ fp[rows + shift], radius)]
        left.append(ok)
        right.append(ok + shift)
        shift += 1
    for lo, hi in zip(cut[:-1][sizes > dense], cut[1:][sizes > dense]):
        i, j = near_pairs(fp[lo:hi], fp[lo:hi], radius)
        left.append(lo + i[i < j])
        right.append(lo + j[i < j])
    i, j = np.concatenate(left), np.concatenate(right)
    differ = group[i] != group[j]
    order = np.argsort(i[differ], kind="stable")
    i, j = i[differ][order], j[differ][order]
    if not len(i):
        return node[:0], node[:0]
    many = np.fromiter(map(len, sets), np.int64, n)
    start = np.r_[0, np.cumsum(many)]
    ids, flat = np.unique(np.concatenate(list(sets)), return_inverse=True)
    mark, alike = np.zeros(len(ids), dtype=np.int32), np.zeros(len(i), dtype=bool)
    steps = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True])
    for lo, hi in zip(steps[:-1], steps[1:]):  # one row against all rows left to it, in one pass over their sets
        row, others = i[lo], j[lo:hi]
        own, first = flat[start[row] : start[row + 1]], others[0]
        mark[own] = 1
        common = np.add.reduceat(mark[flat[start[first] : start[others[-1] + 1]]], start[first : others[-1] + 1] - start[first], dtype=np.int64)[others - first]
        alike[lo:hi] = common / (many[row] + many[others] - common) >= similarity - 1e-12
        mark[own] = 0
    label = forest(n, i[alike], j[alike])
    moved = np.flatnonzero(label != at)
    return node[label[moved]], node[moved]


#: Shingle hashes in one part of a cell, unless one text has more.
CELL_SHINGLES = 1_000_000


def _links_left(nodes: DataFrame, sets: DataFrame, *, radius: int, similarity: float, cell: int) -> DataFrame:
    """The links ``a, b`` between groups that are left among ``nodes`` (``node, fp, keys, grp``), decided in their
    cells from the shingle sets sent there; a cell gives a forest.  Parts are cut by rows and by shingles."""
    rows = nodes.join(sets.hint("merge"), "node").select("node", "fp", "grp", "shingles", F.posexplode("keys").alias("band", "value"))
    shared = rows.groupBy("band", "value").agg(F.count("*").alias("c")).where("c > 1").select("band", "value")
    dealt = _dealt(rows.join(shared, ["band", "value"], "left_semi"), cell, "node", ("grp", "shingles"), F.size("shingles"))

    def edges(cols):
        a, b = _alike_edges(*cols, radius, similarity)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    return map_arrow(dealt, lambda batches: _by_bucket(batches, edges, 500), "a long, b long").distinct()


def similar_links(nodes: DataFrame, texts: DataFrame, *, k: int, similarity: float, radius: int, cell: int = 1024, pair_rounds: int = 2) -> DataFrame:
    """Links ``a, b`` that connect all ``nodes`` (``node, fp, keys``) which share a key, lie within ``radius`` and
    whose shingle sets (of ``texts``: ``node, text``) have a Jaccard similarity of ``similarity`` or more.

    The fingerprints give candidates only.  A round takes for every node the candidates next to it in its
    buckets, compares their sets, and joins the groups of those that are alike; pairs within a group, and
    pairs once found apart, need no further look.  This settles all but the nodes of large groups that lie close
    to ``similarity``; after ``pair_rounds`` their sets are sent to their cells, which decide all pairs left at once,
    so the jobs do not grow with the size of a group.
    """
    none = F.expr("cast(array() as array<bigint>)")
    open_nodes = nodes.select("node", "fp", "keys", F.col("node").alias("grp"), none.alias("apart"))
    sets, linked, apart = None, None, None
    for _ in range(pair_rounds):
        todo = written(_candidates(open_nodes, radius, cell), "candidates")
        if todo.isEmpty():
            return todo if linked is None else linked
        ends = todo.select(F.col("a").alias("node")).unionByName(todo.select(F.col("b").alias("node"))).distinct()
        if sets is None:  # later rounds look at nodes of the first only
            chosen = texts.join(ends.hint("merge"), "node", "left_semi")
            sets = written(shingle_sets(chosen, k=k), "shingles")
        side = lambda end, name: sets.select(F.col("node").alias(end), F.col("shingles").alias(name)).hint("merge")
        both = todo.join(side("a", "x"), "a").join(side("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        found = written(both.select("a", "b", F.when(union == 0, 1.0).otherwise(common / union).alias("j")), "compared")
        yes, no = found.where(F.col("j") >= similarity - 1e-12).select("a", "b"), found.where(F.col("j") < similarity - 1e-12).select("a", "b")
        linked = yes if linked is None else linked.unionByName(yes)
        apart = no if apart is None else apart.unionByName(no)
        groups = components(linked)
        lists = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("apart"))
        again = nodes.join(ends.hint("merge"), "node", "left_semi").join(groups.hint("merge"), "node", "left").join(lists.hint("merge"), "node", "left")
        open_nodes = written(again.select("node", "fp", "keys", F.coalesce("component", "node").alias("grp"), F.coalesce("apart", none).alias("apart")), "open-nodes")
    left = _links_left(open_nodes.drop("apart"), sets, radius=radius, similarity=similarity, cell=cell)
    return linked.unionByName(written(left, "links-left"))


def components(edges: DataFrame, *, most_rounds: int | None = None) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (``a, b``).

    Alternates two steps until nothing changes: each node's larger neighbours are tied to its least
    neighbour, then each node and its smaller neighbours.  Sums before joins keep hot nodes apart;
    every round is written to the shared folder.  It is an error if they still change after ``most_rounds`` (200).
    """
    rounds = most_rounds or 200
    now, seen = written(edges.select("a", "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: of each node's smaller neighbours the least takes the others and the node
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b"))))).where("a != b").distinct()
        now = written(small, "links")
        mark = now.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:  # rounds grow with the square of a logarithm at most, so this is a fault and no result
        raise RuntimeError(f"components still change after {rounds} rounds")
    tied = now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return tied.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct().join(tied.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, *, k: int = 3, radius: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` per row; texts at ``radius`` or fewer differing bits are linked.

    With one word (64 bits) no link is lost.  More words measure the angle between the texts' shingle
    counts more finely, for links at a given similarity (``radius_for``).
    """
    fps = written(fingerprints(docs, k=k, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("c")), "distinct")
    tied = components(links(distinct.where("node is not null").select("node", "fp"), radius=radius))
    place = written(distinct.join(tied, "node", "left").select("fp", "c", F.coalesce("component", "node").alias("component_id")), "places")
    # fingerprints with more than a thousandth of all rows: fewer than a thousand, so they are broadcast and
    # their rows stay where they are; all others meet by the fingerprint
    often = place.where(F.col("c") * 1000 > place.agg(F.sum("c")).first()[0]).select("fp", F.col("component_id").alias("hot"), F.lit(True).alias("known"))
    marked = fps.join(F.broadcast(often), "fp", "left")
    rare = marked.where("known is null").select("doc_id", "fp").join(place.select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")
    return marked.where("known").select("doc_id", "fp", F.col("hot").alias("component_id")).unionByName(rare)


def text_key(text_col: str = "text"):
    """A text's identity as a long; null and blank texts have one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(F.when(text.rlike(r"\A[ \t-\r]*\z"), "").otherwise(text))


def first_of_similar(docs: DataFrame, *, k: int, similarity: float, words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, node`` (``text_key``) of the row that stands for its group; a null id comes last.

    Groups are the components of the links between texts whose sets of word shingles have a Jaccard
    similarity of ``similarity`` or more, computed exactly; texts are told apart by what they say and not by
    their id.  A pair is compared if it shares one of 20 keys of 5 least hashes and lies within 4 deviations
    of the bits expected: all but 0.0004 of pairs at similarity 0.8, fewer above.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("node"))
    texts = written(d.groupBy("node").agg(F.first("text").alias("text"), F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("low")), "texts")
    prints = written(set_prints(texts, k=k, words=words), "prints")
    tied = components(similar_links(prints, texts, k=k, similarity=similarity, radius=radius_for(similarity, words, 4.0)))
    placed = texts.select("node", "low").join(tied.hint("merge"), "node", "left").select(F.coalesce("component", "node").alias("component"), F.struct("low", "node").alias("place"))
    least = placed.groupBy("component").agg(F.min("place").alias("place"))
    return least.select(F.nullif(F.col("place.low"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col("place.node").alias("node"))


def radius_for(similarity: float, words: int, margin: float = 1.0) -> int:
    """Differing bits expected at a Jaccard similarity of equally long texts, and ``margin`` deviations more."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * words
    return int(bits * angle + margin * math.sqrt(bits * angle * (1 - angle)))


def hex64(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
