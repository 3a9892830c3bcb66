"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are whole numbers per dimension.  Candidates are dealt to blocks; a block's index keeps a posting
list per dimension, its candidates sorted by value.  For a query the impact of a posting is the query's
value times the candidate's value, so the postings of large impact, of either sign, lie at both ends of the
list.  Impacts are quantised to geometric steps; one step after the other, from the largest down, its
posting segments are processed: each adds its impact to its candidate's sum and counts one dimension as done.

After each step every impact that is not done lies within the step's bound, so a candidate's score lies
within its sum plus or minus the bound times its open dimensions.  A candidate whose upper bound is below the
k-th largest lower bound is out by proof.  The query stops as soon as few candidates are not out; those are
scored exactly.  Ties go to the smaller id.

Queries and candidates meet in blocks.  A block's index is built once a cell and the cell's queries stream
past it; query blocks are large, and only as many as the cores ask for, so that candidates are seldom sent
twice.  A query's partial lists (k rows per candidate block) are then merged.

Vectors that are null, or have null or non-finite components, take no part; nor do rows with a null id.
Empty vectors, and vectors shorter than the longest, count as padded by zeros.  Large finite values count in
full: rows and queries with a component above ``exact_up_to`` (2^16 to 256 dimensions, less beyond) are scored over whole
numbers of any size beside the index, and a score beyond the range of a long counts as the nearest long; a component
beyond the range of a double once scaled counts as the largest double.  Of repeated ids each row counts on its own; a query's candidates are
all rows with another id.  With fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_arrow

LONG = (1 << 63) - 1
LARGEST = float(np.finfo("f8").max)


def exact_up_to(dims: int) -> float:
    """Components up to this keep all sums, and the count of dimensions beside them, exact in doubles.

    A sum is at most dims * c * c, the unit above it four to eight times that, and the packed number dims units: below 2^53.
    """
    bits = max(1, int(dims - 1).bit_length())
    return float(1 << max(0, min(16, 24 - bits)))


class ImpactIndex:
    """Posting lists of one block of candidates (``x``: whole numbers as doubles, rows in id order)."""

    def __init__(self, x: np.ndarray):
        self.exact = exact_up_to(x.shape[1])
        self.all, self.large = x, np.flatnonzero((np.abs(x) > self.exact).any(axis=1))
        if len(self.large):
            x = x.copy()
            x[self.large] = 0
        self.x = x
        self.order = np.argsort(x.T, axis=1, kind="stable")  # per dimension its postings by value
        self.value = np.take_along_axis(np.ascontiguousarray(x.T), self.order, axis=1)
        self.largest = np.abs(x).max(axis=0) if x.size else np.zeros(x.shape[1])
        # all lists as one ascending list of (dimension, rank of the value), so that one search finds all borders
        self.known, rank = np.unique(self.value, return_inverse=True)
        self.wide = len(self.known) + 1
        self.flat = (rank.reshape(self.value.shape) + self.wide * np.arange(x.shape[1])[:, None]).ravel()
        self.steps = self.left = 0  # of the last query

    def possible(self, q: np.ndarray, k: int, enough: int, ratio: float = 0.5) -> np.ndarray:
        """Rows that may be among the ``k`` best for ``q``, by processing impacts in descending steps."""
        n = len(self.x)
        if n <= enough:
            return np.arange(n)
        used = np.flatnonzero((q != 0) & (self.largest > 0))
        # one number holds both: the dimensions done times `unit`, which no sum comes near, and the sum
        unit, both = 2.0 ** np.ceil(np.log2(4 * (np.abs(q) * self.largest).sum() + 4)), np.zeros(n)
        low, high = np.zeros(len(used), dtype=np.int64), np.full(len(used), n)  # postings between them are open
        bound = float((np.abs(q) * self.largest).max()) if len(used) else 0.0
        self.steps = 0
        while True:
            # the next step takes all impacts above its bound, the last one all that are left
            bound = bound * ratio if bound > 0.5 else 0.0
            self.steps += 1
            at = bound / np.abs(q[used])
            lo = np.maximum(self._below(used, -at, "left"), low)
            hi = np.maximum(np.minimum(self._below(used, at, "right"), high), lo)
            if not bound:
                lo = hi = high
            for d, *cut in zip(used.tolist(), low.tolist(), lo.tolist(), hi.tolist(), high.tolist()):
                for a, b in (cut[:2], cut[2:]):
                    if a < b:
                        both[self.order[d, a:b]] += q[d] * self.value[d, a:b] + unit
            low, high = lo, hi
            done = np.rint(both / unit)
            total, rest = both - done * unit, (len(used) - done) * bound
            sure = total - rest
            kth = np.partition(sure, n - k)[n - k]
            # the k-th lower bound is reached by k candidates for sure; who cannot reach it is out
            open_ = np.flatnonzero(total + rest >= kth)
            if len(open_) <= enough or not bound:
                self.left = int((high - low).sum())
                return open_

    def _below(self, dims: np.ndarray, at: np.ndarray, side: str) -> np.ndarray:
        """How many of each dimension's postings lie below ``at`` (``side`` right: or on it)."""
        return np.searchsorted(self.flat, dims * self.wide + np.searchsorted(self.known, at, side)) - dims * len(self.x)

    def search(self, q: np.ndarray, k: int, enough: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best rows and their exact scores; equal scores by row, which is by id."""
        if (np.abs(q) > self.exact).any():
            rows = exact = np.arange(len(self.x))
        else:
            rows, exact = self.possible(q, min(k + len(self.large), len(self.x)), max(enough or len(self.x) // 20, 4 * k)), self.large
            rows = np.union1d(rows, exact)
        score = (self.x[rows] @ q).astype(np.int64)
        score[np.searchsorted(rows, exact)] = [_whole(self.all[r], q) for r in exact]
        best = np.lexsort((rows, -score))[:k]
        return rows[best], score[best]


def _whole(x: np.ndarray, q: np.ndarray) -> int:
    """The inner product in whole numbers of any size, or the nearest long."""
    return max(-LONG, min(LONG, sum(int(a) * int(b) for a, b in zip(x, q))))


def _cell(batches, k: int, dims: int):
    """Rows come sorted by cell, candidates before queries."""
    at, held, index, ids = None, [], None, None
    for batch in batches:
        cells, sides, vec_ids = (batch.column(i).to_numpy() for i in range(3))
        raw = batch.column(3)
        cut = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1]), True])
        for lo, hi in zip(cut[:-1], cut[1:]):
            part = np.frombuffer(b"".join(raw.slice(lo, hi - lo).to_pylist()), dtype="<f8").reshape(hi - lo, dims)
            if cells[lo] != at:
                at, held, index = cells[lo], [], None
            if sides[lo] == 0:
                held.append((vec_ids[lo:hi], part))
                continue
            if not held:
                continue
            if index is None:
                ids = np.concatenate([h[0] for h in held])
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                index = ImpactIndex(np.concatenate([h[1] for h in held])[order])
            out = []
            for own, q in zip(vec_ids[lo:hi], part):
                same = int(np.searchsorted(ids, own, "right") - np.searchsorted(ids, own, "left"))
                rows, score = index.search(q, k + same)
                other = ids[rows] != own
                out.append((np.full(other.sum(), own), ids[rows][other], score[other]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, *, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 65_536, query_block: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` best other rows by inner product.

    Components are floor(``scale`` * x); ``block`` and ``query_block`` bound a cell's candidates and queries.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.transform(v, lambda x: x.cast("double")).alias("x"))
    facts = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("dims")).first()
    dims, cb = max(1, facts.dims), max(1, -(-facts.n // block))
    cores = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # many candidate blocks keep all cores busy by themselves
    qb = max(1, -(-facts.q // query_block), min(-(-cores // cb), facts.q))

    def encode(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                out = [np.pad(np.clip(np.floor(scale * np.array(x, dtype="<f8")), -LARGEST, LARGEST), (0, dims - len(x))).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "q", "x"])

    coded = map_arrow(rows, encode, "vec_id long, q boolean, x binary")
    own = F.xxhash64("vec_id", F.lit("block"))
    part = lambda of, blocks: F.pmod(F.xxhash64("vec_id", F.lit(of)), F.lit(blocks)).cast("int")
    as_candidate = coded.select(F.lit(0).alias("side"), "vec_id", "x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(qb - 1)), lambda j: j * cb + F.pmod(own, F.lit(cb)).cast("int"))).alias("cell"))
    as_query = coded.where("q").select(F.lit(1).alias("side"), "vec_id", "x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cb - 1)), lambda i: part("query", qb) * cb + i)).alias("cell"))
    cells = as_candidate.unionByName(as_query).repartitionById(cb * qb, F.col("cell")).sortWithinPartitions("cell", "side", "vec_id").select("cell", "side", "vec_id", "x")
    found = map_arrow(cells, partial(_cell, k=k, dims=dims), "query_id long, vec_id long, score long")
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
