"""Product codes of vectors: equal consecutive parts, a codebook for each part, whole numbers throughout.

The nearest entry of a part is found through memoised grid cells.  A part falls into a cell of a coarse grid;
the first time a cell is met, the entries that can be nearest somewhere in its box are kept for it: those whose
least distance to the box is not above the smallest of all entries' greatest distances to it.  An entry left out
is farther than another one everywhere in the box, so only the kept ones are evaluated, exactly, with ties to
the lower index.  A task keeps up to ``CELLS`` cells a part position.

Each round is one pass over the vectors: tasks add up their parts by entry, and one row a task and part
position with the sums is shuffled and added up in a stream.  The driver sees the codebooks only.

Components become floor(``scale`` * x); beyond the range of a long they count as its nearest value, and so do
errors and their sums.  Vectors that are null, or have null or non-finite components, are dropped; so are those
whose length is no multiple of the parts or differs from that of the first kept vector in id order (without that
a codebook has no meaning).  Equal ids go by label and components, null ids come last; all their rows are coded.
With fewer kept vectors than entries a codebook has one entry for each.  Equal parts at the start give equal
entries, of which the later stay unused and unchanged.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

LONG = (1 << 63) - 1
#: Components below this keep squared distances of 4,096 dimensions exact in 64 bits; others take whole numbers of any size.
LARGE = 1 << 24
#: Cells that a task keeps for a part position, labels whose sums are broadcast (24 bytes each).
CELLS, MOST_LABELS = 200_000, 1_000_000


def _large(x: np.ndarray) -> bool:
    return x.max(initial=0) >= LARGE or x.min(initial=0) <= -LARGE


def _names(cells: np.ndarray) -> np.ndarray:
    """One name a cell: up to four small coordinates in a 64-bit number, else the bytes of all."""
    width = cells.shape[1]
    if width <= 4 and cells.max(initial=0) < 1 << 15 and cells.min(initial=0) >= -(1 << 15):
        name = np.zeros(len(cells), dtype=np.int64)
        for i in range(width):
            name = (name << 16) | (cells[:, i] & 0xFFFF)
        return name
    return cells.view(np.dtype((np.void, cells.dtype.itemsize * width))).ravel()


def _larger(batches, rows: int = 16_384):
    """Record batches put together to about ``rows``: the more parts at once, the fewer cells a part."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Grid:
    """The entries of one part position, and the cells met so far."""

    def __init__(self, book: np.ndarray):
        self.book, self.wide = book, book.dtype == object
        spread = int(np.median(np.abs(book - book[:1]))) if book.size else 0
        self.shift = max(0, spread.bit_length() - 1)  # a cell is about a half of the spread wide, or all of it
        self.known: dict[int | bytes, np.ndarray] = {}

    def possible(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that are not dominated in its box, ascending."""
        low = (cells << self.shift)[:, None, :]
        high = low + (1 << self.shift) - 1
        least = np.maximum(np.maximum(low - self.book, self.book - high), 0)
        most = np.maximum(np.abs(low - self.book), np.abs(high - self.book))
        least, most = (least * least).sum(axis=2), (most * most).sum(axis=2)
        return [np.flatnonzero(row) for row in least <= most.min(axis=1)[:, None]]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it, for each row."""
        if self.wide or not parts.shape[1] or _large(parts):
            return self._all(parts.astype(object))
        cells = np.ascontiguousarray(parts >> self.shift)
        name, first, cell = np.unique(_names(cells), return_index=True, return_inverse=True)
        names = [bytes(x) for x in name] if name.dtype.kind == "V" else name.tolist()
        if len(self.known) + len(names) > CELLS:
            self.known.clear()
        new = [i for i, name in enumerate(names) if name not in self.known]
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            self.known.update(zip([names[i] for i in some], self.possible(cells[first[some]])))
        lists = [self.known[name] for name in names]
        size = np.array([len(x) for x in lists])
        entries, begin = np.concatenate(lists), np.cumsum(size) - size
        index, best = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        for at in range(0, len(parts), 4096):
            own = cell[at : at + 4096]
            n = size[own]
            start = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(start, n)
            tried = entries[np.repeat(begin[own], n) + place]
            apart = parts[at + np.repeat(np.arange(len(own)), n)] - self.book[tried]
            far = np.einsum("ij,ij->i", apart, apart)
            least = np.minimum.reduceat(far, start)
            hit = np.flatnonzero(far == np.repeat(least, n))
            hit = hit[np.searchsorted(hit, start)]  # the first one of each row: the lower index
            index[at : at + 4096], best[at : at + 4096] = tried[hit], least
        return index, best

    def _all(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole numbers of any size, against every entry."""
        index, best = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=object)
        for i, x in enumerate(parts):
            far = [sum(int(a - b) ** 2 for a, b in zip(x, e)) for e in self.book.astype(object)]
            best[i] = min(far)
            index[i] = far.index(best[i])
        return index, best


class Codebooks:
    """``books[part]``: entries by index, each a list of whole numbers."""

    def __init__(self, books: list[list[list[int]]]):
        self.books = books

    def grids(self) -> list[Grid]:
        out = []
        for book in self.books:
            large = any(abs(x) >= LARGE for e in book for x in e)
            out.append(Grid(np.array(book, dtype=object if large else np.int64).reshape(len(book), -1)))
        return out

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for e in book for x in e).encode()).hexdigest()

    def vector(self, code: str) -> list[int]:
        """The vector that a code stands for, in scaled whole numbers."""
        return [x for book, i in zip(self.books, bytes.fromhex(code)) for x in book[i]]

    def moved(self, sums: dict[int, tuple[list[int], list[int]]]) -> "Codebooks":
        """Each used entry at the mean of its parts, rounded down."""
        out = []
        for p, book in enumerate(self.books):
            counts, totals = sums.get(p, ([0] * len(book), []))
            width = len(book[0]) if book else 0
            out.append([[t // n for t in totals[i * width : (i + 1) * width]] if n else e for i, (e, n) in enumerate(zip(book, counts))])
        return Codebooks(out)


def scaled(vectors: DataFrame, *, parts: int, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, x``: the kept vectors in whole numbers, all of one length."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(v.isNotNull()).where(finite & (F.size(v) % parts == 0))
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("x"))
    first = rows.orderBy(*_order()).first()
    return rows.where(F.size("x") == (len(first.x) if first else 0))


def _order():
    return F.asc_nulls_last("vec_id"), F.asc_nulls_first("label"), F.asc("x")


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists of longs as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assigned(grids: list[Grid], column) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per part position: the parts, their entries and their squared distances."""
    x = _matrix(column)
    width = x.shape[1] // len(grids)
    cut = [np.ascontiguousarray(x[:, p * width : (p + 1) * width]) for p in range(len(grids))]
    found = [g.nearest(c) for g, c in zip(grids, cut)]
    return cut, [i for i, _ in found], [d for _, d in found]


def _sums(rows: DataFrame, books: Codebooks) -> dict[int, tuple[list[int], list[int]]]:
    """By part position: how many parts each entry has, and their sums one entry after the other."""
    n_parts, k = len(books.books), len(books.books[0])
    kind = "part int, counts array<long>, totals array<decimal(38,0)>"

    def add(batches):
        grids = books.grids()
        width = len(books.books[0][0])
        counts, totals = np.zeros((n_parts, k), dtype=np.int64), np.zeros((n_parts, k, width), dtype=object)
        seen = False
        for batch in _larger(batches):
            seen = seen or batch.num_rows > 0
            for p, (part, index, _) in enumerate(zip(*_assigned(grids, batch.column(0)))):
                counts[p] += np.bincount(index, minlength=k)
                own = np.zeros((k, width), dtype=object if _large(part) else np.int64)
                np.add.at(own, index, part.astype(own.dtype))
                totals[p] += own.astype(object)
        if seen:
            yield _as_rows(range(n_parts), counts, totals)

    def merge(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for p, c, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                c, t = np.array(c, dtype=np.int64), np.array([int(x) for x in t], dtype=object)
                held[p] = [c, t] if p not in held else [held[p][0] + c, held[p][1] + t]
        if held:
            yield _as_rows(list(held), [h[0] for h in held.values()], [h[1] for h in held.values()])

    partial = map_arrow(rows.select("x"), add, kind)
    merged = map_arrow(partial.repartitionById(n_parts, F.col("part")), merge, kind)
    return {r.part: (list(r.counts), [int(t) for t in r.totals]) for r in merged.collect()}


def _as_rows(parts, counts, totals) -> pa.RecordBatch:
    numbers = [[Decimal(int(x)) for x in np.ravel(t)] for t in totals]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([list(map(int, c)) for c in counts], pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.decimal128(38, 0)))], ["part", "counts", "totals"])


def train(rows: DataFrame, *, parts: int, entries: int, rounds: int) -> Codebooks | None:
    """Codebooks that start as the first ``entries`` vectors and are moved ``rounds`` times; None without vectors."""
    first = [r.x for r in rows.orderBy(*_order()).select("x").limit(entries).collect()]
    if not first:
        return None
    width = len(first[0]) // parts
    books = Codebooks([[x[p * width : (p + 1) * width] for x in first] for p in range(parts)])
    for _ in range(rounds):
        books = books.moved(_sums(rows, books))
    return books


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of all ``rows``."""

    def run(batches):
        grids = books.grids()
        for batch in _larger(batches):
            _, index, far = _assigned(grids, batch.column(2))
            codes = np.stack(index, axis=1).astype(np.uint8)
            error = np.sum([f.astype(object) for f in far], axis=0) if any(f.dtype == object for f in far) else np.sum(far, axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(int(e), LONG) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return map_arrow(rows.select("vec_id", "label", "x"), run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """``vec_id, label, code, error, label_error`` of every kept vector, and the codebooks (at most 256 entries).

    ``label_error`` is the error summed over equal labels, nulls together.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = scaled(vectors, parts=parts, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col)
    books = train(rows, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    codes = written(coded(rows, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    by_label = written(codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    few = F.broadcast(by_label) if by_label.count() <= MOST_LABELS else by_label
    return codes.join(few, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books
