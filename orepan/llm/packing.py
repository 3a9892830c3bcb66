"""Sum-of-squares packing of documents into fixed training windows.

Each task packs the documents of its part of the input as they come.  A document longer than the
window gives whole windows first; what is left goes to the fill level (of the windows begun so far)
after which the sum of the squared numbers of windows per level is least.  Levels are ``grain`` ids
wide (a window's level is its fill, rounded up), so that the rule soon has windows of every level to
choose from and few are open at a time.  The state is one array of counts per level.

A window that has less than a grain of room left is filled exactly by the first ids of the next
document.  So windows are full, and no more than one document is cut for each.

At the end of a part the windows still open (fewer than the levels, by experience: see the README)
are laid out one after another, fullest first, and cut at window borders; the rest is cut at powers
of two, which need no padding.  So no id is dropped and the sequences hold no padding at all.

Null texts count as empty (the end id alone); rows with null ids keep a null id; repeated rows are
packed each on its own; very long texts give whole windows; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import CACHED_CHUNKS, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


class SumOfSquares:
    """Online packing into windows of ``size``; pieces are opaque tuples ``(row, start, length)``.

    A begun window is ``[fill, pieces]`` and lies on the stack of its level; ``top[h]`` is the fill of the
    window that a choice of level h would take.
    """

    def __init__(self, size: int, grain: int | None = None):
        self.size, self.grain = size, grain or max(1, size // 32)
        self.levels = -(-size // self.grain)
        self.count, self.top = np.zeros(self.levels + 1, dtype=np.int64), np.zeros(self.levels + 1, dtype=np.int64)
        self.begun: list[list[list]] = [[] for _ in range(self.levels + 1)]

    def level_for(self, length: int) -> int:
        """The level h (0: a new window) for which counting up the level reached and down h is least.

        With N the counts, moving one window from h to t changes the sum of squares by
        2 * (N[t] - N[h] + 1) if h and t differ; a new window only adds, a full one only takes away.
        Equal changes: the fullest window.
        """
        n, fill = self.count, self.top + length
        to = -(-fill // self.grain)
        to[fill > self.size] = 0
        change = 2 * (n[to] - n) + 2
        change[to == np.arange(len(to))] = 0
        full = fill > self.size - self.grain  # leaves the levels
        change[full] = 1 - 2 * n[full]
        change[0] = 0 if full[0] else 2 * n[to[0]] + 1
        change[1:][n[1:] == 0] = np.iinfo(np.int64).max
        change[fill > self.size] = np.iinfo(np.int64).max
        return self.levels - int(np.argmin(change[::-1]))

    def place(self, row, n: int):
        """Put a document of ``n`` ids; yields the windows that become full."""
        start = 0
        while start < n and self.begun[-1]:  # less than a grain of room: filled by what comes next
            fill, pieces = self._take(self.levels)
            length = min(n - start, self.size - fill)
            pieces.append((row, start, length))
            start += length
            if fill + length == self.size:
                yield pieces
            else:
                self._put(fill + length, pieces)
                return
        while n - start >= self.size:
            yield [(row, start, self.size)]
            start += self.size
        length = n - start
        if not length:
            return
        h = self.level_for(length)
        fill, pieces = self._take(h) if h else (0, [])
        pieces.append((row, start, length))
        fill += length
        if fill == self.size:
            yield pieces
        else:
            self._put(fill, pieces)

    def _take(self, h: int) -> list:
        window = self.begun[h].pop()
        self.count[h] -= 1
        self.top[h] = self.begun[h][-1][0] if self.begun[h] else 0
        return window

    def _put(self, fill: int, pieces: list) -> None:
        h = -(-fill // self.grain)
        self.begun[h].append([fill, pieces])
        self.count[h] += 1
        self.top[h] = fill

    def close(self):
        """The begun windows, cut anew: full ones, then powers of two."""
        open_ = sorted((w for stack in self.begun for w in stack), key=lambda w: -w[0])
        left = [p for _, pieces in open_ for p in pieces]
        total, window = sum(p[2] for p in left), []
        room = self._next(total)
        for row, start, length in left:
            while length:
                take = min(length, room)
                window.append((row, start, take))
                start, length, room, total = start + take, length - take, room - take, total - take
                if not room:
                    yield window
                    window, room = [], self._next(total)
        self.__init__(self.size, self.grain)

    def _next(self, left: int) -> int:
        return self.size if left >= self.size else 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, vocabulary: str, *, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cached_chunks: int = CACHED_CHUNKS) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    No shuffle: every input part is packed by the task that reads it, and ``sequence_id`` is that
    part's number and a running number.  ``with_ids`` adds the ids themselves (little-endian); ``cached_chunks`` bounds a worker's memory.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        enc, tail = encoder(vocabulary, cached_chunks), np.asarray([end_id], dtype="<u4").tobytes()
        packer, sequence = SumOfSquares(size), TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}  # row -> [doc_id, bytes, ids not yet given out]
        rows, row = [], 0

        def give(window):
            nonlocal sequence
            offset = 0
            total = sum(p[2] for p in window)
            padded = total if total & (total - 1) == 0 else size
            for r, start, length in window:
                doc = held[r]
                part = doc[1][4 * start : 4 * (start + length)]
                rows.append((doc[0], start, length, zlib.crc32(part), len(doc[1]) // 4, sequence, offset, padded) + ((part,) if with_ids else ()))
                offset += length
                doc[2] -= length
                if not doc[2]:
                    del held[r]
            sequence += 1

        def flush():
            cols = list(zip(*rows))
            out = [pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(c, pa.binary()) for c in cols[8:]]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, enc.encode_many(batch.column(1).to_pylist())):
                raw += tail
                n, row = len(raw) // 4, row + 1
                held[row] = [doc_id, raw, n]
                for full in packer.place(row, n):
                    give(full)
                if len(rows) >= 4000:
                    yield flush()
        for window in packer.close():
            give(window)
            if len(rows) >= 4000:
                yield flush()
        if rows:
            yield flush()

    return map_arrow(d, run, SCHEMA + (", ids binary" if with_ids else ""))
