"""Texts of two lists that are near by edit distance: the work of one task of ``audit.edit_similarity``."""

from __future__ import annotations

import numpy as np

#: Letters of one list gone through at once, pairs counted at once, and matches of pieces looked at at once.
STEP_LETTERS, STEP_PAIRS, STEP_MATCHES = 200_000, 4_000_000, 2_000_000

#: Letters of the texts that are compared to another one at once.
ROW_LETTERS = 8_000
#: No letter.
BETWEEN = 0x110000


def runs(sizes, most: float) -> list[np.ndarray]:
    """Places in runs that sum up to about ``most``."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1)


def hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the ``q`` letters from each place on."""
    if len(codes) < q:
        return np.empty(0, "uint64")
    codes = codes.astype("uint64")
    base, h, w = 0x9E3779B97F4A7C15, codes, 1
    for bit in bin(q)[3:]:
        h, w = h[:-w] * np.uint64(pow(base, w, 1 << 64)) + h[w:], 2 * w
        if bit == "1":
            h, w = h[:-1] * np.uint64(base) + codes[w:], w + 1
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each begins and how many it has."""
    n = np.array([len(s) for s in texts], "int64")
    return np.frombuffer("".join(texts).encode("utf-32-le"), "uint32"), np.cumsum(n) - n, n


def pieces(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pieces of ``q`` letters that texts are cut into: the text's number, the place and the hash."""
    count = np.array([len(s) // q for s in texts], "int64")
    of = np.repeat(np.arange(len(texts)), count)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * q
    h = np.empty(len(of), "uint64")
    for r in runs(np.array([len(s) for s in texts]), STEP_LETTERS):
        codes, start, _ = letters([texts[k] for k in r])
        own = slice(*np.searchsorted(of, (r[0], r[-1] + 1)))
        h[own] = hashes(codes, q)[start[of[own] - r[0]] + at[own]]
    return of, at, h


def close_pairs(xs: list[str], ys: list[str], t: float, eps: float = 1e-9):
    """Places (in ``xs``, in ``ys``) of all pairs that can have an identity of ``t`` or more, and of few others.

    E edits leave all but E pieces of x unchanged in y, whichever pieces are chosen that do not overlap.  With e edits before it a
    piece is shifted by no more than e from the beginning and no more than E - e from the end, so both shifts add up to E at
    most.  First, pieces so long that each x has just more than E are looked up in y, without half of those that it has too many,
    the most frequent.  Pairs with enough of them are looked at again with pieces of half that length.  Hashes stand for
    pieces, where a collision only lets a pair pass.  Where x may be edited at every letter, all pairs of fitting lengths
    are returned.
    """
    n = np.array([len(x) for x in xs], "int64")
    D = np.floor(n * ((1 - t) / t) + eps).astype("int64")  # edits to any partner
    long = int((n / (D + 1)).min())
    short = max(1, long // 2)
    # a key is the first bits of a hash and a place behind them; places beyond the last one of an x are the same
    place, last = np.uint64(int(n.max()).bit_length()), (1 << int(n.max()).bit_length()) - 1
    word = lambda h: (h >> place) << place
    key = lambda h, at: h | np.clip(at, 0, last).astype("uint64")

    if long:
        x_of, lo, h = pieces(xs, long)
        h = word(h)
        have = n // long
        spare = (have - D - 1) // 2
        _, which, often = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.arange(len(h)) - np.repeat(np.cumsum(have) - have, have)
        kept = np.lexsort((-often[which], x_of))[rank >= spare[x_of]]
        h = key(h[kept], lo[kept])
        order = np.argsort(h)
        index, x_of, lo = h[order], x_of[kept[order]], lo[kept[order]]
        first = np.uint64(64 - min(24, len(index).bit_length() + 5))
        seen = np.zeros(1 << 64 - int(first), bool)
        seen[index >> first] = True
        _, again_at, again = pieces(xs, short)
        again, again_from = word(again), np.cumsum(n // short) - n // short

    for part in runs(np.array([max(len(y) / STEP_LETTERS, len(xs) / STEP_PAIRS) for y in ys]), 1):
        codes, begin, m = letters([ys[j] for j in part])
        edits = lambda x, y: np.minimum(np.floor((1 - t) * np.maximum(n[x], m[y]) + eps).astype("int64"), D[x])  # noqa: B023, E731
        found = np.zeros((len(m), len(n)), "int32")
        if long:
            h = hashes(codes, long)
            y_of = np.repeat(np.arange(len(m)), m)[: len(h)]
            s = np.arange(len(h)) - begin[y_of]
            at = np.flatnonzero((s <= m[y_of] - long) & seen[h >> first])
            at = at[np.argsort(h[at])]
            h, farthest = word(h[at]), D.max()
            left = np.searchsorted(index, key(h, s[at] - farthest))
            matches = np.searchsorted(index, key(h, s[at] + farthest), "right") - left
            at, left, matches = (v[matches > 0] for v in (at, left, matches))
            for r in runs(matches, STEP_MATCHES):
                c = matches[r]
                g = np.repeat(at[r], c)
                p = np.arange(len(g)) + np.repeat(left[r] - (np.cumsum(c) - c), c)
                x, y, shift = x_of[p], y_of[g], s[g] - lo[p]
                near = np.abs(shift) + np.abs(shift - (m[y] - n[x])) <= edits(x, y)
                np.add.at(found.reshape(-1), y[near] * len(n) + x[near], 1)
        y, x = np.nonzero(found) if long else np.divmod(np.arange(found.size), len(n))
        good = (m[y] >= n[x] * t - eps) & (n[x] >= m[y] * t - eps)
        if long:
            good &= found[y, x] >= (have - spare)[x] - edits(x, y)
        x, y = x[good], y[good]
        # where half of the pieces are there, the second look would hardly help
        keep = (2 * found[y, x] >= (have - spare)[x]) & (found[y, x] <= (have - spare)[x]) if long else np.ones(len(x), bool)
        for j in np.unique(y[~keep]):
            h = hashes(codes[begin[j] : begin[j] + m[j]], short)
            h = np.sort(key(word(h), np.arange(len(h))))
            pairs = np.arange(*np.searchsorted(y, (j, j + 1)))
            pairs = pairs[~keep[pairs]]
            for r in runs(n[x[pairs]], STEP_LETTERS):
                i = x[pairs[r]]
                E, d, c = edits(i, j), m[j] - n[i], n[i] // short
                p = np.arange(c.sum()) + np.repeat(again_from[i] - (np.cumsum(c) - c), c)
                low, high = (key(again[p], again_at[p] + np.repeat(v, c)) for v in (-((E - d) // 2), (E + d) // 2))
                there = np.searchsorted(h, high, "right") > np.searchsorted(h, low)
                keep[pairs[r]] = np.add.reduceat(there, np.cumsum(c) - c, dtype="int64") >= c - E
        yield x[keep], part[y[keep]]


def distances(xs: list[str], y: str) -> np.ndarray:
    """Edit distances of all ``xs`` to y by bit vectors: a bit a letter of each x, one letter of y after the other.

    A column of the table of distances is kept as its steps of +1 and -1 from one letter of x to the next, all x behind one another in
    one number with a bit between them that takes up the carry.
    """
    codes, start, n = letters([x + " " for x in xs])
    codes = codes.copy()
    codes[start + n - 1] = BETWEEN
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    steps = lambda v: np.add.reduceat(np.unpackbits(np.frombuffer(v.to_bytes(len(codes) // 8 + 1, "little"), "uint8"), bitorder="little")[: len(codes)], start, dtype="int64")
    every, firsts = number(codes != BETWEEN), number(np.bincount(start, minlength=len(codes)).astype(bool))
    places = {c: number(codes == ord(c)) for c in set(y)}
    up, down = every, 0
    for c in y:
        here = places[c]
        same = ((((here & up) + up) ^ up) | here) & every
        right = ((down | (every ^ (same | up))) << 1) | firsts
        here |= down
        up, down = (((up & same) << 1) | (every ^ ((here | right) & every))) & every, right & here & every
    return len(y) + steps(up) - steps(down)


def candidates(xs: list[str], ys: list[str], t: float, eps: float = 1e-9):
    """(y, some x) of all pairs of ``close_pairs``, with about ``ROW_LETTERS`` of x at once."""
    for i, j in close_pairs(xs, ys, t, eps) if xs and ys else ():
        for at in np.split(np.arange(len(j)), np.flatnonzero(np.diff(j)) + 1) if len(j) else ():
            for r in runs([len(xs[k]) for k in i[at]], ROW_LETTERS):
                yield ys[j[at[0]]], [xs[k] for k in i[at][r]]


def near(y: str, xs: list[str], t: float, eps: float = 1e-9) -> list[tuple[str, str, int]]:
    """(x, y, edits) of those ``xs`` that have an identity of ``t`` or more to y."""
    return [(x, y, d) for x, d in zip(xs, distances(xs, y).tolist()) if d <= (1 - t) * max(len(x), len(y)) + eps]
