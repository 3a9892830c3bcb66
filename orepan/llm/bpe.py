"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder as a state machine.

Encoding runs in two stages that each keep a bounded state, whatever the length of a text:

* ``Pieces`` cuts the characters as the vocabulary's own splitter does (contractions, runs of letters, of
  numbers and of other signs with the space before them, white space).  A cut is made once the characters
  that could move it are there; of a run longer than ``LONG`` characters only its class is kept.
* ``Merger`` takes a piece's bytes.  A merge list has a *sufficient lookahead*: ids that end that many bytes
  before the end of what was read are the same whatever follows, and are given out; the bytes after them stay.

The lookahead follows from the merge list alone.  What follows an end can change the ids before it by a merge
over that end only, which moves the border of the change left by the merge's left part.  The next such merge
needs a higher rank and a right part that begins with that left part, so the longest chain of such merges
bounds how far a change reaches (``lookahead``).  This needs a list in which no merge comes before those that
make its parts; any other list is refused.

Decoding keeps the bytes of one unfinished character (``Text``); wrong bytes become U+FFFD as the library does.

Special tokens in a text are found as the library finds them.  Chunks between spaces are kept with their ids
per Python worker, in bounded number.  Null texts count as empty and have no ids; null or repeated document ids
are rows like others; further columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from itertools import compress, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Characters read at once, characters after which a run is streamed, chunks kept and the longest kept one.
SPAN, LONG = 1 << 18, 4096
CACHED_CHUNKS, LONGEST_CHUNK = 1_000_000, 48

#: Below this character (Latin letters) Python's letters are those of any edition of Unicode.
PLAIN = "\u0250"
#: Pieces over a text's classes: letters L (those of contractions stand for themselves), numbers N, other
#: signs O and the apostrophe, spaces, other white space S.
_LETTER = "Lstrevmld"
_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?N+| ?[O']+|[ S]+(?![^ S])|[ S]+")
_RUNS = {"L": re.compile(f"[{_LETTER}]*"), "N": re.compile("N*"), "O": re.compile("[O']*"), " ": re.compile("[ S]*")}
#: A space that may lie inside a piece, and a space that surely begins one.
_INSIDE = re.compile(r"\s (?=\s|\Z)")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Merges:
    """The merge list of a vocabulary file: ranks of pairs, what each rank makes, and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not model.get("ignore_merges") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError(f"{path}: not a byte-level BPE without normalizer or prefix")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take more than their own text")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary, byte = model["vocab"], byte_names()
        self.byte_ids = [vocabulary[name] for name in byte]
        back = {name: b for b, name in enumerate(byte)}
        self.bytes = [b""] * (1 + max(list(vocabulary.values()) + list(self.special.values())))
        for name, i in vocabulary.items():
            self.bytes[i] = bytes(back[c] for c in name)
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rules = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.rank = {(a, b): rank for rank, (a, b, _) in reversed(list(enumerate(self.rules)))}
        self.made = [c for _, _, c in self.rules]
        self.lookahead = lookahead(self.rules, [len(b) for b in self.bytes])


def byte_names() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # fixed values of the format
    other = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(other)) for b in range(256)]


def lookahead(rules: list[tuple[int, int, int]], size: list[int]) -> int:
    """Bytes after an id that settle it: the longest way left that a chain of merges can take."""
    made = {c: rank for rank, (_, _, c) in enumerate(rules)}  # the last merge that makes an id
    for rank, (a, b, _) in enumerate(rules):
        if max(made.get(a, -1), made.get(b, -1)) >= rank:
            raise ValueError(f"merge {rank} comes before a merge that makes its parts")
    heads: dict[int, set[int]] = {}  # what the bytes of an id can begin with on the way to it
    for a, _, c in rules:
        heads[c] = heads.get(c, {c}) | heads.get(a, {a})
    reach: dict[int, int] = {}  # by left part: the longest chain among the merges of higher rank
    most = 1
    for a, b, _ in reversed(rules):
        far = size[a] + reach.get(a, 0)
        most = max(most, far)
        for h in heads.get(b, {b}):
            if far > reach.get(h, 0):
                reach[h] = far
    return most


class Merger:
    """Bytes of one piece in, ids out once they are settled."""

    def __init__(self, merges: Merges, window: int = 0):
        self.m, self.rest = merges, b""
        self.window = window or 4 * merges.lookahead + 1024

    def feed(self, data: bytes) -> list[int]:
        out = []
        for at in range(0, len(data), self.window):
            self.rest += data[at : at + self.window]
            if len(self.rest) >= self.window:
                ids, settled, end, n = self.merged(self.rest), len(self.rest) - self.m.lookahead, 0, 0
                for n, i in enumerate(ids):
                    if end + len(self.m.bytes[i]) > settled:
                        break
                    end += len(self.m.bytes[i])
                out += ids[:n]
                self.rest = self.rest[end:]
        return out

    def close(self) -> list[int]:
        rest, self.rest = self.rest, b""
        return self.merged(rest)

    def merged(self, data: bytes) -> list[int]:
        ids = [self.m.byte_ids[b] for b in data]
        return self._few(ids) if len(ids) <= 48 else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        rank, made, none = self.m.rank.get, self.m.made, len(self.m.made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)  # the leftmost place
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place) and links between the places that are left."""
        rank, made, n = self.m.rank.get, self.m.made, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made[best], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


class _Classes(dict):
    """Code point -> class, as the vocabulary's splitter treats the character between others."""

    def __init__(self, split):
        super().__init__({ord(c): c for c in " '" + _LETTER[1:]})
        self.split = split

    def __missing__(self, point: int) -> str:
        # pieces of a sign, a letter and a number, each followed by the character, show what it joins
        c = chr(point)
        cuts = {x for _, span in self.split(f"!{c}a{c}1{c}") for x in span}
        self[point] = next((name for name, at in (("O", 1), ("L", 3), ("N", 5)) if at not in cuts), "S")
        return self[point]


class Pieces:
    """Characters in, (bytes, ends here) of pieces out; a long run comes in several parts."""

    def __init__(self, classes: _Classes):
        self.classes, self.rest, self.run = classes, "", ""

    def feed(self, text: str, last: bool = False):
        text = self.rest + text
        kinds, at, n = text.translate(self.classes), 0, len(text)
        while at < n:
            if self.run:
                end = _RUNS[self.run].match(kinds, at).end()
                ends = end < n or last
                if self.run == " " and not (end == n and last):
                    end -= 1  # the last white space may belong to what follows
                yield text[at:end].encode(), ends
                at = end
                if not ends:
                    break
                self.run = ""
                continue
            end = _PIECE.match(kinds, at).end()
            if end + 2 <= n or last:
                yield text[at:end].encode(), True
                at = end
            elif end - at <= LONG:
                break
            else:  # the piece goes on in its run; its first character alone may be a space before it
                kind = kinds[at + 1]
                self.run = " " if kind in " S" else "O" if kind in "O'" else "N" if kind == "N" else "L"
                if self.run != " " and kinds[at] == " ":
                    yield text[at : at + 1].encode(), False
                    at += 1
        self.rest = text[at:]
        if last and self.run:  # the text ended where the run did
            self.run = ""
            yield b"", True


class _Chunks(dict):
    def __init__(self, encode, keep: int):
        super().__init__()
        self.encode, self.keep = encode, keep

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= LONGEST_CHUNK:
            if len(self) >= self.keep:  # chunks met first tend to be the frequent ones
                for old in list(islice(self, self.keep // 2, None)):
                    del self[old]
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers, one part of bounded size after the other."""

    def __init__(self, path: str, keep: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.classes = _Classes(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        names = sorted(self.merges.special, key=lambda s: (-len(s), s))
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.merger = Merger(self.merges)
        self.marks = {c: self._short(c) for c in ".,;:!?"}
        self.first = _Chunks(self._short, keep // 8)
        self.rest = _Chunks(self._word, keep)

    def stream(self, parts):
        """The transducer itself: ids of the concatenated ``parts`` (no special tokens in them)."""
        pieces, merger = Pieces(self.classes), Merger(self.merges)
        parts = iter(parts)
        part = next(parts, None)
        while part is not None:
            following = next(parts, None)
            ids = []
            for data, ends in pieces.feed(part, last=following is None):
                if ends and not merger.rest:
                    ids += merger.merged(data) if len(data) < merger.window else merger.feed(data) + merger.close()
                else:
                    ids += merger.feed(data)
                    if ends:
                        ids += merger.close()
            if ids:
                yield array("I", ids).tobytes()
            part = following

    def _short(self, text: str) -> bytes:
        return b"".join(self.stream([text]))

    def _word(self, chunk: str) -> bytes:
        """Ids of a chunk and the space before it; plain letters, with a mark at most, need no look at their classes."""
        if chunk.isalpha() and max(chunk) < PLAIN and len(chunk) <= LONGEST_CHUNK:
            return array("I", self.merger.merged(b" " + chunk.encode())).tobytes()
        if chunk[-1:] in self.marks and chunk[:-1].isalpha() and max(chunk) < PLAIN:
            return self.rest[chunk[:-1]] + self.marks[chunk[-1]]
        return self._short(" " + chunk)

    def encode(self, text: str):
        at = 0
        if self.special and any(s in text for s in self.merges.special):
            for m in self.special.finditer(text):
                yield from self._plain(text[at : m.start()])
                yield np.array([self.merges.special[m.group()]], dtype="<u4").tobytes()
                at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str):
        at = 0
        while at < len(text):
            end = self._cut(text, at, at + SPAN)
            span = text[at:end] if at or end < len(text) else text
            at = end
            if len(span) > 2 * SPAN:  # no cut in it: not one chunk but a stream
                yield from self.stream(span[i : i + SPAN] for i in range(0, len(span), SPAN))
                continue
            chunks = _CUT.split(span) if _INSIDE.search(span) else span.split(" ")
            found = [self.first[chunks[0]]] if chunks[0] else []
            ids = list(map(self.rest.get, islice(chunks, 1, None)))
            for i in compress(range(len(ids)), map(not_, ids)):
                ids[i] = self.rest[chunks[i + 1]]
            yield b"".join(found + ids)

    @staticmethod
    def _cut(text: str, at: int, end: int) -> int:
        """The last sure border before ``end``, or else the first one after it."""
        if end >= len(text):
            return len(text)
        low = end
        for _ in range(100):
            low = text.rfind(" ", at + 1, low)
            if low < 0:
                break
            if _CUT.match(text, low):
                return low
        m = _CUT.search(text, end)
        return m.start() if m else len(text)


class Text:
    """Bytes to text: the state is the bytes of a character that is not whole yet."""

    def __init__(self):
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        end = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a first byte: what follows belongs to it as long as it may
                if back < _needs(b) and data[-back:].decode("utf-8", "replace") == "�":
                    end -= back
                break
            if b < 0x80:
                break
        self.open = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def _needs(first: int) -> int:
    """Bytes of the character that ``first`` begins; 1 for a byte that begins none."""
    return 1 if first < 0xC2 or first > 0xF4 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


_READY: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker: made once, used by all its tasks."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


def _column_by_column(df: DataFrame, col: str, name: str, kind: str, run) -> DataFrame:
    """``df`` with a further column ``name``, made of ``col`` by ``run(list) -> Arrow array``."""
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    at = df.columns.index(col)

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, run(batch.column(at).to_pylist())], [*batch.schema.names, name])

    return map_arrow(df, task, df.withColumn(name, F.lit(None).cast(kind)).schema)


def encoded(docs: DataFrame, vocabulary: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text (``array<int>``; null texts: empty)."""

    def run(texts):
        e = encoder(vocabulary)
        raw = [b"".join(e.encode(t or "")) for t in texts]
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype="<i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))

    return _column_by_column(docs, text_col, ids_col, "array<int>", run)


def decoded(df: DataFrame, vocabulary: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids (null: null; ids that the vocabulary lacks stand for nothing)."""

    def run(rows):
        return pa.array([None if r is None else "".join(texts(encoder(vocabulary).merges, [r])) for r in rows], pa.string())

    return _column_by_column(df, ids_col, text_col, "string", run)


def texts(merges: Merges, parts):
    """Text parts of parts of ids."""
    state, known = Text(), merges.bytes
    for ids in parts:
        yield state.feed(b"".join([known[i] for i in ids if i is not None and 0 <= i < len(known)]))
    yield state.close()


def round_trip_digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: encodes each whole text, decodes its ids, part by part.

    A part is decoded and hashed before the next one is encoded, so a task holds one part beside its batch.
    """

    def task(batches):
        e = encoder(vocabulary)
        named = [str(i) for i in range(len(e.merges.bytes))]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                n, of_ids, of_text, state = 0, hashlib.sha256(), hashlib.sha256(), Text()
                for raw in e.encode(text.as_py() or ""):
                    ids = np.frombuffer(raw, dtype="<u4").tolist()
                    of_ids.update(("," * (n > 0 and bool(ids)) + ",".join([named[i] for i in ids])).encode())
                    n += len(ids)
                    of_text.update(state.feed(b"".join([e.merges.bytes[i] for i in ids])).encode())
                of_text.update(state.close().encode())
                counts.append(n)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), task, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
