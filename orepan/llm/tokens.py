"""Exact, fast use of a ``tokenizers`` vocabulary on many texts.

Running ``Tokenizer.encode`` over whole texts spends nearly all its time on words it has
seen before.  Both vocabularies used here split a text into pieces before merging, and no
piece reaches across a space that has a non-space on either side.  So a text is cut at
those spaces, each distinct chunk is encoded once per Python worker, and the ids of the
chunks are joined as bytes.  Texts for which the cut is not provably exact are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import compress, islice
from operator import not_

import numpy as np

#: Chunks kept by one Python worker, and the longest chunk worth keeping (characters).
CACHED_CHUNKS = 1_500_000
LONGEST_CHUNK = 64

_READY: dict[str, "ChunkEncoder"] = {}


class _Chunks(dict):
    """chunk -> ids as little-endian unsigned 32-bit bytes; fills itself."""

    def __init__(self, encode, marks: dict[str, bytes], keep: int):
        super().__init__()
        self.encode, self.marks, self.keep = encode, marks, keep

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in self.marks and chunk[-2:-1].isalpha():
            # a mark after a letter is a piece of its own, so both parts can be kept apart
            ids = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            ids = np.asarray(self.encode(chunk), dtype="<u4").tobytes()
        if len(chunk) <= LONGEST_CHUNK:
            if len(self) >= self.keep:
                self.forget_later_half()
            self[chunk] = ids
        return ids

    def forget_later_half(self):
        """Chunks met first tend to be the frequent ones, so the younger half goes."""
        for chunk in list(islice(self, len(self) // 2, None)):
            del self[chunk]


#: White space other than the space and the line feed.
_ODD_SPACE = re.compile("[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class ChunkEncoder:
    """Encodes texts to little-endian uint32 bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, keep: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        # either the space belongs to the word after it, or the pre-tokenizer removes it
        self.space_kept = '"Removed"' not in json.dumps(spec.get("pre_tokenizer"))
        mark = self._ids("\0")
        self.mark = mark[0] if len(mark) == 1 else -1
        self.opens = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True  # byte-level name of the space
        marks = {c: np.asarray(self._ids(c), dtype="<u4").tobytes() for c in ".,"}
        self.first = _Chunks(self._ids, marks, keep // 8 if self.space_kept else keep)
        self.rest = _Chunks(lambda chunk: self._ids(" " + chunk), marks, keep) if self.space_kept else self.first

    def _ids(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> bool:
        """Whether a cut could move a piece boundary: a space inside a longer run of white space."""
        return self.space_kept and ("  " in text or "\n \n" in text or text[-2:] == "\n " or _ODD_SPACE.search(text) is not None)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or self._whole(text):
            return np.asarray(self._ids(text), dtype="<u4").tobytes()
        chunks = text.split(" ")
        if not self.space_kept:
            return b"".join(map(self.first.__getitem__, filter(None, chunks)))
        return self.first[chunks[0]] + b"".join(map(self.rest.__getitem__, chunks[1:]))

    def encode_many(self, texts: list[str], span: int = 4_000_000):
        """Encode texts in order, learning the new chunks of each ``span`` characters in one library call."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= span:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        known, marks = self.rest, self.rest.marks
        get = known.get
        cut, found, new = [], [], set()
        for text in texts:
            if self._whole(text) or any(s in text for s in self.special):
                cut.append(None)
                found.append(None)
                continue
            chunks = text.split(" ")
            ids = list(map(get, chunks))
            new.update(compress(chunks, map(not_, ids)))
            cut.append(chunks)
            found.append(ids)
        if len(known) + len(new) > known.keep:
            known.forget_later_half()
        new = {c[:-1] if c[-1:] in marks and c[-2:-1].isalpha() else c for c in new}
        new = [c for c in new if c and c not in known and len(c) <= LONGEST_CHUNK]
        for i in range(0, len(new), 200):
            self._learn(new[i : i + 200])
        out = []
        for text, chunks, ids in zip(texts, cut, found):
            if chunks is None:
                out.append(self.encode(text))
                continue
            for i in list(compress(range(len(ids)), map(not_, ids))):
                ids[i] = known[chunks[i]] if chunks[i] or self.space_kept else b""
            if self.space_kept:
                ids[0] = self.first[chunks[0]] if text else b""
            out.append(b"".join(ids))
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks in one text, with borders that can be told apart in the ids."""
        plain = [c for c in chunks if not (c[0].isspace() or c[-1].isspace() or "\0" in c)]
        text = " " + " ".join(plain) if self.space_kept else " \0 ".join(plain + [""])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        # the first id of a chunk holds the space before it; or the mark's own id follows each chunk
        at = np.flatnonzero(self.opens[ids] if self.space_kept else ids == self.mark)
        if len(at) != len(plain):
            return  # each is then encoded alone when it is asked for
        lo, hi = (at, np.append(at[1:], len(ids))) if self.space_kept else (np.append(0, at[:-1] + 1)[: len(at)], at)
        raw = ids.tobytes()
        self.rest.update((c, raw[x:y]) for c, x, y in zip(plain, (4 * lo).tolist(), (4 * hi).tolist()))


def encoder(path: str, keep: int = CACHED_CHUNKS) -> ChunkEncoder:
    """The encoder of this Python worker: loaded and filled once, used by all its tasks."""
    if path not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        _READY[path] = ChunkEncoder(path, keep)
    return _READY[path]
