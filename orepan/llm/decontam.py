"""Benchmark decontamination: BM25 over test items, searched by every training passage.

The index holds the test items.  A posting's impact is its BM25 weight over the item's own full score,
so a passage's score for an item is the share of the item's weight that it covers (0 to 1).  Postings
ascend by item in blocks with their largest impact; block-max WAND skips items, and whole blocks, that
cannot reach the threshold, so exactly the items at or above it are retrieved.  What is retrieved is
verified: the word pairs of the item's question and of its answer must stand in the passage.

Items are told apart by length: class c holds those of up to 2^c words (32 at least) and is searched by
passages of 2^(c+1) words that advance by 2^c, so every stretch as long as an item lies in one passage, and
a long item does not widen the passages of short ones.  Passages whose terms' largest impacts cannot sum up
to the threshold in any range of items are not searched at all: the same bound, over ranges of the index.

Distinct items are dealt into pieces of at most about ``piece_bytes`` of text.  A piece is indexed by one task,
which writes it to the shared folder; document frequencies and lengths are taken over all items.  The texts
are read and split once: each task loads one piece after the other (a few stay loaded) for a span of texts.

The answer is what follows a line that starts with "A:" or "Answer:", else the last third of the words.
Items without words and null texts match nothing.  An item whose id is null is searched like any other, and
found with a null id.  Items that repeat an id with another text are items of their own; rows that repeat both
count once.  Repeated documents give repeated results; a document's null id stays null.  An empty table on
either side gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from bisect import bisect_left
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, open_fs, shared_dir, written

_MARKS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_ANSWER = re.compile(r"^\s*(?:A|Answer)\s*:", re.M | re.I)


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII marks are white space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()


def pairs_of(words: list[bytes]) -> set:
    return set(zip(words, words[1:])) if len(words) > 1 else {(w,) for w in words}


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    found = _ANSWER.search(text)
    if found:
        return words_of(text[: found.start()]), words_of(text[found.end() :])
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


class ItemIndex:
    """Inverted index of test items for block-max WAND; ``items``: (id, text), ``df``: term -> items."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_length: float, *, k1: float = 1.2, b: float = 0.75, block: int = 64):
        self.ids, self.block, self.vocabulary = [], block, {}
        self.question, self.answer = [], []
        postings: list[list[tuple[int, float]]] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            q, a = question_and_answer(text)
            self.question.append(pairs_of(q))
            self.answer.append(pairs_of(a))
            counts: dict[bytes, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            norm = k1 * (1 - b + b * len(words) / mean_length)
            weights = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (k1 + 1) / (c + norm) for w, c in counts.items()}
            full = sum(weights.values())
            for w, x in weights.items():
                t = self.vocabulary.setdefault(w, len(self.vocabulary))
                if t == len(postings):
                    postings.append([])
                postings[t].append((number, x / full))
        self.items = [[p[0] for p in x] for x in postings]
        self.impacts = [[p[1] for p in x] for x in postings]
        self.block_max = [[max(x[i : i + block]) for i in range(0, len(x), block)] for x in self.impacts]
        self.most = np.array([max(x) for x in self.impacts])
        self.upper = self.most.tolist()
        # largest impact of each term in equal ranges of items: at most 32 wide ones and 256 narrow ones
        self.range_max, self.narrow_max = (self._ranges(postings, n) for n in (32, 256))
        # Terms of little weight: all of them in one item weigh `light` at most, so a passage whose other
        # terms stay below the threshold less that cannot reach it.
        self.light, self.heavy = 0.0, dict(self.vocabulary)
        for cut in (0.1, 0.07, 0.05, 0.03, 0.02, 0.01, 0.005):
            mass = np.zeros(max(1, len(self.ids)))
            for t, x in enumerate(postings):
                if self.upper[t] < cut:
                    for item, impact in x:
                        mass[item] += impact
            if mass.max() <= 0.2:
                self.light = float(mass.max())
                self.heavy = {w: t for w, t in self.vocabulary.items() if self.upper[t] >= cut}
                break

    def _ranges(self, postings, most: int) -> np.ndarray:
        size = max(1, -(-len(self.ids) // most))
        out = np.zeros((len(postings), -(-len(self.ids) // size)), dtype=np.float32)
        for t, x in enumerate(postings):
            for item, impact in x:
                out[t, item // size] = max(out[t, item // size], impact * (1 + 1e-6))
        return out

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item number, score) with a score of at least ``threshold`` for the distinct ``terms``."""
        # the same small allowance for rounding in every bound, none in the final test
        bound, items, upper, found = threshold - 1e-9, self.items, self.upper, []
        at = [[items[t][0], t, 0] for t in terms]  # current item, term, place
        while True:
            at.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(at):
                total += upper[c[1]]
                if total >= bound:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            # the largest impacts of the blocks in which the pivot would lie
            blocks, ends = 0.0, []
            for _, t, i in at[: pivot + 1]:
                own = items[t]
                i = bisect_left(own, item, i)
                if i < len(own):
                    k = i // self.block
                    blocks += self.block_max[t][k]
                    ends.append(own[min((k + 1) * self.block, len(own)) - 1] + 1)
            following = item + 1
            if blocks < bound:
                # nor can any item up to the nearest block's end, unless another list begins before it
                following = min([*ends, *(c[0] for c in at[pivot + 1 : pivot + 2])], default=following)
                following = max(following, item + 1)
            elif at[0][0] == item:
                score = sum(self.impacts[t][i] for _, t, i in at[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
            else:
                following = item
            done = False
            for c in at[: pivot + 1]:
                if c[0] < following:
                    own = items[c[1]]
                    c[2] = bisect_left(own, following, c[2])
                    c[0] = own[c[2]] if c[2] < len(own) else -1
                    done |= c[0] < 0
            if done:
                at = [c for c in at if c[0] >= 0]


OUT = "doc_id long, item_id long, passages int, score double, question_overlap double, answer_overlap double"
TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())


def length_class(n_words: int, least: int = 32) -> int:
    """The words that a passage advances by for items of ``n_words``."""
    return max(least, 1 << (n_words - 1).bit_length())


class Piece:
    """Items of all length classes with one vocabulary: an ``ItemIndex`` per class."""

    def __init__(self, items: list[tuple], df: dict[bytes, int], n_items: int, mean_length: float):
        by_class: dict[int, list] = {}
        for item_id, text in items:
            by_class.setdefault(length_class(len(words_of(text))), []).append((item_id, text))
        self.indexes = {c: ItemIndex(x, df, n_items, mean_length) for c, x in sorted(by_class.items())}
        self.words: dict[bytes, int] = {}
        for index in self.indexes.values():
            for w in index.vocabulary:
                self.words.setdefault(w, len(self.words))
        # a word's number in each index, among all terms and among the heavy ones; the last place is for unknown words
        self.local = {}
        for c, index in self.indexes.items():
            both = np.full((2, len(self.words) + 1), -1)
            for k, terms in enumerate((index.vocabulary, index.heavy)):
                both[k, [self.words[w] for w in terms]] = list(terms.values())
            self.local[c] = both

    def search(self, words: list[bytes], numbers: np.ndarray, threshold: float, question_at: float, answer_at: float) -> list[tuple]:
        """Verified items of one text: (item id, passages, best score, and its two overlaps)."""
        out = []
        for stride, index in self.indexes.items():
            terms, heavy = self.local[stride]
            out += _search_class(words, terms[numbers], heavy[numbers], index, stride, threshold, question_at, answer_at)
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))


def _search_class(words, terms, heavy, index: ItemIndex, stride: int, threshold: float, question_at: float, answer_at: float) -> list[tuple]:
    hit = np.flatnonzero(heavy >= 0)
    if not len(hit):
        return []
    # each distinct term of each stride once, its largest impact per range of items summed up
    n = len(index.vocabulary)
    once = np.unique(hit // stride * n + heavy[hit])
    stretch, once = once // n, once % n
    first = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
    bins = np.zeros((-(-len(words) // stride) + 1, index.range_max.shape[1]), dtype=np.float32)
    bins[stretch[first]] = np.add.reduceat(index.range_max[once], first, axis=0)
    reach = (bins[:-1] + bins[1:]).max(axis=1)
    best: dict[int, list] = {}
    for w in np.flatnonzero(reach >= threshold - index.light):
        lo, hi = int(w) * stride, (int(w) + 2) * stride
        inside = np.unique(terms[lo:hi])
        inside = inside[inside >= 0]
        if index.narrow_max[inside].sum(axis=0).max() < threshold:
            continue
        pairs = None
        for item, score in index.retrieve(inside.tolist(), threshold):
            pairs = pairs if pairs is not None else pairs_of(words[lo:hi]) | {(x,) for x in words[lo:hi]}
            q, a = index.question[item], index.answer[item]
            qo = len(q & pairs) / len(q) if q else 1.0
            ao = len(a & pairs) / len(a) if a else 1.0
            if qo >= question_at and ao >= answer_at:
                old = best.setdefault(item, [0, (-1.0, 0.0, 0.0)])
                old[0] += 1
                old[1] = max(old[1], (score, qo, ao))
    return [(index.ids[item], n, *found) for item, (n, found) in sorted(best.items())]


#: Pieces loaded in this Python worker, by their file; the oldest goes first.
_LOADED: dict[str, Piece] = {}
KEPT = 4


def _piece(uri: str) -> Piece:
    if uri not in _LOADED:
        while len(_LOADED) >= KEPT:
            _LOADED.pop(next(iter(_LOADED)))
        fs, path = open_fs(uri)
        with fs.open_input_stream(path) as f:
            _LOADED[uri] = pickle.loads(f.read())
    return _LOADED[uri]


def _search(batches, uris: list[str], span: int = 16 << 20, **how):
    held, size = [], 0

    def found():
        out = []
        for uri in uris:
            piece = _piece(uri)
            for doc_id, words in held:
                out += [(doc_id, *r) for r in piece.search(words, piece.numbers(words), **how)]
        held.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], [x.split()[0] for x in OUT.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            held.append((doc_id.as_py(), words_of(text)))
            size += len(text)
            # with all pieces loaded there is nothing to gain from a long span
            if size >= (span if len(uris) > KEPT else 1 << 16):
                yield from found()
                size = 0
    yield from found()


def _terms(batches):
    """A row of each item (no term), and of each of its distinct terms."""
    for batch in batches:
        out = []
        for piece, item, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = words_of(text)
            if words:
                out += [(piece, item, text, None, len(words))] + [(piece, None, None, w.decode("utf-8", "surrogatepass"), 1) for w in set(words)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["piece", "item_id", "text", "term", "n"])


def _build(batches, folder: str, n_items: int, mean_length: float):
    """Rows come sorted by piece, terms before items."""
    at, df, items = None, {}, []

    def close():
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        # a task that runs twice writes under its own name, and then moves the same bytes to the same place
        name, own = f"piece-{at:06d}", f".{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/{own}") as f:
            f.write(pickle.dumps(Piece(items, df, n_items, mean_length)))
        fs.move(f"{root}/{own}", f"{root}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(items)], pa.int64())], ["uri", "items"])

    for batch in batches:
        for piece, item, text, term, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if piece != at and at is not None:
                yield close()
                df, items = {}, []
            at = piece
            if term is None:
                items.append((item, text))
            else:
                df[term.encode("utf-8", "surrogatepass")] = n
    if at is not None:
        yield close()


def index_items(items: DataFrame, *, item_id_col: str = "item_id", item_text_col: str = "text", piece_bytes: int = 1 << 20) -> list[str]:
    """Index all distinct items into pieces below the shared folder; their files."""
    given = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pieces = max(1, -(-size // piece_bytes))
    dealt = given.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)).cast("int").alias("piece"), "item_id", "text")
    rows = written(map_arrow(dealt, _terms, "piece int, item_id long, text string, term string, n long"), "item-terms")
    facts = rows.where("term is null").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    if not facts.n:
        return []
    terms = rows.where("term is not null").groupBy("term", "piece").agg(F.sum("n").alias("n"))
    frequency = terms.groupBy("term").agg(F.sum("n").alias("df"))
    own = terms.join(frequency, "term").select("piece", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("string").alias("text"), "term", F.col("df").alias("n"))
    both = own.unionByName(rows.where("term is null")).repartitionById(pieces, F.col("piece")).sortWithinPartitions("piece", F.col("term").asc_nulls_last(), "item_id", "text")
    built = map_arrow(both, partial(_build, folder=shared_dir(items.sparkSession, "items"), n_items=facts.n, mean_length=facts.words / facts.n), "uri string, items long")
    # one name a piece
    return sorted(r.uri for r in built.collect())


def contaminated(
    docs: DataFrame, items: DataFrame, *, threshold: float = 0.6, question_at: float = 0.5, answer_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", piece_bytes: int = 1 << 20
) -> DataFrame:
    """One row per text and test item that it holds: ``doc_id, item_id, passages, score, question_overlap, answer_overlap``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    uris = index_items(items, item_id_col=item_id_col, item_text_col=item_text_col, piece_bytes=piece_bytes)
    return map_arrow(d, partial(_search, uris=uris, threshold=threshold, question_at=question_at, answer_at=answer_at), OUT)
