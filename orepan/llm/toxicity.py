"""Toxicity by a subword-bag classifier.

A text is the bag of its words' character n-grams (3 to 6 characters of ``<word>``) and whole words,
each hashed to a bucket with an embedding.  The embeddings' mean goes into a linear softmax over two
classes; embeddings and softmax weights are trained together in numpy.  A misspelling that was never
seen shares most n-grams with words that were, so it shares their vectors.

Training takes a bounded sample of the labelled rows (``sample_docs`` rows in a hash order, whole texts,
at most ``sample_chars`` characters, no text above a twentieth of that); scoring takes every whole text.  Since the softmax is linear,
a word's share of the score is one number, which each Python worker keeps per word.

Null and blank texts have the score of an empty bag: the toxic share of the sample.  Labels that are null, and
labelled rows without a document, are left out; if a document has several labels each counts.  With
no usable labels, or one class only, every text has that class's share as score (0 if none).  Repeated rows
are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_arrow

#: Words kept by one Python worker.
CACHED_WORDS = 300_000

#: Characters cut from both ends of a word.
EDGE = ".,;:!?\"'()[]{}*#$%&-_"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def subwords(words: list[str], buckets: int, shortest: int = 3, longest: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of ``words``, and how many each word has (one at least)."""
    marked = [f"<{w.strip(EDGE)}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters to the word's end
    found, owners = [], []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, min(longest, len(codes)) + 1):
        # hash of the n characters from each place on
        rolled[: len(codes) - n + 1] = rolled[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n >= shortest:
            at = np.flatnonzero(left >= n)
            h = (rolled[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((h >> np.uint64(40)) % np.uint64(buckets))
            owners.append(owner[at])
    # the whole word: a hash over its characters and places
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    mixed = (codes + np.uint64(1)) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), np.cumsum(size) - size) if len(marked) else np.empty(0, np.uint64)
    found.append((whole * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets))
    owners.append(np.arange(len(marked)))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(found)[order].astype(np.int32), np.bincount(np.concatenate(owners), minlength=len(marked))




class Model:
    """What scoring needs: each bucket's share of the difference of both logits, and the bias."""

    def __init__(self, share: np.ndarray, bias: float, cached_words: int = CACHED_WORDS):
        self.share, self.bias, self.known, self.cached_words = share, bias, None, cached_words

    def __getstate__(self):
        return {**self.__dict__, "known": None}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.known is None:
            self.known = {}
        known, split, seen = self.known, [words_of(t) for t in texts], set()
        for words in split:
            seen.update(words)
        new = [w for w in seen if w not in known]
        if len(known) + len(new) > self.cached_words:
            known.clear()
            new = list(seen)
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            subs, n = subwords(part, len(self.share))
            total = np.add.reduceat(self.share[subs].astype(np.float64), np.cumsum(n) - n)
            pairs = np.stack([total, n.astype(np.float64)], axis=1).astype("<f4")
            raw = pairs.tobytes()
            known.update((w, raw[8 * i : 8 * i + 8]) for i, w in enumerate(part))
        out = np.empty(len(texts))
        for i, words in enumerate(split):
            pairs = np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<f4").reshape(-1, 2)
            total, n = pairs.sum(axis=0, dtype=np.float64) if len(pairs) else (0.0, 1.0)
            out[i] = total / n + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[str], labels: list[int], *, buckets: int = 1 << 18, dim: int = 8, epochs: int = 10, least_steps: int = 400, batch: int = 128, rate: float = 8.0, toxic_weight: float = 2.0, seed: int = 0) -> Model:
    """Train embeddings and softmax weights together on mini batches, with steps that shrink per embedding."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(buckets, np.float32), 30.0 if len(y) and y[0] else -30.0)
    ids: dict[str, int] = {}
    docs = []
    for t in texts:
        w = [ids.setdefault(x, len(ids)) for x in words_of(t)]
        words, counts = np.unique(np.array(w, dtype=np.int32), return_counts=True)
        docs.append((words, counts.astype(np.float32)))
    names = list(ids)
    pieces = [subwords(names[i : i + 20_000], buckets) for i in range(0, len(names), 20_000)]
    subs, n_subs = np.concatenate([x[0] for x in pieces] or [np.empty(0, np.int32)]), np.concatenate([x[1] for x in pieces] or [np.empty(0, np.int64)])
    del names, pieces
    starts = np.cumsum(n_subs) - n_subs
    del ids
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((buckets, dim)) * 0.05).astype(np.float32)
    soft = (rng.standard_normal((dim, 2)) * 0.5).astype(np.float32)
    # the bias stays at the classes' shares, which is then the score of an empty bag
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    seen_emb, seen_soft = np.zeros(buckets, np.float32), np.zeros_like(soft)
    usual, weight = 1e-12, np.array([1.0, toxic_weight])
    epochs = max(epochs, -(-least_steps * batch // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        lr = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            chosen = [d for d in order[lo : lo + batch] if len(docs[d][0])]
            if not chosen:
                continue
            words = np.concatenate([docs[d][0] for d in chosen])
            counts = np.concatenate([docs[d][1] for d in chosen])
            doc = np.repeat(np.arange(len(chosen)), [len(docs[d][0]) for d in chosen])
            used, local = np.unique(words, return_inverse=True)
            # flat list of the used words' subwords
            n = n_subs[used]
            at = np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            s = subs[at]
            # the logits' difference is linear in the embeddings, so each bucket counts with one number
            slope = soft[:, 1] - soft[:, 0]
            per_word = np.add.reduceat((emb @ slope)[s], np.cumsum(n) - n)
            length = np.bincount(doc, counts * n[local], len(chosen))
            z = np.bincount(doc, counts * per_word[local], len(chosen)) / length + bias[1] - bias[0]
            g = weight[y[chosen]] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
            back = np.bincount(local, counts * (g / length)[doc], len(used))
            per_sub = np.bincount(s, np.repeat(back, n), buckets).astype(np.float32)
            pull = emb.T @ per_sub
            touched = np.flatnonzero(per_sub)
            own = per_sub[touched]
            seen_emb[touched] += own * own
            grad = np.stack([-pull, pull], axis=1)
            # each embedding's step is its share of the gradient over its own past size; what is seldom
            # seen is measured by the usual size, so that rare n-grams don't learn texts by heart
            usual += float(own @ own) / len(own)
            emb[touched] -= (lr * own / np.sqrt(seen_emb[touched] + usual))[:, None] * (slope / (np.linalg.norm(slope) + 1e-9))[None, :]
            seen_soft += grad * grad
            soft -= 0.2 * lr * grad / (np.sqrt(seen_soft) + 1e-9)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, *, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 6_000, sample_chars: int = 20_000_000) -> tuple[list[str], list[int]]:
    """At most ``sample_docs`` labelled texts in a hash order, whole, of ``sample_chars`` characters together, none above a twentieth."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and doc_id is not null").where(learn)
    chosen = chosen.withColumn("h", F.xxhash64("doc_id", F.lit("toxicity"))).orderBy("h", "doc_id", "y").limit(sample_docs)
    # the sample's size is bounded, so it is sent to the documents instead of the reverse
    found = d.join(F.broadcast(chosen), "doc_id").select("h", "doc_id", "y", "text")
    # a text that takes a large share of the sample alone is left out, as it would push out all after it
    found = found.where(F.length("text") * 20 <= sample_chars)
    sized = found.withColumn("sum", F.sum(F.length("text").cast("long")).over(W.orderBy("h", "doc_id", "y", F.length("text")).rowsBetween(W.unboundedPreceding, 0)))
    rows = sized.where(F.col("sum") <= sample_chars).orderBy("h", "doc_id", "y").select("text", "y").collect()
    return [r.text for r in rows], [int(bool(r.y)) for r in rows]


def _score(batches, model: Model):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo in range(0, len(texts), 1000):
            s = model.scores(texts[lo : lo + 1000])
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(s)), pa.array(s)], ["doc_id", "score"])


def score_texts(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: the probability of the toxic class."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(d, partial(_score, model=model), "doc_id long, score double")


def keep_below(docs: DataFrame, model: Model, at: float, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``at``; texts are scored where they are read, no join is made."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(names.index(text_col)).to_pylist()]
            ok = np.concatenate([model.scores(texts[lo : lo + 1000]) for lo in range(0, len(texts), 1000)] or [np.empty(0)]) < at
            yield batch.filter(pa.array(ok))

    return map_arrow(docs, run, schema)
