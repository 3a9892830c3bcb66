import collections
import functools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orepan.llm import packing, token_files
from orepan.llm.common import shared_dir
from orepan.llm.tokens import ChunkEncoder

from .conftest import words

BYTE, WORD = (token_files.vocabulary_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


tokenizer = functools.cache(Tokenizer.from_file)


def whole(path, text, end):
    return np.asarray(tokenizer(path).encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_librarys_ids(path):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "é", ".", ",", "..", "'s", "'", "1", "\xa0", "日", "<|endoftext|>", "x", "́", "\0", "Foo,", "bar.", " ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    e = ChunkEncoder(path, keep=500)
    for text, raw in zip(texts, e.encode_many(texts, span=2000)):
        assert raw == np.asarray(e.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_token_files_round_trip(spark, docs, corpus):
    got = token_files.token_round_trip(spark, docs, BYTE, 2).toPandas()
    assert len(got) == len(corpus)
    start = 0
    expected = sorted(((i is not None, i or 0, t or "") for i, t in corpus))
    for (has_id, i, text), r in zip(expected, got.sort_values("start").itertuples()):
        ids = whole(BYTE, text, 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert (r.doc_id == i) if has_id else np.isnan(r.doc_id)
        start += len(ids)


def test_one_document_is_read_by_its_index(spark, docs, corpus):
    dictionary = token_files.train_dictionary(docs, BYTE)
    manifest = token_files.write_token_files(docs, shared_dir(spark, "t"), BYTE, end_id=2, dictionary=dictionary).collect()
    found = []
    for m in manifest:
        f = token_files.TokenFile(m.path, dictionary)
        found += [f[i].tolist() for i in f.find(7)]
    assert found == [whole(BYTE, dict(corpus)[7], 2).tolist()]
    with pytest.raises(ValueError):
        token_files.TokenFile(manifest[0].path, dictionary + b"x")


def test_an_id_with_many_rows_lies_in_several_files(spark):
    rng, v = random.Random(6), [f"w{i}" for i in range(300)]
    rows = [(None, words(rng, 20, v)) for _ in range(600)] + [(7, words(rng, 20, v)) for _ in range(500)] + [(100 + i, words(rng, 20, v)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cuts = token_files.id_quantiles(df, 16)
    assert len(cuts) == 15 and 4 <= (cuts == token_files.NO_ID).sum() <= 8 and 3 <= (cuts == 7).sum() <= 7
    manifest = token_files.write_token_files(df, shared_dir(spark, "t"), BYTE, end_id=2, dictionary=b"", file_bytes=9000)
    files = manifest.orderBy("file_no").collect()
    assert len(files) > 8 and max(m.docs for m in files) < 400
    got = token_files.read_token_files(manifest, b"").orderBy("start").collect()
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    assert collections.Counter(bytes(r.ids) for r in got) == collections.Counter(whole(BYTE, t, 2).tobytes() for _, t in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_no_documents_give_no_tokens(spark, none):
    assert token_files.token_round_trip(spark, none, BYTE, 2).count() == 0
    assert packing.pack(none, WORD, end_id=1).count() == 0


def squares(p, moved=None, length=0):
    """Sum of squared counts over the levels below the last, after a window of fill ``moved`` grew by ``length``."""
    count = collections.Counter(-(-w[0] // p.grain) for stack in p.begun for w in stack)
    if moved is not None:
        count[-(-moved // p.grain)] -= bool(moved)
        if moved + length <= p.size - p.grain:
            count[-(-(moved + length) // p.grain)] += 1
    return sum(c * c for h, c in count.items() if h < p.levels)


@pytest.mark.parametrize("grain", [1, 4])
def test_sum_of_squares_takes_the_best_level(grain):
    rng, p = random.Random(0), packing.SumOfSquares(32, grain)
    for i in range(800):
        length = rng.randint(1, 31)
        while p.begun[-1]:
            list(p.place(i, 1))
        options = {0: squares(p, 0, length)} | {h: squares(p, stack[-1][0], length) for h, stack in enumerate(p.begun) if stack and stack[-1][0] + length <= 32}
        h = p.level_for(length)
        assert options[h] == min(options.values()) and h == max(k for k, v in options.items() if v == options[h])
        list(p.place(i, length))


def test_few_windows_are_left_to_cutting():
    rng, p, given = random.Random(4), packing.SumOfSquares(2048), 0
    for i in range(6000):
        for pieces in p.place(i, rng.choice([rng.randint(1, 300), rng.randint(1, 5000)])):
            assert sum(x[2] for x in pieces) == 2048
            given += 1
    assert sum(1 for _ in p.close()) < 0.02 * given


def test_packing_keeps_every_id_once_and_pads_nothing(docs, corpus):
    got = packing.pack(docs, WORD, end_id=1, size=64, with_ids=True).toPandas()
    totals = got.groupby("sequence_id").length.sum()
    assert totals.max() <= 64 and all(n == 64 or n & (n - 1) == 0 for n in totals)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
    by_id = {}
    for i, t in corpus:
        by_id.setdefault(-1 if i is None else i, []).append(whole(WORD, t, 1))
    for i, pieces in got.fillna({"doc_id": -1}).groupby("doc_id"):
        expected = by_id[i]
        assert pieces.length.sum() == sum(map(len, expected))
        if len(expected) == 1:
            assert b"".join(pieces.sort_values("start").ids) == expected[0].tobytes()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(p.ids) and p.ids == expected[0][p.start : p.start + p.length].tobytes() and p.doc_tokens == len(expected[0])
    assert set(by_id) == set(got.fillna({"doc_id": -1}).doc_id)
