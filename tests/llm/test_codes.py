import hashlib
import random

import numpy as np
import pytest

from orepan.llm import bpe, queries, token_files, vector_codes

from .conftest import make_docs

BYTE = token_files.vocabulary_path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "Bc", "é", ".", "..", "'s", "'", "'re", "'l", "1", "\xa0", "日", "<|endoftext|>", "́", "\0", "Foo,", "re", " the", "\x1c", "՘", "\U00010940", "ing"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    return lambda text: t.encode(text, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(BYTE, keep=200)


def ids_of(parts):
    return np.frombuffer(b"".join(parts), dtype="<u4").tolist()


def test_ids_are_the_librarys(library, encoder):
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        assert ids_of(encoder.encode(text)) == library[0](text), repr(text)


def test_a_stream_cut_anywhere_gives_the_same_ids(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 8)  # runs that are streamed
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(PARTS) * rng.choice([1, 1, rng.randint(1, 60)]) for _ in range(rng.randint(0, 20))).replace("<|endoftext|>", "")
        k = rng.randint(1, 20)
        assert ids_of(encoder.stream(text[i : i + k] for i in range(0, len(text), k))) == library[0](text), (text, k)


@pytest.mark.parametrize("alphabet", ["ab", "etaoin", " \n\t", "=-*_", "0123"])
def test_what_a_window_settles_stays(encoder, alphabet):
    rng = random.Random(7)
    for _ in range(60):
        data = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3000))).encode()
        m, got, at = bpe.Merger(encoder.merges, window=encoder.merges.lookahead + rng.randint(1, 40)), [], 0
        while at < len(data):
            k = rng.randint(1, 90)
            got += m.feed(data[at : at + k])
            assert len(m.rest) < m.window + max(map(len, encoder.merges.bytes))
            at += k
        assert got + m.close() == m.merged(data)


def test_lookahead_is_that_of_the_longest_chain():
    # ab; then b? bc cannot begin with a or ab: one step of one byte
    assert bpe.lookahead([(0, 1, 3)], [1, 1, 1, 2]) == 1
    # what follows may take the b of ab, and then x is joined with a or with ab: two steps
    assert bpe.lookahead([(0, 1, 3), (2, 0, 4)], [1, 1, 1, 2, 2]) == 2
    with pytest.raises(ValueError):
        bpe.lookahead([(3, 2, 4), (0, 1, 3)], [1, 1, 1, 2, 3])


def test_wrong_bytes_decode_as_in_the_library(library, encoder):
    rng = random.Random(8)
    for _ in range(3000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert "".join(bpe.texts(encoder.merges, [[i] for i in ids])) == library[1](ids)


def test_a_run_of_a_million_letters(library, encoder):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    assert ids_of(encoder.encode(text)) == library[0](text)
    assert ids_of(encoder.encode(" " * 700_000 + "x")) == library[0](" " * 700_000 + "x")


def test_round_trip_digests(spark, docs, corpus, none, library):
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, BYTE).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows == {(i, len(ids := library[0](t or "")), sha(",".join(map(str, ids))), sha(t or "")) for i, t in corpus}
    assert bpe.round_trip_digests(docs, BYTE).count() == len(corpus)
    assert bpe.round_trip_digests(none, BYTE).count() == 0


def test_encoded_and_decoded_columns(spark, docs, corpus, library):
    got = bpe.decoded(bpe.encoded(docs, BYTE), BYTE)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    for r in got.collect():
        assert r.ids == library[0](r.text or "") and r.decoded == (r.text or "")
    with pytest.raises(ValueError):
        bpe.encoded(docs.withColumn("ids", docs.text), BYTE)
    lone = spark.createDataFrame([([0xFFFFFFF, 15, None, -1],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decoded(lone, BYTE).collect()] == [library[1]([15]), None]


def test_op12_reads_whole_texts(spark, tmp_path):
    make_docs(spark, [(1, "a b " * 300_000), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_bpe(spark, str(tmp_path)).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(b"a b " * 300_000).hexdigest() and got[2].n_tokens == 0


def brute_force(rows, parts, entries, rounds, scale):
    """(id, code, error), codebooks: every part against every entry, in Python's whole numbers."""
    kept = [(i, lab, [int(np.floor(scale * np.float64(x))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    w = len(kept[0][2]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for _, _, x in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(y, e)), j) for j, e in enumerate(book)) for y, book in zip(c, books)] for c in cut]

    for _ in range(rounds):
        found = assign()
        books = [
            [[sum(v) // len(own) for v in zip(*own)] if (own := [c[p] for c, f in zip(cut, found) if f[p][1] == j]) else e for j, e in enumerate(book)]
            for p, book in enumerate(books)
        ]
    return {(i, lab, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for (i, lab, _), f in zip(kept, assign())}, books


def vectors(spark, rows):
    return spark.createDataFrame([(i, lab, v, "x", 1.0) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, code string, error double").repartition(3)


@pytest.mark.parametrize("spread", [0.02, 1.0, 40.0])
def test_codes_equal_brute_force(spark, spread):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2]), [rng.gauss(0, spread) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, 1, rows[4][2]) for i in range(80)]  # a hot group of copies
    rows += [(500, 1, None), (501, 1, [float("nan")] * 12), (502, 1, [float("inf")] * 12), (503, 2, [None] * 12), (None, 2, rows[7][2])]
    codes, books = vector_codes.compress(vectors(spark, rows), parts=3, entries=16, rounds=2)
    got = codes.collect()
    expected, their = brute_force(rows, 3, 16, 2, 256.0)
    assert books.books == their and len(got) == 381
    assert {(r.vec_id, r.label, r.code, r.error) for r in got} == expected
    for label in (None, 1, 2):
        assert {r.label_error for r in got if r.label == label} == {sum(r.error for r in got if r.label == label)}
    assert books.sha256() == hashlib.sha256(",".join(str(x) for b in their for e in b for x in e).encode()).hexdigest()


def test_large_components_count_in_full(spark):
    rows = [(i, 0, [float(10 ** (i % 9)) * (-1) ** i, float(i)]) for i in range(30)] + [(40, 0, [1e308, -1e308])]
    codes, _ = vector_codes.compress(vectors(spark, rows[:30]), parts=2, entries=4, rounds=2)
    expected = {(i, lab, code, min(error, vector_codes.LONG)) for i, lab, code, error in brute_force(rows[:30], 2, 4, 2, 256.0)[0]}
    assert {(r.vec_id, r.label, r.code, r.error) for r in codes.collect()} == expected
    codes, _ = vector_codes.compress(vectors(spark, rows), parts=2, entries=4, rounds=2)
    assert codes.count() == 31 and codes.where("vec_id = 40").first().error == 0  # an entry of its own, at the nearest longs


def test_only_entries_that_can_be_nearest_are_kept():
    rng = np.random.default_rng(0)
    book = rng.integers(-200, 200, (64, 4))
    grid = vector_codes.Grid(book)
    parts = rng.integers(-300, 300, (5000, 4))
    index, far = grid.nearest(parts)
    every = ((parts[:, None] - book) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    assert np.mean([len(x) for x in grid.known.values()]) < 40
    again = grid.nearest(parts)
    assert (again[0] == index).all()


def test_few_and_no_vectors(spark):
    rows = [(2, 1, [0.5] * 16), (1, None, [0.25] * 16), (3, 1, [0.5] * 15), (4, 1, [0.5] * 32)]
    codes, books = vector_codes.compress(vectors(spark, rows))
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()} == {(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0)}
    assert books.vector("01" * 16) == [128] * 16 and len(books.books[0]) == 2
    codes, books = vector_codes.compress(vectors(spark, rows).limit(0))
    assert codes.count() == 0 and books is None and codes.columns == ["vec_id", "label", "code", "error", "label_error"]
