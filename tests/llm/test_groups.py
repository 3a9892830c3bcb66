import collections
import hashlib
import math
import random
import uuid

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from orepan.llm import sharding, simhash, topk, warc
from orepan.llm.common import shared_dir

from .conftest import make_docs, words


# --- SimHash ----------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints_are_spark_hashes_too(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b c", 42)


def test_components_of_documents(docs, corpus):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex64("fp").alias("fp"), "component_id").collect()
    assert len(got) == len(corpus)
    rows = sorted({(i, brute_fingerprint(t)) for i, t in corpus if i is not None})
    labels = brute_components([f for _, f in rows], 3)
    expected = {(i, f"{f:016x}", rows[labels[k]][0]) for k, (i, f) in enumerate(rows)}
    assert {tuple(r) for r in got if r.doc_id is not None} == expected
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_links_lose_nothing_in_large_buckets(spark):
    rng = np.random.default_rng(0)
    fps = [int(x) for x in rng.integers(0, 2**63, 20)]
    for _ in range(500):
        x = fps[int(rng.integers(len(fps)))]
        for _ in range(int(rng.integers(1, 4))):
            x ^= 1 << int(rng.integers(64))
        fps.append(x)
    fps = sorted(set(fps))
    labels = brute_components(fps, 3)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    for cell, blocks in ((1024, 4), (16, 4), (1024, 6)):
        got = {r.node: r.component for r in simhash.components(simhash.links(df, cell=cell, blocks=blocks)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == labels


def test_bit_sliced_pairs():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, (130, 2), dtype=np.uint64)
    x[7], x[90] = x[3], x[5] ^ np.uint64(7)
    i, j = simhash.near_pairs(x, x, 6)
    d = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(d <= 6))))
    lanes = np.arange(130)
    assert (simhash.near_lanes(x ^ x[3], 6) == (d[3] <= 6)).all() and len(lanes) == 130


def test_wide_fingerprints_follow_similarity(spark):
    rng, v = random.Random(4), [f"w{i}" for i in range(5000)]
    rows, same, apart = [], [], []
    for g in range(12):
        w = words(rng, 300, v).split()
        near, far = w[:], w[:]
        for at in (40, 200):
            near[at] = "x"
        for at in range(0, 300, 6):
            far[at] = "y"
        rows += [(3 * g, " ".join(w)), (3 * g + 1, " ".join(near)), (3 * g + 2, " ".join(far))]
        same.append((3 * g, 3 * g + 1))
        apart.append((3 * g, 3 * g + 2))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make_docs(spark, rows), k=5, words=8, radius=simhash.radius_for(0.8, 8)).collect()}
    assert all(got[a] == got[b] for a, b in same) and all(got[a] != got[b] for a, b in apart)


def shingles(text, k=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def edited(rng, text, n, fresh):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"{fresh}{at}"
    return " ".join(w)


def similar_rows():
    """Bases with copies on both sides of 0.8, groups that hang together by chains, and texts that repeat shingles."""
    rng, v, rows = random.Random(21), [f"w{i}" for i in range(5000)], []
    for g in range(60):
        base = words(rng, rng.choice([60, 150, 300]), v)
        n = len(base.split())
        rows.append(base)
        rows += [edited(rng, base, max(1, round(n * share)), f"x{g}_{c}_") for c, share in enumerate((0.01, 0.019, 0.021, 0.024, 0.027, 0.03, 0.04))]
    base = words(rng, 200, v)
    rows += [edited(rng, base, 2 + c % 3 // 2, f"y{c}_") for c in range(90)]
    rows += [base + " a b c d e" * 100, base, base.upper(), "one two", "ONE  two"]
    return list(enumerate(rows))


def brute_firsts(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    places = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for y in x:
            places[y].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for j, x in enumerate(sets):
        for i, c in collections.Counter(i for y in x for i in places[y] if i < j).items():
            if c >= least * (len(x) + len(sets[i]) - c) - 1e-12:
                pairs += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}, pairs


def test_near_copies_agree_with_brute_force(spark):
    rows = similar_rows()
    expected, pairs = brute_firsts(rows)
    assert pairs > 1000
    got = corpus_pipeline.drop_near_copies(spark, make_docs(spark, rows), "")
    assert {r.doc_id for r in got.collect()} == expected


def test_large_group_close_to_the_threshold(spark, monkeypatch):
    """What two rounds of pairs leave is decided in the cells, here of several parts."""
    rng = random.Random(8)
    base = words(rng, 200, [f"w{i}" for i in range(5000)])
    rows = list(enumerate(edited(rng, base, 2 + c % 3, f"z{c}_") for c in range(400)))
    expected, pairs = brute_firsts(rows)
    assert 1 < len(expected) < 390 and pairs > 1000
    calls = []
    left = simhash._links_left
    monkeypatch.setattr(simhash, "_links_left", lambda *a, **k: calls.append(1) or left(*a, **k))
    for most in (1_000_000, 10_000):
        monkeypatch.setattr(simhash, "CELL_SHINGLES", most)
        got = corpus_pipeline.drop_near_copies(spark, make_docs(spark, rows), "")
        assert {r.doc_id for r in got.collect()} == expected
    assert len(calls) == 2


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(1500):
        x = rng.integers(0, 2**63, 110, dtype=np.uint64)  # 80 of 100 hashes in common
        a, b = x[:90], np.concatenate([x[:80], x[90:100]])
        met += bool((simhash.band_keys(a) == simhash.band_keys(b)).any()) and int(np.bitwise_count(simhash.bits_of(a, 8) ^ simhash.bits_of(b, 8)).sum()) <= simhash.radius_for(0.8, 8, 4.0)
    assert met >= 1495


def test_one_fingerprint_may_hold_most_rows(spark):
    rng, v = random.Random(2), [f"w{i}" for i in range(400)]
    rows = [(i, words(rng, 20, v)) for i in range(1500)] + [(3000 + i, None) for i in range(500)] + [(None, "")]
    got = simhash.near_duplicates(make_docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.fp == 0} == {3000}
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 3000} <= set(range(1500))


def test_no_documents_have_no_components(none):
    assert simhash.near_duplicates(none).count() == 0


# --- sharding ---------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_keep_copies_together(spark, docs, corpus):
    got = sharding.shard(docs, shards=5).toPandas()
    assert len(got) == len(corpus)
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    rng, v = random.Random(1), [f"w{i}" for i in range(500)]
    rows = [(i, words(rng, rng.randint(10, 60), v)) for i in range(3000)]
    rows += [(10_000 + i, rows[0][1]) for i in range(1500)] + [(20_000 + i, rows[1][1]) for i in range(10)]
    d = make_docs(spark, rows)
    placed = sharding.shard(d, shards=24).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() < 1.1 * sizes.mean() and sizes.min() > 0.9 * sizes.mean()
    assert placed[placed.doc_id.isin([1, *range(20_000, 20_010)])].shard.nunique() == 1
    assert placed["size"].sum() == sum(len(t.encode()) + 8 for _, t in rows)
    assert sharding.shard(d, target_bytes=int(sizes.sum() / 7) + 1).select("shard").distinct().count() == 7


def test_only_groups_that_no_shard_can_hold_are_dealt(spark):
    parts, load = sharding.deal_heavy([(1, 50), (2, 30), (3, 30), (4, 250)], 5, 100.0)
    assert max(load) <= 101 and sum(load) == 360
    by_group = {g: [(lo, hi) for x, lo, hi, _ in parts if x == g] for g in (1, 2, 3, 4)}
    assert all(len(by_group[g]) == 1 for g in (1, 2, 3)) and len(by_group[4]) == 3
    assert all(x[0][0] == 0 and x[-1][1] == sharding.SALT and all(a[1] == b[0] for a, b in zip(x, x[1:])) for x in by_group.values())
    rng, v = random.Random(3), [f"w{i}" for i in range(500)]
    copies = [words(rng, 40, v) for _ in range(6)]
    rows = [(i, words(rng, rng.randint(10, 60), v)) for i in range(2000)] + [(10_000 + i, copies[i % 6]) for i in range(400)] + [(20_000 + i, None) for i in range(60)]
    placed = sharding.shard(make_docs(spark, rows), shards=10).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(sizes) == 10 and sizes.max() < 1.03 * sizes.mean() and sizes.min() > 0.97 * sizes.mean()
    own = dict(zip(placed.doc_id, placed.shard))
    for k in range(6):  # each a third of a shard
        assert len({own[10_000 + i] for i in range(400) if i % 6 == k}) == 1
    assert len({own[20_000 + i] for i in range(60)}) == 1


def test_written_shards_hold_every_row_once(spark, docs, corpus, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(corpus)
    assert set(docs.columns) < set(got.columns)
    slots = sharding.shard(docs, shards=4).toPandas().sort_values(["shard", "slot"])
    for s, part in slots.groupby("shard"):
        written = [r.doc_id for f in sorted((tmp_path / "s" / f"__shard={s}").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert [-1 if i is None else i for i in written] == part.doc_id.fillna(-1).astype(int).tolist()
    plain = docs.select("doc_id", "text")
    sharding.write_shards(plain, str(tmp_path / "t"), target_bytes=20_000)
    assert spark.read.parquet(str(tmp_path / "t")).count() == len(corpus)


def test_null_metadata_is_placed_like_empty(spark):
    rows = [(i, "a b c" * (i % 7), None, "") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sizes = sharding.shard(df, shards=6).groupBy("shard").count().collect()
    assert sum(r["count"] for r in sizes) == 200


def test_no_documents_have_no_shards(none):
    assert sharding.shard(none, shards=24).count() == 0


# --- top-k ------------------------------------------------------------------------------------


def brute_top(rows, k):
    x = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    return {(q, r + 1, i, s) for q in x if q % 20 == 0 for r, (s, i) in enumerate(sorted(((int(x[q] @ x[i]), i) for i in x if i != q), key=lambda t: (-t[0], t[1]))[:k])}


@pytest.mark.parametrize("dims", [3, 600])
def test_top_k_of_extreme_components_and_many_dimensions(spark, dims):
    rng = random.Random(dims)
    plain = [(i, [rng.choice([0.0, rng.gauss(0, 300)]) for _ in range(dims)]) for i in range(60)]
    rows = plain + [(100, [1e308] * dims), (101, [-1e308, 1e308] + [0.0] * (dims - 2)), (102, []), (103, [float("nan")] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, is_query=F.col("vec_id") % 20 == 0, k=4, block=25).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    largest, long_ = 1.7976931348623157e308, (1 << 63) - 1
    whole = {i: [int(max(-largest, min(largest, math.floor(64 * x) if abs(x) < 1e300 else math.copysign(largest, x)))) for x in v] for i, v in rows if i != 103}
    for q in (0, 20, 40, 100):
        score = {i: max(-long_, min(long_, sum(a * b for a, b in zip(whole[q], v)))) for i, v in whole.items() if i != q}
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert sorted(got[q]) == [(n + 1, i, s) for n, (i, s) in enumerate(best)]


def test_exact_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(0, 0.15, 16)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(500, None), (501, [None] * 16), (502, [float("nan")] * 16), (503, [float("inf")] + [0.0] * 15), (None, rows[0][1]), (520, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, cell string, score int").repartition(3)
    exact = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    for block, query_block in ((65_536, 256), (100, 7)):
        got = {tuple(r) for r in topk.top_k(df, is_query=F.col("vec_id") % 20 == 0, block=block, query_block=query_block).collect()}
        assert got == brute_top(exact, 20)
    assert topk.top_k(df.limit(0), is_query=F.lit(True)).count() == 0
    few = df.where("vec_id < 5")
    assert topk.top_k(few, is_query=F.col("vec_id") == 0).count() == 4


def test_index_stops_only_on_proof():
    rng = np.random.default_rng(3)
    x = np.floor(64 * rng.normal(0, 0.12, (3000, 32)))
    x[::7] = x[0]
    index, left = topk.ImpactIndex(x), []
    for i in range(20):
        rows, score = index.search(x[i], 15)
        s = x @ x[i]
        best = np.lexsort((np.arange(len(s)), -s))[:15]
        assert (rows == best).all() and (score == s[best]).all()
        left.append(index.left)
    assert sum(n > 0 for n in left) > 10  # the proof came before the last postings, but for the many ties


def test_large_finite_values_take_part(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)]
    rows[40] = (40, [1e9] * 8)
    rows[41], rows[42], rows[60] = (41, [-1e9] + [0.5] * 7), (42, [3e38, -3e38] + [0.0] * 6), (60, [2e8] * 8)
    rows += [(301, []), (302, [0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    x = {i: [int(np.floor(64 * np.float64(c))) for c in v] + [0] * (8 - len(v)) for i, v in rows}
    most = (1 << 63) - 1
    expected = set()
    for q in x:
        if q % 20 == 0:
            s = sorted((-max(-most, min(most, sum(a * b for a, b in zip(x[q], x[i])))), i) for i in x if i != q)[:20]
            expected |= {(q, r + 1, i, -v) for r, (v, i) in enumerate(s)}
    for block in (65_536, 70):
        assert {tuple(r) for r in topk.top_k(df, is_query=F.col("vec_id") % 20 == 0, block=block).collect()} == expected


def test_empty_vectors_have_the_score_zero(spark):
    df = spark.createDataFrame([(i, []) for i in range(4)], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df, is_query=F.col("vec_id") == 0).collect()} == {(0, i, i, 0) for i in (1, 2, 3)}


# --- WARC -------------------------------------------------------------------------------------


def test_archives_hold_what_was_written(spark):
    big, other = "<p>" + "é" * 700 + "</p>", "<p>" + "b" * 2000 + "</p>"
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b/", big), (5, None, big), (3, "http://c/", "small"), (4, "http://d/", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", big), (9, "u", "x" * 999), (10, "u", "x" * 999)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, path string")
    got = collections.Counter(tuple(r) for r in warc.archive_round_trip(spark, pages).collect())
    last = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            last[raw] = max(last.get(raw, i), i)
    expected = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = last.get(raw)
        to = None if to == i else to
        expected[(i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert got == expected
    manifest = warc.write_bundles(warc.decide(pages), shared_dir(spark, "w"), frame_bytes=3000, bundle_bytes=5000).collect()
    read = [raw for m in manifest for raw in warc.Bundle(m.path).read(8)]
    assert len(read) == 2 and all(warc.parse(raw)[1] == other.encode() for raw in read)
    assert sum(m.records for m in manifest) == len(rows)
    heads = [(warc.parse(raw)[0], raw) for m in manifest for raw in warc.Bundle(m.path).read(None)]
    assert len(heads) == 1 and heads[0][0]["WARC-Type"] == "revisit"
    known = [warc.Bundle(m.path) for m in manifest]
    for name in ("WARC-Record-ID", "WARC-Refers-To"):
        found = [r for b in known for r in b.read_record(uuid.UUID(heads[0][0][name].strip("<>").removeprefix("urn:uuid:")))]
        assert len(found) == 1 and (found[0] == heads[0][1] or warc.parse(found[0])[1] == big.encode())
    joined = collections.Counter((r.page_id, r.payload_digest, r.refers_to) for r in warc.decide(pages, broadcast_rows=0).collect())
    assert joined == collections.Counter((i, d, to) for i, _, d, _, to in got.elements())
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_any_zstandard_reader_can_unpack_a_bundle(spark):
    import zstandard

    pages = spark.createDataFrame([(i, "u", "x" * 5000 + str(i)) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    m = warc.write_bundles(warc.decide(pages), shared_dir(spark, "w"), frame_bytes=8000).first()
    with open(m.path.removeprefix("file:"), "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 9
