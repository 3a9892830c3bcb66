import hashlib
import random
import re
import zlib

import pytest

from orepan.llm import turn_trie

SCHEMA = "conv_id long, turn int, role string, text string, codes string, words string, path string, shard string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def brute_force(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
    ended = lambda p: ",".join(str(c) for c in sorted(c for c in members[p] if len(built[c]) == len(p)))
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ended(p).encode()).hexdigest())
        for p, m in members.items()
    }


def found(spark, rows, **columns):
    got = [tuple(r) for r in turn_trie.prefix_trie(make(spark, rows), **columns).select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(params=[2, 40])
def shards(request, spark):
    keys = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def conversations(rng, n, texts, longest):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("texts,longest", [(["a b", "a  b ", "", None], 4), ([f"w{i} x" for i in range(40)], 7)])
def test_trie_equals_brute_force(spark, shards, monkeypatch, texts, longest):
    monkeypatch.setattr(turn_trie, "GROUP", 3)  # several levels of boundary merging
    rng = random.Random(longest)
    rows = conversations(rng, 240, texts, longest)
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(150) for t in range(3)]  # copies
    rows += [(2000 + i, t, "user", "first of many" if t == 0 else rng.choice(["p q", "r"])) for i in range(100) for t in range(rng.randint(1, 5))]
    rows += [(3000, None, "user", "null turn"), (3000, 1, "user", "x"), (3000, 1, "user", "x"), (3000, 1, None, "y"), (None, 0, "user", "no conversation"), (None, 1, "user", "a b")]
    rows += [(3021, 0, "user", "whose head has no rows")]
    rng.shuffle(rows)
    assert found(spark, rows) == brute_force(rows)


def test_long_conversations_and_many_copies(spark):
    rows = [(5000 + 20 * i, t, "user", f"t{t}") for i in range(3) for t in range(4000 - 1500 * (i == 1))]
    rows += [(20 * i, 0, "user", "hello there") for i in range(60)]
    rows += [(10_000 + 20 * i, 0, "user", "copy") for i in range(9000)]  # more than two pieces of ids
    got = {r[1]: r for r in found(spark, [r for r in rows if r[0] < 10_000]) if r[0] >= 5000}
    deep = [r for r in brute_force([(5000, 0, "user", "a")])]
    assert len(deep) == 2 and max(got) == 4000 and got[4000][3] == 2 and got[2500][3] == 3 and got[2501][3] == 2
    assert found(spark, rows[-9060:]) == brute_force(rows[-9060:])


def test_no_and_turnless_conversations(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, 0, "user", "a")]) == set()
    turnless = next(c for c in range(1, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(turnless, 0, "user", "a"), (turnless, 1, "user", "b")]
    assert found(spark, rows) == brute_force(rows) and len(brute_force(rows)) == 1


def test_search_tree_walks_in_code_order():
    rng = random.Random(1)
    sequences = sorted({tuple(rng.randint(-3, 3) for _ in range(rng.randint(1, 6))) for _ in range(300)})
    tree = turn_trie.SearchTree()
    order = list(turn_trie.median_first(len(sequences)))
    assert sorted(order) == list(range(len(sequences)))
    for i in order:
        tree.insert(list(sequences[i]), [0] * len(sequences[i]), i)
    path, ends = [], []
    for depth, code, _, number in tree.walk():
        path = path[: depth - 1] + [code]
        if number >= 0:
            assert sequences[number] == tuple(path)
            ends.append(number)
    assert ends == list(range(len(sequences)))
    assert len(tree.code) == len({s[:d] for s in sequences for d in range(1, len(s) + 1)})


def test_two_turns_with_one_code_get_another_seed(spark, monkeypatch):
    from pyspark.sql import functions as F

    true = F.xxhash64
    monkeypatch.setattr(turn_trie.F, "xxhash64", lambda seed, *c: F.lit(7).cast("long") if "(0)" in str(seed) or "'0'" in str(seed) else true(seed, *c))
    turns = turn_trie.coded_turns(make(spark, [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a")]))
    assert turns.select("code").distinct().count() == 2 and turns.where("code = 7").count() == 0
