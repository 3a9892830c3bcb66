import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orepan.llm import decontam, line_dedup, lm, toxicity
from orepan.llm.common import crc_of_id

from .conftest import make_docs, words


# --- language model ---------------------------------------------------------------------------


def brute_lm(corpus):
    counts, n_train, docs = collections.Counter(), 0, []
    for i, t in corpus:
        w = (t or "").encode().lower().split() + [b"\n"]
        learn = i is not None and zlib.crc32(str(i).encode()) % 7 != 2
        if learn:
            counts.update(w)
        docs.append((i, learn, w))
    n, v = sum(counts.values()), len(counts)
    return sorted((i is not None, i or 0, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, _, w in docs)


def brute_scores(corpus):
    """The whole model token by token: counts, deleted counts, mixture weights, scores."""
    docs = []
    for i, t in corpus:
        r = zlib.crc32(str(i).encode()) % 7 if i is not None else 2
        docs.append((r != 2, r == 3, [b"\n", *(t or "").encode().lower().split(), b"\n"]))
    uni, bi, fold_uni, fold_bi = (collections.Counter() for _ in range(4))
    for learn, fold, w in docs:
        if learn:
            uni.update(w[1:])
            bi.update(zip(w, w[1:]))
        if fold:
            fold_uni.update(w[1:])
            fold_bi.update(zip(w, w[1:]))
    n, kept_n, p0 = sum(uni.values()), sum(uni.values()) - sum(fold_uni.values()), 1 / (len(uni) + 1)
    bucket = lambda c: min(c.bit_length(), lm.BUCKETS - 1)
    step = lambda p: 0.0 if p <= 0 else 2.0 ** (round(lm.STEP * math.log2(p / p0)) / lm.STEP)
    seen = collections.defaultdict(collections.Counter)
    for _, fold, w in docs:
        for a, b in zip(w, w[1:]) if fold else ():
            before = uni[a] - fold_uni[a]
            seen[bucket(before)][step((bi[a, b] - fold_bi[a, b]) / before if before else 0), step((uni[b] - fold_uni[b]) / kept_n)] += 1
    weights = {}
    for k in range(lm.BUCKETS):
        m = [1 / 3] * 3 if k else [0, 0.5, 0.5]
        for _ in range(60):
            total = [1.0, 1.0, 1.0]
            for (r2, r1), c in seen[k].items():
                share = [m[0] * r2, m[1] * r1, m[2]]
                total = [x + c * y / sum(share) for x, y in zip(total, share)]
            if not k:
                total[0] = 0
            m = [x / sum(total) for x in total]
        weights[k] = m
    out = []
    for _, _, w in docs:
        s = 0.0
        for a, b in zip(w, w[1:]):
            m = weights[bucket(uni[a])]
            s += math.log10(m[0] * (bi[a, b] / uni[a] if uni[a] else 0) + m[1] * uni[b] / n + m[2] * p0)
        out.append(s)
    return out


def test_language_model_scores_agree_with_brute_force(docs, corpus):
    expected = sorted((i is not None, i or 0, s) for (i, _), s in zip(corpus, brute_scores(corpus)))
    for kw in ({}, {"part_bytes": 3000, "bucket_bytes": 2000}):
        got = sorted((r.doc_id == r.doc_id, int(r.doc_id) if r.doc_id == r.doc_id else 0, r.score) for r in scored(docs, **kw).itertuples())
        assert [x[:2] for x in got] == [x[:2] for x in expected] and np.allclose([x[2] for x in got], [x[2] for x in expected], rtol=1e-6)


def scored(docs, **kw):
    fold = F.pmod(crc_of_id("doc_id"), F.lit(7))
    return lm.score_texts(docs, learn=fold != 2, fold=fold == 3, **kw).toPandas()


def test_language_model_base_scores(docs, corpus):
    got = scored(docs)
    assert sorted((r.doc_id == r.doc_id, int(r.doc_id) if r.doc_id == r.doc_id else 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()) == brute_lm(corpus)


def test_language_model_does_not_depend_on_parts(docs):
    a, b = (x.sort_values(["doc_id", "n_tokens"]).score.to_numpy() for x in (scored(docs), scored(docs.repartition(7), part_bytes=2000)))
    assert np.allclose(a, b)


def test_language_model_learns_word_order(spark):
    rng = random.Random(1)
    chain = {i: rng.sample(range(30), 2) for i in range(30)}

    def text(n):
        w, out = 0, []
        for _ in range(n):
            w = rng.choice(chain[w])
            out.append(f"t{w}")
        return " ".join(out)

    got = scored(make_docs(spark, [(i, text(80)) for i in range(150)]))
    held = got[~got.learn]
    assert held.score.sum() > held.base_score.sum() * 0.5


def test_weights_follow_the_better_estimate():
    cell = lambda b, s2, s1: (b << 28) | ((s2 + (1 << 13)) << 14) | (s1 + (1 << 13))
    w = lm.learn_weights([(cell(3, 40, 8), 1000), (cell(5, -(1 << 12), 30), 1000)])
    assert w[3].argmax() == 0 and w[5].argmax() == 1 and np.allclose(w.sum(axis=1), 1)


def test_language_model_without_rows(none):
    assert len(scored(none)) == 0


# --- toxicity ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_rows():
    rng, v = random.Random(3), [f"{a}{b}" for a in ("ar", "ti", "lo", "pre", "con") for b in ("ma", "ne", "sol", "vid", "tor", "quen", "dal")]
    bad = ["grobnik", "slurmo", "vexhag"]
    rows = []
    for i in range(400):
        w = words(rng, rng.randint(20, 60), v).split()
        y = i % 4 == 0
        if y:
            for _ in range(max(1, len(w) // 20)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(y)))
    return rows


@pytest.fixture(scope="module")
def model(toxic_rows):
    return toxicity.train([t for _, t, _ in toxic_rows[:300]], [y for *_, y in toxic_rows[:300]], buckets=1 << 14, least_steps=150)


def test_held_out_toxicity(model, toxic_rows):
    s = model.scores([t for _, t, _ in toxic_rows[300:]])
    y = np.array([y for *_, y in toxic_rows[300:]])
    assert ((s >= 0.7) == y).mean() > 0.95


def test_unseen_misspellings_share_ngrams(model, toxic_rows):
    clean = toxic_rows[1][1]
    a, b = model.scores([clean, clean + " grobnikk grobnick"])
    assert b > a + 0.2


def test_whole_texts_are_scored(spark, docs, corpus, model, toxic_rows):
    got = toxicity.score_texts(docs, model)
    assert got.count() == len(corpus) and got.where("score is null or not score between 0 and 1").count() == 0
    assert docs.count() == len(corpus) and toxicity.keep_below(docs, model, 2.0).columns == docs.columns
    d = make_docs(spark, [(i, t) for i, t, _ in toxic_rows] + [(9999, None)])
    kept = {r.doc_id for r in toxicity.keep_below(d, model, 0.7).select("doc_id").collect()}
    low = model.scores([t for _, t, _ in toxic_rows]) < 0.7
    assert 9999 in kept and kept - {9999} == {i for (i, *_), ok in zip(toxic_rows, low) if ok}


def test_training_sample_takes_only_learning_labels(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2 if i != 4 else None) for i in range(50)] + [(77777, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    texts, y = toxicity.training_sample(docs, labels, learn=F.col("doc_id") < 10)
    assert len(texts) == 9 and sum(y) == 5
    assert toxicity.train([], []).scores(["a"])[0] < 0.01
    assert len(toxicity.training_sample(docs, labels, learn=F.col("doc_id") < 10, sample_docs=4)[0]) == 4
    assert len(toxicity.training_sample(docs.limit(0), labels, learn=F.col("doc_id") < 10)[0]) == 0
    assert toxicity.score_texts(docs.limit(0), toxicity.train([], [])).count() == 0


def test_one_huge_text_does_not_empty_the_sample(spark):
    rows = [(i, "x" * 30_000 if i % 5 == 0 else f"text {i}") for i in range(50)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    texts, _ = toxicity.training_sample(make_docs(spark, rows), labels, learn=F.lit(True), sample_chars=40_000)
    assert len(texts) == 40 and max(map(len, texts)) < 100


# --- line dedup -------------------------------------------------------------------------------


def test_repeated_runs_are_deleted_where_they_stand_later(spark):
    rng = random.Random(3)
    v = [f"w{i}" for i in range(3000)]
    passages = ["\n".join(words(rng, rng.choice([5, 9, 12, 20]), v) for _ in range(8)) for _ in range(5)] + [words(rng, 70, v)]
    rows, first = [], {}
    for i in range(60):
        own = [words(rng, rng.randint(3, 25), v) for _ in range(rng.randint(1, 12))]
        if i % 2:
            own.insert(rng.randint(0, len(own)), passages[i // 2 % 6])
        if i % 3 == 0:
            own.insert(rng.randint(0, len(own)), "All rights reserved.")
        rows.append((i, "\n".join(own)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make_docs(spark, rows)).collect()}
    for i, text in rows:
        lines = text.split("\n")
        for k, p in enumerate(passages):
            if p in text:
                if first.setdefault(k, i) != i:
                    at = text[: text.index(p)].count("\n")
                    del lines[at : at + p.count("\n") + 1]
        assert got[i] == "\n".join(lines)


def brute_dedup(rows, least=50):
    """Every place against every earlier one, line by line."""
    texts = {i: t.split("\n") for i, t in rows}
    lines = {i: [(p, x.strip(), len(x.split())) for p, x in enumerate(t) if x.strip()] for i, t in texts.items()}
    places = collections.defaultdict(list)
    for i in sorted(lines):
        for k, (_, x, _) in enumerate(lines[i]):
            places[x].append((i, k))
    gone = collections.defaultdict(set)
    for found in places.values():
        for n, (j, q) in enumerate(found):
            for i, k in found[:n]:
                if k and q and lines[i][k - 1][1] == lines[j][q - 1][1]:
                    continue  # counted from where the run begins
                m = 0
                while k + m < len(lines[i]) and q + m < len(lines[j]) and lines[i][k + m][1] == lines[j][q + m][1]:
                    m += 1
                if sum(w for *_, w in lines[j][q : q + m]) >= least:
                    gone[j].update(range(lines[j][q][0], lines[j][q + m - 1][0] + 1))
    return {i: ("\n".join(x for p, x in enumerate(t) if p not in gone[i]), len(gone[i])) for i, t in texts.items()}


def deduped(spark, rows):
    return {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(make_docs(spark, rows)).collect()}


def test_partly_shared_earlier_texts_hide_no_run(spark):
    rng, v = random.Random(11), [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(20):  # the first text shares 45 words of the 60 that the other two share
        p, q, r, s = (words(rng, 15, v) for _ in range(4))
        rows += [(3 * g, "\n".join([p, q, r, words(rng, 40, v)])), (3 * g + 1, "\n".join([p, q, r, s])), (3 * g + 2, "\n".join(["own", p, q, r, s, "end"]))]
    got = deduped(spark, rows)
    assert got == brute_dedup(rows)
    assert all(got[3 * g + 2] == ("own\nend", 4) and got[3 * g + 1][1] == 0 for g in range(20))


def test_runs_agree_with_brute_force(spark):
    rng, v = random.Random(12), [f"w{i}" for i in range(300)]
    pool = [words(rng, rng.choice([1, 2, 5, 8, 12, 20, 49, 50, 70]), v) for _ in range(14)]
    chains = [[rng.choice(pool) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(1, 5)):
            c = rng.choice(chains)
            lo = rng.randrange(len(c))
            part = c[lo : lo + rng.randint(1, 9)]
            if rng.random() < 0.4:  # an edited line
                part[rng.randrange(len(part))] = words(rng, 9, v)
            for x in part:
                lines += [x] + [""] * (rng.random() < 0.2)
        rows.append((i, "\n".join(lines)))
    assert deduped(spark, rows) == brute_dedup(rows)


def test_line_dedup_edge_cases(spark, docs, none):
    run = "\n".join(f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(12))
    rows = [(1, run), (2, None), (3, ""), (4, "\n\n"), (5, "x\n\n" + run + "\n\ny"), (5, "x\n\n" + run + "\n\ny"), (None, run), (6, run + "\n" + run)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.removed_lines) for r in line_dedup.dedup_lines(make_docs(spark, rows)).collect()), key=str)
    assert got == sorted([(False, 1, run, 0), (False, 2, None, 0), (False, 3, "", 0), (False, 4, "\n\n", 0), (False, 5, "x\n\n\ny", 12), (False, 5, "x\n\n\ny", 12), (True, 0, "", 12), (False, 6, "", 24)], key=str)
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(docs).columns == docs.columns + ["removed_lines"]


def test_runs_may_repeat_within_themselves(spark):
    rng, v = random.Random(14), [f"w{i}" for i in range(500)]
    a, b, c = (words(rng, 20, v) for _ in range(3))
    rows = [(i, "\n".join(rng.choice([a, b, c]) for _ in range(rng.randint(3, 12)))) for i in range(40)]
    rows += [(100, "\n".join([c, "own", a, b, a, b, a])), (101, "\n".join([a] * 9))]
    assert deduped(spark, rows) == brute_dedup(rows)


def test_rows_without_an_id_are_places_of_their_own(spark):
    rng, v = random.Random(13), [f"w{i}" for i in range(500)]
    run = "\n".join(words(rng, 12, v) for _ in range(5))
    rows = [(None, run), (None, run), (None, "x\n" + run), (None, words(rng, 60, v)), (None, None), (7, "short")]
    got = collections.Counter(r.text for r in line_dedup.dedup_lines(make_docs(spark, rows).repartition(3)).collect())
    assert sum(run in (t or "") for t in got.elements()) == 1 and sum(got.values()) == len(rows)
    d = spark.createDataFrame([(1, run, 9), (2, run, 8)], "doc_id long, text string, removed_lines int")
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(d).collect()) == [(1, run, 9), (2, "", 8)]


def test_line_dedup_is_native(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- decontamination --------------------------------------------------------------------------


def test_wand_retrieves_all_above_the_threshold():
    rng, v = random.Random(1), [f"w{i}" for i in range(300)]
    items = [(i, words(rng, rng.randint(5, 40), v)) for i in range(150)]
    df, lengths = collections.Counter(), []
    for _, t in items:
        w = decontam.words_of(t)
        df.update(set(w))
        lengths.append(len(w))
    index = decontam.ItemIndex(items, df, len(items), float(np.mean(lengths)), block=4)
    for threshold in (0.1, 0.3, 0.6):
        for _ in range(40):
            terms = sorted({index.vocabulary[w] for w in decontam.words_of(rng.choice(items)[1]) if rng.random() < 0.7} | set(rng.sample(range(len(index.items)), 20)))
            score = np.zeros(len(index.ids))
            for t in terms:
                for item, x in zip(index.items[t], index.impacts[t]):
                    score[item] += x
            assert sorted(i for i, _ in index.retrieve(terms, threshold)) == np.flatnonzero(score >= threshold).tolist()


def brute_contaminated(rows, items, threshold=0.6, question_at=0.5, answer_at=0.5):
    """Every passage against every item, term by term."""
    items = [(i, t, decontam.words_of(t)) for i, t in dict.fromkeys(items) if t is not None and decontam.words_of(t)]
    df = collections.Counter(w for *_, ws in items for w in set(ws))
    mean, out = sum(len(ws) for *_, ws in items) / len(items), collections.Counter()
    for doc_id, text in rows:
        words = decontam.words_of(text or "")
        for item_id, item, ws in items:
            counts = collections.Counter(ws)
            weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in counts.items()}
            stride = 32
            while stride < len(ws):
                stride *= 2
            passages, best = 0, (-1.0, 0.0, 0.0)
            for lo in range(0, len(words), stride):
                inside = words[lo : lo + 2 * stride]
                score = sum(x for w, x in weight.items() if w in inside) / sum(weight.values())
                pairs = set(zip(inside, inside[1:])) | {(w,) for w in inside}
                q, a = (decontam.pairs_of(x) for x in decontam.question_and_answer(item))
                overlaps = [len(x & pairs) / len(x) if x else 1.0 for x in (q, a)]
                if score >= threshold and overlaps[0] >= question_at and overlaps[1] >= answer_at:
                    passages, best = passages + 1, max(best, (round(score, 9), *overlaps))
            if passages:
                out[(doc_id, item_id, passages, *best)] += 1
    return out


def test_found_items_agree_with_brute_force(spark):
    rng, v = random.Random(8), [f"w{i}" for i in range(150)]
    items = [(i, words(rng, rng.choice([3, 12, 31, 33, 60, 70, 130]), v)) for i in range(25)]
    items += [(3, words(rng, 20, v)), (None, words(rng, 25, v)), items[5], items[5], (77, items[6][1]), (78, "Q: " + words(rng, 9, v) + "\nAnswer: " + words(rng, 4, v)), (79, "?!"), (80, None)]
    rows = []
    for i in range(60):
        w = words(rng, rng.randint(0, 500), v).split()
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(items)[1] or "x"
            part = t.split()
            part = part[rng.randint(0, len(part) // 3) :]
            at = rng.randint(0, len(w))
            w[at:at] = part
        rows.append((i, " ".join(w)))
    rows += [rows[0], (None, items[0][1]), (99, None), (98, "")]
    given = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_contaminated(rows, items)
    assert len(expected) > 40
    for piece in (1 << 20, 1500):
        got = collections.Counter((r.doc_id, r.item_id, r.passages, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontam.contaminated(make_docs(spark, rows), given, piece_bytes=piece).collect())
        assert got == expected


def test_a_long_item_changes_no_other_result(spark):
    rng, v = random.Random(9), [f"w{i}" for i in range(3000)]
    item = [f"q{i}" for i in range(20)]
    scattered = [words(rng, 300, v)]
    for w in item:
        scattered += [w, words(rng, 300, v)]
    long_item = words(rng, 5000, v)
    rows = [(1, " ".join(scattered)), (2, words(rng, 100, v) + " " + long_item + " " + words(rng, 20_000, v))]
    given = spark.createDataFrame([(0, " ".join(item)), (1, long_item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(make_docs(spark, rows), given).collect()} == {(2, 1)}


def test_planted_items_are_found_and_clean_texts_left_alone(spark, none):
    rng, v = random.Random(2), [f"w{i}" for i in range(2000)]
    items = [(i, words(rng, rng.randint(15, 50), v)) for i in range(30)] + [(30, None), (31, ""), (None, "a b c"), (32, "Q: which word comes " + words(rng, 12, v) + "\nA: " + words(rng, 6, v))]
    rows = [(i, words(rng, rng.randint(1, 400), v)) for i in range(80)] + [(900, None), (901, "")]
    planted = set()
    for i in range(0, 80, 4):
        k = i // 4
        w = rows[i][1].split()
        at = rng.randint(0, len(w))
        rows[i] = (i, " ".join(w[:at]) + " " + items[k][1].upper() + ", " + " ".join(w[at:]))
        planted.add((i, k))
    rows.append((500, items[33][1]))
    rows.append((501, items[33][1].split("\n")[0]))  # the question alone
    given = spark.createDataFrame(items, "item_id long, text string")
    for piece in (1 << 20, 2000):
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make_docs(spark, rows), given, piece_bytes=piece).collect()}
        assert got == planted | {(500, 32)}
    assert decontam.contaminated(none, given).count() == 0
    assert decontam.contaminated(make_docs(spark, rows), given.limit(0)).count() == 0
