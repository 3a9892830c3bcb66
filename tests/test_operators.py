"""Operators on small fixtures with known results."""

import math
import random
import re
import time
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from orepan.operators import audit, catalog, edits, fusion, geometry, quantiles, runs, selection, stats, text

POINT = "array<struct<type string, position array<double>>>"


def points(*p):
    return [(t, [float(c) for c in xyz]) for t, *xyz in p]


QUERY = points(("Donor", 0, 0, 0), ("Acceptor", 3, 0, 0), ("Aromatic", 0, 4, 0), ("Hydrophobe", 0, 0, 5))


def library(spark, rows):
    return spark.createDataFrame([(i, c, f) for i, c, f in rows], f"object_id string, conformer_id int, features {POINT}")


def search(spark, rows, query=QUERY, tolerance=1.0):
    index = geometry.binned(geometry.triangles(library(spark, rows)))
    q = geometry.select_query_triangles(geometry.binned(geometry.triangles(library(spark, [("q", 0, query)]))))
    return geometry.top_objects(geometry.hits(geometry.best_matches(geometry.match_triangles(index, q, tolerance=tolerance)), len(query)), 10).collect()


def test_translated_and_distorted_objects_are_ranked(spark):
    moved = [(t, [p[0] + 10, p[1], p[2]]) for t, p in QUERY]
    distorted = points(("Donor", 0, 0, 0), ("Acceptor", 2.7, 0, 0), ("Aromatic", 0, 4, 0), ("Hydrophobe", 0, 0, 5))
    got = search(spark, [("demo-002", 0, distorted), ("demo-001", 0, moved), ("demo-003", 0, points(("Donor", 0, 0, 0), ("Donor", 1, 0, 0), ("Donor", 0, 1, 0))), ("small", 0, moved[:2]), ("none", 0, [])])
    assert [(r.object_id, r["rank"], r.coverage) for r in got] == [("demo-001", 1, 1.0), ("demo-002", 2, 1.0)]
    assert got[0].median_error == pytest.approx(0) and got[0].score == pytest.approx(1)


def test_search_loses_nothing_to_bins(spark):
    rng = random.Random(1)
    rows = [(f"o{i}", 0, points(*((rng.choice("AB"), rng.random() * 6, rng.random() * 6, rng.random() * 6) for _ in range(5)))) for i in range(40)]
    query = rows[0][2]

    def tri(f):
        for a in range(len(f)):
            for b in range(a + 1, len(f)):
                for c in range(b + 1, len(f)):
                    yield f[a], f[b], f[c]

    def fits(q, c):
        return any(all(q[i][0] == c[p[i]][0] for i in range(3)) and all(abs(math.dist(q[a][1], q[b][1]) - math.dist(c[p[a]][1], c[p[b]][1])) <= 0.7 * (1 + 1e-12) for a, b in ((0, 1), (0, 2), (1, 2))) for p in permutations(range(3)))

    index = geometry.binned(geometry.triangles(library(spark, rows)))
    q = geometry.binned(geometry.triangles(library(spark, [("q", 0, query)])))
    got = geometry.match_triangles(index, q, tolerance=0.7).groupBy("object_id").count().collect()
    expected = {o: sum(fits(a, b) for a in tri(query) for b in tri(f)) for o, _, f in rows}
    assert {r.object_id: r["count"] for r in got} == {o: n for o, n in expected.items() if n}


def test_triangles_are_compiled_and_keep_points_with_missing_parts(spark):
    odd = [("Donor", [0.0, 0.0, 0.0]), (None, [3.0, 0.0, 0.0]), ("Aromatic", [0.0, 4.0]), ("Hydrophobe", None), ("Donor", [0.0, 0.0, 5.0])]
    tri = geometry.binned(geometry.triangles(library(spark, [("o", 0, odd), ("two", 0, odd[:2]), ("null", 0, None)])))
    got = {(r.i, r.j, r.k): r for r in tri.collect()}
    # a triangle counts as long as one of its edges is known
    assert set(got) == {(0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4), (1, 2, 4), (1, 3, 4)}
    whole, part = got[0, 1, 4], got[0, 1, 2]
    assert (whole.type_key, whole.kinds, whole.d01, whole.d02, whole.area) == ("Donor|Donor", 2, 3.0, 5.0, 7.5) and [round(e, 9) for e in whole.edges] == [3.0, 5.0, round(34**0.5, 9)]
    assert (part.d01, part.d02, part.d12, part.area, part.edges[0]) == (3.0, None, None, None, 3.0)
    # a method of more than 8,000 bytes is never compiled by the JVM
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = re.findall(r"maxMethodCodeSize:\s*(\d+)", tri.where(F.col("perimeter") > 0)._jdf.queryExecution().explainString(mode))
    assert sizes and max(map(int, sizes)) < 8000


def test_published_index_is_searched_by_its_buckets(spark):
    from orepan.sources import sinks

    rng = random.Random(3)
    rows = [(f"o{i}", 0, points(*((rng.choice(["Donor", "Acceptor", "Aromatic"]), *(rng.uniform(0, 6) for _ in range(3))) for _ in range(5)))) for i in range(60)]
    sinks.publish_index(library(spark, rows), "published_test", buckets=32).collect()
    index = spark.table("published_test")
    q = geometry.select_query_triangles(index.where("object_id = 'o7'"), most=3)
    found = geometry.match_published(index, q)
    plain = geometry.match_triangles(geometry.binned(geometry.triangles(library(spark, rows))), q)
    key = lambda df: sorted((r.object_id, tuple(r.q), round(r.error, 9), tuple(r.c)) for r in df.collect())
    assert key(found) == key(plain) and len(key(found)) > 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    leaves = found._jdf.queryExecution().sparkPlan().collectLeaves()
    scans = [x for x in (leaves.apply(i) for i in range(leaves.size())) if x.getClass().getSimpleName() == "FileSourceScanExec"]
    assert scans and all(x.optionalBucketSet().get().cardinality() < 32 for x in scans) and "Exchange hashpartitioning" not in plan
    with pytest.raises(ValueError):
        geometry.match_published(index, index)
    spark.sql("DROP TABLE published_test")


def test_published_rows_leave_out_what_follows_from_types_and_distances(spark):
    from orepan.sources import sinks

    rng = random.Random(5)
    rows = [(f"o{i}", 0, points(*((rng.choice(["Donor", "Acceptor"]), *(rng.uniform(0, 6) for _ in range(3))) for _ in range(4)))) for i in range(5)]
    sinks.publish_index(library(spark, rows), "narrow_test", buckets=4).collect()
    index = spark.table("narrow_test")
    assert not {"edges", "type_key", "kinds", "perimeter", "b0", "b1", "b2"} & set(index.columns)
    whole = geometry.binned(geometry.triangles(library(spark, rows)))
    again = geometry.binned(geometry.completed(index)).select(whole.columns)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(again) == key(whole) and len(key(whole)) == 20
    spark.sql("DROP TABLE narrow_test")


def test_query_object_is_read_once(spark):
    from orepan.plans import registry  # noqa: F401  (loads the queries in their order)
    from orepan.plans import queries

    best, own, _ = queries._matched(spark, "/root/testdata/sf0.001")
    leaves = own._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert [leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())] in (["LocalRelation"], ["LogicalRDD"])
    assert 0 < own.count() <= geometry.MOST_TRIANGLES and best.where("object_id is not null").count() > 0


def test_fusion_breaks_ties_by_id(spark):
    a = spark.createDataFrame([("x", 1, 0.9), ("y", 2, 0.8)], "id string, rank int, score double")
    b = spark.createDataFrame([("y", 1, 0.7), ("x", 2, 0.6)], "id string, rank int, score double")
    got = fusion.fuse({"l": a, "p": b}, top=5).collect()
    assert [(r.id, r["rank"]) for r in got] == [("x", 1), ("y", 2)] and got[0].rrf_score == got[1].rrf_score
    assert got[0].branch_ranks == {"l": 1, "p": 2}
    with pytest.raises(ValueError):
        fusion.fuse({"l": a}, weights={"m": 1.0})


def test_intervals_and_exact_test(spark):
    r = spark.range(1).select(stats.wilson(F.lit(9), F.lit(10)).alias("w"), stats.wilson(F.lit(0), F.lit(0)).alias("none"), stats.mcnemar(F.lit(1), F.lit(0)).alias("p1"), stats.mcnemar(F.lit(0), F.lit(0)).alias("p0"), stats.mcnemar(F.lit(2), F.lit(9)).alias("p"), stats.mcnemar(F.lit(900), F.lit(1100)).alias("big")).first()
    assert (round(r.w.low, 5), round(r.w.high, 5)) == (0.59585, 0.98212) and r.none is None
    assert r.p1 == 1 and r.p0 == 1 and r.p == pytest.approx(2 * sum(math.comb(11, i) for i in range(3)) / 2**11)
    assert r.big == pytest.approx(2 * sum(math.comb(2000, i) for i in range(901)) / 2**2000)


def test_study_with_failures_in_the_denominator(spark):
    cases = spark.createDataFrame([(f"c{i}",) for i in range(10)], "case_id string")
    modes = spark.createDataFrame([(f"c{i}", m, -9.0 + m, 1.0 if i else 5.0, True) for i in range(10) if i != 4 for m in (1, 2)], "case_id string, mode int, score double, rmsd double, valid boolean")
    base = stats.case_recovery(cases, modes)
    arm = stats.arm_summary(base).first()
    assert (arm.cases, arm.completed, arm.top1) == (10, 9, 8) and arm.top1_rate == 0.8
    assert base.where("case_id = 'c4'").first().status == "NOT_ATTEMPTED"
    better = cases.select("case_id", (F.col("case_id") != "c0").alias("top1"))
    p = stats.paired(better, base).first()
    assert (p.only_a, p.only_b, p.both, p.neither, p.p) == (1, 0, 8, 1, 1.0)
    rules = spark.createDataFrame([("a", "rate", "gte", 0.8), ("b", "rate", "eq", 0.9), ("c", "diff", "superior", None), ("d", "gone", "gte", 0.1)], "claim_id string, endpoint string, operator string, threshold double")
    ends = spark.createDataFrame([("rate", 0.8, None, 0.05, True), ("diff", 0.1, 1.0, 0.05, True)], "endpoint string, value double, p double, alpha double, complete boolean")
    assert {r.claim_id: r.verdict for r in stats.claims(rules, ends).collect()} == {"a": "SUPPORTED", "b": "CONTRADICTED", "c": "INCONCLUSIVE", "d": "NOT_EVALUATED"}


def test_empty_sets_have_null_ratios(spark):
    df = spark.createDataFrame([(["A:10|H", "A:20|D"], ["A:20|D", "A:30|A", "A:40|P"]), ([], [])], "x array<string>, y array<string>")
    a, b = df.select(*(c.alias(k) for k, c in stats.set_overlap("x", "y").items())).collect()
    assert (a.common, a.union_size, a.jaccard, a.recovery, a.precision) == (1, 4, 0.25, pytest.approx(1 / 3), 0.5)
    assert b.jaccard is None and b.recovery is None and b.precision is None


def test_three_percentile_rules_differ(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double")
    assert stats.linear_percentile(df, "k", "v", 0.5, "p").first().p == 2.5
    assert stats.rounded_percentile(df, "k", "v", 0.5, "p").first().p == 3.0  # round(1.5) is 2
    assert stats.sample_summary(df, "k", "v").where("total = 1").first().p95 == 4.0


def test_order_statistics_without_a_group_in_one_task(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.randint(0, 40))) for _ in range(4000)] + [("hot", 7.0)] * 3000 + [(None, rng.random()) for _ in range(50)] + [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    groups = {k: sorted(v, key=lambda x: (x != x, x)) for k, v in groups.items()}
    places = {"med": quantiles.lower(0.5), "up": quantiles.upper(0.5), "p95": quantiles.nearest_rank(0.95), "top": lambda n: n - 1, "r": quantiles.rounded(0.75), "beyond": lambda n: n}
    got = {r.k: r for r in quantiles.at_places(df, ["k"], "v", places).collect()}
    assert set(got) == set(groups)
    same = lambda a, b: a == b or (a != a and b != b)
    for k, v in groups.items():
        n = len(v)
        expected = [v[(n - 1) // 2], v[n // 2], v[math.ceil(n * 0.95) - 1], v[-1], v[round((n - 1) * 0.75)]]
        assert got[k].n == n and all(same(a, b) for a, b in zip(expected, (got[k].med, got[k].up, got[k].p95, got[k].top, got[k].r))) and got[k].beyond is None
    every = sorted(v for v in sum(groups.values(), []) if v == v)
    assert quantiles.at_places(df.where("NOT isnan(v)"), [], "v", {"m": quantiles.lower(0.5)}).first().m == every[(len(every) - 1) // 2]
    assert quantiles.at_places(df.limit(0), ["k"], "v", {"m": quantiles.lower(0.5)}).count() == 0
    plan = quantiles.at_places(df, ["k"], "v", {"m": quantiles.lower(0.5)})
    native = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", 0.37).alias("p")).collect()}
    mine = {r.k: r.p for r in stats.linear_percentile(df, "k", "v", 0.37, "p").collect()}
    assert all(same(mine[k], native[k]) or abs(mine[k] - native[k]) < 1e-12 for k in mine) and plan.columns == ["k", "n", "m"]


def test_split_summary_shows_its_first_invalid_records(spark):
    rows = [("a", i, f"x{i % 3}", "BAD" if i % 2 else None) for i in range(60)] + [("b", 0, "x0", None), (None, 5, "y", "ODD")]
    df = spark.createDataFrame(rows, "split string, i int, identity string, error string")
    got = {r.split: r for r in audit.split_summary(df, ["identity"], "error", index="i").collect()}
    assert (got["a"].records, got["a"].parsed, got["a"].invalid, got["a"].unique_identity, got["a"].repeats_identity) == (60, 30, 30, 3, 27)
    assert [tuple(x) for x in got["a"].examples] == [(i, "BAD") for i in range(1, 40, 2)] and got["b"].examples == [] and [tuple(x) for x in got[None].examples] == [(5, "ODD")]


def test_split_overlap_reports_pairs_without_any(spark):
    m = spark.createDataFrame([("train", "e"), ("train", "b"), ("test", "e"), ("test", "e"), ("val", "z"), ("val", None)], "split string, identity string")
    got = {(r.a, r.b): (r.common, r.share, len(r.examples)) for r in audit.overlap(m, "identity").collect()}
    assert got == {("test", "train"): (1, 1.0, 1), ("test", "val"): (0, 0.0, 0), ("train", "val"): (0, 0.0, 0)}
    one = audit.roles_check(m, ["train", "test", "holdout"]).first()
    assert one.missing == ["holdout"] and one.unexpected == ["val"]


def test_similarity_joins_equal_brute_force(spark):
    rng = random.Random(2)
    sets = [(i, sorted({rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))})) for i in range(60)]
    df = spark.createDataFrame(sets, "id int, tokens array<string>")
    for t in (0.3, 0.8, 1.0):
        got = {(r.left_id, r.right_id) for r in audit.token_similarity(df, df, t).collect()}
        assert got == {(a, b) for a, x in sets for b, y in sets if len(set(x) & set(y)) / len(set(x) | set(y)) >= t}
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(50)]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    w = spark.createDataFrame([(x,) for x in words], "seq string")
    for t in (0.4, 0.6, 0.8, 1.0):
        got = {(r.x, r.y) for r in audit.edit_similarity(w, w, t, grain=2).collect()}
        assert got == {(a, b) for a in words for b in words if (1 - lev(a, b) / max(len(a), len(b)) if a or b else 1) >= t - 1e-12}


def test_edit_join_of_long_sequences(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (200, 210, 480, 900, 1500)]

    def edited(s, k):
        s = list(s)
        for _ in range(k):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice([[], ["A"], ["W", s[at]]])
        return "".join(s)

    x = base + [edited(s, len(s) // 20) for s in base]
    y = [edited(s, int(len(s) * f)) for s in base for f in (0.02, 0.05, 0.09, 0.13, 0.3)] + ["WWW" + base[0], base[1][20:]]
    a, b = (spark.createDataFrame([(s,) for s in v], "seq string") for v in (x, y))
    for t in (0.85, 0.9):
        every = a.select(F.col("seq").alias("x")).crossJoin(b.select(F.col("seq").alias("y"))).withColumn("i", 1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"))).where(F.col("i") >= t - 1e-12)
        got = {(r.x, r.y, round(r.identity, 9)) for r in audit.edit_similarity(a, b, t).collect()}
        assert got == {(r.x, r.y, round(r.i, 9)) for r in every.collect()} and len(got) > 20


def test_gates_rank_fail_before_incomplete(spark):
    g = spark.createDataFrame([("a", "PASS"), ("b", "INCOMPLETE"), ("c", "FAIL")], "rule string, status string")
    r = audit.overall(g).first()
    assert r.status == "FAIL" and r.blockers == ["b", "c"]
    assert audit.overall(g.where("rule != 'c'")).first().status == "INCOMPLETE"
    row = spark.range(1).select(audit.gate(F.lit(0), F.lit(None).cast("boolean")).alias("g")).first()
    assert row.g == "INCOMPLETE"


def test_holdout_does_not_depend_on_row_order(spark):
    rows = [(f"case-{i}", []) for i in range(7)] + [("metal-case", ["metal"])]
    df = spark.createDataFrame(rows, "id string, reasons array<string>")
    pick = lambda d: sorted((r.id, r.place) for r in selection.holdout(d, "ns", 3).where("place is not null").collect())
    assert pick(df) == pick(df.orderBy(F.rand(1)).repartition(4)) and len(pick(df)) == 3
    assert selection.holdout(df, "ns", 3).where("id = 'metal-case'").first().why == ["metal"]


def test_coverage_and_multisets(spark):
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    got = {r.k: r.defect for r in selection.coverage(k(1, 2, 3, 4), k(1, 2, 9), k(2, 3), "k").collect()}
    assert got == {2: "done_and_failed", 4: "missing", 9: "unexpected"}
    assert {(r.k, r.in_a, r.in_b) for r in selection.multiset_difference(k(1, 1, 2), k(1, 2, 3), ["k"]).collect()} == {(1, 2, 1), (3, 0, 1)}


def test_redaction_and_citations(spark):
    df = spark.createDataFrame([('api_key="abc def" token=xyz Bearer aa.bb /home/me/x.txt C:\\a\\b',)], "t string")
    got = df.select(text.redact(F.col("t")).alias("t")).first().t
    assert not any(s in got for s in ("abc def", "xyz", "aa.bb", "/home/me", "C:\\a"))
    cases = {
        "MY_SECRET=abc next": "MY_SECRET=[REDACTED] next",
        '{"password": "hunter2", "n": 1}': '{"password": "[REDACTED]", "n": 1}',
        "AWS_SECRET_KEY: 'a b'; x": "AWS_SECRET_KEY: [REDACTED]; x",
        "CREDENTIAL=abc,d": "CREDENTIAL=[REDACTED],d",
        "see /srv/a/b.txt: ok": "see [INTERNAL_PATH]: ok",
        "Authorization: bearer abc.def": "Authorization: Bearer [REDACTED]",
        "c:/users/me/f.txt and a/b/c": "c:[INTERNAL_PATH] and a/b/c",
        "D:\\x\\y z": "[INTERNAL_PATH] z",
        "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.r for r in df.select("t", text.redact(F.col("t")).alias("r")).collect()} == cases
    sources = {"/a": ["absolute_path"], "~/a": ["absolute_path"], "C:\\a": ["absolute_path"], "FILE:///x": ["file_url"], "https://u:p@h/x": ["credentials"], "https://h/x?a=1": ["query_or_fragment"], "https://h/x#f": ["query_or_fragment"], "https://h/x?": [], "ftp://u@h/?q": [], "data set": []}
    df = spark.createDataFrame([(k,) for k in sources], "s string")
    assert {r.s: r.why for r in df.select("s", text.safe_source(F.col("s")).alias("why")).collect()} == sources
    a = spark.createDataFrame([("see [doc:1] and [doc:9]", ["doc:1", "doc:2"]), ("see [doc:9]", ["doc:2"]), ("x", [])], "text string, known array<string>")
    assert [r.checked for r in text.check_citations(a).collect()] == ["see [doc:1] and", "see [doc:2]", "x"]


#: The rules as published, for comparison: what is masked, in this order (fixed values).
PUBLISHED_NAME = r"(?:[A-Z0-9_.-]*(?:API[_-]?KEY|TOKEN|PASSWORD|SECRET|CREDENTIAL)[A-Z0-9_.-]*)"
PUBLISHED = (
    (rf"(?i)([\"']?{PUBLISHED_NAME}[\"']?\s*[:=]\s*)([\"'])(.*?)\2", r"\1\2[REDACTED]\2"),
    (rf"(?i)({PUBLISHED_NAME}\s*[:=]\s*)[^\s,;}}]+", r"\1[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"(?<![\w.])/(?:[^\s/:]+/)+[^\s,;:]+", "[INTERNAL_PATH]"),
    (r"(?i)\b[A-Z]:[\\/](?:[^\s\\/:]+[\\/])+[^\s,;:]+", "[INTERNAL_PATH]"),
)


def test_redaction_equals_the_published_rules(spark):
    rng = random.Random(2)
    parts = ["token", "API_KEY", "a", "Secret", "=", ":", " ", '"', "'", "x-", "/", ",", ";", "\\", "C:", "\n", "bearer ", "é", ".", "}", "/a/", "pass", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 18))) for _ in range(12_000)]
    expected = []
    for t in texts:
        for pattern, to in PUBLISHED:
            t = re.sub(pattern, to, t)
        expected.append(t)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.r for r in df.select("i", text.redact(F.col("t")).alias("r")).orderBy("i").collect()]
    assert [(t, e, g) for t, e, g in zip(texts, expected, got) if e != g] == []


def test_redaction_takes_linear_time(spark):
    n = 1_000_000
    for t in ("A" * n, "token" * (n // 5), "/a" * (n // 2) + "/x", "C:\\" + "a\\" * (n // 2), "x=" * (n // 2), "token " * (n // 6), '"' * n, "a." * (n // 2)):
        df = spark.createDataFrame([(t,)], "t string")
        start = time.time()
        df.select(F.length(text.redact(F.col("t")))).collect()
        assert time.time() - start < 3


def test_hosts_cannot_be_disguised(spark):
    cases = {
        "https://good.com/x": True, "HTTPS://GOOD.com": True, "https://good.com.": True, "https://good.com./x": True, "https://u:p@good.com:443/x": True, "https://good.com?q": True, "https://a@b@good.com/": True, " https://good.com": True,
        "https://evil.com?@good.com/x": False, "https://evil.com#@good.com": False, "https://evil.com/@good.com": False, "https://good.com@evil.com": False, "http://good.com": False, "https://good.com.evil.com": False, "https://xgood.com": False,
        "https:///good.com": False, "https://": False, "": False, "good.com": False, "https://[::1]/": True, "https://good.com\\@evil.com": False, "https://good.com:x@evil.com:1": False, None: False,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    hosts = spark.createDataFrame([("Good.com.",), ("::1",)], "host string")
    assert {r.url: r.allowed for r in text.allowed_host(df, hosts).collect()} == cases


def test_public_identifiers_and_entries(spark):
    rows = [("rcsb-mmcif", " 1abc\n"), ("rcsb-mmcif", "pdb_00001abc"), ("rcsb-mmcif", "1abcd"), ("alphafold-mmcif", "p12345-2"), ("uniprot-fasta", "p12345"), ("rcsb-ccd-sdf", "atp"), ("pubchem-cid-sdf-3d", "0"), ("x", "1"), ("rcsb-ccd-sdf", " "), ("rcsb-ccd-sdf", None)]
    got = {(r.source, r.identifier): (r.filename, r.error) for r in catalog.public_identifiers(spark.createDataFrame(rows, "source string, identifier string")).collect()}
    assert [got[r] for r in rows] == [("rcsb-1abc.cif", None), ("rcsb-pdb_00001abc.cif", None), (None, "form"), ("afdb-P12345-2.cif", None), ("uniprot-P12345.fasta", None), ("rcsb-ccd-ATP-ideal.sdf", None), (None, "form"), (None, "source"), (None, "blank"), (None, "blank")]
    e = spark.createDataFrame([('{"a": 1.5, "sequences": ["M"], "b": {"sequences": 1}}', "/x/y.pdb"), ('{"a": null}', "C:\\d\\z.cif"), ("no json", "plain"), (None, None)], "qc string, source_name string")
    assert [(r.qc, r.source_name, r.withheld) for r in catalog.public_entries(e).collect()] == [('{"a":1.5,"b":{"sequences":1},"sequence_values_disclosed":false}', "y.pdb", True), ('{"a":null}', "z.cif", False), ("{}", "plain", False), ("{}", None, False)]


def test_term_search_equals_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    pick = lambda n: sorted(set(rng.choices(vocabulary, weights, k=n)))
    docs = [(i, pick(rng.randint(1, 40))) for i in range(150)] + [(200, []), (201, None)]
    queries = [(f"q{i}", pick(rng.randint(1, 30))) for i in range(20)] + [("copy", docs[5][1]), ("unknown", ["x", "y"]), ("partly", ["x", "w59", "w0"]), ("none", [])]
    got = {(r.query_id, r.id, round(r.score, 9), r.rank) for r in text.term_search(spark.createDataFrame(docs, "id int, tokens array<string>"), spark.createDataFrame(queries, "query_id string, tokens array<string>"), k=5, first=2).collect()}
    expected = set()
    for qid, terms in queries:
        scored = sorted((-len(set(t or []) & set(terms)), i) for i, t in docs if set(t or []) & set(terms))
        expected |= {(qid, i, round(-c / len(terms), 9), r + 1) for r, (c, i) in enumerate(scored[:5])}
    assert got == expected


def test_term_search_deals_documents_and_queries(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["x", "ü", "語", "语法"]) + str(int(rng.expovariate(0.08)))
    docs = [(f"d{i:03}é" if i % 3 else f"d{i:03}e", [word() for _ in range(rng.randint(0, 60))] + rng.choice([[], [None]])) for i in range(120)] + [(None, ["x0"]), ("none", None), ("copy", ["x1", "x2"]), ("copy", ["x2", "x3"])]
    queries = [(i, list({word() for _ in range(rng.randint(0, 25))})) for i in range(30)] + [(None, ["x0"]), (90, None), (91, ["nowhere"]), (92, ["x1", "x2", "x3", "x0"])]
    held = {}
    for i, t in docs:
        if i is not None:
            held.setdefault(i, set()).update(t or [])
    expected = set()
    for q, t in queries:
        scored = sorted((-len((held[i] - {None}) & set(t)), i.encode()) for i in held if q is not None and t and (held[i] - {None}) & set(t))
        expected |= {(q, i.decode(), round(-c / len(t), 9), n + 1) for n, (c, i) in enumerate(scored[:7])}
    d, q = spark.createDataFrame(docs, "id string, tokens array<string>"), spark.createDataFrame(queries, "query_id long, tokens array<string>")
    for size in ({}, {"most": 20, "block": 6}, {"most": 1, "block": 40}):
        rows = text.term_search(d, q, k=7, **size)
        assert {(r.query_id, r.id, round(r.score, 9), r["rank"]) for r in rows.collect()} == expected
        # a document is a row, and its words are made, once a block: no row for a word or a shared word
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(tokens" not in plan and "Join" not in plan
    assert text.term_search(d.where("id is null"), q).count() == text.term_search(d, q.where("query_id is null")).count() == 0


def test_chunks(spark):
    d = spark.createDataFrame([(1, "a" * 2500), (2, None), (3, "   "), (4, "# One\n" + "x" * 900 + "\n" + "y" * 1200 + "\n# Two\nz")], "doc_id long, text string")
    assert [(r.doc_id, r.offset, len(r.text)) for r in text.chunk_fixed(d.where("doc_id < 4")).orderBy("offset").collect()] == [(1, 0, 1800), (1, 1800, 700)]
    s = [(r.section, r.chunk_no, len(r.text)) for r in text.chunk_sections(d.where("doc_id = 4")).orderBy("chunk_no").collect()]
    assert s == [("One", 0, 1800), ("One", 1, 301), ("Two", 2, 1)]
    assert list(text.section_pieces("#  A \n####### b\n#\nc\n## D\n\n")) == [("A", "####### b\n#\nc")]
    # what is gathered goes as a whole: the rest of a cut is not carried on to the next lines
    lines = ["x" * 1000, "y" * 900, "z" * 100]
    assert [len(p) for _, p in text.section_pieces("\n".join(lines))] == [1000, 900, 100]
    assert [len(p) for _, p in text.section_pieces("a" * 4000 + "\nb")] == [1800, 1800, 400, 1]


def test_required_tools_in_order(spark):
    e = [("a", ["status", "search", "x", "write"], [1, 1, 0, 1]), ("b", ["search", "status", "write"], [1, 1, 1]), ("c", ["status", "search", "search", "write"], [1, 0, 1, 1])]
    df = spark.createDataFrame([(s, i, t, bool(o)) for s, ts, os in e for i, (t, o) in enumerate(zip(ts, os))], "session_id string, seq int, tool string, ok boolean")
    got = {r.session_id: (r.matched, r.passed) for r in runs.required_subsequence(df, ["status", "search", "write"]).collect()}
    assert got == {"a": (3, True), "b": (1, False), "c": (3, True)}


def test_receipts_show_tampering(spark):
    df = catalog.with_receipt(spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, v string, w string"), ["id", "v", "w"])
    assert catalog.broken_receipts(df, ["id", "v", "w"]).count() == 0
    changed = df.withColumn("v", F.when(F.col("id") == 2, "c").otherwise(F.col("v")))
    assert [r.id for r in catalog.broken_receipts(changed, ["id", "v", "w"]).collect()] == [2]


def test_lineage_ends_in_cycles(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("q", "z")], "parent string, child string")
    got = catalog.lineage(edges, spark.createDataFrame([("r",)], "node string"))
    assert {(r.node, r.depth) for r in got.collect()} == {("r", 0), ("a", 1), ("b", 2), ("c", 3)}
    assert [r.node for r in catalog.missing_references(got, spark.createDataFrame([("r",), ("a",), ("b",)], "node string")).collect()] == ["c"]


def test_contacts_by_cells_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [("s", i, rng.random() * 20 - 10, rng.random() * 20 - 10, rng.random() * 20 - 10) for i in range(80)]
    df = spark.createDataFrame(rows, "structure_id string, id int, x double, y double, z double")
    got = {(r.left_id, r.right_id) for r in geometry.contacts(df, df, 5.0).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if math.dist(a[2:], b[2:]) <= 5.0}


def test_crop_by_array_and_by_cells(spark):
    rng = random.Random(9)
    place = lambda: [rng.uniform(0, 30) for _ in range(3)]
    atoms = [(s, i, f"r{i // 4}", *place(), rng.random() < 0.2) for s in ("a", "b", "c") for i in range(80)]
    pose = [(s, i, *place()) for s, n in (("a", 3), ("b", 12)) for i in range(n)]
    df = spark.createDataFrame(atoms, "structure_id string, id int, residue string, x double, y double, z double, hydrogen boolean")
    p = spark.createDataFrame(pose, "structure_id string, id int, x double, y double, z double")
    near = {(a[0], a[2]) for a in atoms for q in pose if a[0] == q[0] and not a[6] and math.dist(a[3:6], q[2:5]) <= 5}
    expected = sorted((a[0], a[1]) for a in atoms if (a[0], a[2]) in near)
    for most in (2000, 5, 1):
        assert sorted((r.structure_id, r.id) for r in geometry.crop_residues(df, p, 5.0, most=most).collect()) == expected
    assert geometry.crop_residues(df, p.limit(0), 5.0).count() == 0


def test_nested_keys_write_nothing_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(catalog, "checkpointed", lambda df: pytest.fail("a level was written"))
    docs = [(1, ' {"b": {"k": 1.25}, "a": [[{"k": {"k": -3}}]]}'), (2, '{"k": 1, "k": 2}'), (3, '{"n": ' * 300 + '{"k": 12345678901234567890123}' + "}" * 300), (4, '"k"'), (5, '{"k": "\\ud83d\\ude00"}')]
    found = catalog.nested_keys(spark.createDataFrame(docs, "n long, doc string"), "doc", "k", by="n")
    got = sorted((r.id, r.holder[:27], r.pos, r.v) for r in found.select("id", "holder", "pos", F.col("v").cast("string").alias("v")).collect())
    inner = "00000000/" * 3
    assert got == [(1, inner, 0, "-3"), (1, inner, 0, '{"k":-3}'), (1, "00000001/", 0, "1.25"), (3, inner, 0, "12345678901234567890123"), (5, "", 0, "\U0001f600")]


def test_chain_atoms_equal_the_kept_and_absent_chains(spark):
    from orepan.operators import structures
    from orepan.plans import registry

    atoms = spark.createDataFrame([("s", "A", 1, False), ("s", "A", 1, False), ("s", "A", 2, False), ("s", "B", 1, True), ("t", "A", 1, False), (None, "A", 1, False)], "structure_id string, chain string, model int, het boolean")
    chains = spark.createDataFrame([("s", "A"), ("s", "B"), ("t", "C"), (None, "A")], "structure_id string, chain string")
    kept, absent = structures.keep_chains(atoms, chains)
    both = kept.groupBy("structure_id", "chain").count().unionByName(absent.withColumn("count", F.lit(0)))
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(structures.chain_atoms(atoms, chains)) == key(both) == sorted([("s", "A", 2), ("s", "B", 0), ("t", "C", 0), (None, "A", 0)], key=repr)
    plan = registry.QUERIES["kept_chains"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Relation [") == 2


def test_nested_keys_at_any_depth(spark):
    deep = '{"a": [' * 12 + '{"VINA": {"version": " 1.2 "}, "sample_ranking_score": 0.5}' + "]}" * 12
    docs = {
        1: deep, 2: '{"a": {"b": {"vina": "deep"}}, "c": {"vina": "other"}}', 3: '{"z": {"vina": "x"}, "Vina": " own "}', 4: '{"vina": " ", "b": [{"vina": {"version": 3}}, {"vina": "kept"}]}', 5: "[]", 6: "{broken", 7: None,
        8: '{"sample_ranking_score": true, "b": [{"sample_ranking_score": "7"}, {"sample_ranking_score": -2}, {"sample_ranking_score": {"sample_ranking_score": 1.5}}]}',
    }
    df = spark.createDataFrame(list(docs.items()), "k int, doc string")
    assert {r.k: r.version for r in catalog.nested_versions(df, "doc", "vina", by="k").collect()} == {1: "1.2", 2: "deep", 3: "own", 4: "kept"}
    assert {r.k: r.score for r in catalog.ranking_scores(df, "doc", by="k").collect()} == {1: 0.5, 8: 1.5}


def test_altloc_and_clusters(spark):
    a = spark.createDataFrame([("s", "CA", "A", 0.5, 1.0, 0.0, 0.0), ("s", "CA", "B", 0.5, 2.0, 0.0, 0.0), ("s", "CB", "B", 0.7, 0.0, 0.0, 0.0), ("s", "CB", "A", 0.3, 0.0, 0.0, 0.0)], "structure_id string, atom string, altloc string, occ double, x double, y double, z double")
    assert {(r.atom, r.altloc, r.tied) for r in geometry.choose_altloc(a, ("structure_id", "atom")).collect()} == {("CA", "A", 2), ("CB", "B", 1)}
    p = spark.createDataFrame([("s", "D", 0.0, 0.0, 0.0), ("s", "D", 1.0, 0.0, 0.0), ("s", "D", 5.0, 0.0, 0.0), ("s", "A", 1.0, 0.0, 0.0)], "structure_id string, type string, x double, y double, z double")
    assert sorted((r.type, r.x, r.members) for r in geometry.cluster_points(p).collect()) == [("A", 1.0, 1), ("D", 0.5, 2), ("D", 5.0, 1)]


def test_overlay_and_coherent_mapping(spark):
    import numpy as np

    from orepan.operators import overlay

    rng = np.random.default_rng(0)
    p = rng.normal(size=(6, 3))
    c, s = np.cos(0.7), np.sin(0.7)
    q = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + (1, 2, 3)
    m = overlay.rigid_overlay(p, q)
    assert np.allclose(p @ m[:3, :3].T + m[:3, 3], q)
    # the second match would map point 0 to another partner, so it does not count
    mapping, chosen = overlay.coherent_mapping([(0.1, (0, 1, 2), (0, 1, 2)), (0.0, (0, 1, 3), (5, 1, 3)), (0.2, (0, 2, 3), (0, 2, 3))], p, q, 1e-6)
    assert mapping == {0: 0, 1: 1, 2: 2, 3: 3} and sorted(chosen) == [0, 2]
    rows = [("demo", 0, [(t, [x[0] + 10, x[1], x[2]]) for t, x in QUERY])]
    objects = library(spark, rows)
    index = geometry.binned(geometry.triangles(objects))
    best = geometry.best_matches(geometry.match_triangles(index, geometry.binned(geometry.triangles(library(spark, [("q", 0, QUERY)])))))
    r = overlay.coherent_hits(best, objects, [x for _, x in QUERY]).first()
    assert (r.coverage, r.matches) == (1.0, 4) and r.overlay[0][3] == pytest.approx(-10)


def test_coherent_mapping_equals_all_unions():
    """Against every union of matches, on cases small enough for the beam to hold all."""
    import numpy as np

    from orepan.operators import overlay

    rng = random.Random(8)
    for _ in range(60):
        points_ = np.array([[rng.randint(0, 3) for _ in range(3)] for _ in range(5)], dtype=float)
        other = points_[[rng.randrange(5) for _ in range(5)]] if rng.random() < 0.5 else points_
        matches = [(rng.choice([0.0, 0.1, 0.2, 0.5]), tuple(sorted(rng.sample(range(5), 3))), tuple(rng.sample(range(5), 3))) for _ in range(6)]
        fine = lambda m: len({a for a, _ in m}) == len(m) == len({b for _, b in m}) and all(abs(np.linalg.norm(points_[a] - points_[c]) - np.linalg.norm(other[b] - other[d])) <= 1 + 1e-12 for a, b in m for c, d in m)
        unions = {frozenset(p for i in range(6) if use >> i & 1 for p in zip(*matches[i][1:])) for use in range(1, 64)}
        explained = lambda m: [x for x in matches if m >= set(zip(*x[1:]))]

        def key(m):
            e = [x[0] for x in explained(m)]
            return -len(m), float(np.median(e)), -len(e), float(np.mean(e)), sorted(m)

        best = min((m for m in unions if fine(m)), key=key, default=frozenset())
        mapping, chosen = overlay.coherent_mapping(matches, points_, other, 1.0)
        assert mapping == dict(best) and sorted(matches[i] for i in chosen) == sorted(explained(best))


def test_sequence_verification(spark):
    from orepan.operators import overlay

    assert overlay.align("ACGT", "ACGT") == (8, 4, 4) and overlay.align("", "AC") == (-4, 0, 2) and overlay.align("ACGTACGTAC", "ACGTAACGTAC")[1:] == (10, 11)
    pairs = spark.createDataFrame([("a", "MKTV", "MKTV"), ("b", "KT", "MKTV"), ("c", "MKTV" * 30, "MKTV" * 29 + "MKTC"), ("e", "MKTV" * 5, "MKTV" * 4 + "MKTC"), ("f", "A" * 2001, "A"), ("d", "WWWW", "MKTV"), ("d", "WWWW", "WWWWQ")], "k string, observed string, reference string")
    assert {r.k: r.status for r in overlay.verify_identity(pairs, "k").collect()} == {"a": "EXACT", "b": "PARTIAL", "c": "VARIANT", "e": "CONFLICT", "f": "TOO_LONG", "d": "PARTIAL"}


def test_structure_checks(spark):
    from orepan.operators import structures

    atoms = spark.createDataFrame(
        [("s", 1, "A", 1, "", "ALA", a, i, "", "C", False, float(i), 0.0, 0.0) for i, a in enumerate(["N", "CA", "C"])] + [("s", 1, "A", 2, "", "GLY", "CA", 3, "A", "C", False, 3.0, 0.0, 0.0), ("s", 1, "B", 9, "", "LIG", "C1", 4, "", "C", True, 4.0, 0.0, 0.0), ("s", 1, "B", 10, "", "ZN", "ZN", 5, "", "ZN", True, 9.0, 0.0, 0.0)],
        "structure_id string, model int, chain string, resnum int, icode string, resname string, atom string, serial int, altloc string, element string, het boolean, x double, y double, z double",
    )
    letters = spark.createDataFrame([("ALA", "A"), ("GLY", "G")], "resname string, letter string")
    r = structures.inspect(atoms, letters, ["ZN"]).where("chain = 'A'").first()
    assert (r.residues, r.sequence, r.broken_backbone, r.altlocs) == (2, "AG", 1, 1)
    classes = spark.createDataFrame([("ZN", "metal")], "resname string, class string")
    assert structures.first_reject(structures.classify_residues(atoms, classes)).first().reject == "metal"
    expected = spark.createDataFrame([("GLY", "N"), ("GLY", "CA"), ("ALA", "N")], "resname string, atom string")
    m = structures.missing_atoms(atoms, expected, spark.createDataFrame([("s", 0.0, 0.0, 0.0)], "structure_id string, cx double, cy double, cz double"), 2.0).collect()
    assert [(x.resname, x.missing, x["inside"]) for x in m] == [("GLY", ["N"], False)]
    bonds = structures.bond_edges(spark.createDataFrame([("s", 2, [4, 99]), ("s", 4, [2])], "structure_id string, serial int, others array<int>"), atoms)
    assert {(x.a, x.b, x.kind) for x in bonds.collect()} == {(2, 4, "covalent"), (2, 99, "unresolved")}
    chains = spark.createDataFrame([("s", "A", "AG"), ("s", "B", "AG")], "structure_id string, chain string, sequence string")
    wanted = spark.createDataFrame([("s", "AG"), ("s", "XX")], "structure_id string, sequence string")
    assert {x.sequence: x.status for x in structures.assign_chains(wanted, chains).collect()} == {"AG": "AMBIGUOUS", "XX": "MISSING"}
    assert structures.element_counts(atoms).first().elements == {"C": 5, "ZN": 1}


def test_bonds_are_dealt_over_more_tasks_as_the_tables_grow(spark):
    from orepan.operators import structures

    rng = random.Random(9)
    atoms = [(s, n, rng.random() < 0.5) for s in ("a", "b", "c", None) for n in range(1, 21)] + [("a", 3, True)]
    records = [(s, rng.randint(1, 24), [rng.randint(1, 24) for _ in range(rng.randint(0, 4))]) for s in ("a", "b", "c", "d", None) for _ in range(12)] + [("b", 1, None)]
    pairs = {(s, min(n, o), max(n, o)) for s, n, others in records for o in others or []}
    end = lambda s, n: [h for t, m, h in atoms if s is not None and (t, m) == (s, n)] or [None]
    expected = sorted((str(s), a, b, "unresolved" if x is None or y is None else "covalent" if x != y else "inner") for s, a, b in pairs for x in end(s, a) for y in end(s, b))
    c, a = spark.createDataFrame(records, "structure_id string, serial int, others array<int>"), spark.createDataFrame(atoms, "structure_id string, serial int, het boolean")
    for dealt, more in (("SinglePartition", {}), (", 9)", {"most": 10})):
        bonds = structures.bond_edges(c, a, **more)
        assert sorted((str(r.structure_id), r.a, r.b, r.kind) for r in bonds.collect()) == expected
        plan = bonds._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and f"{dealt}, REPARTITION_BY_NUM" in plan


def test_predicted_complexes(spark):
    from orepan.operators import structures

    def residue(s, chain, num, name, atoms, start, bad=False):
        return [(s, 1, chain, num, "", name, a, e, start + i, float("nan") if bad and i == 0 else 1.0, 2.0, 3.0) for i, (a, e) in enumerate(atoms)]

    back = [("N", "N"), ("CA", "C"), ("C", "C")]
    lig = residue(0, "Z", 1, "LIG", [("C1", "C"), ("C2", "c"), ("O1", "O"), ("H1", "H")], 50)
    of = lambda s, rows: [(s, *r[1:]) for r in rows]
    good = residue(0, "A", 2, "GLY", back, 1) + residue(0, "A", 1, "ALA", back, 4) + residue(0, "B", 1, "ALA", back, 10) + residue(0, "B", 9, "HOH", [("O", "O")], 20) + lig
    cases = {
        "good": good, "order": residue(0, "B", 1, "ALA", back, 1) + residue(0, "A", 2, "GLY", back, 5) + residue(0, "A", 3, "ALA", back, 8) + lig, "backbone": residue(0, "A", 2, "GLY", back[:2], 1) + good[3:], "none": [r for r in good if r[2] != "Z"],
        "two": good + residue(0, "Z", 2, "LIG", [("C1", "C")], 60), "bare": [r for r in good if r[2] != "Z"] + residue(0, "Z", 1, "LIG", [("H1", "H")], 60), "other": good + residue(0, "C", 1, "ZN", [("ZN", "ZN")], 70), "nan": residue(0, "A", 2, "GLY", back, 1, True) + good[3:], "empty": [],
    }
    df = spark.createDataFrame([r for s, rows in cases.items() for r in of(s, rows)], "structure_id string, model int, chain string, resnum int, icode string, resname string, atom string, element string, serial int, x double, y double, z double")
    asked = spark.createDataFrame([(s, ["GA", "A"]) for s in cases], "structure_id string, sequences array<string>")
    letters = spark.createDataFrame([("ALA", "A"), ("GLY", "G")], "resname string, letter string")
    got = {r.structure_id: r for r in structures.predicted_complex(df, asked, letters).collect()}
    assert {s: r.reasons for s, r in got.items()} == {"good": [], "order": ["chains", "sequences"], "backbone": ["backbone"], "none": ["ligand"], "two": ["ligand"], "bare": ["ligand"], "other": ["molecules"], "nan": ["coordinates"], "empty": ["missing"]}
    assert got["good"].sequences == ["GA", "A"] and got["good"].elements == {"C": 2, "O": 1}
    p = spark.createDataFrame([(0.0, 0.0, 10.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    zero = (F.lit(0.0),) * 3
    assert [round(r.z, 9) for r in p.select(geometry.toward(tuple(F.col(c) for c in "xyz"), zero)[2].alias("z")).collect()] == [7.2, 0.5, 0.0]


def test_similarity_audit_agrees_with_brute_force(spark, tmp_path):
    from orepan.plans import registry

    rng, v = random.Random(31), [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    items = [(i, text(rng.randint(10, 40))) for i in range(12)] + [(50, "too short"), (51, None)]
    docs = [(i, "\n".join([text(rng.randint(0, 60)), items[i % 12][1], "a common line of six words"])) for i in range(150)]
    docs += [(900, docs[3][1]), (901, None), (902, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def sets(rows):
        first = {}
        for i, t in sorted(rows):
            first.setdefault(t, i)
        w = {i: t.split() for t, i in first.items() if t is not None}
        return {i: {" ".join(x[k : k + 5]) for k in range(len(x) - 4)} for i, x in w.items() if len(x) >= 5}

    expected = {(i, j, len(x & y)) for i, x in sets(docs).items() for j, y in sets(items).items() if len(x & y) / len(x | y) >= 0.1}
    got = registry.QUERIES["similarity_audit"](spark, str(tmp_path)).collect()
    assert len(got) == len(expected) >= 100 and {(r.left_id, r.right_id, r.common) for r in got} == expected


def test_lineage_does_not_end_early_in_silence(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "parent long, child long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert catalog.lineage(edges, roots, 4).count() == 5
    with pytest.raises(RuntimeError):
        catalog.lineage(edges, roots, 3)


def test_similarity_at_the_threshold_and_shingles_made_once(spark):
    """A subset at exactly the threshold is a pair; exploding shingles does not make a text's words anew for each."""
    from orepan.plans import registry  # noqa: F401  (loads the queries in their order)
    from orepan.plans import queries

    a = spark.createDataFrame([(1, list(range(55)))], "id int, tokens array<int>")
    b = spark.createDataFrame([(2, list(range(100))), (3, list(range(101)))], "id int, tokens array<int>")
    got = audit.token_similarity(a, b, 0.55).collect()
    assert [(r.left_id, r.right_id, r.common) for r in got] == [(1, 2, 55)]

    docs = spark.createDataFrame([(1, "a b  c d e f"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    flat = queries._shingle_sets(docs, "doc_id").select("id", F.explode("tokens").alias("t"))
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    want = spark.createDataFrame([("a b c d e",), ("b c d e f",)], "s string").select(F.xxhash64("s").alias("t"))
    assert sorted((r.id, r.t) for r in flat.collect()) == sorted((1, r.t) for r in want.collect())


def test_edit_similarity_keys_are_short(spark):
    """What the join of pieces shuffles are numbers, no texts or digests."""
    df = spark.createDataFrame([("a" * 30 + "b" * 30,), ("a" * 29 + "c" + "b" * 30,)], "seq string")
    e = audit.edit_similarity(df, df, 0.9)
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" not in plan and "sha2" not in plan
    assert len({(r.x, r.y) for r in e.collect()}) == 4


def test_edit_similarity_broadcasts_no_rows_of_pieces(spark):
    """What the driver holds are bands of lengths, however many pieces the sequences have."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(40)]
    a, b = (spark.createDataFrame([(s[:i] + c + s[i:],) for i, s in enumerate(base)], "seq string") for c in "xy")
    e = audit.edit_similarity(a, b, 0.9)
    assert sorted((r.x.replace("x", ""), round(r.identity, 9)) for r in e.collect()) == sorted((s, round(1 - 1 / 601, 9)) for s in base)

    def broadcast(plan):
        inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else None
        children = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
        own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "BroadcastExchange" else []
        return own + [n for c in children for n in broadcast(c)]

    assert max(broadcast(e._jdf.queryExecution().executedPlan()), default=0) < 40


def test_close_pairs_and_distances_equal_brute_force():
    """Few letters, repeats, empty texts and letters of several bytes, at thresholds with long, short and no pieces."""
    rng = random.Random(3)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    for letters in ("ab", "abé中\U0001f600") * 5:
        some = lambda n: ["".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([3, 12, 60])))) for _ in range(n)]  # noqa: B023, E731
        ys = [*some(12), "ab" * 25, "abb" * 17]
        xs = [*some(6), *(y[: len(y) // 2] + rng.choice(["", "a"]) + y[len(y) // 2 + 1 :] for y in ys)]
        apart = {(x, y): lev(x, y) for x in xs for y in ys}
        assert all(edits.distances(xs, y).tolist() == [apart[x, y] for x in xs] for y in ys)
        for t in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0):
            want = sorted((x, y, apart[x, y]) for x in xs for y in ys if (1 - apart[x, y] / max(len(x), len(y)) if x or y else 1) >= t - 1e-12)
            assert sorted(pair for y, some in edits.candidates(xs, ys, t) for pair in edits.near(y, some, t)) == want


def test_candidates_are_joined_to_matches(spark):
    """The restriction to candidates meets the matches, never the index."""
    features = [("A", [0.0, 0.0, 0.0]), ("B", [3.0, 0.0, 0.0]), ("C", [0.0, 4.0, 0.0])]
    objects = spark.createDataFrame([(i, 0, features) for i in range(4)], "object_id long, conformer_id int, features array<struct<type string, position array<double>>>")
    index = geometry.binned(geometry.triangles(objects))
    found = geometry.match_triangles(index, index.where("object_id = 0"), candidates=spark.createDataFrame([(1,), (3,)], "object_id long"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.index("LeftSemi") < plan.index("Inner")
    assert sorted(r.object_id for r in found.collect()) == [1, 3]
