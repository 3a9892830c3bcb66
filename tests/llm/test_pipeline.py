import random

import corpus_pipeline
from orepan.llm import queries

from .conftest import words


def test_pipeline_over_a_small_corpus(spark, tmp_path):
    rng, v = random.Random(9), [f"w{i}" for i in range(3000)]
    item = words(rng, 40, v)
    rows = [(i, words(rng, 150, v)) for i in range(120)]
    rows += [(200, rows[0][1]), (201, " ".join(["new", *rows[1][1].split()[1:]])), (202, rows[2][1] + " " + item), (203, None), (None, words(rng, 60, v)), (204, " ".join(("grobnik slurmo " + words(rng, 10, v)) for _ in range(5)))]
    labels = []
    for i in range(300, 420):
        bad = i % 2
        rows.append((i, " ".join((("grobnik slurmo " if bad else "") + words(rng, 10, v)) for _ in range(5))))
        labels.append((i, 1, bad))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, left = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == list(corpus_pipeline.COLUMNS)
        d.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in d.select("doc_id").collect()}
    every = {i for i, _ in rows}
    assert 204 not in left["toxicity"] and {0, 1, 2, 203, None} <= left["toxicity"]
    assert left["line_dedup"] == left["toxicity"]
    assert {0, 1, None} <= left["near_duplicates"] and not {201, 203} & left["near_duplicates"]
    assert 202 not in left["decontamination"] and set(range(3, 100)) <= left["decontamination"] <= every
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == left["decontamination"]


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(queries.queries())
