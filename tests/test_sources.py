import pytest
"""Readers, sinks and streaming feeds on small files."""

import datetime
import json
import random

from pyspark.sql import functions as F

from orepan.operators import runs
from orepan.sources import readers, sinks
from orepan.streaming import feeds


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_feature_library(spark, tmp_path):
    feature = {"type": "Donor", "position": [0.0, 1.0, 2.0], "atom_indices": [1]}
    lines = [json.dumps({"molecule_id": "a", "smiles": "C", "conformers": [{"id": 2, "features": [feature]}]}), "", json.dumps({"id": "b", "original_smiles": "N", "conformers": [{"conformer_id": 1, "features": []}]}), "{broken", json.dumps({"smiles": "x"})]
    good, bad = readers.read_features(spark, write(tmp_path / "l.jsonl", "\n".join(lines)))
    assert {(r.object_id, r.smiles, r.conformer_id) for r in good.collect()} == {("a", "C", 2), ("b", "N", 1)}
    assert bad.count() == 2


def test_smiles_and_tables(spark, tmp_path):
    p = write(tmp_path / "set.smi", "# head\nCCO ethanol\n\nc1ccccc1\n")
    assert [(r.record_index, r.smiles, r.name) for r in readers.read_smiles(spark, p).orderBy("record_index").collect()] == [(1, "CCO", "ethanol"), (2, "c1ccccc1", "set-000002")]
    t = readers.read_table(spark, write(tmp_path / "t.csv", "SMILES, Name\nC,x\n"), {"smiles": ["canonical_smiles"], "name": []})
    assert [tuple(r) for r in t.collect()] == [("C", "x")]


def test_sites(spark, tmp_path):
    p = write(tmp_path / "s.csv", "name, rank, score, probability, center_x, center_y, center_z, residue_ids, surf_atom_ids\np2, 2, 1.5, 0.4, 1, 2, 3, A_1 A_2, 5 6\np1, 1, 9.5, 0.9, 1, 2, 3, A_3, 7\np3, 3, x, 0.1, 1, 2, 3, , \n")
    got = readers.read_sites(spark, p, top=2).orderBy("place").collect()
    assert [(r.name, r.error) for r in got] == [("p1", None), ("p2", None), ("p3", "score")] and got[1].residue_ids == ["A_1", "A_2"]


def test_fasta_and_atoms_and_docking(spark, tmp_path):
    write(tmp_path / "f/a.fa", ">x\nmkt\nVV*\n")
    write(tmp_path / "f/b.fa", ">x\nM1\n")
    write(tmp_path / "f/c.fa", ">x\nM\n>y\nM\n")
    assert {(r.sequence, r.error) for r in readers.read_fasta(spark, str(tmp_path / "f")).collect()} >= {("MKTVV", None), ("M1", "alphabet")}
    line = "ATOM      1  CA AALA A  12      11.104   6.134  -6.504  0.50  0.00           C"
    got = readers.read_atoms(spark, write(tmp_path / "x.pdb", f"MODEL 1\n{line}\nENDMDL\nMODEL 2\n{line.replace('ATOM  ', 'HETATM')}\nEND\n")).orderBy("line_no").collect()
    assert [(r.model, r.atom, r.altloc, r.resname, r.chain, r.resnum, r.x, r.z, r.occ, r.element, r.het) for r in got] == [(1, "CA", "A", "ALA", "A", 12, 11.104, -6.504, 0.5, "C", False), (2, "CA", "A", "ALA", "A", 12, 11.104, -6.504, 0.5, "C", True)]
    d = readers.read_docking(spark, write(tmp_path / "d.pdbqt", "MODEL 1\nREMARK RESULT: -9.1\nENDMDL\nMODEL 2\nREMARK RESULT: -9.5\nENDMDL\nMODEL 3\nENDMDL\n")).orderBy("mode").collect()
    assert [(r.mode, r.score, r.error) for r in d] == [(1, -9.1, None), (2, -9.5, "order"), (3, None, "no_score")]


def test_manifest(spark, tmp_path):
    record = {"record_id": "t1", "split": "train", "protein_sequence": "MKT", "pdb_release_date": "2020-01-05", "label": "1"}
    doc = {"split_roles": {"train": "TRAIN"}, "pdb_training_cutoff_date": "2021-09-30", "records": [record, {**record, "record_id": "t2", "split": "other", "pdb_release_date": "2020-1-5"}]}
    rows, broken = readers.read_manifest(spark, write(tmp_path / "m.json", json.dumps(doc, indent=1)))
    assert rows.count() == 2 and {(r.record_id, r.rule) for r in broken.collect()} == {("t2", "role"), ("t2", "release_date")}


def test_scan_and_stream_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    for name, content in (("a.txt", "x"), ("sub/b.txt", "x"), ("c.bin", "y"), ("d.txt", "")):
        write(folder / name, content)
    scan = readers.scan_files(spark, str(folder), [".txt"])
    assert {(r.path.rsplit("/", 1)[1], r.skip_reason) for r in scan.collect()} == {("a.txt", None), ("b.txt", None), ("c.bin", "suffix")}
    assert readers.plan_id(scan).first() == readers.plan_id(scan.repartition(3)).first()
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    feeds.ingest_folder(spark, str(folder), table, mark).awaitTermination()
    write(folder / "e.txt", "y")
    write(folder / "f.txt", "new")
    feeds.ingest_folder(spark, str(folder), table, mark).awaitTermination()
    got = spark.read.parquet(table)
    assert got.count() == 3 == got.select("sha256").distinct().count() and got.where("state = 'QUARANTINED'").count() == 0


def test_stream_cursor_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    tools = ["s", "w", "v"]
    rows = [(f"u{u}", i, rng.choice([*tools, "x"]), rng.random() < 0.8, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=30 * i)) for u in range(12) for i in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    schema = "session_id string, seq int, tool string, ok boolean, ts timestamp"
    end = [("end", i, "x", True, datetime.datetime(2025, 1, 1)) for i in range(2)]
    for n, part in enumerate([rows[i::4] for i in range(4)] + [end[:1], end[1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"e/{n}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    feeds.state_store(spark)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "e/*"))
        q = feeds.tool_cursor(stream, tools, delay="1 hour").writeStream.format("memory").queryName("cursor").outputMode("update").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = {}
    for r in spark.table("cursor").where("session_id <> 'end'").collect():
        last[r.session_id] = max(last.get(r.session_id, (0, False)), (r.matched, r.passed))
    batch = runs.required_subsequence(spark.createDataFrame(rows, schema), tools)
    assert last == {r.session_id: (r.matched, r.passed) for r in batch.collect()} and len({m for m, _ in last.values()}) > 2


def test_latest_states_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("r", "a", 1, "FAILED", 1.0, "2024-01-01 00:00:00"), ("r", "a", 2, "DONE", 2.0, "2024-01-01 00:05:00")], "run_id string, stage string, seq int, status string, seconds double, t string").withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("run_id string, stage string, seq int, status string, seconds double, ts timestamp").parquet(str(tmp_path / "s"))
    q = feeds.latest_states(stream).writeStream.format("memory").queryName("latest").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.stage, r["last"].status, r.attempts) for r in spark.table("latest").collect()] == [("a", "DONE", 2)]


def test_objects_are_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary").withColumn("sha256", F.sha2("content", 256))
    assert sinks.store_objects(rows, str(tmp_path / "o")).count() == 2
    # a second delivery adds nothing, and what is not the content's digest is an error
    assert sinks.store_objects(rows.limit(2), str(tmp_path / "o")).count() == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    with pytest.raises(Exception, match="not the digest"):
        sinks.store_objects(rows.withColumn("sha256", F.lit("0")), str(tmp_path / "o"))
    lines = [r.line for r in sinks.markdown_table(rows.select("sha256", F.lit("x|y").alias("v")).distinct(), ["v"], ["sha256"]).orderBy("place").collect()]
    assert lines == ["| v |", "| --- |", "| x\\|y |", "| x\\|y |"]


def test_lines_of_a_large_file_are_numbered_by_its_splits(spark, tmp_path):
    lines = {name: [f"{name}{i} " + "x" * (i % 50) if i % 7 else "# note" if i % 2 else "" for i in range(n)] for name, n in (("a", 5000), ("b", 3), ("c", 1200))}
    for name, text in lines.items():
        write(tmp_path / f"{name}.smi", "\n".join(text) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = readers.numbered_lines(spark, str(tmp_path), notes=F.startswith("line", F.lit("#")))
        got = {(r.file[-5], r.line_no): (r.line, r.notes) for r in found.collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        for name, text in lines.items():
            notes = 0
            for i, line in enumerate(text):
                notes += line.startswith("#")
                assert got.pop((name, i)) == (line, notes)
        assert not got
        smiles = readers.read_smiles(spark, str(tmp_path)).collect()
        assert sorted((r.file[-5], r.record_index, r.smiles) for r in smiles) == sorted((n, i, x.split()[0]) for n, text in lines.items() for i, x in enumerate((x for x in text if x and x[0] != "#"), 1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_run_manifests(spark, tmp_path):
    doc = {"run_id": "a", "case_id": "c", "state": "DOCKED", "last_completed_stage": "INDEXED", "more": [1]}
    for name, text in (("1", json.dumps(doc, indent=1)), ("2", "{broken"), ("3", json.dumps({**doc, "run_id": "b"})), ("4", json.dumps({k: v for k, v in doc.items() if k != "state"})), ("5", "")):
        write(tmp_path / f"runs/{name}/manifest.json", text)
    write(tmp_path / "runs/1/other.json", json.dumps({**doc, "run_id": "no"}))
    got = readers.read_runs(spark, str(tmp_path / "runs"), "run_id string, case_id string, state string, last_completed_stage string")
    assert sorted(r.run_id for r in got.collect()) == ["a", "b"]


def test_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Few keys or a small table do not leave the writing of files to one task."""
    from pathlib import Path

    from orepan.plans import registry  # before its parts
    from orepan.plans import files

    df = spark.range(40, numPartitions=4).select(F.col("id").cast("string").alias("line"), F.lit(1).alias("k"))
    path = files._as_text(df, F.col("line"), "few", by="k", whole=False)
    assert len(list(Path(path.removeprefix("file:")).glob("k=1/part-*"))) == 4

    spark.range(1, 61, numPartitions=1).selectExpr("id AS s_suppkey", "1 AS s_nationkey", "1.0D AS s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    seen = []
    monkeypatch.setattr(readers, "read_runs", lambda spark, path, *a, read=readers.read_runs, **b: (seen.append(path), read(spark, path, *a, **b))[1])
    assert registry.QUERIES["run_manifests"](spark, str(tmp_path)).count() == sum(k % 7 != 0 and k % 5 != 0 for k in range(1, 61))
    names = [p.name for p in Path(seen[0].removeprefix("file:")).glob("part-*")]
    assert len(names) == 60 and len({n.split("-")[1] for n in names}) > 1
