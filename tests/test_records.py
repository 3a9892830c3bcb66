"""Experience records, dossiers, selection documents and validation batches on small fixtures."""

import hashlib
import json
import random

import pytest

from orepan.operators import experience, runs, selections

RUN = "run_id string, case_id string, mode string, last_stage string, receptor string, folded string, support string, smiles string, ligand string, manifest_sha256 string, code string"


def run(i, manifest="m1", last="REPORTED", receptor="r", smiles=None, ligand=None):
    return (i, "case", "both", last, receptor, "f", None, smiles, ligand, manifest, "clash")


def parts(spark, runs_, **others):
    kinds = {
        "output": "run_id string, artifact_id string", "failure": "run_id string, code string", "selected": "run_id string, place int, candidate_id string, molecule_id string", "graded": "run_id string, place int, candidate_id string, molecule_id string, grade string",
        "tool": "run_id string, name string, version string, place int", "preference": "run_id string, preference string, place int",
    }
    return experience.parts(run=spark.createDataFrame(runs_, RUN), **{k: spark.createDataFrame(v, kinds[k]) for k, v in others.items()})


def test_record_of_a_reported_run(spark):
    p = parts(
        spark,
        [run("b", smiles="CCO"), run("c", last="DOCKED"), run("d", receptor=None, ligand="lig")],
        output=[("b", "z"), ("b", "a"), ("b", "a"), ("x", "lost")],
        failure=[("b", "F2"), ("b", "F1"), ("b", "F2")],
        selected=[("b", 2, None, "m2"), ("b", 1, "c1", "m1"), ("b", 3, "", None)],
        graded=[("b", 1, "c1", "m9", "METHOD_CONSENSUS"), ("b", 2, "c2", "m1", "REFERENCE_SUPPORTED"), ("b", 3, None, "m0", "REDOCKING_RECOVERED"), ("b", 4, "c4", None, "NEW"), ("b", 5, "c5", "m5", None)],
        tool=[("b", "vina", "1.2", 2), ("b", "vina", " 1.1 ", 1), ("b", "vina", " ", 0), ("b", "meeko", "0.5", 1)],
        preference=[("b", "  ", 0), ("b", " slow ", 1)],
    )
    got = {r.run_id: r for r in experience.records(p).collect()}
    assert set(got) == {"b", "d"}
    b = got["b"]
    assert (b.receptor_identity, b.ligand_identity, b.evidence_grade, b.preference) == ("r", hashlib.sha256(b"CCO").hexdigest(), "REDOCKING_RECOVERED", "slow")
    assert b.selected_candidates == ["c1", "m2"] and b.failure_codes == ["F1", "F2"] and b.artifact_ids == ["a", "z"]
    assert [(x.candidate_id, x.molecule_id, x.evidence_grade) for x in b.candidate_evidence] == [("m0", "m0", "REDOCKING_RECOVERED"), ("c2", "m1", "REFERENCE_SUPPORTED"), ("c1", "m9", "METHOD_CONSENSUS"), ("c4", "unknown", "NEW")]
    assert [tuple(t) for t in b.toolchain] == [("meeko", "0.5"), ("vina", "1.1")]
    assert b.search_text == f"case b both r {b.ligand_identity} REDOCKING_RECOVERED c1 m2 F1 F2 meeko 0.5 vina 1.1 slow"
    body = {c: b[c] for c in ("case_id", "mode", "receptor_identity", "ligand_identity", "selected_candidates", "failure_codes", "artifact_ids", "preference", "source_manifest_sha256", "evidence_grade", "run_id")}
    body |= {"candidate_evidence": [x.asDict() for x in b.candidate_evidence], "toolchain": {t.name: t.version for t in b.toolchain}, "schema_version": "1.0", "kind": "experience-record", "stage": "REPORTED"}
    assert b.experience_id == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    d = got["d"]
    assert (d.receptor_identity, d.ligand_identity, d.evidence_grade, d.selected_candidates) == ("f", "lig", "UNKNOWN", [])
    assert d.search_text == "case d both f lig UNKNOWN    "


def test_rows_of_several_kinds_equal_single_parts(spark):
    from pyspark.sql import functions as F

    rows = [("b", 1, "a1", "F1", "1.0"), ("b", 2, "a0", None, " "), ("b", 3, "a2", "F0", "2.0")]
    wide = spark.createDataFrame(rows, "run_id string, place int, artifact_id string, code string, version string")
    held = experience.wide_parts(wide, output={"artifact_id": F.col("artifact_id")}, failure=(F.col("code").isNotNull(), {"code": F.col("code")}), tool=(F.col("place") > 1, {"name": F.lit("vina"), "version": F.col("version"), "place": F.col("place")}))
    one = parts(spark, [run("b")])
    many = parts(spark, [run("b")], output=[(r[0], r[2]) for r in rows], failure=[(r[0], r[3]) for r in rows if r[3]], tool=[(r[0], "vina", r[4], r[1]) for r in rows if r[1] > 1])
    assert held.dtypes == one.dtypes and held.count() == 3
    assert experience.records(one.unionByName(held)).collect() == experience.records(many).collect()


def test_registered_records_take_one_shuffle(spark):
    from orepan.plans import registry

    plan = registry.QUERIES["experience_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 2


def test_refresh_equals_a_rebuild_after_any_updates(spark):
    rng = random.Random(1)
    state = {}
    shown = lambda df: sorted((r.run_id, r.experience_id, r.search_text) for r in df.collect())
    store = None
    for step in range(4):
        for i in range(12):
            if rng.random() < 0.5:
                state[f"run{i}"] = (f"v{step}", rng.choice(["REPORTED", "REPORTED", "DOCKED"]), rng.choice("abc"))
        for i in rng.sample(sorted(state), 2):
            del state[i]
        p = parts(spark, [run(i, m, last) for i, (m, last, _) in state.items()], output=[(i, a) for i, (_, _, a) in state.items()])
        store = experience.records(p) if store is None else experience.refresh(store, p)
        store = spark.createDataFrame(store.collect(), store.schema)
        assert shown(store) == shown(experience.records(p))


def test_dossier_states(spark):
    r = spark.createDataFrame([("x", "B"), ("y", None), ("z", "C"), ("z", "A")], "run_id string, last_stage string")
    records = spark.createDataFrame([("x", "A", 1, 1.0), ("x", "A", 3, 3.0), ("x", "B", 2, 2.0), ("w", "A", 1, 1.0)], "run_id string, stage string, seq long, seconds double")
    receipts = spark.createDataFrame([("x", "A", 1, "POSTFLIGHT", "REJECTED", "a1"), ("x", "A", 2, "POSTFLIGHT", "ACCEPTED", "a2"), ("x", "A", 3, "PREFLIGHT", "REJECTED", "a3"), ("x", "B", 1, "POSTFLIGHT", "ACCEPTED", "b1"), ("x", "B", 2, "POSTFLIGHT", "REJECTED", "b2"), ("x", "other", 9, "POSTFLIGHT", "ACCEPTED", "o")], "run_id string, stage string, seq long, phase string, decision string, artifact_id string")
    failures = spark.createDataFrame([("x", "C", 1, True), ("y", "B", 1, True), ("y", "C", 2, False), ("z", "D", 5, True)], "run_id string, stage string, seq long, recoverable boolean")
    got = {(x.run_id, x.stage): x for x in runs.dossier_rows(r, ["A", "B", "C", "D"], records, receipts, failures).collect()}
    assert {k: v.status for k, v in got.items()} == {
        ("x", "A"): "COMPLETED_ACCEPTED", ("x", "B"): "COMPLETED_UNRECEIPTED", ("x", "C"): "BLOCKED_RETRYABLE", ("x", "D"): "PENDING", ("y", "A"): "NEXT", ("y", "B"): "PENDING", ("y", "C"): "FAILED", ("y", "D"): "PENDING",
        ("z", "A"): "PENDING", ("z", "B"): "PENDING", ("z", "C"): "PENDING", ("z", "D"): "BLOCKED_RETRYABLE",
    }
    assert (got["x", "A"].seconds, got["x", "A"].acceptance_receipt, got["x", "B"].accepted, got["x", "B"].acceptance_receipt) == (3.0, "a2", False, "b2")
    early = {(x.run_id, x.stage): x for x in runs.dossier_rows(r, ["A", "B", "C", "D"], records, receipts, failures, as_of=1).collect()}
    assert early["x", "A"].seconds == 1.0 and early["x", "A"].status == "COMPLETED_UNRECEIPTED" and early["y", "B"].status == "BLOCKED_RETRYABLE"


def candidate(i, **change):
    return {"candidate_id": f"c{i}", "molecule_id": f"m{i}", "microstate_id": "s", "canonical_isomeric_smiles": "C", "box_center": [0, 1.5, -2], "box_size": [1, 1, 1]} | change


def bundle(cands, **change):
    return {"schema_version": "2.0", "kind": "selection-bundle", "screening_artifact": "S", "library_index": "L", "receptor": "R", "candidates": cands} | change


def scored(m, s, score, **change):
    return {"molecule_id": m, "microstate_id": s, "score": score, "score_semantics": "lower", "pose": "p", "evidence": "e", "box_center": [0, 0, 0], "box_size": [2, 2, 2]} | change


def legacy(evaluated, retained, states=(("a", "s1"), ("a", "s2"), ("b", "s1")), **change):
    return {"schema_version": "1.0", "kind": "cofold-input-batch", "receptor": "R", "quick_vina": {"evaluated": evaluated, "retained_molecule_ids": retained}, "microstates": [{"molecule_id": m, "microstate_id": s, "canonical_isomeric_smiles": f"C{m}{s}", "heavy_element_counts": {"C": 2}} for m, s in states]} | change


def test_documents_of_both_versions(spark):
    docs = {
        1: bundle([candidate(1), candidate(2, receptor="R"), candidate(3, receptor=None)]),
        2: {k: v for k, v in bundle([], schema_version="1.0", selected_candidates=[candidate(7)]).items() if k != "candidates"},
        3: legacy([scored("a", "s2", -9), scored("a", "s1", -9), scored("b", "s1", -7.5), scored("c", "s1", -20)], ["b", "a"]),
        10: bundle([]), 11: bundle([candidate(i) for i in range(17)]), 12: bundle([candidate(1), candidate(1, molecule_id="x")]), 13: bundle([candidate(1), candidate(2, molecule_id="m1")]),
        14: bundle([candidate(1, box_size=[1, 0, 1]), candidate(2, box_center=[1, 2]), candidate(3, box_center=[1, 2, True]), candidate(4, box_size=["1", 1, 1]), candidate(5, canonical_isomeric_smiles=" "), candidate(6, molecule_id=5)]),
        15: bundle([candidate(1, receptor="other")], screening_artifact="T"), 16: bundle([candidate(1)], schema_version="3.0"), 17: bundle(5), 18: bundle(["text"]), 19: bundle([candidate(1)], receptor="Q"),
        20: legacy([scored("a", "s1", 1)], ["a", "b"]), 21: legacy([scored("a", "s9", 1)], ["a"]), 22: legacy([], []), 23: [1],
    }
    rows = [(i, json.dumps(d), "S", "L", "R") for i, d in docs.items()] + [(30, "{broken", "S", "L", "R"), (31, None, "S", "L", "R")]
    read = selections.read_documents(spark.createDataFrame(rows, "doc_id int, document string, screen string, library string, receptor string"))
    got = {(r.doc_id, r.place): r for r in selections.candidates(read).collect()}
    assert {k: r.candidate_id for k, r in got.items() if k[0] < 3} == {(1, 1): "c1", (1, 2): "c2", (1, 3): "c3", (2, 1): "c7"}
    key = hashlib.sha256(b'{"microstate_id":"s1","molecule_id":"a","schema_version":"2.0"}').hexdigest()[:20]
    a = got[3, 2]
    assert (a.candidate_id, a.version, a.microstate_id, a.smiles, a.score, a.heavy_element_counts, got[3, 1].molecule_id) == (f"selected-{key}", "legacy", "s1", "Cas1", -9.0, {"C": 2}, "b")
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2)} and got[1, 1].receptor == "R" and got[1, 1].score is None
    broken = sorted((r.doc_id, r.place or 0, r.reason) for r in selections.violations(read).collect())
    assert broken == sorted(
        [(10, 0, "count"), (11, 0, "count"), (12, 0, "identities"), (13, 0, "identities"), (14, 1, "box_size"), (14, 2, "box_center"), (14, 3, "box_center"), (14, 4, "box_size"), (14, 5, "smiles"), (14, 6, "molecule_id"), (15, 0, "screening_artifact"), (15, 1, "receptor"), (16, 0, "document"), (17, 0, "count")]
        + [(18, 1, r) for r in ("object", "candidate_id", "molecule_id", "microstate_id", "smiles", "box_center", "box_size")]
        + [(19, 0, "receptor"), (20, 2, "evaluation"), (20, 2, "microstate"), (20, 2, "smiles"), (20, 2, "box_center"), (20, 2, "box_size"), (21, 1, "microstate"), (21, 1, "smiles"), (22, 0, "count"), (23, 0, "document"), (30, 0, "document"), (31, 0, "document")]
    )


def test_validation_batches_and_their_guard(spark, tmp_path):
    b = spark.createDataFrame([(1, "r", None, "chemical/x-pdb"), (2, "r", "prep", "chemical/x-pdb"), (3, "r", None, "text/plain"), (4, "r", None, "chemical/x-pdb")], "bundle_id long, receptor string, prepared_receptor string, receptor_media string")
    docked = "bundle_id long, place int, candidate_id string, molecule_id string, microstate_id string, pose_sdf string, pose string, pose_media string, cofold string"
    sdf = "chemical/x-sdf"
    d = [(1, 1, "c1", "m", "s", "p1", "x", sdf, None), (2, 2, "c2", "m", "s", None, "p2", sdf, "fold"), (2, 1, "c1", "m", "s", "p1", None, sdf, None), (3, 1, "c1", "m", "s", "p", None, sdf, None), (4, 1, "c1", "m", "s", None, None, "x/y", None), (4, 2, "c1", "m", "s", "p", None, sdf, None)]
    refs = spark.createDataFrame([(1, "native", "chemical/x-mol2"), (4, "native", "text/plain")], "bundle_id long, reference string, reference_media string")
    found = selections.validation_batches(b, spark.createDataFrame(d, docked), refs)
    got = {r.bundle_id: r for r in found.collect()}
    with_reference = json.loads(got[1].batch)["candidates"][0]
    assert with_reference["spyrmsd"] == {"predicted_ligand": "p1", "reference_ligand": "native"} and with_reference["reference_pose"] == "native" and "cofold_pose" not in with_reference
    assert with_reference["prolif"] == {"docked_ligand": "p1", "docked_receptor": "r", "reference_ligand": "native", "reference_receptor": "r"}
    without = json.loads(got[2].batch)
    assert without["reference_scope"] == "NOT_PROVIDED" and [sorted(c) for c in without["candidates"]] == [["candidate_id", "docked_pose", "microstate_id", "molecule_id", "posebusters", "prolif"], ["candidate_id", "cofold_pose", "docked_pose", "microstate_id", "molecule_id", "posebusters", "prolif"]]
    assert without["candidates"][1]["posebusters"] == {"docked_ligand": "p2", "docked_receptor": "prep"}
    assert got[3].reasons == ["receptor_media"] and got[3].batch is None and got[4].reasons == ["reference_scope", "reference_media", "identities", "pose", "pose_media"]
    whole = selections.write_batches(found.where("bundle_id < 3"), f"{tmp_path}/good")
    assert whole["batches"] == 2 and whole["candidates"] == 3 and spark.read.parquet(f"{tmp_path}/good").count() == 2
    with pytest.raises(selections.BrokenBatches, match="broken_receptor_media: 1"):
        selections.write_batches(found, f"{tmp_path}/bad")
    assert not (tmp_path / "bad").exists()
    none = selections.validation_batches(b.limit(0), spark.createDataFrame(d, docked), refs)
    assert none.count() == 0


def test_long_documents_name_their_candidates_too(spark):
    """A document above the count still has a row for each broken rule of its candidates, in both versions."""
    of = lambda i: {"candidate_id": f"c{i % 2}", "molecule_id": "m", "microstate_id": "s", "canonical_isomeric_smiles": "" if i == 18 else "C", "box_center": [1, 2, 3], "box_size": [0 if i == 17 else 4, 4, 4]}
    head = {"schema_version": "1.0", "kind": "selection-bundle", "screening_artifact": "scr", "library_index": "lib", "receptor": "rec"}
    bundle = head | {"selected_candidates": [of(i) for i in range(1, 19)]}
    box = {"box_center": [1.0, 2.0, 3.0], "box_size": [4.0, 4.0, 4.0]}
    scores = [{"molecule_id": f"m{i}", "microstate_id": "s", "score": 1.0, "score_semantics": "lower", "pose": "p", "evidence": "e", **box} for i in range(1, 18)]
    states = [{"molecule_id": f"m{i}", "microstate_id": "s", "canonical_isomeric_smiles": "" if i == 2 else "C"} for i in range(1, 18)]
    legacy = {"schema_version": "1.0", "kind": "cofold-input-batch", "receptor": "rec", "quick_vina": {"evaluated": scores, "retained_molecule_ids": [f"m{i}" for i in range(1, 18)]}, "microstates": states}
    docs = spark.createDataFrame([(1, json.dumps(bundle), "scr", "lib", "rec"), (2, json.dumps(legacy), "scr", "lib", "rec"), (3, json.dumps(head), "scr", "lib", "rec")], "doc_id long, document string, screen string, library string, receptor string")
    read = selections.read_documents(docs)
    got = {tuple(r) for r in selections.violations(read).collect()}
    assert got == {(1, None, "count"), (1, 17, "box_size"), (1, 18, "smiles"), (2, None, "count"), (2, 2, "smiles"), (3, None, "count")}
    assert selections.candidates(read).isEmpty()
