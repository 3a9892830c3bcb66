"""Experience records: what a reported run was about, what it chose, and how far the evidence went.

All that is known of runs comes as one table of parts, each row tagged with what it is (``parts`` makes it; ``wide_parts``
of rows that are several at once).  One
shuffle by run then gives a nested row for each reported run.  ``refresh`` makes only the rows anew of runs whose
manifest changed, and equals a rebuild whatever the order of updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog

#: Grades from the best down, and what the canonical record says of itself.
GRADES = ("REDOCKING_RECOVERED", "REFERENCE_SUPPORTED", "METHOD_CONSENSUS", "CONSENSUS_SUPPORTED", "HYPOTHESIS_ONLY", "REJECTED")
PLACES = (0, 0, 1, 1, 2, 3)
UNKNOWN_PLACE = 99
SCHEMA_VERSION, KIND = "1.0", "experience-record"

#: The columns of each kind of part beside ``run_id``.
PARTS = {
    "run": "struct<case_id:string,mode:string,last_stage:string,receptor:string,folded:string,support:string,smiles:string,ligand:string,manifest_sha256:string>",
    "output": "struct<artifact_id:string>",
    "failure": "struct<code:string>",
    "selected": "struct<place:int,candidate_id:string,molecule_id:string>",
    "graded": "struct<place:int,candidate_id:string,molecule_id:string,grade:string>",
    "tool": "struct<name:string,version:string,place:int>",
    "preference": "struct<preference:string,place:int>",
}


def parts(**tables: DataFrame) -> DataFrame:
    """One table out of those of ``PARTS`` (any may be absent): ``run_id`` and a column a kind, null for other kinds.

    Columns beyond the named ones are not taken along.
    """
    out = None
    for kind, df in tables.items():
        fields = [f.split(":") for f in PARTS[kind][7:-1].split(",")]
        own = F.struct(*(F.col(c).cast(t).alias(c) for c, t in fields))
        rows = df.select("run_id", *(own.alias(k) if k == kind else F.lit(None).cast(t).alias(k) for k, t in PARTS.items()))
        out = rows if out is None else out.unionByName(rows)
    return out


def wide_parts(rows: DataFrame, **kinds: dict[str, Column] | tuple[Column, dict[str, Column]]) -> DataFrame:
    """A table as ``parts`` makes it, of rows that are parts of several kinds at once: what all kinds share is read once.

    ``rows`` has ``run_id``.  A kind's columns (as in ``PARTS``) stand alone or after the condition that a row is of it.
    """
    made = {}
    for kind, given in kinds.items():
        when, columns = given if isinstance(given, tuple) else (None, given)
        own = F.struct(*(columns[c].cast(t).alias(c) for c, t in (f.split(":") for f in PARTS[kind][7:-1].split(","))))
        made[kind] = own if when is None else F.when(when, own)
    return rows.select("run_id", *(made.get(k, F.lit(None)).cast(t).alias(k) for k, t in PARTS.items()))


def place_of(grade: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in zip(GRADES, PLACES) for x in pair)), grade), F.lit(UNKNOWN_PLACE))


def _text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def records(parts: DataFrame) -> DataFrame:
    """A row for each run that was reported to its end: ``experience_id``, the record's fields and ``search_text``.

    Selected candidates keep their order and go by their id or else by their molecule; those with neither are left out.
    Graded candidates without a grade are left out; the others go by grade, molecule and id, and the first one's grade is
    the run's, UNKNOWN without any.  A tool's version is the first one by place; so is a preference, blank ones do not
    count.  Of several run rows that with the largest manifest hash counts.  Runs without a run row, or with another last
    stage, give no record.
    """
    g = parts.groupBy("run_id").agg(
        F.max_by("run", F.struct("run.manifest_sha256", "run")).alias("run"),
        F.sort_array(F.collect_set("output.artifact_id")).alias("artifact_ids"),
        F.sort_array(F.collect_set("failure.code")).alias("failure_codes"),
        F.sort_array(F.collect_list("selected")).alias("selected"),
        F.collect_list("graded").alias("graded"),
        F.sort_array(F.collect_list(F.when(_text(F.col("tool.version")).isNotNull(), F.struct(F.col("tool.name").alias("name"), F.col("tool.place").alias("place"), F.trim("tool.version").alias("version"))))).alias("tools"),
        F.min(F.when(_text(F.col("preference.preference")).isNotNull(), F.struct("preference.place", F.trim("preference.preference").alias("text")))).alias("preference"),
    )
    g = g.where(F.col("run.last_stage") == "REPORTED")
    named = lambda s: F.coalesce(F.nullif(s["candidate_id"], F.lit("")), F.nullif(s["molecule_id"], F.lit("")))
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    evidence = F.sort_array(
        F.transform(
            F.filter("graded", lambda x: x["grade"].isNotNull()),
            lambda x: F.struct(place_of(x["grade"]).alias("p"), known(x["molecule_id"]).alias("molecule_id"), F.coalesce(x["candidate_id"], x["molecule_id"], F.lit("unknown")).alias("candidate_id"), x["grade"].alias("evidence_grade")),
        )
    )
    first_of_name = F.filter("tools", lambda t, i: (i == 0) | (F.get(F.col("tools"), i - 1)["name"] != t["name"]))
    rows = g.select(
        "run_id",
        F.col("run.case_id").alias("case_id"),
        F.col("run.mode").alias("mode"),
        known(F.coalesce("run.receptor", "run.folded", "run.support")).alias("receptor_identity"),
        known(F.coalesce(F.sha2(F.nullif("run.smiles", F.lit("")), 256), "run.ligand")).alias("ligand_identity"),
        F.filter(F.transform("selected", named), lambda c: c.isNotNull()).alias("selected_candidates"),
        evidence.alias("e"),
        "failure_codes",
        F.transform(first_of_name, lambda t: F.struct(t["name"].alias("name"), t["version"].alias("version"))).alias("toolchain"),
        "artifact_ids",
        F.col("preference.text").alias("preference"),
        F.col("run.manifest_sha256").alias("source_manifest_sha256"),
    )
    rows = rows.withColumn("evidence_grade", F.coalesce(F.get("e", F.lit(0))["evidence_grade"], F.lit("UNKNOWN")))
    rows = rows.withColumn("candidate_evidence", F.transform("e", lambda x: F.struct(x["candidate_id"], x["evidence_grade"], x["molecule_id"]))).drop("e")
    return rows.withColumns({"experience_id": F.sha2(canonical_record(rows), 256), "search_text": search_text()})


def canonical_record(rows: DataFrame) -> Column:
    """The record as canonical JSON; the toolchain as an object."""
    body = {c: F.col(c) for c in rows.columns if c != "toolchain"}
    body |= {"run_id": F.col("run_id").cast("string"), "toolchain": F.map_from_entries("toolchain"), "schema_version": F.lit(SCHEMA_VERSION), "kind": F.lit(KIND), "stage": F.lit("REPORTED")}
    return catalog.canonical(body)


def search_text() -> Column:
    words = lambda c: F.array_join(c, " ")
    tools = words(F.transform("toolchain", lambda t: F.concat_ws(" ", t["name"], t["version"])))
    return F.concat_ws(" ", "case_id", F.col("run_id").cast("string"), "mode", "receptor_identity", "ligand_identity", "evidence_grade", words(F.col("selected_candidates")), words(F.col("failure_codes")), tools, F.coalesce("preference", F.lit("")))


def changed_runs(existing: DataFrame, parts: DataFrame) -> DataFrame:
    """``run_id, gone`` of runs that the catalog lacks, that have another manifest now, or that are no longer reported."""
    now = parts.where("run is not null").groupBy("run_id").agg(F.max_by("run", F.struct("run.manifest_sha256", "run")).alias("run")).where("run.last_stage = 'REPORTED'").select("run_id", F.col("run.manifest_sha256").alias("now"))
    was = existing.select("run_id", F.col("source_manifest_sha256").alias("was"))
    both = now.withColumn("in_now", F.lit(True)).join(was.withColumn("in_was", F.lit(True)), "run_id", "full_outer")
    other = F.col("in_now").isNull() | F.col("in_was").isNull() | ~F.col("now").eqNullSafe(F.col("was"))
    return both.where(other).select("run_id", F.col("in_now").isNull().alias("gone"))


def refresh(existing: DataFrame, parts: DataFrame) -> DataFrame:
    """The catalog after an update: only the changed runs' parts are shuffled and made into records again.

    A run's parts may change only together with its manifest, which names them all.
    """
    changed = catalog.checkpointed(changed_runs(existing, parts))
    kept = existing.join(changed, "run_id", "left_anti")
    return kept.unionByName(records(parts.join(changed.where("not gone").select("run_id"), "run_id", "left_semi")))
