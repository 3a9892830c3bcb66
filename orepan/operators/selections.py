"""Selection documents of two versions as one candidate table, and validation batches out of docking results.

A broken rule is a row, never a guess: a document or batch with any broken rule gives no candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import catalog

#: How many candidates a document may hold, and the media types that keep a receptor's or ligand's chemistry.
LEAST, MOST = 1, 16
RECEPTOR_MEDIA = ("chemical/x-pdb",)
LIGAND_MEDIA = ("chemical/x-mdl-sdfile", "chemical/x-sdf", "chemical/x-mdl-molfile", "chemical/x-mol2")

#: What each candidate has in the end; the columns from ``score`` on are null for bundles that do not carry them.
CANDIDATE = "candidate_id string, molecule_id string, microstate_id string, smiles string, receptor string, box_center array<double>, box_size array<double>, score double, score_semantics string, pose string, evidence string, heavy_element_counts map<string,int>"

_LEGACY = "struct<molecule_id:string,microstate_id:string,score:double,score_semantics:string,pose:string,evidence:string,box_center:array<double>,box_size:array<double>>"
_BUNDLE = "struct<" + ",".join(f"{k}:variant" for k in ("candidate_id", "molecule_id", "microstate_id", "canonical_isomeric_smiles", "receptor", "box_center", "box_size")) + ">"
_STATE = "struct<molecule_id:string,microstate_id:string,canonical_isomeric_smiles:string,heavy_element_counts:map<string,int>>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    """Whether a value is there and of this kind (a pattern on its schema)."""
    return F.coalesce(F.rlike(F.schema_of_variant(v), F.lit(f"^(?:{kind})$")), F.lit(False))


def _filled(v: Column) -> Column:
    """A string that is not blank, else null."""
    return F.when(_is(v, "STRING"), _nonblank(_get(v, "$", "string")))


def _nonblank(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def _numbers(v: Column) -> Column:
    """The values of an array, null for those that are no numbers; booleans and numbers in quotes do not count."""
    return F.transform(_get(v, "$", "array<variant>"), lambda x: F.when(_is(x, "BIGINT|DOUBLE|FLOAT|DECIMAL.*"), _get(x, "$", "double")))


def _vector(value: Column, positive: bool = False) -> Column:
    """Exactly three finite numbers (above 0), else null."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & ((x > 0) if positive else F.lit(True))
    return F.when((F.size(value) == 3) & F.forall(value, fine), value)


def _once(df: DataFrame) -> DataFrame:
    """``df`` with its columns made once a row: filters and projections above do not take their expressions apart."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def selected_id(molecule: Column, microstate: Column) -> Column:
    return F.concat(F.lit("selected-"), catalog.short_id({"schema_version": F.lit("2.0"), "molecule_id": molecule, "microstate_id": microstate}))


def _reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that are broken; an undefined rule counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))


def read_documents(docs: DataFrame, *, legacy_kind: str = "cofold-input-batch", bundle_kind: str = "selection-bundle") -> DataFrame:
    """One row a document: ``doc_id, version`` (legacy, bundle or null), ``reasons, candidates`` (``reasons`` and a candidate each).

    ``docs``: doc_id, document (JSON text), and what the run holds: screen, library, receptor (artifact ids).

    The version field and the kind choose the reading.  A bundle holds its candidates under ``candidates``, or else
    ``selected_candidates``.  A legacy batch holds scores of states: each retained molecule is taken with its best state,
    by score, then by state, with what the batch says of that state; ids are made of molecule and state.
    Documents of another kind, broken or null ones have the reason ``document``.
    """
    v = F.col("v")
    rows = docs.withColumn("v", F.try_parse_json("document"))
    schema, kind = _get(v, "$.schema_version", "string"), _get(v, "$.kind", "string")
    version = F.when((schema == "1.0") & (kind == legacy_kind), "legacy").when(schema.isin("1.0", "2.0") & (kind == bundle_kind), "bundle")

    # what is no array, or no object, has no such reading: null
    given = _get(F.coalesce(_get(v, "$.candidates", "variant"), _get(v, "$.selected_candidates", "variant")), "$", "array<variant>")

    # each step names what the next one uses more than once: a lambda's expressions are not shared
    def of_bundle(given: Column) -> Column:
        read = F.transform(given, lambda c: _get(c, "$", _BUNDLE))
        texts = ("candidate_id", "molecule_id", "microstate_id", "canonical_isomeric_smiles")
        cut = F.transform(read, lambda c: F.struct(c.isNotNull().alias("object"), *(_filled(c[k]).alias(k) for k in texts), c["receptor"].alias("receptor"), _numbers(c["box_center"]).alias("box_center"), _numbers(c["box_size"]).alias("box_size")))
        whole = F.transform(cut, lambda c: F.struct(*(c[k].alias(k) for k in ("object", *texts, "receptor")), _vector(c["box_center"]).alias("box_center"), _vector(c["box_size"], positive=True).alias("box_size")))

        def candidate(c: Column) -> Column:
            absent = c["receptor"].isNull() | F.is_variant_null(c["receptor"])
            rules = {"object": c["object"], **{k: c[k].isNotNull() for k in texts[:3]}, "smiles": c[texts[3]].isNotNull(), "box_center": c["box_center"].isNotNull(), "box_size": c["box_size"].isNotNull(), "receptor": absent | (_get(c["receptor"], "$", "string") == F.col("receptor"))}
            return _candidate(_reasons(rules), *(c[k] for k in texts), F.col("receptor"), c["box_center"], c["box_size"])

        return F.transform(whole, candidate)

    # by score (nulls last), then state; repeated evaluations in the order of the batch
    order = lambda e, i: F.struct(e["score"].isNull().alias("none"), e["score"].alias("score"), e["molecule_id"].alias("molecule_id"), e["microstate_id"].alias("microstate_id"), i.alias("i"), e.alias("e"))
    legacy = version == "legacy"
    evaluated = F.when(legacy, F.sort_array(F.transform(_get(v, "$.quick_vina.evaluated", f"array<{_LEGACY}>"), order)))
    states = F.when(legacy, _get(v, "$.microstates", f"array<{_STATE}>"))
    retained = F.when(legacy, _get(v, "$.quick_vina.retained_molecule_ids", "array<string>"))

    def of_legacy(retained: Column) -> Column:
        scored = F.transform(retained, lambda m: F.struct(m.alias("m"), F.get(F.filter(F.col("evaluated"), lambda e: e["molecule_id"] == m), F.lit(0))["e"].alias("best")))
        # of repeated states the last one counts
        state = lambda c: F.try_element_at(F.filter(F.col("states"), lambda s: (s["molecule_id"] == c["m"]) & (s["microstate_id"] == c["best"]["microstate_id"])), F.lit(-1))
        stated = F.transform(scored, lambda c: F.struct(c["m"].alias("m"), c["best"].alias("best"), state(c).alias("state")))

        def candidate(c: Column) -> Column:
            best, state = c["best"], c["state"]
            smiles = _nonblank(state["canonical_isomeric_smiles"])
            center = F.when(F.size(best["box_center"]) == 3, best["box_center"])
            size = F.when((F.size(best["box_size"]) == 3) & F.forall(best["box_size"], lambda x: x > 0), best["box_size"])
            rules = {"evaluation": best["score"].isNotNull(), "microstate": state.isNotNull(), "smiles": smiles.isNotNull(), "box_center": center.isNotNull(), "box_size": size.isNotNull()}
            return _candidate(_reasons(rules), selected_id(c["m"], best["microstate_id"]), c["m"], best["microstate_id"], smiles, F.col("receptor"), center, size, best["score"], best["score_semantics"], best["pose"], best["evidence"], state["heavy_element_counts"])

        return F.transform(stated, candidate)

    rows = _once(rows.select("doc_id", "screen", "library", "receptor", "v", version.alias("version"), given.alias("given"), evaluated.alias("evaluated"), states.alias("states"), retained.alias("retained")))
    count = F.coalesce(F.when(F.col("version") == "legacy", F.size("retained")).otherwise(F.size("given")), F.lit(-1))
    rows = rows.withColumn("counted", count.between(LEAST, MOST))
    none = F.array().cast(f"array<{_STRUCT}>")
    # a document that fails the count is opened too, as its candidates' broken rules are rows as well; ids are compared in short ones only
    found = F.coalesce(F.when(F.col("version") == "legacy", of_legacy(F.col("retained"))).when(F.col("version") == "bundle", of_bundle(F.col("given"))), none)
    rows = _once(rows.select("doc_id", "screen", "library", "receptor", "v", "version", "counted", found.alias("candidates")))
    ids = F.transform("candidates", lambda c: c["candidate_id"])
    pairs = F.transform("candidates", lambda c: F.struct(c["molecule_id"], c["microstate_id"]))
    unique = ~F.col("counted") | ((F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_distinct(pairs)) == F.size(pairs)))
    named = lambda path, column: _get(v, path, "string") == F.col(column)
    legacy_or = lambda holds: (F.col("version") == "legacy") | holds
    rules = {"count": F.col("counted"), "identities": unique, "screening_artifact": legacy_or(named("$.screening_artifact", "screen")), "library_index": legacy_or(named("$.library_index", "library")), "receptor": named("$.receptor", "receptor")}
    reasons = F.when(F.col("version").isNull(), F.array(F.lit("document"))).otherwise(_reasons(rules))
    return _once(rows.select("doc_id", "version", reasons.alias("reasons"), "candidates"))


_STRUCT = "struct<reasons:array<string>," + CANDIDATE.replace(", ", ";").replace(" ", ":").replace(";", ",") + ">"


def _candidate(reasons: Column, *values: Column) -> Column:
    fields = [f.split(" ", 1) for f in CANDIDATE.split(", ")]
    filled = list(values) + [F.lit(None)] * (len(fields) - len(values))
    return F.struct(reasons.alias("reasons"), *(x.cast(kind).alias(name) for x, (name, kind) in zip(filled, fields)))


def candidates(read: DataFrame) -> DataFrame:
    """``doc_id, version, place`` (from 1) and the candidate of every document without a broken rule."""
    whole = (F.size("reasons") == 0) & F.forall("candidates", lambda c: F.size(c["reasons"]) == 0)
    rows = read.where(whole).select("doc_id", "version", F.posexplode("candidates").alias("at", "c"))
    return rows.select("doc_id", "version", (F.col("at") + 1).alias("place"), *(F.col(f"c.{f.split(' ')[0]}") for f in CANDIDATE.split(", ")))


def violations(read: DataFrame) -> DataFrame:
    """``doc_id, place, reason``: every broken rule; ``place`` is null for rules on the document."""
    own = F.transform("reasons", lambda r: F.struct(F.lit(None).cast("int").alias("place"), r.alias("reason")))
    of_candidates = F.flatten(F.transform("candidates", lambda c, i: F.transform(c["reasons"], lambda r: F.struct((i + 1).alias("place"), r.alias("reason")))))
    return read.select("doc_id", F.inline(F.concat(own, of_candidates)))


# --- validation batches ---------------------------------------------------------------------------------------------------


def validation_batches(bundles: DataFrame, docked: DataFrame, references: DataFrame) -> DataFrame:
    """A batch for each docking bundle: ``bundle_id, reasons, n, scope, batch`` (canonical JSON) and ``batch_sha256``.

    ``bundles``: bundle_id, receptor, prepared_receptor (null: the receptor itself), receptor_media; ``docked``: bundle_id, place,
    candidate_id, molecule_id, microstate_id, pose_sdf, pose (either), pose_media, cofold (optional); ``references``: bundle_id,
    reference, reference_media (optional, at most one row a bundle; the smallest one counts).

    With a reference, a candidate also has ``reference_pose``, a ``spyrmsd`` part and the reference in the other parts;
    with a cofold structure ``cofold_pose``.  Else these are not there at all, rather than null.  Candidates of a bundle are
    at most ``MOST`` where its rules hold, so they are one array; of longer bundles the count alone is kept.
    """
    pose = F.coalesce("pose_sdf", "pose")
    n = docked.groupBy("bundle_id").agg(F.count("*").alias("n"))
    ref = references.groupBy("bundle_id").agg(F.min(F.struct("reference", "reference_media")).alias("ref"))
    heads = bundles.join(n, "bundle_id", "left").join(ref, "bundle_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    few = docked.join(heads.where(F.col("n") <= MOST).select("bundle_id"), "bundle_id", "left_semi")
    own = few.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("place", "candidate_id", "molecule_id", "microstate_id", pose.alias("pose"), "pose_media", "cofold"))).alias("docked"))
    rows = heads.join(own, "bundle_id", "left").withColumns({"docked": F.coalesce("docked", F.array().cast(own.schema["docked"].dataType)), "target": F.coalesce("prepared_receptor", "receptor"), "given": F.col("ref.reference")})
    ids = F.transform("docked", lambda c: c["candidate_id"])
    rules = {
        "receptor": F.col("target").isNotNull(),
        "receptor_media": F.col("receptor_media").isin(*RECEPTOR_MEDIA),
        "count": F.col("n").between(LEAST, MOST),
        "reference_scope": F.col("given").isNull() | (F.col("n") == 1),
        "reference_media": F.col("given").isNull() | F.col("ref.reference_media").isin(*LIGAND_MEDIA),
        "identities": (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda c: F.coalesce(c, F.lit("")) != ""),
        "pose": F.forall("docked", lambda c: c["pose"].isNotNull()),
        "pose_media": F.forall("docked", lambda c: F.coalesce(c["pose_media"].isin(*LIGAND_MEDIA), F.lit(False))),
    }

    def entry(c: Column) -> Column:
        ligand, reference, target = c["pose"], F.col("given"), F.col("target")
        only = lambda x: F.when(reference.isNotNull(), x)
        pair = [ligand.alias("docked_ligand"), target.alias("docked_receptor")]
        return F.struct(
            c["candidate_id"].alias("candidate_id"), c["cofold"].alias("cofold_pose"), ligand.alias("docked_pose"), c["microstate_id"].alias("microstate_id"), c["molecule_id"].alias("molecule_id"),
            F.struct(*pair, only(reference).alias("reference_ligand")).alias("posebusters"),
            F.struct(*pair, only(reference).alias("reference_ligand"), only(target).alias("reference_receptor")).alias("prolif"),
            only(reference).alias("reference_pose"), only(F.struct(ligand.alias("predicted_ligand"), reference.alias("reference_ligand"))).alias("spyrmsd"),
        )

    scope = F.when(F.col("given").isNotNull(), "VALIDATION_ONLY").otherwise("NOT_PROVIDED")
    body = F.to_json(F.struct(F.transform("docked", entry).alias("candidates"), F.col("bundle_id").cast("string").alias("docking_bundle"), F.lit("validation-input-batch").alias("kind"), scope.alias("reference_scope"), F.lit("2.0").alias("schema_version")))
    rows = rows.withColumn("reasons", _reasons(rules))
    batch = F.when(F.size("reasons") == 0, body)
    return rows.select("bundle_id", "reasons", "n", scope.alias("scope"), batch.alias("batch"), F.sha2(batch, 256).alias("batch_sha256"))


class BrokenBatches(ValueError):
    """Some batches broke a rule; nothing is left of the write."""


def write_batches(batches: DataFrame, path: str) -> dict[str, int]:
    """Writes whole batches as Parquet and returns the counts; a broken one fails the write as a whole.

    The counts are taken while the rows are written, so the guard costs no second scan.  ``path`` must be new.
    """
    seen = Observation("batches")
    broken = F.size("reasons") > 0
    each = reduce(lambda out, k: out | {f"broken_{k}": F.count_if(F.array_contains("reasons", F.lit(k)))}, ("receptor", "receptor_media", "count", "reference_scope", "reference_media", "identities", "pose", "pose_media"), {})
    counts = {"batches": F.count("*"), "broken": F.count_if(broken), "candidates": F.coalesce(F.sum("n"), F.lit(0).cast("long")), **each}
    batches.observe(seen, *(c.alias(k) for k, c in counts.items())).write.mode("errorifexists").parquet(path)
    found = seen.get
    if found["broken"]:
        spark = batches.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        raise BrokenBatches(", ".join(f"{k}: {n}" for k, n in sorted(found.items()) if n and k.startswith("broken")))
    return found
