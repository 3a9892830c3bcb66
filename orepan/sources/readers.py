"""Scans of the file formats that screening and audit data come in.

Every reader is a Spark scan with a fixed schema.  Bad rows are not dropped silently: they come back
with an ``error`` (or in the corrupt-record column) so that the caller can count and show them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FEATURES = "array<struct<type:string,position:array<double>,atom_indices:array<int>>>"
FEATURE_SCHEMA = f"molecule_id string, id string, smiles string, original_smiles string, source string, conformers array<struct<id:int,conformer_id:int,features:{FEATURES}>>, _bad string"


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines feature library: (conformer rows, bad lines).  Blank lines are skipped; aliases are merged."""
    raw = spark.read.schema(FEATURE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    who = F.coalesce("molecule_id", F.col("id"))
    ok = F.col("_bad").isNull() & who.isNotNull() & (F.size("conformers") > 0)
    rows = raw.where(ok).select(who.alias("object_id"), F.coalesce("smiles", "original_smiles").alias("smiles"), "source", F.inline("conformers"))
    good = rows.select("object_id", "smiles", "source", F.coalesce("id", "conformer_id", F.lit(0)).alias("conformer_id"), "features")
    return good, raw.where(~ok).select(F.coalesce("_bad", F.to_json(F.struct("molecule_id", "smiles"))).alias("line"))


def numbered_lines(spark: SparkSession, path: str, **marks: Column) -> DataFrame:
    """``file, line_no`` (from 0)``, line`` of text files, a large file read by many tasks.

    Each of ``marks``, a condition on ``line``, adds a column of that name: how many lines of the file up to and
    with this one meet it.  Lines are numbered in each split of a file; the splits' totals, one small row
    each, tell how many lines and marked ones stand before a split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    hit = {k: F.coalesce(c, F.lit(False)).cast("int") for k, c in marks.items()}
    totals = raw.groupBy("file", "block").agg(F.count("*").alias("lines"), *(F.sum(c).alias(k) for k, c in hit.items()))
    above = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("file").alias("f_"), F.col("block").alias("b_"), *(F.coalesce(F.sum(k).over(above), F.lit(0)).alias(f"before_{k}") for k in ("lines", *marks)))
    own = W.partitionBy("file", "block").orderBy("at")
    rows = raw.withColumns({"n": F.row_number().over(own), **{k: F.sum(c).over(own) for k, c in hit.items()}})
    met = rows.join(before, (F.col("file") == F.col("f_")) & (F.col("block") == F.col("b_")))
    return met.select("file", (F.col("before_lines") + F.col("n") - 1).alias("line_no"), "line", *((F.col(f"before_{k}") + F.col(k)).alias(k) for k in marks))


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """``text [name]`` a line; blank lines and ``#`` comments out; unnamed rows get the file's stem and a number."""
    record = (F.trim("line") != "") & ~F.startswith(F.ltrim("line"), F.lit("#"))
    rows = numbered_lines(spark, path, record_index=record).where(record)
    parts = F.split(F.trim("line"), r"\s+", 2)
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select("file", F.col("record_index").cast("int").alias("record_index"), F.get(parts, F.lit(0)).alias("smiles"), F.coalesce(F.get(parts, F.lit(1)), F.format_string("%s-%06d", stem, "record_index")).alias("name"))


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by case-insensitive header; of several aliases the first that is present and not null."""
    by_name = {c.lower().strip(): c for c in df.columns}
    found = {name: [F.col(f"`{by_name[a]}`") for a in [name, *others] if a in by_name] for name, others in aliases.items()}
    missing = [k for k, v in found.items() if not v]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return df.select(*(F.coalesce(*v).alias(k) for k, v in found.items()))


def read_table(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """CSV or Parquet by its suffix, with column aliases."""
    df = spark.read.option("header", True).csv(path) if path.lower().endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    return with_aliases(df, aliases)


def read_sites(spark: SparkSession, path: str, top: int = 3) -> DataFrame:
    """Site predictions: trimmed and typed, with an error where a value is missing or out of range; the best per file."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    num = lambda c: F.col(c).try_cast("double")
    ids = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda x: x != "")
    rows = raw.select("file", "name", F.col("rank").try_cast("int").alias("rank"), *(num(c).alias(c) for c in ("score", "probability", "center_x", "center_y", "center_z")), ids("residue_ids").alias("residue_ids"), ids("surf_atom_ids").alias("surf_atom_ids"))
    bad = F.when(F.col("rank").isNull() | (F.col("rank") < 1), "rank").when(F.col("score").isNull() | F.isnan("score"), "score").when(F.col("probability").isNull() | ~F.col("probability").between(0, 1), "probability").when(F.col("center_x").isNull() | F.col("center_y").isNull() | F.col("center_z").isNull(), "center")
    own = W.partitionBy("file").orderBy(F.col("error").isNotNull(), "rank", F.desc("score"), "name")
    return rows.withColumn("error", bad).withColumn("place", F.row_number().over(own)).where((F.col("place") <= top) | F.col("error").isNotNull())


def read_fasta(spark: SparkSession, path: str, alphabet: str = "ACDEFGHIKLMNPQRSTVWYBXZUOJ") -> DataFrame:
    """One record a file: header, upper-case sequence without a closing ``*``, and an error code."""
    whole = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("l"))
    lines = F.filter("l", lambda x: F.trim(x) != "")
    heads = F.filter(lines, lambda x: F.startswith(x, F.lit(">")))
    body = F.upper(F.array_join(F.transform(F.filter(lines, lambda x: ~F.startswith(x, F.lit(">"))), lambda x: F.regexp_replace(x, r"\s", "")), ""))
    seq = F.regexp_replace(body, r"\*$", "")
    error = F.when(F.size(heads) != 1, "record_count").when(F.length(seq) == 0, "empty").when(~F.rlike(seq, F.lit(f"^[{alphabet}]+$")), "alphabet")
    return whole.select("file", F.get(heads, F.lit(0)).alias("header"), seq.alias("sequence"), error.alias("error"))


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width ATOM and HETATM lines as an atoms table; the model number counts MODEL lines above."""
    kind = F.trim(F.substring("line", 1, 6))
    numbered = numbered_lines(spark, path, model=kind == "MODEL").withColumns({"kind": kind, "model": F.greatest(F.lit(1), F.col("model"))})
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    atoms = numbered.where(F.col("kind").isin("ATOM", "HETATM"))
    return atoms.select(
        F.col("file").alias("structure_id"), F.col("line_no").cast("int").alias("line_no"), F.col("model").cast("int").alias("model"), cut(7, 5).try_cast("int").alias("serial"), cut(13, 4).alias("atom"), cut(17, 1).alias("altloc"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"),
        cut(23, 4).try_cast("int").alias("resnum"), cut(27, 1).alias("icode"), *(cut(a, 8).try_cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))), F.coalesce(cut(55, 6).try_cast("double"), F.lit(1.0)).alias("occ"), F.upper(cut(77, 2)).alias("element"), (F.col("kind") == "HETATM").alias("het"),
    )


def read_docking(spark: SparkSession, path: str, score: str = r"RESULT:\s+(-?\d+(?:\.\d+)?)") -> DataFrame:
    """One row a MODEL block: its mode and score; an error where the score is missing, repeated or falls in order."""
    whole = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file"), F.filter(F.split("value", "ENDMDL"), lambda b: F.contains(b, F.lit("MODEL"))).alias("b"))
    rows = whole.select("file", F.posexplode("b").alias("i", "block")).withColumn("found", F.regexp_extract_all("block", F.lit(score), F.lit(1)))
    rows = rows.select("file", (F.col("i") + 1).alias("mode"), F.size("found").alias("n"), F.get("found", F.lit(0)).try_cast("double").alias("score"))
    before = F.lag("score").over(W.partitionBy("file").orderBy("mode"))
    return rows.withColumn("error", F.when(F.col("n") == 0, "no_score").when(F.col("n") > 1, "score_repeated").when(F.col("score") < before, "order")).drop("n")


def scan_files(spark: SparkSession, path: str, suffixes: list[str], max_bytes: int = 64 << 20) -> DataFrame:
    """All files below ``path``: relative name, size, digest, and why one would be skipped.

    Spark's scan leaves out files of no bytes.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    skip = F.when(~suffix.isin([s.lower() for s in suffixes]), "suffix").when(F.col("length") > max_bytes, "too_large").when(F.col("length") == 0, "empty")
    rows = listed.select("path", F.col("length").alias("size"), "modificationTime", skip.alias("skip_reason"), F.when(F.col("length") <= max_bytes, F.sha2("content", 256)).alias("sha256"))
    return rows.withColumn("sha256", F.when(F.col("skip_reason").isNull(), F.col("sha256")))


def plan_id(scan: DataFrame, path_col: str = "path") -> DataFrame:
    """One hash that stands for a scan's files: over the row hashes in order, summed before they meet."""
    rows = scan.where("skip_reason is null").select(F.sha2(F.concat_ws("\0", path_col, F.col("size").cast("string"), "sha256"), 256).alias("h"))
    # an order-free sum of the rows' hashes, so no task holds the listing
    return rows.agg(F.count("*").alias("files"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5))), 256).alias("plan_id"))


def read_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark suite lines, and the ids that stand more than once."""
    rows = spark.read.schema("id string, messages array<struct<role:string,content:string>>, max_tokens int, checks struct<min_chars:int,contains:array<string>,excludes:array<string>>").json(path)
    return rows, rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")


MANIFEST = """dataset struct<name:string,version:string,license:string,source:string>, split_roles map<string,string>, pdb_training_cutoff_date string,
records array<struct<record_id:string,split:string,protein_sequence:string,sequence_cluster_id:string,pocket_artifact_sha256:string,pocket_cluster_id:string,pdb_id:string,pdb_release_date:string,
assay_id:string,replicate_group_id:string,target_identity:string,compound_parent_identity:string,label:string>>"""


def iso_date(text: Column) -> Column:
    """The date of a canonical ISO text, null for any other form."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, day)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A leakage manifest: (records with their role and dates, violations with their record and rule)."""
    doc = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    rows = doc.select(F.col("split_roles").alias("roles"), iso_date(F.col("pdb_training_cutoff_date")).alias("cutoff"), F.inline("records"))
    rows = rows.withColumns({"role": F.try_element_at("roles", "split"), "released": iso_date(F.col("pdb_release_date"))})
    rules = {"record_id": F.col("record_id").isNull(), "role": F.col("role").isNull(), "release_date": F.col("pdb_release_date").isNotNull() & F.col("released").isNull(), "pocket_sha256": F.col("pocket_artifact_sha256").isNotNull() & ~F.rlike("pocket_artifact_sha256", F.lit("^[0-9a-f]{64}$")), "sequence": F.col("protein_sequence").isNotNull() & ~F.rlike("protein_sequence", F.lit("^[A-Z]+$"))}
    broken = rows.select("record_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
    return rows, broken


def read_runs(spark: SparkSession, path: str, schema: str, *, required: tuple[str, ...] = ("run_id", "case_id", "state", "last_completed_stage"), name: str = "manifest.json") -> DataFrame:
    """Run manifests (files called ``name``, a pattern) below a folder; files that are no valid JSON, or lack a required field, are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", name).option("recursiveFileLookup", True).json(path)
    return rows.where(F.forall(F.array(*(F.col(c).isNotNull() for c in required)), lambda x: x))
