"""Registered queries of the file formats: the driver's tables written in a format and read back by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..sources import readers, sinks
from .bindings import LINES_SQL, POINTS_SQL, lines, objects, table
from .queries import r6
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{catalog.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_text(df: DataFrame, line, name: str, *, by: str | None = None, whole: bool = True) -> str:
    """Write one line (or block) a row; ``by``: one folder a value, of one file if ``whole``, else of a file a task."""
    path = _folder(df.sparkSession, name)
    if by is None:
        df.select(line.alias("value")).write.text(path)
    else:
        rows = df.select(line.alias("value"), F.col(by).alias("k"))
        (rows.repartition("k") if whole else rows).write.partitionBy("k").text(path)
    return path


def _key(kind: str = "int"):
    """The folder of a row's file is its key."""
    return F.regexp_extract("file", r"/k=([^/]+)/", 1).cast(kind)


@query(f"WITH {POINTS_SQL} SELECT o AS object_id, count(*) AS points, round(sum(x), 6) AS x FROM pts GROUP BY 1")
def feature_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point objects as a JSON-lines library; blank and broken lines between them are told apart."""
    o = objects(spark, sf_dir)
    doc = F.to_json(F.struct(F.col("object_id").cast("string").alias("molecule_id"), F.lit("C").alias("smiles"), F.array(F.struct(F.col("conformer_id").alias("id"), "features")).alias("conformers")))
    path = _as_text(o, F.concat(doc, F.when(F.col("object_id") % 5 == 0, "\n\n{broken").otherwise("")), "features")
    good, _ = readers.read_features(spark, path)
    f = good.select(F.col("object_id").cast("long").alias("object_id"), F.explode("features").alias("f"))
    return f.groupBy("object_id").agg(F.count("*").alias("points"), r6(F.sum(F.get("f.position", F.lit(0)))).alias("x"))


@query("SELECT replace(p_name, ' ', '-') AS smiles, CASE WHEN p_partkey % 3 = 0 THEN 'part ' || p_partkey ELSE 'p' || p_partkey END AS name FROM part")
def smiles_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of texts with names; comments and blank lines out."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("part "), F.col("p_partkey"))).otherwise(F.concat(F.lit("p"), F.col("p_partkey")))
    line = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("  "), name, F.when(F.col("p_partkey") % 4 == 0, "\n# a comment\n").otherwise(""))
    return readers.read_smiles(spark, _as_text(table(spark, sf_dir, "part"), line, "smiles")).select("smiles", "name")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment) AS smiles FROM customer")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV by case-insensitive headers, with an alias for a column that may be empty."""
    path = _folder(spark, "table") + ".csv"
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("Smiles"), F.col("c_mktsegment").alias("CANONICAL_SMILES")).write.option("header", True).csv(path)
    return readers.read_table(spark, path, {"id": [], "smiles": ["canonical_smiles"]})


@query("WITH s AS (SELECT s_nationkey AS k, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS rank, s_acctbal AS score, s_suppkey % 100 / 100.0 AS p FROM supplier) SELECT k, rank, round(score, 6) AS score, 2 AS residues FROM s WHERE rank <= 3")
def site_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted sites, the three best of each file."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("pocket"), rank).alias("name"), rank.alias("rank"), F.col("s_acctbal").alias("score"), (F.col("s_suppkey") % 100 / 100).alias("probability"), *(F.lit(1.0).alias(f"center_{c}") for c in "xyz"), F.lit("A_1 A_2").alias("residue_ids"), F.lit(" 7 8 9").alias("surf_atom_ids"))
    path = _folder(spark, "sites")
    s.repartition("k").write.partitionBy("k").option("header", True).csv(path)
    sites = readers.read_sites(spark, path)
    return sites.where("error is null").select(_key().alias("k"), "rank", r6(F.col("score")).alias("score"), F.size("residue_ids").alias("residues"))


@query("SELECT n_nationkey AS k, '>' || n_name AS header, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) END AS sequence, CASE WHEN n_nationkey % 5 = 4 THEN 'empty' END AS error FROM nation")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence a file, folded into lines and ended by a mark."""
    letters = F.regexp_replace("n_name", "[^A-Za-z]", "")
    body = F.when(F.col("n_nationkey") % 5 == 4, "").otherwise(F.concat(F.lower(F.left(letters, F.lit(3))), F.lit("\n"), F.substring(letters, 4, 100), F.lit("*")))
    path = _as_text(table(spark, sf_dir, "nation"), F.concat(F.lit(">"), F.col("n_name"), F.lit("\n"), body), "fasta", by="n_nationkey")
    return readers.read_fasta(spark, path).select(_key().alias("k"), "header", "sequence", "error")


@query(f"WITH {LINES_SQL} SELECT l_linenumber AS model_records, CAST(l_suppkey % 7 AS INTEGER) AS resnum, l_returnflag AS chain, count(*) AS atoms, round(sum(round(l_quantity, 3)), 3) AS x, round(sum(round(l_extendedprice % 1000, 3)), 3) AS z, count(*) FILTER (l_linestatus = 'O') AS het FROM lines GROUP BY 1, 2, 3")
def pdb_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as fixed-width records, read back as atoms; a folder a line number, as few numbers hold all rows."""
    m = table(spark, sf_dir, "lineitem")
    line = F.format_string("%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.when(F.col("l_linestatus") == "O", "HETATM").otherwise("ATOM"), (F.col("l_orderkey") % 99999).cast("int"), F.lit(" CA"), F.lit(""), F.lit("ALA"), F.col("l_returnflag"), (F.col("l_suppkey") % 7).cast("int"), F.lit(""), F.round("l_quantity", 3), F.lit(0.0), F.round(F.col("l_extendedprice") % 1000, 3), F.lit(1.0), F.lit(0.0), F.lit("C"))
    a = readers.read_atoms(spark, _as_text(m, line, "pdb", by="l_linenumber", whole=False)).withColumnRenamed("structure_id", "file")
    rows = a.groupBy(_key().alias("model_records"), "resnum", "chain")
    return rows.agg(F.count("*").alias("atoms"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("z"), 3).alias("z"), F.count_if("het").alias("het"))


@query("WITH p AS (SELECT s_nationkey AS k, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS mode FROM supplier), q AS (SELECT *, lag(s_acctbal) OVER (PARTITION BY k ORDER BY mode) AS before FROM p) SELECT k, CAST(mode AS INTEGER) AS mode, round(s_acctbal, 3) AS score, CASE WHEN round(s_acctbal, 3) < round(before, 3) THEN 'order' END AS error FROM q")
def docking_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model blocks with one score each; scores that fall are errors."""
    block = F.format_string("MODEL %d\nREMARK RESULT: %.3f 0 0\nENDMDL\n", "s_suppkey", "s_acctbal")
    whole = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", block.alias("b")))), lambda x: x["b"]), "").alias("b"))
    d = readers.read_docking(spark, _as_text(whole, F.col("b"), "docking", by="s_nationkey"))
    return d.select(_key().alias("k"), "mode", "score", "error")


@query("SELECT n_nationkey AS k, CAST(length(n_name) + 1 AS BIGINT) AS size, CASE WHEN length(n_name) + 1 > 12 THEN 'too_large' END AS skip_reason, CASE WHEN length(n_name) + 1 <= 12 THEN sha256(n_name || chr(10)) END AS sha256 FROM nation")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder with their size and digest, or why they are skipped."""
    s = readers.scan_files(spark, _as_text(table(spark, sf_dir, "nation"), F.col("n_name"), "files", by="n_nationkey"), [".txt"], max_bytes=12)
    return s.withColumnRenamed("path", "file").select(_key().alias("k"), "size", "skip_reason", "sha256")


@query("SELECT 'c' || conv_id AS id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def suite_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suite cases that repeat an id."""
    doc = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id")).alias("id"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"), F.lit(64).alias("max_tokens")))
    return readers.read_suite(spark, _as_text(table(spark, sf_dir, "conversations"), doc, "suite"))[1]


@query("SELECT 'r' || o_orderkey AS record_id, CASE WHEN o_orderkey % 4 = 0 THEN 'release_date' ELSE 'role' END AS rule FROM orders WHERE o_orderkey % 4 = 0 OR o_orderpriority = '5-LOW'" " EXCEPT SELECT 'r' || o_orderkey, 'role' FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT 'r' || o_orderkey, 'role' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderpriority = '5-LOW'")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests (one a priority) whose records break rules: dates in another form, a split without a role."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    record = F.struct(F.concat(F.lit("r"), F.col("o_orderkey")).alias("record_id"), F.col("o_orderpriority").alias("split"), F.when(F.col("o_orderkey") % 4 == 0, F.replace(day, F.lit("-"), F.lit("/"))).otherwise(day).alias("pdb_release_date"))
    roles = F.create_map(*(F.lit(x) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED") for x in (p, "TRAIN")))
    docs = o.groupBy((F.col("o_orderkey") % 16).alias("m")).agg(F.collect_list(record).alias("records")).select("m", F.to_json(F.struct(roles.alias("split_roles"), F.lit("1996-01-01").alias("pdb_training_cutoff_date"), "records")).alias("doc"))
    return readers.read_manifest(spark, _as_text(docs, F.col("doc"), "manifests", by="m"))[1]


@query("SELECT sha256(text) AS sha256, CAST(octet_length(encode(min(text))) AS BIGINT) AS size FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second delivery adds to a store of objects by digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("content"))
    path = _folder(spark, "store")
    sinks.store_objects(d.where("doc_id % 2 = 0").drop("doc_id"), path)
    added = sinks.store_objects(d.where("doc_id % 2 = 1").drop("doc_id"), path)
    return added.select("sha256", F.length("content").cast("long").alias("size"))


@query("SELECT CAST(place AS BIGINT) AS place, line FROM (SELECT 0 AS place, '| c_custkey | c_mktsegment |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey), '| ' || c_custkey || ' | ' || c_mktsegment || ' |' FROM customer)")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as the lines of a report."""
    return sinks.markdown_table(table(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment"], ["c_acctbal desc", "c_custkey"])


@query(f"WITH {POINTS_SQL} SELECT count(DISTINCT o) AS objects, count(DISTINCT o) AS conformers, count(*) AS triangles FROM tri")
def published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle index as a table bucketed by its look-up key; the counts of what was written."""
    name = f"triangles_{uuid.uuid4().hex}"
    facts = sinks.publish_index(objects(spark, sf_dir), name, buckets=8).first()
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame([(facts.objects, facts.conformers, facts.triangles)], "objects long, conformers long, triangles long")


@query("SELECT 's' || s_suppkey AS run_id, 'c' || s_nationkey AS case_id, CASE WHEN s_acctbal > 0 THEN 'DOCKED' ELSE 'FAILED' END AS state, 'INDEXED' AS last_completed_stage FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0")
def run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest file a supplier; broken ones and those without a state are left out."""
    key = F.col("s_suppkey")
    doc = F.to_json(F.struct(F.concat(F.lit("s"), key.cast("string")).alias("run_id"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("case_id"), F.when(key % 5 != 0, F.when(F.col("s_acctbal") > 0, "DOCKED").otherwise("FAILED")).alias("state"), F.lit("INDEXED").alias("last_completed_stage")), {"pretty": "true"})
    path = _folder(spark, "runs")
    # a file a row: writing them is the work, so the rows of a small table are dealt to many tasks
    dealt = table(spark, sf_dir, "supplier").select(F.when(key % 7 == 0, F.left(doc, F.lit(20))).otherwise(doc).alias("value")).repartition(4 * spark.sparkContext.defaultParallelism)
    dealt.write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_runs(spark, path, "run_id string, case_id string, state string, last_completed_stage string", name="*.txt")
