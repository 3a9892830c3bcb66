"""The registered queries: operators bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import audit, catalog, fusion, geometry, runs, selection, stats, text
from ..sources import sinks
from .bindings import LINES_SQL, POINTS_SQL, lines, objects, table
from .registry import query


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- geometric search -------------------------------------------------------------------------


@query(
    f"WITH {POINTS_SQL} SELECT o AS object_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, type_key, CAST(kinds AS INTEGER) AS kinds, round(area, 6) AS area, round(e[1] + e[2] + e[3], 6) AS perimeter, CAST(floor(e[1] / 0.5) AS INTEGER) AS b0, CAST(floor(e[2] / 0.5) AS INTEGER) AS b1, CAST(floor(e[3] / 0.5) AS INTEGER) AS b2 FROM tri"
)
def triangle_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object's triangles with their bins."""
    t = geometry.binned(geometry.triangles(objects(spark, sf_dir)))
    return t.select("object_id", "i", "j", "k", "type_key", "kinds", r6(F.col("area")).alias("area"), r6(F.col("perimeter")).alias("perimeter"), "b0", "b1", "b2")


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle index of the orders' objects, published once a session and table version and then only read."""
    source = table(spark, sf_dir, "lineitem")
    version = catalog.receipt_hash({"dir": sf_dir, "files": sorted(source.inputFiles()), "app": spark.sparkContext.applicationId})
    name = f"triangles_{version[:24]}"
    if not spark.catalog.tableExists(name):
        sinks.publish_index(objects(spark, sf_dir), name, buckets=32)
    return spark.table(name)


def _query_triangles(index: DataFrame):
    """The triangles of the object with the smallest id of 4 to 9 points, and its number of points.

    They are at most ``MOST_TRIANGLES`` and are read once, so that nothing that uses them reads the index again.
    """
    first = index.where(F.col("points").between(4, 9)).agg(F.min(F.struct("object_id", "points")).alias("f")).select("f.*").first()
    own = index.where((F.col("object_id") == first.object_id) & F.col("points").between(4, 9))
    chosen = geometry.select_query_triangles(own)
    return index.sparkSession.createDataFrame(chosen.collect(), chosen.schema), first.points


def _matched(spark: SparkSession, sf_dir: str, candidates: DataFrame | None = None):
    """Matches of the query object over the published index, the object's triangles and its number of points."""
    index = _published(spark, sf_dir)
    q, n = _query_triangles(index)
    return geometry.best_matches(geometry.match_published(index, q, candidates=candidates)), q, n


def _search(spark: SparkSession, sf_dir: str, candidates: DataFrame | None = None):
    best, _, n = _matched(spark, sf_dir, candidates)
    return best, n


MATCH_SQL = f"""WITH {POINTS_SQL},
qo AS (SELECT min(l_orderkey) AS o FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 4 AND 9)),
q AS (SELECT * FROM tri WHERE o = (SELECT o FROM qo) QUALIFY row_number() OVER (ORDER BY kinds DESC, area DESC, e[1] + e[2] + e[3] DESC, i, j, k) <= 64),
perms AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) AS v(p0, p1, p2)),
m AS (SELECT c.o, q.i AS qi, q.j AS qj, q.k AS qk, [c.i, c.j, c.k][p0 + 1] AS c0, [c.i, c.j, c.k][p1 + 1] AS c1, [c.i, c.j, c.k][p2 + 1] AS c2,
        abs(q.dab - CASE p0 + p1 WHEN 1 THEN c.dab WHEN 2 THEN c.dac ELSE c.dbc END) AS e0,
        abs(q.dac - CASE p0 + p2 WHEN 1 THEN c.dab WHEN 2 THEN c.dac ELSE c.dbc END) AS e1,
        abs(q.dbc - CASE p1 + p2 WHEN 1 THEN c.dab WHEN 2 THEN c.dac ELSE c.dbc END) AS e2
      FROM q JOIN tri c ON q.type_key = c.type_key CROSS JOIN perms
      WHERE q.ta = [c.ta, c.tb, c.tc][p0 + 1] AND q.tb = [c.ta, c.tb, c.tc][p1 + 1] AND q.tc = [c.ta, c.tb, c.tc][p2 + 1]),
best AS (SELECT o, qi, qj, qk, list_sort([e0, e1, e2])[2] AS err FROM m WHERE greatest(e0, e1, e2) <= 1 + 1e-12
      QUALIFY row_number() OVER (PARTITION BY o, qi, qj, qk ORDER BY list_sort([e0, e1, e2])[2], c0, c1, c2) = 1),
h AS (SELECT o, (SELECT count(DISTINCT x) FROM (SELECT unnest(flatten(list([qi, qj, qk]))) AS x)) AS covered, median(err) AS med, count(*) AS n FROM best GROUP BY o),
top AS (SELECT o AS object_id, covered / CAST((SELECT count(*) FROM pts WHERE o = (SELECT o FROM qo)) AS DOUBLE) AS coverage, med, n FROM h)
"""


@query(
    MATCH_SQL
    + "SELECT object_id, CAST(row_number() OVER (ORDER BY coverage DESC, med, object_id) AS INTEGER) AS rank, round(coverage, 6) AS coverage, round(med, 6) AS median_error, round(coverage / (1 + med), 6) AS score, n AS matches FROM top QUALIFY rank <= 512"
)
def geometric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 512 objects that best hold a query object's labelled points, within the tolerance."""
    best, n = _search(spark, sf_dir)
    top = geometry.top_objects(geometry.hits(best, n), 512)
    return top.select("object_id", "rank", r6(F.col("coverage")).alias("coverage"), r6(F.col("median_error")).alias("median_error"), r6(F.col("score")).alias("score"), "matches")


@query(MATCH_SQL + ", qn AS (SELECT i, j, k, row_number() OVER (ORDER BY i, j, k) - 1 AS number FROM q) SELECT o AS object_id, CAST(bit_or(CAST(1 AS BIGINT) << CAST(number AS BIGINT)) AS BIGINT) AS mask, round(min(err), 6) AS min_error FROM best JOIN qn ON qi = i AND qj = j AND qk = k GROUP BY o")
def match_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per object a bit for each query triangle it matches, and the least error."""
    best, own, _ = _matched(spark, sf_dir)
    numbers = own.select(F.struct("i", "j", "k").alias("q"), (F.row_number().over(W.orderBy("i", "j", "k")) - 1).alias("number"))
    return geometry.match_masks(best, numbers).select("object_id", "mask", r6(F.col("min_error")).alias("min_error"))


@query("""WITH a AS (SELECT vec_id // 8 AS g, CAST(vec_id % 8 AS INTEGER) AS n, CAST(label AS VARCHAR) AS t, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
t AS (SELECT a.g, list_sort([a.t, b.t, c.t]) AS types,
  list_sort([sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z)), sqrt((b.x-c.x)*(b.x-c.x)+(b.y-c.y)*(b.y-c.y)+(b.z-c.z)*(b.z-c.z))]) AS e
  FROM a JOIN a b ON a.g = b.g AND a.n < b.n JOIN a c ON b.g = c.g AND b.n < c.n)
SELECT array_to_string(types, '|') AS type_key, count(*) AS triangles, count(DISTINCT g) AS objects, round(min(e[1]), 6) AS shortest, round(max(e[3]), 6) AS longest FROM t WHERE e[1] > 1e-8 GROUP BY 1""")
def embedding_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangle type statistics over groups of eight vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("object_id"), (F.col("vec_id") % 8).alias("n"), F.col("label").cast("string").alias("type"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("position"))
    grouped = v.groupBy("object_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "type", "position"))), lambda x: F.struct(x["type"].alias("type"), x["position"].alias("position"))).alias("features"))
    t = geometry.triangles(grouped, keep=("object_id",))
    return t.groupBy("type_key").agg(F.count("*").alias("triangles"), F.count_distinct("object_id").alias("objects"), r6(F.min(F.get("edges", F.lit(0)))).alias("shortest"), r6(F.max(F.get("edges", F.lit(2)))).alias("longest"))


@query("""WITH p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r1, row_number() OVER (ORDER BY p_size, p_partkey) AS r2 FROM part),
s AS (SELECT id, r1 <= 200 AS a, r2 <= 300 AS b, r1, r2 FROM p WHERE r1 <= 200 OR r2 <= 300),
f AS (SELECT id, CASE WHEN a THEN 0.75 / (60 + r1) ELSE 0 END + CASE WHEN b THEN 0.25 / (60 + r2) ELSE 0 END AS score, CASE WHEN a THEN r1 END AS price_rank, CASE WHEN b THEN r2 END AS size_rank FROM s)
SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, round(score, 9) AS rrf_score, CAST(price_rank AS INTEGER) AS price_rank, CAST(size_rank AS INTEGER) AS size_rank FROM f QUALIFY rank <= 100""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ranked by price and by size, fused by weighted reciprocal ranks."""
    p = table(spark, sf_dir, "part")
    price = geometry.ranked(p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")), ["score desc", "id"], 200)
    size = geometry.ranked(p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score")), ["score", "id"], 300)
    fused = fusion.fuse({"price": price, "size": size}, weights={"price": 3.0, "size": 1.0}, top=100)
    return fused.select("id", "rank", F.round("rrf_score", 9).alias("rrf_score"), F.try_element_at("branch_ranks", F.lit("price")).alias("price_rank"), F.try_element_at("branch_ranks", F.lit("size")).alias("size_rank"))


# --- points -----------------------------------------------------------------------------------

ATOMS_SQL = f"{LINES_SQL}, atoms AS (SELECT l_orderkey AS s, mode, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_returnflag = 'R' AS het, l_partkey % 5 AS residue FROM lines)"


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("structure_id"), F.col("mode").alias("id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), (F.col("l_returnflag") == "R").alias("het"), (F.col("l_partkey") % 5).alias("residue"), F.col("l_linestatus").alias("type"))


@query(f"WITH {ATOMS_SQL}, d AS (SELECT *, sqrt((x-25)*(x-25)+(y-5)*(y-5)+(z-4)*(z-4)) AS d FROM atoms) SELECT s AS structure_id, count(*) AS points, count(*) FILTER (abs(x-25) <= 10 AND abs(y-5) <= 3 AND abs(z-4) <= 3) AS inside, round(min(d), 6) AS nearest, round(min(d) FILTER (het), 6) AS nearest_het FROM d GROUP BY s")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.box_overlap(_atoms(spark, sf_dir), (25.0, 5.0, 4.0), (20.0, 6.0, 6.0))


@query(f"WITH {ATOMS_SQL} SELECT s AS structure_id, round((min(x)+max(x))/2, 6) AS center_x, round((min(y)+max(y))/2, 6) AS center_y, round((min(z)+max(z))/2, 6) AS center_z, round(max(x)-min(x)+10, 6) AS size_x, round(max(y)-min(y)+10, 6) AS size_y, round(max(z)-min(z)+10, 6) AS size_z, coalesce((max(x)-min(x)+10) BETWEEN 4 AND 60 AND (max(y)-min(y)+10) BETWEEN 4 AND 60 AND (max(z)-min(z)+10) BETWEEN 4 AND 60 AND (max(x)-min(x)+10)*(max(y)-min(y)+10)*(max(z)-min(z)+10) <= 27000, false) AS plausible FROM atoms GROUP BY s")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geometry.bounding_box(_atoms(spark, sf_dir))
    b = b.withColumn("plausible", geometry.plausible_box(("size_x", "size_y", "size_z")))
    return b.select("structure_id", *(r6(F.col(f"{k}_{c}")).alias(f"{k}_{c}") for k in ("center", "size") for c in "xyz"), "plausible")


@query(f"WITH {ATOMS_SQL} SELECT a.s AS structure_id, count(*) AS contacts, round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))), 6) AS nearest FROM atoms a JOIN atoms b ON a.s = b.s AND a.het AND NOT b.het WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 5 GROUP BY 1")
def grid_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts within 5 between both classes of points, by cells."""
    a = _atoms(spark, sf_dir)
    c = geometry.contacts(a.where("het"), a.where("not het"), 5.0)
    return c.groupBy("structure_id").agg(F.count("*").alias("contacts"), r6(F.min("distance")).alias("nearest"))


@query(f"WITH {ATOMS_SQL}, near AS (SELECT DISTINCT a.s, b.residue FROM atoms a JOIN atoms b ON a.s = b.s AND a.het WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 8) SELECT atoms.s AS structure_id, count(*) AS atoms, count(DISTINCT residue) AS residues FROM atoms SEMI JOIN near ON atoms.s = near.s AND atoms.residue = near.residue GROUP BY atoms.s")
def crop_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups with a point near any of the marked points."""
    a = _atoms(spark, sf_dir)
    return geometry.crop_residues(a, a.where("het"), 8.0).groupBy("structure_id").agg(F.count("*").alias("atoms"), F.count_distinct("residue").alias("residues"))


@query(f"WITH {ATOMS_SQL} SELECT s AS structure_id, residue, count(*) AS points, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM atoms GROUP BY ALL HAVING count(*) >= 3")
def ring_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geometry.ring_centroids(_atoms(spark, sf_dir))
    return c.select("structure_id", "residue", "points", *(r6(F.col(x)).alias(x) for x in "xyz"))


@query(f"""WITH {ATOMS_SQL}, p AS (SELECT s, mode AS id, (SELECT l_linestatus FROM lines l WHERE l.l_orderkey = atoms.s AND l.mode = atoms.mode) AS t, round(sqrt((x-25)*(x-25)+(y-5)*(y-5)+(z-4)*(z-4)), 6) AS d FROM atoms),
k AS (SELECT *, (SELECT count(DISTINCT t) FROM p p2 WHERE p2.s = p.s) AS kinds, row_number() OVER (PARTITION BY s, t ORDER BY d, id) AS rn FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rn, t, id) AS place FROM k WHERE rn <= ceil(4 / kinds))
SELECT s AS structure_id, id AS id, t AS type, CAST(place AS INTEGER) AS place FROM c WHERE place <= 4""")
def diverse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.sqrt((F.col("x") - 25) * (F.col("x") - 25) + (F.col("y") - 5) * (F.col("y") - 5) + (F.col("z") - 4) * (F.col("z") - 4))
    return geometry.diverse_points(_atoms(spark, sf_dir).withColumn("distance", r6(d)), 4).select("structure_id", F.col("id").cast("long").alias("id"), "type", "place")


@query(f"""WITH {ATOMS_SQL}, a AS (SELECT s, residue, mode, round(z / 10, 3) AS occ, CAST(y AS VARCHAR) AS altloc, x, y, z FROM atoms),
t AS (SELECT *, max(occ) OVER (PARTITION BY s, residue) AS top FROM a), n AS (SELECT *, count(*) OVER (PARTITION BY s, residue) AS tied, row_number() OVER (PARTITION BY s, residue ORDER BY y, x, z, mode) AS rn FROM t WHERE occ >= top - 1e-6)
SELECT s AS structure_id, residue, occ, y, tied FROM n WHERE rn = 1""")
def choose_altloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _atoms(spark, sf_dir).withColumns({"occ": F.round(F.col("z") / 10, 3), "altloc": F.col("y")})
    return geometry.choose_altloc(a, ("structure_id", "residue")).select("structure_id", "residue", "occ", "y", "tied")


# --- statistics -------------------------------------------------------------------------------

MODES_SQL = f"{LINES_SQL}, modes AS (SELECT l_orderkey AS case_id, CAST(mode AS INTEGER) AS mode, l_extendedprice AS score, 40 * l_discount AS rmsd, l_returnflag <> 'R' AS valid FROM lines)"
RECOVERY_SQL = MODES_SQL + """, f AS (SELECT case_id, min({rmsd: rmsd, mode: mode}) FILTER (mode <= 5) AS o, min(rmsd) FILTER (mode <= 5 AND valid) AS vo, min(mode) FILTER (valid AND rmsd <= %s) AS fr,
  coalesce(bool_or(valid AND rmsd <= %s AND mode = 1), false) AS top1, coalesce(bool_or(valid AND rmsd <= %s AND mode <= 5), false) AS topn FROM modes GROUP BY 1),
rec AS (SELECT o_orderkey AS case_id, CASE WHEN f.case_id IS NULL THEN 'NOT_ATTEMPTED' ELSE 'METRICS_COMPLETED' END AS status, f.o.rmsd AS best_rmsd, f.o.mode AS best_mode, vo AS best_valid_rmsd, fr AS first_recovered, coalesce(top1, false) AS top1, coalesce(topn, false) AS topn FROM orders LEFT JOIN f ON o_orderkey = f.case_id)"""


def _recovery(spark: SparkSession, sf_dir: str, threshold: float = 2.0) -> DataFrame:
    modes = lines(spark, sf_dir).select(F.col("l_orderkey").alias("case_id"), "mode", F.col("l_extendedprice").alias("score"), (F.lit(40.0) * F.col("l_discount")).alias("rmsd"), (F.col("l_returnflag") != "R").alias("valid"))
    return stats.case_recovery(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id")), modes, threshold=threshold)


@query(f"WITH {RECOVERY_SQL % (2, 2, 2)} SELECT case_id, status, round(best_rmsd, 6) AS best_rmsd, best_mode, round(best_valid_rmsd, 6) AS best_valid_rmsd, first_recovered, top1, topn FROM rec")
def case_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case of the manifest with its recovery; cases without results stay."""
    r = _recovery(spark, sf_dir)
    return r.select("case_id", "status", r6(F.col("best_rmsd")).alias("best_rmsd"), "best_mode", r6(F.col("best_valid_rmsd")).alias("best_valid_rmsd"), "first_recovered", "top1", "topn")


WILSON = "round(greatest(0, ({s}/n + 1.9599639845400545*1.9599639845400545/(2*n) - 1.9599639845400545*sqrt({s}/n*(1-{s}/n)/n + 1.9599639845400545*1.9599639845400545/(4*n*n)))/(1+1.9599639845400545*1.9599639845400545/n)), 6) AS {k}_low, round(least(1, ({s}/n + 1.9599639845400545*1.9599639845400545/(2*n) + 1.9599639845400545*sqrt({s}/n*(1-{s}/n)/n + 1.9599639845400545*1.9599639845400545/(4*n*n)))/(1+1.9599639845400545*1.9599639845400545/n)), 6) AS {k}_high"


@query(f"WITH {RECOVERY_SQL % (2, 2, 2)}, a AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (top1) AS DOUBLE) AS s1, CAST(count(*) FILTER (topn) AS DOUBLE) AS s5, count(*) FILTER (status = 'METRICS_COMPLETED') AS done FROM rec) SELECT CAST(n AS BIGINT) AS cases, done AS completed, CAST(s1 AS BIGINT) AS top1, CAST(s5 AS BIGINT) AS topn, round(s1/n, 6) AS top1_rate, {WILSON.format(s='s1', k='top1')}, {WILSON.format(s='s5', k='topn')} FROM a")
def wilson_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery rates over all cases with Wilson intervals."""
    a = stats.arm_summary(_recovery(spark, sf_dir))
    return a.select("cases", "completed", "top1", "topn", r6(F.col("top1_rate")).alias("top1_rate"), *(r6(F.col(f"{k}_ci.{s}")).alias(f"{k}_{s}") for k in ("top1", "topn") for s in ("low", "high")))


PAIRED_SQL = MODES_SQL + """, a AS (SELECT case_id, bool_or(valid AND rmsd <= 2 AND mode = 1) AS x, bool_or(valid AND rmsd <= 1.2 AND mode <= 5) AS y FROM modes GROUP BY 1),
j AS (SELECT o_orderkey, coalesce(x, false) AS x, coalesce(y, false) AS y FROM orders LEFT JOIN a ON case_id = o_orderkey),
c AS (SELECT count(*) AS cases, count(*) FILTER (x AND y) AS both_, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither FROM j)"""


@query(f"WITH {PAIRED_SQL} SELECT cases, both_ AS \"both\", only_a, only_b, neither, round((only_a - only_b) / CAST(cases AS DOUBLE), 6) AS difference, round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM (SELECT CAST(only_a + only_b AS DOUBLE) AS n, CAST(unnest(generate_series(0, least(only_a, only_b))) AS DOUBLE) AS i))), 6) AS p FROM c")
def paired_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two success rules over the same cases: contingency table and exact test."""
    a = _recovery(spark, sf_dir, 2.0).select("case_id", F.col("top1").alias("hit"))
    b = _recovery(spark, sf_dir, 1.2).select("case_id", F.col("topn").alias("hit"))
    return stats.paired(a, b, "hit").select("cases", "both", "only_a", "only_b", "neither", r6(F.col("difference")).alias("difference"), r6(F.col("p")).alias("p"))


@query("WITH u AS (SELECT 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS low, round(max(v), 6) AS high FROM u GROUP BY 1")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.metric_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return m.select("metric", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "median", "low", "high")))


@query("SELECT event_type, CAST(grouping(event_type) AS INTEGER) AS total, count(value) AS n, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95, round(stddev_samp(value) / avg(value), 6) AS cv FROM events GROUP BY GROUPING SETS ((event_type), ())")
def sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.sample_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return s.select("event_type", "total", "n", *(r6(F.col(c)).alias(c) for c in ("median", "p95", "cv")))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def linear_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.linear_percentile(table(spark, sf_dir, "events"), "event_type", "value", 0.9, "p90").withColumn("p90", r6(F.col("p90")))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(value, 6) AS p75 FROM r WHERE rn = round_even((n - 1) * 0.75, 0) + 1")
def rounded_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.rounded_percentile(table(spark, sf_dir, "events"), "event_type", "value", 0.75, "p75")
    return r.select("event_type", r6(F.col("p75")).alias("p75"))


@query(f"WITH {LINES_SQL} SELECT l_orderkey, mode, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'REJECTED' WHEN l_quantity < 10 THEN 'UNVERIFIED' WHEN 40 * l_discount <= 2 AND l_tax >= 0.04 THEN 'RECOVERED' WHEN l_tax >= 0.06 THEN 'CONSENSUS' ELSE 'PLAUSIBLE' END AS grade FROM lines")
def evidence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).withColumns({"hard_fail": (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "attested": F.col("l_quantity") >= 10, "rmsd": F.lit(40) * F.col("l_discount"), "recovery": F.when(F.col("l_tax") >= 0.04, 0.5).otherwise(0.0), "overlap": F.when(F.col("l_tax") >= 0.06, 0.5).otherwise(0.0)})
    return d.select("l_orderkey", F.col("mode").cast("long").alias("mode"), stats.evidence_grade().alias("grade"))


@query("WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, list_distinct(list(l_partkey % 50)) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), p AS (SELECT o_orderkey, x, lag(x) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS y FROM s) SELECT o_orderkey, CAST(len(list_intersect(x, y)) AS INTEGER) AS common, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS jaccard, round(len(list_intersect(x, y)) / CAST(len(y) AS DOUBLE), 6) AS recovery, round(len(list_intersect(x, y)) / CAST(len(x) AS DOUBLE), 6) AS precision FROM p WHERE y IS NOT NULL")
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's label set against the same customer's order before."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = o.groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(F.collect_set(F.col("l_partkey") % 50).alias("x"))
    p = s.withColumn("y", F.lag("x").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("y is not null")
    m = stats.set_overlap("x", "y")
    return p.select("o_orderkey", m["common"].alias("common"), *(r6(m[k]).alias(k) for k in ("jaccard", "recovery", "precision")))


# --- audits -----------------------------------------------------------------------------------


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select((F.col("doc_id") % 3).cast("string").alias("split"), "doc_id", F.sha2("text", 256).alias("identity"), F.sha2(F.regexp_replace("text", "[^a-z]", ""), 256).alias("letters"))


MEMBERS_SQL = "m AS (SELECT CAST(doc_id % 3 AS VARCHAR) AS split, doc_id, sha256(text) AS identity, sha256(regexp_replace(text, '[^a-z]', '', 'g')) AS letters FROM documents)"


@query(f"WITH {MEMBERS_SQL}, v AS (SELECT DISTINCT split, identity FROM m), s AS (SELECT split, count(*) AS n FROM v GROUP BY 1) SELECT a.split AS a, b.split AS b, (SELECT count(*) FROM v x JOIN v y ON x.identity = y.identity WHERE x.split = a.split AND y.split = b.split) AS common, round((SELECT count(*) FROM v x JOIN v y ON x.identity = y.identity WHERE x.split = a.split AND y.split = b.split) / CAST(least(a.n, b.n) AS DOUBLE), 6) AS share FROM s a JOIN s b ON a.split < b.split")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = audit.overlap(_members(spark, sf_dir), "identity")
    return o.select("a", "b", "common", r6(F.col("share")).alias("share"))


@query(f"""WITH {MEMBERS_SQL}, e AS (SELECT m.*, CASE WHEN length(text) < 120 THEN 'SHORT' WHEN d.lang = 'fr' AND d.doc_id % 11 = 0 THEN 'LANGUAGE' END AS error FROM m JOIN documents d USING (doc_id)), v AS (SELECT * FROM e WHERE error IS NULL),
x AS (SELECT split, string_agg(doc_id || ':' || error, ',' ORDER BY doc_id) AS examples FROM (SELECT * FROM e WHERE error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split ORDER BY doc_id) <= 20) GROUP BY 1)
SELECT e.split, count(*) AS records, count(*) FILTER (error IS NULL) AS parsed, count(error) AS invalid, count(DISTINCT identity) FILTER (error IS NULL) AS unique_identity, count(identity) FILTER (error IS NULL) - count(DISTINCT identity) FILTER (error IS NULL) AS repeats_identity,
  count(DISTINCT letters) FILTER (error IS NULL) AS unique_letters, count(letters) FILTER (error IS NULL) - count(DISTINCT letters) FILTER (error IS NULL) AS repeats_letters, coalesce(any_value(examples), '') AS examples FROM e LEFT JOIN x ON x.split = e.split GROUP BY 1""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each split, with its first invalid records."""
    short = F.when(F.length("text") < 120, "SHORT").when((F.col("lang") == "fr") & (F.col("doc_id") % 11 == 0), "LANGUAGE")
    errors = table(spark, sf_dir, "documents").select("doc_id", short.alias("error"))
    s = audit.split_summary(_members(spark, sf_dir).join(errors, "doc_id"), ["identity", "letters"], "error", index="doc_id")
    return s.withColumn("examples", F.array_join(F.transform("examples", lambda x: F.concat_ws(":", x["record_index"].cast("string"), x["code"])), ","))


NAMES_SQL = "n AS (SELECT DISTINCT p_name AS s, list_sort(list_distinct(string_split(p_name, ' '))) AS t FROM part)"


@query(f"WITH {NAMES_SQL} SELECT a.s AS left_id, b.s AS right_id, len(list_intersect(a.t, b.t)) AS common, round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) AS similarity FROM n a JOIN n b ON a.s < b.s WHERE len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) >= 0.3")
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("id")).distinct().withColumn("tokens", F.array_distinct(F.split("id", " ")))
    s = audit.token_similarity(n, n, 0.3).where("left_id < right_id")
    return s.select("left_id", "right_id", F.col("common").cast("long").alias("common"), r6(F.col("similarity")).alias("similarity"))


def _shingle_sets(df: DataFrame, id_col: str) -> DataFrame:
    """``id, tokens``: the five-word shingles of each distinct text, under its smallest id."""
    one = df.where(F.col("text").isNotNull()).groupBy("text").agg(F.min(id_col).alias("id")).where("id is not null")
    once = lambda df: df.select(F.inline(F.array(F.struct(*df.columns))))  # noqa: E731  no filter above takes the columns apart and makes the words anew for each shingle
    w = once(one.select("id", F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "").alias("w"))).where(F.size("w") >= 5)
    # words are taken one by one: a slice would copy the whole array for each shingle
    shingle = lambda i: F.xxhash64(F.concat_ws(" ", *(F.get("w", i + k) for k in range(5))))
    return once(w.select("id", F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0))), shingle)).alias("tokens")))


def _shingles_sql(name: str, source: str, id_col: str) -> str:
    return f"{name}t AS (SELECT text, min({id_col}) AS id FROM {source} WHERE text IS NOT NULL GROUP BY 1), {name}w AS (SELECT id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM {name}t WHERE id IS NOT NULL), {name} AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM {name}w WHERE len(w) >= 5)), {name}n AS (SELECT id, count(*) AS n FROM {name} GROUP BY 1)"


@query(f"WITH {_shingles_sql('d', 'documents', 'doc_id')}, {_shingles_sql('b', 'benchmark', 'item_id')}, c AS (SELECT d.id AS left_id, b.id AS right_id, count(*) AS common FROM d JOIN b ON d.t = b.t GROUP BY 1, 2) SELECT left_id, right_id, common, round(common / CAST(dn.n + bn.n - common AS DOUBLE), 6) AS similarity FROM c JOIN dn ON dn.id = left_id JOIN bn ON bn.id = right_id WHERE common / CAST(dn.n + bn.n - common AS DOUBLE) >= 0.1")
def similarity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingle sets of the distinct documents against the benchmark's items."""
    a, b = _shingle_sets(table(spark, sf_dir, "documents"), "doc_id"), _shingle_sets(table(spark, sf_dir, "benchmark"), "item_id")
    s = audit.token_similarity(a, b, 0.1)
    return s.select("left_id", "right_id", F.col("common").cast("long").alias("common"), r6(F.col("similarity")).alias("similarity"))


@query("WITH p AS (SELECT DISTINCT p_size % 3 AS k, p_name AS s FROM part) SELECT DISTINCT a.s AS x, b.s AS y, round(1 - levenshtein(a.s, b.s) / CAST(greatest(length(a.s), length(b.s)) AS DOUBLE), 6) AS identity FROM p a JOIN p b ON a.k = 0 AND b.k = 1 WHERE 1 - levenshtein(a.s, b.s) / CAST(greatest(length(a.s), length(b.s)) AS DOUBLE) >= 0.7")
def edit_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("k"), F.col("p_name").alias("seq"))
    e = audit.edit_similarity(p.where("k = 0"), p.where("k = 1"), 0.7)
    return e.select("x", "y", r6(F.col("identity")).alias("identity"))


@query("""WITH d AS (SELECT DISTINCT doc_id % 3 AS k, regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g') AS s FROM documents WHERE length(text) BETWEEN 200 AND 2000)
SELECT sha256(a.s) AS x, sha256(b.s) AS y, round(1 - levenshtein(a.s, b.s) / CAST(greatest(length(a.s), length(b.s)) AS DOUBLE), 6) AS identity FROM d a JOIN d b ON a.k = 0 AND b.k = 1 AND length(b.s) >= 0.9 * length(a.s) - 1e-9 AND length(a.s) >= 0.9 * length(b.s) - 1e-9 WHERE 1 - levenshtein(a.s, b.s) / CAST(greatest(length(a.s), length(b.s)) AS DOUBLE) >= 0.9 - 1e-12""")
def edit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 200 to 2,000 letters of one split that nearly stand in another."""
    d = table(spark, sf_dir, "documents").where(F.length("text").between(200, 2000)).select((F.col("doc_id") % 3).alias("k"), F.regexp_replace("text", r"[^\x00-\x7F]", "~").alias("seq"))
    e = audit.edit_similarity(d.where("k = 0"), d.where("k = 1"), 0.9)
    return e.select(F.sha2("x", 256).alias("x"), F.sha2("y", 256).alias("y"), r6(F.col("identity")).alias("identity"))


@query("SELECT o_orderpriority AS split, count(*) AS records, count(o_orderdate) AS dated, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last, count(*) FILTER (CASE WHEN o_orderpriority < '3' THEN CAST(o_orderdate AS DATE) > DATE '1996-06-30' ELSE CAST(o_orderdate AS DATE) <= DATE '1996-06-30' END) AS violations FROM orders GROUP BY 1")
def temporal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), F.col("o_orderdate").cast("date").alias("date"))
    roles = {r.split: "TRAIN" if r.split < "3" else "EVALUATION" for r in o.select("split").distinct().collect()}
    return audit.temporal(o, "1996-06-30", roles)


@query("WITH p AS (SELECT o_custkey, o_orderpriority AS split, list_sort(list_distinct(list(o_orderstatus))) AS labels, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, CAST(count(*) AS INTEGER) AS splits, count(DISTINCT labels) > 1 AS conflict, CAST(sum(n) AS BIGINT) AS records FROM p GROUP BY 1 HAVING count(*) > 1")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("split"), F.col("o_orderstatus").alias("label"))
    return audit.label_conflicts(o, ["o_custkey"]).select("o_custkey", F.size("splits").alias("splits"), "conflict", "records")


@query(f"WITH {MEMBERS_SQL}, v AS (SELECT DISTINCT split, identity FROM m), g AS (SELECT 'identity' AS rule, CASE WHEN (SELECT count(*) FROM v x JOIN v y ON x.identity = y.identity AND x.split < y.split) > 0 THEN 'FAIL' ELSE 'PASS' END AS status UNION ALL SELECT 'uniqueness', CASE WHEN (SELECT count(*) - count(DISTINCT (split, identity)) FROM m) > 0 THEN 'FAIL' ELSE 'PASS' END UNION ALL SELECT 'labels', CASE WHEN (SELECT count(*) FROM documents) > (SELECT count(DISTINCT doc_id) FROM labels) THEN 'INCOMPLETE' ELSE 'PASS' END) SELECT rule, status FROM g UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'INCOMPLETE') THEN 'INCOMPLETE' ELSE 'PASS' END FROM g")
def audit_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over the documents' splits, and the overall verdict."""
    m = _members(spark, sf_dir)
    common = audit.overlap(m, "identity", 1).agg(F.lit("identity").alias("rule"), F.sum("common").alias("bad"), F.lit(True).alias("complete"))
    repeats = audit.split_summary(m, ["identity"]).agg(F.lit("uniqueness").alias("rule"), F.sum("repeats_identity").alias("bad"), F.lit(True).alias("complete"))
    labelled = table(spark, sf_dir, "labels").agg(F.count_distinct("doc_id").alias("l")).join(m.agg(F.count("*").alias("n"))).select(F.lit("labels").alias("rule"), F.lit(0).cast("long").alias("bad"), (F.col("l") >= F.col("n")).alias("complete"))
    gates = common.unionByName(repeats).unionByName(labelled).select("rule", audit.gate(F.col("bad"), F.col("complete")).alias("status"))
    return gates.unionByName(audit.overall(gates).select(F.lit("overall").alias("rule"), "status"))


# --- selection --------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rules = {"negative_balance": F.col("c_acctbal") < 0, "household": F.col("c_mktsegment") == "HOUSEHOLD", "nation_excluded": F.col("c_nationkey").isin(3, 7, 11)}
    return c.select(F.col("c_custkey").alias("id"), selection.reasons(rules).alias("reasons"))


CANDIDATES_SQL = "c AS (SELECT c_custkey AS id, list_sort(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'household' END, CASE WHEN c_nationkey IN (3, 7, 11) THEN 'nation_excluded' END], lambda x: x IS NOT NULL)) AS reasons FROM customer)"


@query(f"WITH {CANDIDATES_SQL} SELECT id, array_to_string(reasons, ',') AS reasons FROM c")
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {CANDIDATES_SQL}, e AS (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['eligible'] ELSE reasons END) AS reason FROM c) SELECT reason, count(*) AS n FROM e GROUP BY 1")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.reason_histogram(_candidates(spark, sf_dir))


@query(f"WITH {CANDIDATES_SQL} SELECT id, CAST(row_number() OVER (ORDER BY sha256('holdout:' || id), id) AS INTEGER) AS place FROM c WHERE len(reasons) = 0 QUALIFY place <= 100")
def holdout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 eligible candidates in hash order."""
    return selection.holdout(_candidates(spark, sf_dir), "holdout", 100).where("place is not null").select("id", "place")


@query("WITH b AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1) SELECT p_brand, p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM b QUALIFY place <= 128")
def first_per_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    return selection.first_per_group(table(spark, sf_dir, "part"), "p_brand", order, 128).select("p_brand", "p_partkey", "place")


@query("WITH t AS (SELECT l_partkey, l_extendedprice, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS place FROM lineitem) SELECT l_partkey, l_orderkey, l_extendedprice, CAST(place AS INTEGER) AS place FROM t WHERE place <= 4")
def states_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")]
    return selection.top_per_group(table(spark, sf_dir, "lineitem"), ["l_partkey"], order, 4).select("l_partkey", "l_orderkey", "l_extendedprice", "place")


@query("WITH b AS (SELECT l_partkey, min(l_extendedprice) AS s FROM lineitem GROUP BY 1) SELECT l_partkey, s AS score, CAST(row_number() OVER (ORDER BY s, l_partkey) AS INTEGER) AS rank FROM b QUALIFY rank <= 16")
def best_state_top16(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("score"))
    return geometry.ranked(best, ["score", "l_partkey"], 16)


@query("WITH d AS (SELECT l_orderkey, count(*) AS d FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), f AS (SELECT l_orderkey, count(*) AS f FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) SELECT o_orderkey, CASE WHEN coalesce(d, 0) > 0 AND coalesce(f, 0) > 0 THEN 'done_and_failed' WHEN coalesce(d, 0) + coalesce(f, 0) > 1 THEN 'reported_twice' WHEN coalesce(d, 0) + coalesce(f, 0) = 0 THEN 'missing' END AS defect FROM orders LEFT JOIN d ON d.l_orderkey = o_orderkey LEFT JOIN f ON f.l_orderkey = o_orderkey WHERE defect IS NOT NULL")
def exact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first and second lines do not stand for exactly one outcome."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return selection.coverage(table(spark, sf_dir, "orders"), li.where("l_linenumber = 1"), li.where("l_linenumber = 2"), "o_orderkey")


@query("WITH s AS (SELECT 0 AS place, 'customers' AS stage, count(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 1, 'ordered', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 2, 'large', count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 200000) SELECT CAST(place AS INTEGER) AS place, stage, n, round(n / CAST(lag(n) OVER (ORDER BY place) AS DOUBLE), 6) AS kept FROM s")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, sf_dir, "orders")
    f = selection.funnel([("customers", c), ("ordered", o.select(F.col("o_custkey").alias("id"))), ("large", o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")))], "id")
    return f.select("place", "stage", "n", r6(F.col("kept")).alias("kept"))


# --- text -------------------------------------------------------------------------------------


@query("WITH c AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 1800)) AS o FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(o AS INTEGER) AS \"offset\", sha256(trim(substr(text, o + 1, 1800), ' ')) AS h FROM c WHERE trim(substr(text, o + 1, 1800), ' ') <> ''")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_fixed(table(spark, sf_dir, "documents")).select("doc_id", "offset", F.sha2("text", 256).alias("h"))


#: The same rules in SQL: both kinds of quotes spelled out, and the letter before a path taken along.
_NAME_SQL = f"(?:{text.NAME_LETTER}*{text.SECRET_WORD}{text.NAME_LETTER}*)"
REDACTED_SQL = "text"
for _pattern, _to in (
    (rf"""((?i)["']?{_NAME_SQL}["']?\s*[:=]\s*)(?:(")[^"\n]*"|(')[^'\n]*')""", r"\1\2\3[REDACTED]\2\3"),
    (rf"((?i){_NAME_SQL}\s*[:=]\s*)[^\s,;}}]+", r"\1[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"(^|[^\pL\pN_.])/(?:[^\s/:]+/)+[^\s,;:]+", r"\1[INTERNAL_PATH]"),
    (r"(?i)\b[A-Z]:[\\/](?:[^\s\\/:]+[\\/])+[^\s,;:]+", "[INTERNAL_PATH]"),
):
    REDACTED_SQL = "regexp_replace({}, '{}', '{}', 'g')".format(REDACTED_SQL, _pattern.replace("'", "''"), _to)


@query(f"SELECT doc_id, sha256({REDACTED_SQL}) AS h, length({REDACTED_SQL}) - length(text) AS longer FROM documents")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets, tokens and paths masked in every document."""
    masked = text.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(masked, 256).alias("h"), (F.length(masked) - F.length("text")).cast("long").alias("longer"))


@query("WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_.-]+')) AS q FROM benchmark), d AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_.-]+')) AS t FROM documents), qx AS (SELECT query_id, len(q) AS n, unnest(q) AS w FROM q), dx AS (SELECT id, unnest(t) AS w FROM d), s AS (SELECT query_id, id, count(*) / CAST(any_value(n) AS DOUBLE) AS score FROM qx JOIN dx USING (w) GROUP BY ALL) SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents per benchmark item by shared terms."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.terms(F.col("text")).alias("tokens"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.terms(F.col("text")).alias("tokens"))
    return text.term_search(d, q).select("query_id", "id", r6(F.col("score")).alias("score"), "rank")


@query("""WITH v AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), c AS (SELECT doc_id AS id, text, embedding AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
l AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM c WHERE contains(lower(text), 'the') QUALIFY r <= 20),
s AS (SELECT id, list_sum(list_transform(list_zip(e, q), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(e, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))) AS cos FROM c, v WHERE e IS NOT NULL),
d AS (SELECT id, row_number() OVER (ORDER BY cos DESC, id) AS r FROM s QUALIFY r <= 20),
f AS (SELECT id, sum(x) AS score FROM (SELECT id, 1.0 / (60 + r) AS x FROM l UNION ALL SELECT id, 1.0 / (60 + r) FROM d) GROUP BY id)
SELECT id, round(CAST(score AS DOUBLE), 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first().embedding
    c = table(spark, sf_dir, "documents").join(e, F.col("vec_id") == F.col("doc_id"), "left").select(F.col("doc_id").alias("id"), "text", "embedding")
    return text.hybrid_search(c, keyword="the", vector=q).select("id", r6(F.col("score")).alias("score"), "rank")


@query("SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(text) < 40 THEN 'too_short' END, CASE WHEN NOT contains(text, 'the') THEN 'missing:the' END, CASE WHEN contains(text, 'http') THEN 'forbidden:http' END], lambda x: x IS NOT NULL), ',') AS failures FROM conversations")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = text.quality_failures(F.col("text"), least=40, contains=("the",), excludes=("http",))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(f, ",").alias("failures"))


@query(r"""WITH h AS (SELECT page_id, url, CASE WHEN starts_with(lower(url), 'https://') THEN rtrim(string_split(string_split(string_split_regex(substr(lower(url), 9), '[/?#]')[1], '@')[-1], ':')[1], '.') ELSE '' END AS host
  FROM (SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'https://evil.com?@' || substr(url, 9) WHEN 1 THEN 'https://evil.com#@' || substr(url, 9) WHEN 2 THEN 'https://user:pw@' || upper(substr(url, 9)) WHEN 3 THEN replace(url, '.net', '.net.') ELSE url END AS url FROM pages))
SELECT page_id, host, host IN ('blog.tionsh.example.net', 'thther.example.org', 'blog.ththan.example.net') AS allowed,
  array_to_string(list_filter([CASE WHEN regexp_matches(url, '^(?:[/~]|[A-Za-z]:[\\/])') THEN 'absolute_path' END, CASE WHEN regexp_matches(url, '^(?i:file):') THEN 'file_url' END, CASE WHEN regexp_matches(url, '^(?i:https?)://[^/?#]+@') THEN 'credentials' END, CASE WHEN regexp_matches(url, '^(?i:https?)://[^?#]*(?:\?[^#]+|\??#.)') THEN 'query_or_fragment' END], lambda x: x IS NOT NULL), ',') AS unsafe FROM h""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of addresses and of such as try to pass for another host."""
    n, rest = F.col("page_id") % 10, F.substr("url", F.lit(9))
    disguised = F.when(n == 0, F.concat(F.lit("https://evil.com?@"), rest)).when(n == 1, F.concat(F.lit("https://evil.com#@"), rest)).when(n == 2, F.concat(F.lit("https://user:pw@"), F.upper(rest))).when(n == 3, F.replace("url", F.lit(".net"), F.lit(".net."))).otherwise(F.col("url"))
    p = table(spark, sf_dir, "pages").withColumn("url", disguised)
    listed = spark.createDataFrame([("blog.tionsh.example.net",), ("thther.example.org",), ("blog.ththan.example.net",)], "host string")
    return text.allowed_host(p, listed).select("page_id", F.coalesce("host", F.lit("")).alias("host"), "allowed", F.array_join(text.safe_source(F.col("url")), ",").alias("unsafe"))


# --- catalogs and runs ------------------------------------------------------------------------


@query("WITH d AS (SELECT sha256(text) AS sha256, doc_id FROM documents) SELECT sha256, min(doc_id) AS doc_id FROM d GROUP BY 1")
def artifact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object per digest: the smallest id."""
    d = table(spark, sf_dir, "documents").select(catalog.digest(F.col("text")).alias("sha256"), "doc_id")
    return catalog.new_objects(d, None, "doc_id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 10 = 5 THEN 'size_mismatch' ELSE 'hash_mismatch' END AS why FROM documents WHERE doc_id % 10 IN (3, 5) OR (doc_id % 10 = 7 AND length(text) > 0 AND right(text, 1) <> 'x')")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded against stored: every tenth text is lost, cut or changed, and must be told apart."""
    d = table(spark, sf_dir, "documents")
    recorded = d.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.length("text").alias("size"))
    k = F.col("doc_id") % 10
    found = F.when(k == 5, F.concat("text", F.lit("+"))).when(k == 7, F.concat(F.left("text", F.length("text") - 1), F.lit("x"))).otherwise(F.col("text"))
    stored = d.where(k != 3).select(F.col("doc_id").alias("id"), F.sha2(found, 256).alias("found_sha256"), F.length(found).alias("found_size"))
    return catalog.integrity(recorded, stored)


@query("WITH f AS (SELECT doc_id AS path, sha256(text) AS sha256, length(text) AS size, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) SELECT path, CASE WHEN rn > 1 THEN 'DUPLICATE' WHEN size > 4000 THEN 'QUARANTINED' ELSE 'ACTIVE' END AS state FROM f")
def import_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.length("text").alias("size"))
    found = d.select("path", F.col("sha256").alias("found_sha256"), F.col("size").alias("found_size"))
    blockers = F.array_compact(F.array(F.when(F.col("found_size") > 4000, F.lit("too_long"))))
    return catalog.import_objects(d, found, d.select("sha256").limit(0), blockers).select("path", "state")


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS parent, CASE WHEN o_custkey > 1 THEN o_custkey // 2 END AS child FROM orders WHERE o_custkey > 1), t(root, node, depth) AS (SELECT c, c, 0 FROM (SELECT max(o_custkey) AS c FROM orders) UNION SELECT root, child, depth + 1 FROM t JOIN e ON parent = node) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM t GROUP BY ALL")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a root reaches over references, with the least depth."""
    o = table(spark, sf_dir, "orders")
    edges = o.where("o_custkey > 1").select(F.col("o_custkey").alias("parent"), F.expr("o_custkey div 2").alias("child")).distinct()
    return catalog.lineage(edges, o.agg(F.max("o_custkey").alias("node")))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS INTEGER) AS level, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.state_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


STAGES = ("view", "click", "purchase")


@query("""WITH e AS (SELECT user_id, event_id, event_type, value FROM events), d AS (SELECT user_id, event_type AS stage, arg_max(value, event_id) AS v, count(*) AS n FROM e GROUP BY ALL),
s AS (SELECT * FROM (VALUES ('view', 0), ('click', 1), ('purchase', 2)) AS t(stage, place)), u AS (SELECT DISTINCT user_id FROM e),
r AS (SELECT u.user_id, s.stage, place, CASE WHEN d.v IS NULL THEN NULL WHEN d.v < 20 THEN 'FAILED' ELSE 'DONE' END AS status, coalesce(n, 0) AS n FROM u CROSS JOIN s LEFT JOIN d ON d.user_id = u.user_id AND d.stage = s.stage),
w AS (SELECT *, coalesce(sum(CASE WHEN coalesce(status, '') <> 'DONE' THEN 1 ELSE 0 END) OVER p, 0) AS opened, coalesce(max(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) OVER p, 0) AS failed FROM r WINDOW p AS (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id AS run_id, stage, CASE WHEN status IS NOT NULL THEN status WHEN failed > 0 THEN 'BLOCKED' WHEN opened = 0 THEN 'NEXT' ELSE 'PENDING' END AS state, n AS attempts FROM w""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's stages with their latest state."""
    e = table(spark, sf_dir, "events")
    records = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.when(F.col("value") < 20, "FAILED").otherwise("DONE").alias("status"), F.col("value").alias("seconds"))
    stages = spark.createDataFrame([(s, i) for i, s in enumerate(STAGES)], "stage string, place int")
    return runs.stage_rows(records, stages, records.where(F.col("stage").isin(*STAGES))).select("run_id", "stage", "state", "attempts")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type AS t FROM events WHERE value >= 1), n AS (SELECT user_id, count(*) AS events FROM events GROUP BY 1),
a AS (SELECT user_id, min({ts: ts, id: event_id}) AS k FROM e WHERE t = 'view' GROUP BY 1),
b AS (SELECT e.user_id, min({ts: ts, id: event_id}) AS k FROM e JOIN a ON a.user_id = e.user_id WHERE t = 'click' AND {ts: ts, id: event_id} > a.k GROUP BY 1),
c AS (SELECT e.user_id, min({ts: ts, id: event_id}) AS k FROM e JOIN b ON b.user_id = e.user_id WHERE t = 'purchase' AND {ts: ts, id: event_id} > b.k GROUP BY 1)
SELECT n.user_id AS session_id, events, CAST((a.k IS NOT NULL)::INT + (b.k IS NOT NULL)::INT + (c.k IS NOT NULL)::INT AS INTEGER) AS matched, c.k IS NOT NULL AS passed FROM n LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def required_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's successful events hold view, click and purchase in order."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("tool"), (F.col("value") >= 1).alias("ok"))
    return runs.required_subsequence(e, list(STAGES))


# --- further operators ------------------------------------------------------------------------


@query("WITH a AS (SELECT event_type AS k, user_id, event_id, value FROM events), r AS (SELECT user_id % 50 AS c, event_id % 7 AS rep, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS v, count(*) AS n FROM a WHERE event_id % 2 = 0 GROUP BY ALL), s AS (SELECT user_id % 50 AS c, event_id % 7 AS rep, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS v, count(*) AS n FROM a WHERE event_id % 2 = 1 GROUP BY ALL) SELECT count(*) FILTER (r.v IS NOT NULL AND s.v IS NOT NULL) AS common, count(*) FILTER (r.v IS NULL OR s.v IS NULL) AS unmatched, round(avg(CASE WHEN r.v IS NOT NULL AND s.v IS NOT NULL THEN CAST(r.n = s.n AS INTEGER) END), 6) AS equal_share, round(median(s.v) FILTER (r.v IS NOT NULL) / median(r.v) FILTER (s.v IS NOT NULL), 6) AS ratio FROM r FULL JOIN s ON r.c = s.c AND r.rep = s.rep")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over common keys: equal outputs and the ratio of medians."""
    e = table(spark, sf_dir, "events").withColumns({"c": F.col("user_id") % 50, "rep": F.col("event_id") % 7})
    run = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("c", "rep").agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("seconds"), F.count("*").alias("output"))
    r = stats.compare_runs(run(0), run(1), ["c", "rep"])
    return r.select("common", "unmatched", r6(F.col("equal_share")).alias("equal_share"), r6(F.col("ratio")).alias("ratio"))


@query("WITH r AS (SELECT o_orderkey AS case_id, list_distinct(list(l_shipdate > TIMESTAMP '1996-01-01')) AS have FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey AS case_id, CASE WHEN have IS NULL THEN 'PENDING' WHEN list_contains(have, o_orderdate > TIMESTAMP '1996-01-01') THEN 'REUSED' ELSE 'STALE' END AS status FROM orders LEFT JOIN r ON case_id = o_orderkey")
def resume_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cases have a result with their binding."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp")).alias("binding"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_shipdate") > F.lit("1996-01-01").cast("timestamp")).alias("binding"))
    return selection.resume(o, r)


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING n > 1")
def cache_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that stand for more than one value."""
    return selection.conflicts(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").select("l_partkey", "n")


@query("WITH x AS (SELECT l_partkey AS k, count(*) AS in_a FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), y AS (SELECT l_partkey AS k, count(*) AS in_b FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) SELECT coalesce(x.k, y.k) AS l_partkey, coalesce(in_a, 0) AS in_a, coalesce(in_b, 0) AS in_b FROM x FULL JOIN y ON x.k = y.k WHERE coalesce(in_a, 0) <> coalesce(in_b, 0)")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return selection.multiset_difference(li.where("l_linenumber = 1"), li.where("l_linenumber = 2"), ["l_partkey"])


@query(f"WITH {LINES_SQL}, m AS (SELECT l_orderkey AS case_id, l_linenumber AS mode, l_extendedprice AS score, row_number() OVER w AS rn, lag(l_extendedprice) OVER w AS before FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY lines.mode)) SELECT case_id, bool_or(mode <> rn) AS gap, coalesce(bool_or(score < before), false) AS falls FROM m GROUP BY 1 HAVING gap OR falls")
def contiguous_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose modes are not 1..n or whose scores fall."""
    # equal line numbers are told apart by what follows in the total order of lines
    m = lines(spark, sf_dir).select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") + F.col("mode") / 1000).alias("mode"), F.col("l_linenumber").alias("number"), F.col("l_extendedprice").alias("score"))
    return runs.contiguous(m, number="number")


@query("WITH c AS (SELECT c_custkey AS id, map {'positive': c_acctbal > 0, 'segment': c_mktsegment <> 'HOUSEHOLD', 'rmsd': false, 'nation': CASE WHEN c_nationkey < 20 THEN c_nationkey > 2 END} AS m FROM customer) SELECT id, array_to_string(list_sort([k for k in map_keys(m) if k <> 'rmsd' and not coalesce(m[k], false)]), ',') AS failed FROM c")
def failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a boolean map that do not hold; a null check does not hold, the ignored one is left out."""
    checks = F.create_map(F.lit("positive"), F.col("c_acctbal") > 0, F.lit("segment"), F.col("c_mktsegment") != "HOUSEHOLD", F.lit("rmsd"), F.lit(False), F.lit("nation"), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey") > 2))
    _, failed = stats.failed_checks("m")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), checks.alias("m")).select("id", F.array_join(failed, ",").alias("failed"))


@query("WITH d AS (SELECT doc_id AS id, lower(text) AS t FROM documents), p AS (SELECT * FROM (VALUES ('trash', 'filter'), ('licensed', 'license'), ('the', 'english'), ('idiot', 'filter')) AS v(term, tool)), n AS (SELECT * FROM (VALUES ('filter', 'score'), ('license', 'catalog')) AS v(tool, needs)), h AS (SELECT DISTINCT id, tool FROM d JOIN p ON contains(t, term)), u AS (SELECT id, tool FROM h UNION SELECT id, needs FROM h JOIN n USING (tool)), c AS (SELECT id, array_to_string(list_sort(list(tool)), ',') AS tools FROM u WHERE tool IN ('filter', 'score', 'english', 'license') GROUP BY 1) SELECT d.id, coalesce(tools, 'english,filter,license,score') AS tools, tools IS NULL AS fallback FROM d LEFT JOIN c ON c.id = d.id")
def route_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools per document by the terms in it, with what the tools need; all tools where no term stands."""
    packs = spark.createDataFrame([("trash", "filter"), ("licensed", "license"), ("the", "english"), ("idiot", "filter")], "term string, tool string")
    needs = spark.createDataFrame([("filter", "score"), ("license", "catalog")], "tool string, needs string")
    available = spark.createDataFrame([("filter",), ("score",), ("english",), ("license",)], "tool string")
    r = text.route_keywords(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), packs, needs, available)
    return r.select("id", F.array_join("tools", ",").alias("tools"), "fallback")


@query("WITH a AS (SELECT o_orderkey AS id, 'see [ord:' || o_custkey || '] and [ord:' || (o_custkey + 1) || ']' AS t, ['ord:' || o_custkey, 'ord:0'] AS k FROM orders) SELECT id, trim(replace(t, '[ord:' || regexp_extract(t, 'and .ord:([0-9]+)', 1) || ']', '')) AS checked FROM a")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown citations taken out of the text."""
    key = F.col("o_custkey").cast("string")
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("see [ord:"), key, F.lit("] and [ord:"), (F.col("o_custkey") + 1).cast("string"), F.lit("]")).alias("text"), F.array(F.concat(F.lit("ord:"), key), F.lit("ord:0")).alias("known"))
    return text.check_citations(a).select("id", "checked")


@query("SELECT event_id, round(value * 10 / nullif(value / 5, 0), 6) AS total_rate FROM events")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, _ = runs.throughput(F.col("value") * 10, F.col("value") / 5, F.col("value") / 10)
    return table(spark, sf_dir, "events").select("event_id", r6(total).alias("total_rate"))


@query("WITH e AS (SELECT user_id, value, event_type FROM events), r AS (SELECT user_id, bool_or(event_type = 'purchase') AS passed, bool_or(event_type = 'click') AS cited, bool_and(value >= 0) AS tools_ok, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS seconds FROM e GROUP BY 1) SELECT count(*) AS runs, round(avg(CAST(passed AS INTEGER)), 6) AS pass_rate, round(avg(CAST(cited AS INTEGER)), 6) AS citation_rate, round(avg(CAST(tools_ok AS INTEGER)), 6) AS tool_rate, round(quantile_cont(seconds, 0.5), 5) AS p50, round(quantile_cont(seconds, 0.95), 5) AS p95, coalesce(least(avg(CAST(passed AS INTEGER)), avg(CAST(cited AS INTEGER)), avg(CAST(tools_ok AS INTEGER))) = 1, false) AS eligible FROM r")
def agent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over all runs and the gate over them."""
    e = table(spark, sf_dir, "events")
    r = e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("passed"), F.bool_or(F.col("event_type") == "click").alias("cited"), F.bool_and(F.col("value") >= 0).alias("tools_ok"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("seconds"))
    a = runs.agent_rollup(r)
    return a.select("runs", *(r6(F.col(c)).alias(c) for c in ("pass_rate", "citation_rate", "tool_rate")), *(F.round(c, 5).alias(c) for c in ("p50", "p95")), "eligible")


@query("WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS q FROM lineitem GROUP BY ALL), b AS (SELECT * REPLACE (q + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS q) FROM a WHERE l_orderkey % 13 <> 0) SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, CASE WHEN b.q IS NULL THEN 'only_recorded' ELSE 'q' END AS reasons FROM a LEFT JOIN b USING (l_orderkey, l_partkey, l_suppkey) WHERE b.q IS NULL OR abs(a.q - b.q) > 1e-6")
def recorded_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded summary against a recomputed one that lost rows and changed some."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    a = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"))
    b = a.where("l_orderkey % 13 != 0").withColumn("q", F.col("q") + F.when(F.col("l_orderkey") % 11 == 0, 1).otherwise(0))
    return stats.recorded_differences(a, b, keys, ["q"]).select(*keys, F.array_join("reasons", ",").alias("reasons"))


_WHITE = "' ' || chr(9) || chr(10) || chr(13)"


# line by line what is gathered and what goes out; then each passage cut from its front
@query(f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, l, 1 AS i, CAST(NULL AS VARCHAR) AS section, '' AS buf, 0 AS held, CAST(NULL AS VARCHAR) AS out_section, CAST(NULL AS VARCHAR) AS out_text FROM d
  UNION ALL SELECT doc_id, l, i + 1, CASE WHEN head <> '' THEN head ELSE section END, CASE WHEN goes THEN '' ELSE now END, CASE WHEN goes THEN 0 ELSE size END, section, CASE WHEN goes THEN now END
  FROM (SELECT *, head <> '' OR size >= 1800 OR i > len(l) AS goes FROM (SELECT *, CASE WHEN head <> '' OR i > len(l) THEN buf WHEN held = 0 THEN l[i] ELSE buf || chr(10) || l[i] END AS now, CASE WHEN head <> '' OR i > len(l) THEN held ELSE held + length(l[i]) + 1 END AS size
    FROM (SELECT *, CASE WHEN i <= len(l) THEN regexp_extract(l[i], '^#{{1,6}}\\s+(.+?)\\s*$', 1) ELSE '' END AS head FROM f WHERE i <= len(l) + 1)))),
c AS (SELECT doc_id, i, 0 AS n, out_section AS section, trim(out_text, {_WHITE}) AS rest, CAST(NULL AS VARCHAR) AS piece FROM f WHERE out_text IS NOT NULL
  UNION ALL SELECT doc_id, i, n + 1, section, ltrim(substr(rest, cut_at + 1), {_WHITE}), substr(rest, 1, cut_at)
  FROM (SELECT *, CASE WHEN length(rest) <= 1800 THEN length(rest) WHEN strpos(substr(rest, 902, 899), chr(10)) = 0 THEN 1800 ELSE 1800 - strpos(reverse(substr(rest, 902, 899)), chr(10)) END AS cut_at FROM c WHERE rest <> '')),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, n) - 1 AS INTEGER) AS chunk_no FROM c WHERE piece IS NOT NULL)
SELECT doc_id, chunk_no, section, trim(piece, {_WHITE}) AS text, substr(sha256(coalesce(section, '') || chr(0) || chunk_no || chr(0) || piece), 1, 20) AS chunk_id FROM p""")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks by sections and line ends; the packing is sequential in each document."""
    return text.chunk_sections(table(spark, sf_dir, "documents"))


# point by point: the first cluster in reach takes it and moves, or it begins one
@query(f"""WITH RECURSIVE {LINES_SQL}, p AS (SELECT l_orderkey AS s, list({{'t': l_linestatus, 'x': l_quantity, 'y': l_discount * 100, 'z': l_tax * 100}} ORDER BY l_linestatus, l_quantity, l_discount * 100, l_tax * 100) AS p FROM lines GROUP BY 1),
r AS (SELECT s, p, 1 AS i, CAST([] AS STRUCT(t VARCHAR, x DOUBLE, y DOUBLE, z DOUBLE, n BIGINT)[]) AS c FROM p
  UNION ALL SELECT s, p, i + 1, CASE WHEN hit = 0 THEN list_append(c, {{'t': q.t, 'x': q.x, 'y': q.y, 'z': q.z, 'n': CAST(1 AS BIGINT)}})
    ELSE list_transform(c, lambda v, k: CASE WHEN k = hit THEN {{'t': v.t, 'x': (v.x * v.n + q.x) / (v.n + 1), 'y': (v.y * v.n + q.y) / (v.n + 1), 'z': (v.z * v.n + q.z) / (v.n + 1), 'n': v.n + 1}} ELSE v END) END
  FROM (SELECT *, coalesce(list_position(list_transform(c, lambda v: v.t = q.t AND sqrt((v.x - q.x) * (v.x - q.x) + (v.y - q.y) * (v.y - q.y) + (v.z - q.z) * (v.z - q.z)) <= 5), true), 0) AS hit FROM (SELECT *, p[i] AS q FROM r WHERE i <= len(p))))
SELECT s AS structure_id, c.t AS type, round(c.x, 6) AS x, round(c.y, 6) AS y, round(c.z, 6) AS z, c.n AS members FROM (SELECT s, unnest(c) AS c FROM r WHERE i = len(p) + 1)""")
def point_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of same-type points per structure."""
    c = geometry.cluster_points(_atoms(spark, sf_dir).select("structure_id", "type", "x", "y", "z"), 5.0)
    return c.select("structure_id", "type", *(r6(F.col(x)).alias(x) for x in "xyz"), "members")


@query(None)
def coherent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's hits over coherent matches only, with their overlays."""
    from ..operators import overlay

    best, n = _search(spark, sf_dir)
    first = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n")).where(F.col("n").between(4, 9)).agg(F.min("l_orderkey").alias("o")).first()
    own = objects(spark, sf_dir).where(F.col("object_id") == first.o).first()
    hits = overlay.coherent_hits(best, objects(spark, sf_dir), [list(f.position) for f in own.features])
    return geometry.top_objects(hits.withColumn("score", F.col("coverage") / (1 + F.col("median_error"))), 512)


@query(None)
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the names of the same brand with the next key, by containment or alignment."""
    from ..operators import overlay

    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    pairs = p.withColumn("reference", F.lead("p_name").over(W.partitionBy("p_brand").orderBy("p_partkey"))).where("reference is not null")
    return overlay.verify_identity(pairs.select("p_partkey", F.col("p_name").alias("observed"), "reference"), "p_partkey")
