"""The registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, line_dedup, lm, packing, sharding, simhash, token_files, topk, toxicity, turn_trie, vector_codes, warc
from .common import crc_of_id, small_batches, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(spark, table(spark, sf_dir, "documents"), token_files.vocabulary_path("byte_bpe_50k.json"), end_id=2)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20, scale=64.0)


TOXIC_AT = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(3)) == 1
    model = toxicity.train(*toxicity.training_sample(docs, table(spark, sf_dir, "labels"), learn=~held_out))
    return toxicity.score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), words=50).select("doc_id", "text", "removed_lines")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(crc_of_id("doc_id"), F.lit(7))
    found = lm.score_texts(table(spark, sf_dir, "documents"), learn=fold != 2, fold=fold == 3)
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), token_files.vocabulary_path("word_bpe_49k.json"), end_id=1, size=2048)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=3)
    return found.select("doc_id", simhash.hex64("fp").alias("fingerprint"), "component_id")


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), token_files.vocabulary_path("byte_bpe_50k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256.0)
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def job(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: job(f) for f in (op1_token_files, op2_topk, op3_toxicity, op4_sharding, op5_line_dedup, op6_lm, op7_warc, op8_packing, op9_decontamination, op10_simhash, op11_turn_trie, op12_bpe, op13_vector_codes)}


def _vector_codes_sql(rounds: int) -> str:
    """Each round: the nearest entry of every part, then the means of the entries, rounded down."""
    far = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.y, b.y)])"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT p.vec_id, p.j, min({{'d': CAST({far} AS BIGINT), 'e': b.e}}) AS m FROM p JOIN b{r} b USING (j) GROUP BY ALL)")
        if r < rounds:
            steps.append(f"""
        s{r} AS (SELECT j, m.e AS e, i, CAST(sum(y[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN p USING (vec_id, j), (SELECT unnest(range(1, w + 1)) AS i FROM w) GROUP BY ALL),
        b{r + 1} AS (SELECT b.j, b.e, coalesce(t.y, b.y) AS y FROM b{r} b LEFT JOIN (SELECT j, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{r} GROUP BY ALL) t USING (j, e))""")
    return f"""
        WITH v AS (
            SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        w AS (SELECT max(len(x)) // 16 AS w FROM v),
        p AS (SELECT vec_id, label, j, x[j * w + 1 : (j + 1) * w] AS y FROM v, w, (SELECT unnest(range(16)) AS j)),
        b0 AS (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, y FROM p SEMI JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64) USING (vec_id)),
        {",".join(steps)},
        c AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY j) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h"""


ORACLE = {
    # crc32 by its table; a subtree is every node that has the node's turns at its beginning
    "op11_turn_trie": r"""
        WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)),
        crc AS (SELECT list(c ORDER BY i) AS t FROM bits),
        turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t FROM turns GROUP BY conv_id),
        h AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                                  lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) % 4 AS h FROM own, crc),
        seq AS (SELECT o.conv_id, list_concat(coalesce(f.t[1:h.h], []), o.t[h.h + 1 :]) AS t FROM own o JOIN h USING (conv_id) LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20),
        places AS (SELECT conv_id, d, t[1:d] AS path, d = len(t) AS ended FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM seq)),
        nodes AS (
            SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256,
                   (count(*) - 1) * len(regexp_extract_all(coalesce(path[-1].text, ''), '[^\x20\x09-\x0D]+')) AS own_saved
            FROM places GROUP BY path
        ),
        kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        marked AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
        above AS (SELECT path[1:d] AS path, own_saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS d FROM marked)),
        sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved) AS saved FROM above GROUP BY path)
        SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
        FROM marked m JOIN sums s USING (path) LEFT JOIN nodes p ON m.depth > 0 AND p.path = m.path[1:m.depth - 1]""",
    "op13_vector_codes": _vector_codes_sql(2),
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM g""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
