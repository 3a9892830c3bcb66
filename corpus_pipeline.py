"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Each stage reads the table that the stage before it wrote, takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of ``documents``.

In all stages texts are judged by what they say: rows that share an id, or have none, are judged one by one,
null texts count as empty, further columns are left out, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orepan.llm import decontam, line_dedup, packing, simhash, token_files, toxicity
from orepan.llm.common import crc_of_id, made, remove_scratch, shared_dir, small_batches, table, written
from orepan.llm.queries import TOXIC_AT

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SIMILARITY, SHINGLE, WORDS = 0.8, 5, 8


def _as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go.  It learns from the labels of ``documents``.

    Rows without an id are scored, never learned from; without labels nothing goes; equal texts share one lot.
    """
    learn = F.pmod(crc_of_id("doc_id"), F.lit(3)) != 1
    model = toxicity.train(*toxicity.training_sample(docs, table(spark, sf_dir, "labels"), learn=learn))
    model.cached_words = 60_000  # the stages share their workers' memory
    return toxicity.keep_below(docs, model, TOXIC_AT).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words and more are deleted from the texts; all documents stay.

    Ids say which place is the earlier one; rows without an id come last, each a place of its own.
    """
    return _as_documents(line_dedup.dedup_lines(docs, words=50))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays.

    Of one id's different texts each is judged by itself; rows that repeat an id and its text are one document,
    of which one row stays.  Rows without an id are the last of their group, so copies among them leave one.
    Null and blank texts are copies of each other.
    """
    first = simhash.first_of_similar(docs, k=SHINGLE, similarity=SIMILARITY, words=WORDS)
    keep = written(first.select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")), "firsts")
    keyed = docs.withColumn("__key", simhash.text_key())
    kept = keyed.join(keep.hint("merge"), (F.col("__key") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: all rows with such a text, whatever their id, and no others."""
    keyed = docs.withColumn("__key", simhash.text_key())
    found = decontam.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="__key").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(written(found, "leaks"), "__key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of 2048 ids: one row per piece of a document.

    Every row is packed by itself, under its id (which may be null); an empty text is its end id alone.
    """
    return packing.pack(docs, token_files.vocabulary_path("word_bpe_49k.json"), end_id=1, size=2048, cached_chunks=400_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL has no form for a trained classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage wrote on its way is then removed."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = shared_dir(spark, f"stage-{name}")
        before = made()
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(out)
        remove_scratch(before)
        docs = spark.read.schema(kept.schema).parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
