"""Writing indexes, objects and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import catalog, geometry


def publish_index(objects: DataFrame, name: str, *, width: float = geometry.BIN_WIDTH, buckets: int = 64) -> DataFrame:
    """Write the triangle index as a table bucketed by cell and sorted by it; an existing table is an error.

    Each triangle also has its object's number of points.  What follows from the types and distances is not written
    (``geometry.completed`` adds it again): the rows are sorted for the buckets, and narrow ones need no spill.  Returns one row of counts and the hash of the configuration.
    """
    t = geometry.binned(geometry.triangles(objects.withColumn("points", F.size("features")), keep=("object_id", "conformer_id", "points")), width)
    t = t.drop("edges", "type_key", "kinds", "perimeter", "b0", "b1", "b2")
    t.write.mode("errorifexists").bucketBy(buckets, "cell").sortBy("cell").saveAsTable(name)
    saved = objects.sparkSession.table(name)
    return saved.agg(F.count_distinct("object_id").alias("objects"), F.count_distinct("object_id", "conformer_id").alias("conformers"), F.count("*").alias("triangles")).withColumn("config_sha256", F.lit(catalog.receipt_hash({"bin_width": width, "buckets": buckets})))


def store_objects(incoming: DataFrame, path: str) -> DataFrame:
    """Append the objects (``sha256, content``) that the store lacks, one per digest; returns what was added.

    A row whose digest is not that of its content is an error, as the store must hold what it names.
    """
    spark = incoming.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    present = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = spark.read.parquet(path).select("sha256") if present else None
    right = F.assert_true(F.col("sha256").eqNullSafe(F.sha2("content", 256)), F.concat(F.lit("not the digest of its content: "), F.coalesce("sha256", F.lit("null"))))
    first = incoming.where(right.isNull()).dropDuplicates(["sha256"])
    new = first if known is None else first.join(known, "sha256", "left_anti")
    # each call writes a part of its own, which is what was added
    part = f"{path}/added={uuid.uuid4().hex}"
    new.write.parquet(part)
    return spark.read.schema(incoming.schema).parquet(part)


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """All rows with their number in ``order`` (from 1): sorted by ranges, each of which starts after those before it."""
    keys = [F.desc(x.removesuffix(" desc")) if x.endswith(" desc") else F.col(x) for x in order]
    # the sort's ranges are fixed by writing it, as both their sizes and their rows are needed
    placed = df.orderBy(*keys).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    placed = catalog.checkpointed(placed)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("c"))
    before = sizes.select("__part", (F.sum("c").over(W.orderBy("__part")) - F.col("c")).alias("__before"))  # one row a range
    row = F.row_number().over(W.partitionBy("__part").orderBy("__row"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + row).drop("__part", "__row", "__before")


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A report as lines of a Markdown table, in order (``place, line``); all rows, numbered by ranges and not in one task."""
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))]
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    ranked = numbered(df, order).select((F.col("place") + 1).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |")).alias("line"))
    return df.sparkSession.createDataFrame(head, "place long, line string").unionByName(ranked)


def write_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("place").select("line").coalesce(1).write.text(path)
