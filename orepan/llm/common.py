"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Folders made below the shared folder, for ``remove_scratch``.
_MADE: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent the context's checkpoint folder counts; a temporary folder is made on a
    single machine only (tests), since executors elsewhere could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root and context._jsc.sc().getCheckpointDir().isDefined():
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-orepan-")
        context.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


def remove_scratch(since: int = 0) -> None:
    """Remove the folders made after the first ``since`` (see ``made``): only once nothing lazy reads them."""
    while len(_MADE) > since:
        fs, path = open_fs(_MADE.pop())
        try:
            fs.delete_dir(path)
        except FileNotFoundError:  # nothing was written there
            pass


def made() -> int:
    return len(_MADE)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors, wherever the driver has it from."""
    ship(df.sparkSession)

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return what a task has freed to the machine: its Python worker lives on beside other work."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For a job over whole documents, which are wide rows: bounds what a worker and the JVM's buffers hold.

    A setting of the job's session; the operators themselves change none.
    """
    if spark.conf.get(BATCH) == "10000":  # Spark's own default; another value is the user's choice
        spark.conf.set(BATCH, str(rows))


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_orepan_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-orepan-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._orepan_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(id_col: str):
    """Unsigned crc32 of the id written in decimal."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a URI; works for file:, hdfs:, s3: and gs: folders alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
