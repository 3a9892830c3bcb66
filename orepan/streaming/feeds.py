"""Streaming forms of the catalog import, the run states and the tool sequence.

Each gives on a stream what its batch operator gives on the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest_folder(spark: SparkSession, incoming: str, table_path: str, checkpoint: str, *, max_bytes: int = 64 << 20, max_files: int = 1000) -> StreamingQuery:
    """Files of a folder as catalog rows, exactly one per content hash; too large or empty ones are quarantined.

    A micro batch is joined with what the table holds, and written under its batch number, so a batch
    that is run again replaces itself.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(incoming)
    state = F.when((F.col("length") > max_bytes) | (F.col("length") == 0), "QUARANTINED").otherwise("ACTIVE")
    rows = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), state.alias("state"))

    def write(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("sha256").agg(F.min(F.struct("path", "size", "state")).alias("f")).select("sha256", "f.*")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(table_path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            known = spark.read.schema("sha256 string, batch long").parquet(table_path).where(F.col("batch") != number).select("sha256")
            first = first.join(known, "sha256", "left_anti")
        first.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(events: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """The last record of each run and stage so far (update mode); the watermark only lets old runs go."""
    seen = events.withWatermark("ts", delay)
    return seen.groupBy("run_id", "stage").agg(F.max_by(F.struct("status", "seconds"), F.struct("ts", "seq")).alias("last"), F.count("*").alias("attempts"), F.max("ts").alias("ts"))


def tool_cursor(events: DataFrame, required: list[str], *, delay: str = "10 minutes") -> DataFrame:
    """How far each session has got in the required tools: ``session_id, matched, passed`` whenever it gets further, and at first.

    ``events``: session_id, seq, tool, ok, ts.  Failures and other tools may stand between.  Rows wait until the
    watermark (``delay`` behind the latest ``ts``) has passed them and are then taken by (ts, seq), so rows that
    come late or in another order, within the delay, give what the batch operator gives on all rows.  Rows
    behind the watermark are not taken.  A session keeps its place and the rows that wait; rows that cannot move the place,
    and those of a session that has passed, are not kept.  Needs the RocksDB state store (see ``state_store``).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Cursor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.at = handle.getValueState("at", "at int")
            self.waiting = handle.getListState("waiting", "ms long, seq long, tool string")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            known = self.at.exists()
            at, passed_ms = self.at.get()[0] if known else 0, timerValues.getCurrentWatermarkInMs()
            if not known:
                self.at.update((0,))
                yield pd.DataFrame({"session_id": [key[0]], "matched": [0], "passed": [not required]})
            new = []
            for pdf in rows:
                if at < len(required):
                    pdf = pdf[pdf["ok"].fillna(False).astype(bool) & pdf["tool"].isin(required)]
                    new += [(int(ms), int(seq), tool) for ms, seq, tool in zip(pdf["ms"], pdf["seq"], pdf["tool"]) if ms > passed_ms]
            if new:
                self.waiting.appendList(new)
                for ms in {r[0] for r in new}:
                    self.handle.registerTimer(ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            passed_ms = timerValues.getCurrentWatermarkInMs()
            rows = sorted(self.waiting.get())
            due, later = [r for r in rows if r[0] <= passed_ms], [r for r in rows if r[0] > passed_ms]
            if due:
                before = at = self.at.get()[0]
                for _, _, tool in due:
                    at += at < len(required) and tool == required[at]
                self.waiting.clear()
                if later and at < len(required):
                    self.waiting.put(later)
                if at > before:
                    self.at.update((at,))
                    yield pd.DataFrame({"session_id": [key[0]], "matched": [at], "passed": [at == len(required)]})

        def close(self) -> None:
            pass

    kind = dict(events.dtypes)["session_id"]
    rows = events.withWatermark("ts", delay).select("session_id", "seq", "tool", "ok", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("session_id").transformWithStateInPandas(Cursor(), f"session_id {kind}, matched int, passed boolean", "update", "eventtime")


def state_store(spark: SparkSession) -> None:
    """Sets the state store that ``tool_cursor`` needs; to be called by a job before its streams start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
