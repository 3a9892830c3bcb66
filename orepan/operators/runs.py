"""Run logs: latest stages, completion, tool sequences and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import quantiles


def required_subsequence(events: DataFrame, required: list[str], *, by: str = "session_id", order: str = "seq") -> DataFrame:
    """Per session whether the required tools succeed in order, and how far it got.

    Other tools, and failures of the tool that is due, may stand between.
    """
    want = F.array(*(F.lit(t) for t in required))
    # only successes of required tools can move the cursor
    useful = F.when(F.col("ok") & F.array_contains(want, F.col("tool")), F.struct(F.col(order).alias("o"), F.col("tool").alias("t")))
    cursor = F.aggregate(F.sort_array(F.collect_list(useful)), F.lit(0), lambda c, e: c + F.when(F.get(want, c) == e["t"], 1).otherwise(0))
    return events.groupBy(by).agg(F.count("*").alias("events"), cursor.alias("matched")).withColumn("passed", F.col("matched") == len(required))


def stage_rows(runs: DataFrame, stages: DataFrame, records: DataFrame) -> DataFrame:
    """Every stage of every run with its last record; the first stage without one is NEXT, later ones PENDING or BLOCKED.

    ``runs``: run_id; ``stages``: stage, place; ``records``: run_id, stage, seq, status, seconds.
    """
    last = records.groupBy("run_id", "stage").agg(F.max_by(F.struct("status", "seconds"), "seq").alias("r"), F.count("*").alias("attempts"))
    spine = runs.select("run_id").distinct().join(F.broadcast(stages))
    joined = spine.join(last, ["run_id", "stage"], "left")
    own = W.partitionBy("run_id").orderBy("place")
    open_ = F.sum(F.when(F.coalesce(F.col("r.status"), F.lit("")) != "DONE", 1).otherwise(0)).over(own.rowsBetween(W.unboundedPreceding, -1))
    failed = F.max(F.when(F.col("r.status") == "FAILED", 1).otherwise(0)).over(own.rowsBetween(W.unboundedPreceding, -1))
    state = F.when(F.col("r.status").isNotNull(), F.col("r.status")).when(F.coalesce(failed, F.lit(0)) > 0, "BLOCKED").when(F.coalesce(open_, F.lit(0)) == 0, "NEXT").otherwise("PENDING")
    return joined.select("run_id", "stage", "place", state.alias("state"), F.col("r.seconds").alias("seconds"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def dossier_rows(runs: DataFrame, stages: list[str], records: DataFrame, receipts: DataFrame, failures: DataFrame, *, as_of=None) -> DataFrame:
    """Every stage of every run, with what its record, its last POSTFLIGHT receipt and the run's last failure say of it.

    ``runs``: run_id, last_stage (null: none yet); ``records``: run_id, stage, seq, seconds; ``receipts``: run_id, stage, seq,
    phase, decision, artifact_id; ``failures``: run_id, stage, seq, recoverable.  Rows after ``as_of`` (a seq) do not count.

    A stage with a record is COMPLETED_ACCEPTED if its last receipt accepts it, else COMPLETED_UNRECEIPTED.  Without one it is
    BLOCKED_RETRYABLE or FAILED if the run's last failure is its own, NEXT if it follows the last stage, else PENDING.
    The streams are put together in one shuffle by (run, stage); a run then has a row a stage at most.
    """
    kinds = {"record": "struct<seq:bigint,seconds:double>", "receipt": "struct<seq:bigint,decision:string,artifact_id:string>", "failure": "struct<seq:bigint,stage:string,recoverable:boolean>"}

    def tagged(df, kind, where=F.lit(True)):
        fields = [f.split(":") for f in kinds[kind][7:-1].split(",")]
        own = F.struct(*(F.col(c).cast(t).alias(c) for c, t in fields))
        in_time = F.lit(True) if as_of is None else F.col("seq") <= F.lit(as_of)
        return df.where(where & in_time).select("run_id", "stage", *(own.alias(k) if k == kind else F.lit(None).cast(t).alias(k) for k, t in kinds.items()))

    rows = tagged(records, "record").unionByName(tagged(receipts, "receipt", F.col("phase") == "POSTFLIGHT")).unionByName(tagged(failures, "failure"))
    # receipts of one place in the order go by their content, so that the last one is always the same
    each = rows.groupBy("run_id", "stage").agg(F.max("record").alias("record"), F.max("receipt").alias("receipt"), F.max("failure").alias("failure"))
    per_run = each.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("stage").isin(stages), F.struct("stage", F.struct("record", "receipt"))))).alias("of"), F.max("failure").alias("failure"))
    order = F.array(*(F.lit(s) for s in stages))
    spine = runs.groupBy("run_id").agg(F.max(F.array_position(order, F.coalesce("last_stage", F.lit("")))).alias("done")).join(per_run, "run_id", "left")
    out = spine.select("run_id", "done", "of", "failure", F.posexplode(order).alias("at", "stage")).withColumns({"position": F.col("at") + 1, "r": F.try_element_at("of", F.col("stage"))})
    accepted = F.coalesce(F.col("r.receipt.decision") == "ACCEPTED", F.lit(False))
    status = (
        F.when(F.col("r.record").isNotNull() & accepted, "COMPLETED_ACCEPTED")
        .when(F.col("r.record").isNotNull(), "COMPLETED_UNRECEIPTED")
        .when(F.col("failure.stage") == F.col("stage"), F.when(F.coalesce("failure.recoverable", F.lit(False)), "BLOCKED_RETRYABLE").otherwise("FAILED"))
        .when(F.col("position") == F.col("done") + 1, "NEXT")
        .otherwise("PENDING")
    )
    return out.select("run_id", "position", "stage", status.alias("status"), F.col("r.record").isNotNull().alias("completed"), accepted.alias("accepted"), F.col("r.record.seconds").alias("seconds"), F.col("r.receipt.artifact_id").alias("acceptance_receipt"))


def completion(rows: DataFrame) -> DataFrame:
    """Done stages, their share of all stages, and the seconds of each run."""
    return rows.groupBy("run_id").agg(F.count("*").alias("stages"), F.count_if(F.col("state") == "DONE").alias("done"), F.try_divide(F.count_if(F.col("state") == "DONE").cast("double"), F.count("*")).alias("share"), F.sum("seconds").alias("seconds"))


def throughput(tokens: Column, total: Column, first: Column, guard: float = 0.01) -> tuple[Column, Column]:
    """Tokens a second end to end, and after the first token (null if that took less than the guard)."""
    after = total - first
    return F.try_divide(tokens.cast("double"), total), F.when(after >= guard, F.try_divide((tokens - 1).cast("double"), after))


def agent_rollup(runs: DataFrame) -> DataFrame:
    """Rates over all agent runs, and eligibility: every gate at 1.

    ``runs``: passed, cited, tools_ok (booleans; null counts as false), seconds.
    """
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    out = runs.agg(F.count("*").alias("runs"), share("passed").alias("pass_rate"), share("cited").alias("citation_rate"), share("tools_ok").alias("tool_rate"))
    ends = {f"{side}{p}": f(p) for p in (0.5, 0.95) for side, f in (("a", quantiles.lower), ("b", quantiles.upper))}
    found = quantiles.at_places(runs, [], "seconds", {k.replace(".", "_"): f for k, f in ends.items()})
    times = found.agg(*(F.max(quantiles.between(F.col(f"a{p}".replace(".", "_")), F.col(f"b{p}".replace(".", "_")), F.col("n"), p)).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95))))
    out = out.join(times)  # one row each
    return out.withColumn("eligible", F.coalesce(F.least("pass_rate", "citation_rate", "tool_rate") == 1, F.lit(False)))


def contiguous(modes: DataFrame, by: str = "case_id", mode: str = "mode", score: str = "score", number: str | None = None) -> DataFrame:
    """Groups whose modes (``number``, in the order of ``mode``) are not 1..n in steps of one, or whose scores fall."""
    own = W.partitionBy(by).orderBy(mode)
    marked = modes.select(by, (F.col(number or mode) != F.row_number().over(own)).alias("gap"), (F.col(score) < F.lag(score).over(own)).alias("falls"))
    return marked.groupBy(by).agg(F.coalesce(F.bool_or("gap"), F.lit(False)).alias("gap"), F.coalesce(F.bool_or("falls"), F.lit(False)).alias("falls")).where("gap or falls")
