"""Selection funnels: eligibility reasons, deterministic picks, and coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def reasons(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that hold; a rule that is null does not hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))


def first_reason(rules: dict[str, Column], default: str = "OTHER") -> Column:
    """Name of the first rule that holds, in order."""
    out = None
    for name, rule in rules.items():
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise(default)


def reason_histogram(df: DataFrame, column: str = "reasons") -> DataFrame:
    """Rows per reason, and the rows without any as ``eligible``."""
    each = F.explode(F.when(F.size(column) == 0, F.array(F.lit("eligible"))).otherwise(F.col(column)))
    return df.select(each.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def holdout(candidates: DataFrame, namespace: str, count: int, *, id_col: str = "id", reasons_col: str = "reasons") -> DataFrame:
    """Eligible candidates in the order of sha256(namespace:id); the first ``count`` are selected.

    Every other row keeps a reason: its own, or ``not_selected``.
    """
    h = F.sha2(F.concat_ws(":", F.lit(namespace), F.col(id_col).cast("string")), 256)
    eligible = candidates.where(F.size(reasons_col) == 0).withColumn("h", h)
    chosen = eligible.orderBy("h", id_col).limit(count).select(id_col, F.row_number().over(W.orderBy("h", id_col)).alias("place"))
    out = candidates.join(chosen, id_col, "left")
    why = F.when(F.size(reasons_col) > 0, F.col(reasons_col)).when(F.col("place").isNull(), F.array(F.lit("not_selected"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("why", why)


def first_per_group(df: DataFrame, group: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """First row of each group in ``order`` (which ends in an id), then the first ``limit`` of those."""
    best = df.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("rn = 1").drop("rn")
    return best if limit is None else best.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(W.orderBy(*order)))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def coverage(planned: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Keys where successes and failures do not cover the plan exactly, with the defect."""
    p = planned.groupBy(key).agg(F.count("*").alias("p"))
    d = done.groupBy(key).agg(F.count("*").alias("d"))
    f = failed.groupBy(key).agg(F.count("*").alias("f"))
    z = lambda c: F.coalesce(c, F.lit(0))
    defect = F.when(z("p") == 0, "unexpected").when(z("p") > 1, "planned_twice").when((z("d") > 0) & (z("f") > 0), "done_and_failed").when(z("d") + z("f") > 1, "reported_twice").when(z("d") + z("f") == 0, "missing")
    return p.join(d, key, "full_outer").join(f, key, "full_outer").select(key, defect.alias("defect")).where("defect is not null")


def resume(cases: DataFrame, results: DataFrame) -> DataFrame:
    """REUSED where a result has the same binding, STALE where another, PENDING where none (``case_id, binding``)."""
    r = results.groupBy("case_id").agg(F.collect_set("binding").alias("have"))
    status = F.when(F.col("have").isNull(), "PENDING").when(F.array_contains("have", F.col("binding")), "REUSED").otherwise("STALE")
    return cases.join(r, "case_id", "left").select("case_id", status.alias("status"))


def conflicts(cache: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return cache.groupBy(key).agg(F.count_distinct(value).alias("n"), F.sort_array(F.collect_set(value)).alias("found")).where("n > 1")


def trace_check(expected: DataFrame, supplied: DataFrame, key: str) -> DataFrame:
    """Rows of a reproduced selection that the supplied one lacks, and the reverse."""
    a = expected.select(key, F.lit("missing").alias("defect")).join(supplied.select(key), key, "left_anti")
    return a.unionByName(supplied.select(key, F.lit("unexpected").alias("defect")).join(expected.select(key), key, "left_anti"))


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose numbers of rows differ, with both numbers; nulls compare equal."""
    rows = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return rows.groupBy(*keys).agg(F.sum("x").alias("in_a"), F.sum("y").alias("in_b")).where("in_a != in_b")


def funnel(stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Distinct keys per stage in order, with the share kept from the stage before."""
    rows = None
    for i, (name, df) in enumerate(stages):
        part = df.agg(F.count_distinct(key).alias("n")).select(F.lit(i).alias("place"), F.lit(name).alias("stage"), "n")
        rows = part if rows is None else rows.unionByName(part)
    # one row per stage
    return rows.withColumn("kept", F.try_divide(F.col("n").cast("double"), F.lag("n").over(W.orderBy("place"))))
