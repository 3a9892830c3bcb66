"""Benchmark and study statistics over frozen denominators.

Rules that hold throughout: failures and missing results stay in the denominator, an empty denominator
gives null, and every ranking ends in an id.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import quantiles


def rate(hits: Column, total: Column) -> Column:
    """hits / total, null for an empty total."""
    return F.try_divide(hits.cast("double"), total)


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> Column:
    """Wilson score interval as ``struct<low, high>``; null for an empty total."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    n, p = total.cast("double"), F.try_divide(successes.cast("double"), total)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(total > 0, F.struct(F.greatest(middle - half, F.lit(0.0)).alias("low"), F.least(middle + half, F.lit(1.0)).alias("high")))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided McNemar p: 2 * P(Binomial(n, 1/2) <= min), at most 1; 1 without discordant pairs.

    Terms are multiplied up from the first one in logarithms, so large counts neither overflow nor vanish.
    """
    n, m = (only_a + only_b).cast("int"), F.least(only_a, only_b).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))

    def step(s, i):
        log = F.when(i == 0, s["log"]).otherwise(s["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), m), start, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def case_recovery(cases: DataFrame, modes: DataFrame, *, threshold: float = 2.0, top: int = 5) -> DataFrame:
    """Per case of the manifest: status, best pose, first recovered mode, top-1 and top-n success.

    ``cases``: case_id; ``modes``: case_id, mode, score, rmsd, valid.  A case without modes is NOT_ATTEMPTED;
    one whose first modes lack a metric is METRIC_FAILED.
    """
    ok = F.col("valid") & (F.col("rmsd") <= threshold)
    first = F.col("mode") <= top
    found = modes.groupBy("case_id").agg(
        F.count("*").alias("modes"),
        F.count_if(F.col("rmsd").isNull() | F.col("valid").isNull()).alias("unmeasured"),
        F.min(F.when(first, F.struct("rmsd", "mode"))).alias("oracle"),
        F.min(F.when(first & F.col("valid"), F.struct("rmsd", "mode"))).alias("valid_oracle"),
        F.min(F.when(ok, F.col("mode"))).alias("first_recovered"),
        F.coalesce(F.bool_or(ok & (F.col("mode") == 1)), F.lit(False)).alias("top1"),
        F.coalesce(F.bool_or(ok & first), F.lit(False)).alias("topn"),
        ((F.max("mode") == F.count("*")) & (F.min("mode") == 1)).alias("contiguous"),
    )
    status = F.when(F.col("modes").isNull(), "NOT_ATTEMPTED").when(F.col("unmeasured") > 0, "METRIC_FAILED").otherwise("METRICS_COMPLETED")
    joined = cases.select("case_id").join(found, "case_id", "left")
    none = F.lit(False)
    return joined.select("case_id", status.alias("status"), F.col("oracle.rmsd").alias("best_rmsd"), F.col("oracle.mode").alias("best_mode"), F.col("valid_oracle.rmsd").alias("best_valid_rmsd"), "first_recovered", F.coalesce("top1", none).alias("top1"), F.coalesce("topn", none).alias("topn"), F.coalesce("contiguous", none).alias("contiguous"))


def arm_summary(recovery: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Counts, rates and intervals of one arm over all its cases."""
    n, done = F.count("*"), F.count_if(F.col("status") == "METRICS_COMPLETED")
    one, many = F.count_if("top1"), F.count_if("topn")
    out = recovery.agg(n.alias("cases"), done.alias("completed"), one.alias("top1"), many.alias("topn"))
    for c in ("completed", "top1", "topn"):
        out = out.withColumns({f"{c}_rate": rate(F.col(c), F.col("cases")), f"{c}_ci": wilson(F.col(c), F.col("cases"), confidence)})
    return out


def paired(a: DataFrame, b: DataFrame, outcome: str = "top1") -> DataFrame:
    """Contingency table of two arms over the union of their cases; a missing outcome is a failure."""
    both = a.select("case_id", F.col(outcome).alias("a")).join(b.select("case_id", F.col(outcome).alias("b")), "case_id", "full_outer")
    x, y = (F.coalesce(c, F.lit(False)) for c in ("a", "b"))
    out = both.agg(F.count("*").alias("cases"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"))
    return out.withColumns({"difference": rate(F.col("only_a") - F.col("only_b"), F.col("cases")), "p": mcnemar(F.col("only_a"), F.col("only_b"))})


def paired_mismatches(a: DataFrame, b: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases of one arm only, or repeated within an arm: with any such row the arms cannot be compared."""
    x, y = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((a, "x"), (b, "y")))
    why = F.when(F.col("y").isNull(), "only_in_a").when(F.col("x").isNull(), "only_in_b").when((F.col("x") > 1) | (F.col("y") > 1), "repeated")
    return x.join(y, key, "full_outer").select(key, why.alias("why")).where("why is not null")


def calibration(recovery: DataFrame, *, threshold: float = 2.0, required: str = "top1") -> DataFrame:
    """PASS or FAIL of each case by the required rank (``top1`` or ``top5``); INVALID where modes have gaps.

    ``recovery``: ``case_recovery`` with the same threshold.
    """
    if required not in ("top1", "top5"):
        raise ValueError(f"required rank must be top1 or top5, not {required}")
    top5 = F.coalesce(F.col("best_valid_rmsd") <= threshold, F.lit(False))
    met = F.col("top1") if required == "top1" else top5
    verdict = F.when(~F.col("contiguous"), "INVALID").when(met, "PASS").otherwise("FAIL")
    return recovery.select("case_id", F.col("top1").alias("top1_pass"), top5.alias("top5_pass"), verdict.alias("verdict"))


def bundle_violations(*, tolerance: float = 1e-12) -> Column:
    """Broken consistency rules of an evidence row, in order.

    Columns: ``common, left_size, right_size, union_size`` (counts), ``jaccard, recovery, precision`` (ratios),
    ``stable`` (boolean) and ``parameterised`` (boolean).  A ratio must be the quotient of its counts, and null where
    the denominator is 0; the union must be what the sizes leave; stability needs parameters.
    """
    def ratio(name: str, of: str) -> Column:
        want = F.try_divide(F.col("common").cast("double"), F.col(of))
        bad = (want.isNull() != F.col(name).isNull()) | F.coalesce(F.abs(F.col(name) - want) > tolerance, F.lit(False))
        return F.when(bad, F.lit(name))

    return F.array_compact(
        F.array(
            F.when(F.least("common", "left_size", "right_size") < 0, F.lit("negative")),
            F.when(F.col("common") > F.least("left_size", "right_size"), F.lit("common")),
            F.when(F.col("union_size") != F.col("left_size") + F.col("right_size") - F.col("common"), F.lit("union")),
            ratio("jaccard", "union_size"), ratio("recovery", "right_size"), ratio("precision", "left_size"),
            F.when(F.coalesce("stable", F.lit(False)) & ~F.coalesce("parameterised", F.lit(False)), F.lit("stable")),
        )
    )


def claims(rules: DataFrame, endpoints: DataFrame) -> DataFrame:
    """SUPPORTED, CONTRADICTED, INCONCLUSIVE or NOT_EVALUATED per rule.

    ``rules``: claim_id, endpoint, operator (gte, eq, superior), threshold; ``endpoints``: endpoint, value,
    p, alpha, complete.
    """
    met = F.when(F.col("operator") == "gte", F.col("value") >= F.col("threshold")).when(F.col("operator") == "eq", F.abs(F.col("value") - F.col("threshold")) <= 1e-12)
    paired_ = F.when(F.col("p") > F.col("alpha"), "INCONCLUSIVE").when(F.col("value") > 0, "SUPPORTED").when(F.col("value") < 0, "CONTRADICTED").otherwise("INCONCLUSIVE")
    verdict = (
        F.when(F.col("value").isNull() | ~F.coalesce("complete", F.lit(False)), "NOT_EVALUATED")
        .when(F.col("operator") == "superior", F.when(F.col("p").isNull(), "NOT_EVALUATED").otherwise(paired_))
        .when(met.isNull(), "NOT_EVALUATED")
        .when(met, "SUPPORTED")
        .otherwise("CONTRADICTED")
    )
    return rules.join(endpoints, "endpoint", "left").select("claim_id", "endpoint", verdict.alias("verdict"))


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Count, mean, median, least and largest of each metric; null values are not counted."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))).where("value is not null")
    plain = long.groupBy(F.col("metric").alias("m")).agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    mid = quantiles.at_places(long, ["metric"], "value", {"a": quantiles.lower(0.5), "b": quantiles.upper(0.5)})
    median = quantiles.between(F.col("a"), F.col("b"), F.col("n"), 0.5)
    return mid.join(plain, F.col("metric") == F.col("m")).select("metric", "n", "mean", median.alias("median"), "low", "high")


def sample_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median, nearest-rank p95 and coefficient of variation per group and over all (``total`` = 1).

    A group without values has no median; over no rows at all there is the total row.
    """
    v = F.col(value)
    cv = F.when(F.count(v) > 1, F.try_divide(F.stddev_samp(v), F.avg(v))).otherwise(F.lit(0.0))
    plain = df.groupingSets([[by], []], by).agg(F.grouping(by).cast("int").alias("total"), F.count(v).alias("n"), cv.alias("cv"))
    places = {"a": quantiles.lower(0.5), "b": quantiles.upper(0.5), "p95": quantiles.nearest_rank(0.95)}
    each = quantiles.at_places(df, [by], value, places).withColumn("t", F.lit(0)).unionByName(quantiles.at_places(df, [], value, places).withColumns({by: F.lit(None).cast(df.schema[by].dataType), "t": F.lit(1)}))
    each = each.select(F.col(by).alias("of"), "t", quantiles.between(F.col("a"), F.col("b"), F.col("n"), 0.5).alias("median"), "p95")
    return plain.join(each, (F.col("total") == F.col("t")) & F.col(by).eqNullSafe(F.col("of")), "left").select(by, "total", "n", "median", "p95", "cv")


def linear_percentile(df: DataFrame, by: str, value: str, p: float, name: str) -> DataFrame:
    """Percentile of each group by linear interpolation between closest ranks."""
    found = quantiles.at_places(df, [by], value, {"a": quantiles.lower(p), "b": quantiles.upper(p)})
    return found.select(by, quantiles.between(F.col("a"), F.col("b"), F.col("n"), p).alias(name))


def rounded_percentile(df: DataFrame, by: str, value: str, p: float, name: str) -> DataFrame:
    """The value at index round((n - 1) * p), halves to even, of each group in order."""
    return quantiles.at_places(df, [by], value, {name: quantiles.rounded(p)}).select(by, name)


def failed_checks(checks: str, ignored: str = "rmsd") -> tuple[Column, Column]:
    """Whether all checks of a ``map<string, boolean>`` but the ignored one hold, and those that do not."""
    entries = F.filter(F.map_entries(F.col(checks)), lambda e: e["key"] != ignored)
    return F.forall(entries, lambda e: F.coalesce(e["value"], F.lit(False))), F.array_sort(F.transform(F.filter(entries, lambda e: ~F.coalesce(e["value"], F.lit(False))), lambda e: e["key"]))


def evidence_grade(*, rmsd: float = 2.0, overlap: float = 0.5) -> Column:
    """Grade of one candidate by ordered rules over ``hard_fail, attested, rmsd, overlap, recovery``."""
    recovered = F.col("rmsd").isNotNull() & (F.col("rmsd") <= rmsd)
    return (
        F.when(F.coalesce("hard_fail", F.lit(False)), "REJECTED")
        .when(~F.coalesce("attested", F.lit(False)), "UNVERIFIED")
        .when(recovered & (F.col("recovery") >= overlap), "RECOVERED")
        .when(F.col("overlap") >= overlap, "CONSENSUS")
        .otherwise("PLAUSIBLE")
    )


def set_overlap(a: str, b: str) -> dict[str, Column]:
    """Jaccard, recovery of ``b``, precision of ``a`` and the counts; empty sets give null ratios."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return {"common": both, "union_size": either, "jaccard": rate(both, either), "recovery": rate(both, F.size(y)), "precision": rate(both, F.size(x))}


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], *, output: str = "output", seconds: str = "seconds") -> DataFrame:
    """Share of equal outputs over common keys, ratio of median seconds, and keys of one run only."""
    joined = a.select(*keys, F.col(output).alias("oa"), F.col(seconds).alias("sa"), F.lit(1).alias("ha")).join(b.select(*keys, F.col(output).alias("ob"), F.col(seconds).alias("sb"), F.lit(1).alias("hb")), keys, "full_outer")
    both = F.col("ha").isNotNull() & F.col("hb").isNotNull()
    plain = joined.agg(F.count_if(both).alias("common"), F.count_if(~both).alias("unmatched"), F.avg(F.when(both, F.col("oa").eqNullSafe(F.col("ob")).cast("int"))).alias("equal_share"))
    sides = joined.where(both).select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("sa").alias("s")), F.struct(F.lit("b").alias("side"), F.col("sb").alias("s")))).alias("x")).select("x.*")
    middle = linear_percentile(sides, "side", "s", 0.5, "m").agg(F.max(F.when(F.col("side") == "a", F.col("m"))).alias("ma"), F.max(F.when(F.col("side") == "b", F.col("m"))).alias("mb"))
    return plain.join(middle).select("common", "unmatched", "equal_share", F.try_divide("mb", "ma").alias("ratio"))  # one row each


def null_aware_sum(*parts: str) -> Column:
    """Sum that is null only if all parts are."""
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0))))


def recorded_differences(recorded: DataFrame, computed: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Rows on which a recorded and a recomputed summary differ, with the reasons."""
    a = recorded.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(True).alias("in_a"))
    b = computed.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(True).alias("in_b"))
    off = [F.when((F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) > tolerance) | (F.col(f"a_{v}").isNull() != F.col(f"b_{v}").isNull()), F.lit(v)) for v in values]
    reasons = F.array_compact(F.array(F.when(F.col("in_b").isNull(), F.lit("only_recorded")), F.when(F.col("in_a").isNull(), F.lit("only_computed")), *(F.when(F.col("in_a") & F.col("in_b"), c) for c in off)))
    return a.join(b, keys, "full_outer").select(*keys, reasons.alias("reasons")).where(F.size("reasons") > 0)
