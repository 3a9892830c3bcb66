"""Reciprocal-rank fusion of ranked branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import ranked


def fuse(branches: dict[str, DataFrame], *, k: int = 60, weights: dict[str, float] | None = None, top: int = 512) -> DataFrame:
    """Fuse branches of ``id, rank, score``: sum of normalised weight / (k + rank), ordered by (-score, id).

    ``branch_ranks`` and ``branch_scores`` map branch names.  A repeated id in one branch is an error
    (``duplicates`` finds them beforehand).
    """
    weights = weights or dict.fromkeys(branches, 1.0)
    if set(weights) != set(branches) or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must name every branch, without negative ones and not all zero")
    total = sum(weights.values())
    rows = None
    for name in sorted(branches):
        part = branches[name].select("id", F.lit(name).alias("branch"), "rank", "score", (F.lit(weights[name] / total) / (k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    # parts are added in branch order, so that equal sums are equal to the last bit
    parts = F.sort_array(F.collect_list(F.struct("branch", "rank", "score", "part")))
    merged = rows.groupBy("id").agg(parts.alias("p"))
    out = merged.select(
        "id",
        F.aggregate("p", F.lit(0.0), lambda s, x: s + x["part"]).alias("rrf_score"),
        F.map_from_entries(F.transform("p", lambda x: F.struct(x["branch"], x["rank"]))).alias("branch_ranks"),
        F.map_from_entries(F.transform("p", lambda x: F.struct(x["branch"], x["score"]))).alias("branch_scores"),
    )
    return ranked(out, ["rrf_score desc", "id"], top)


def duplicates(branch: DataFrame) -> DataFrame:
    """Ids that a branch holds more than once."""
    return branch.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
