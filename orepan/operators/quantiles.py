"""Exact order statistics of large groups: no group is sorted in one task.

Equal values are counted first, so ties take one row.  The counted values are range-partitioned by (group, value), a
group lying in as many parts as it needs.  The parts' totals tell in which part each wanted place lies, and
only those parts' rows are numbered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .catalog import checkpointed

Place = Callable[[Column], Column]


def lower(p: float) -> Place:
    return lambda n: F.floor((n - 1) * F.lit(p))


def upper(p: float) -> Place:
    return lambda n: F.ceil((n - 1) * F.lit(p))


def nearest_rank(p: float) -> Place:
    return lambda n: F.ceil(n * F.lit(p)) - 1


def rounded(p: float) -> Place:
    """Halves to even."""
    return lambda n: F.bround((n - 1) * F.lit(p))


def at_places(df: DataFrame, by: list[str], value: str, places: dict[str, Place]) -> DataFrame:
    """``by, n`` and for each name the value at that place (from 0) of the group in ascending order.

    Null values are not counted, NaN is the largest; groups without a value give no row.  ``by`` may be empty, and its
    columns may be null.
    """
    groups = [f"g{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(by, groups)), F.col(value).alias("v"))
    counted = rows.groupBy(*groups, "v").agg(F.count("*").alias("c"))
    # where rows lie is read twice, so it is written first
    spread = checkpointed(counted.repartitionByRange(*groups, "v").withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy(*groups, "part").agg(F.sum("c").alias("c"))
    own = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    sizes = sizes.withColumns({"before": F.sum("c").over(own.orderBy("part")) - F.col("c"), "n": F.sum("c").over(own)})
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), p(F.col("n")).cast("long").alias("at")) for k, p in places.items()))
    asked = sizes.withColumn("w", F.explode(wanted)).where((F.col("w.at") >= F.col("before")) & (F.col("w.at") < F.col("before") + F.col("c")))
    asked = asked.select(*(F.col(g).alias(f"a_{g}") for g in groups), F.col("part").alias("a_part"), "before", "n", F.col("w.name").alias("name"), F.col("w.at").alias("at"))
    same = F.col("part") == F.col("a_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"a_{g}"))
    met = spread.join(asked, same)
    up_to = F.sum("c").over(W.partitionBy(*groups, "part", "name").orderBy("v")) + F.col("before")
    hit = met.withColumn("up_to", up_to).where((F.col("at") < F.col("up_to")) & (F.col("at") >= F.col("up_to") - F.col("c")))
    out = hit.groupBy(*groups).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("name") == k, F.col("v"))).alias(f"p_{k}") for k in places))
    return out.select(*(F.col(g).alias(c) for c, g in zip(by, groups)), "n", *(F.col(f"p_{k}").alias(k) for k in places))


def between(low: Column, high: Column, n: Column, p: float) -> Column:
    """The percentile by linear interpolation, of the values at ``lower(p)`` and ``upper(p)``."""
    place = (n - 1) * F.lit(p)
    return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)
