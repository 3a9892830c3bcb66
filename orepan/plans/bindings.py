"""How the screening data model is read from the driver's tables, in Spark and (as text) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: An order's lines in a total order: they are the modes of a case, or the points of an object.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")

LINES_SQL = f"lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS mode FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("mode", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with 3 to 9 lines as point objects."""
    rows = lines(spark, sf_dir).select("l_orderkey", "mode", F.concat("l_returnflag", "l_linestatus").alias("type"), F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).alias("position"))
    grouped = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("mode", "type", "position"))).alias("f"))
    return grouped.where(F.size("f").between(3, 9)).select(F.col("l_orderkey").alias("object_id"), F.lit(0).alias("conformer_id"), F.transform("f", lambda x: F.struct(x["type"].alias("type"), x["position"].alias("position"))).alias("features"))


POINTS_SQL = f"""{LINES_SQL},
pts AS (SELECT l_orderkey AS o, mode - 1 AS n, l_returnflag || l_linestatus AS t, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lines
        WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 3 AND 9)),
tri0 AS (SELECT a.o, a.n AS i, b.n AS j, c.n AS k, a.t AS ta, b.t AS tb, c.t AS tc,
         a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz,
         sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dab,
         sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z)) AS dac,
         sqrt((b.x-c.x)*(b.x-c.x)+(b.y-c.y)*(b.y-c.y)+(b.z-c.z)*(b.z-c.z)) AS dbc
  FROM pts a JOIN pts b ON a.o = b.o AND a.n < b.n JOIN pts c ON b.o = c.o AND b.n < c.n),
tri AS (SELECT *, list_sort([dab, dac, dbc]) AS e, array_to_string(list_sort([ta, tb, tc]), '|') AS type_key, len(list_distinct([ta, tb, tc])) AS kinds,
        0.5 * sqrt(((by_-ay)*(cz-az)-(bz-az)*(cy-ay))*((by_-ay)*(cz-az)-(bz-az)*(cy-ay)) + ((bz-az)*(cx-ax)-(bx-ax)*(cz-az))*((bz-az)*(cx-ax)-(bx-ax)*(cz-az))
                 + ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))*((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))) AS area
  FROM tri0 WHERE least(dab, dac, dbc) > 1e-8)"""
