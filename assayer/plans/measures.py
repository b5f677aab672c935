"""The provided tables read as measurements, one row a slice, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.tables import table

CONTROL = "Brand#1"


def dose(flag: str = "l_returnflag"):
    return F.when(F.col(flag) == "A", 0.10).when(F.col(flag) == "N", 0.25).otherwise(0.50)


#: Slices that a task joins with their orders at most, on average.
_A_TASK = 1_000_000


def slices(spark: SparkSession, folder: str) -> DataFrame:
    """vendor, dose, method, patient, series, slice, psnr, cnr, score_a, score_b."""
    line, order = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    supplier, nation, part = (table(spark, folder, n) for n in ("supplier", "nation", "part"))
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    joined = joined.join(part, line.l_partkey == part.p_partkey)
    # what a task sorts and groups by order must not grow with the table, and adaptive execution would merge small partitions
    n = -(-line.count() // _A_TASK)
    if n > spark.sparkContext.defaultParallelism:
        joined, order = joined.repartition(n, "l_orderkey"), order.repartition(n, "o_orderkey")
    joined = joined.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("n_name").alias("vendor"),
        dose().alias("dose"),
        F.col("p_brand").alias("method"),
        F.col("o_custkey").alias("patient"),
        F.col("l_orderkey").alias("series"),
        F.col("l_linenumber").alias("slice"),
        F.col("l_quantity").alias("psnr"),
        (F.col("l_extendedprice") / 1000).alias("cnr"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("score_a"),
        (F.col("l_extendedprice") * (1 - F.col("l_tax")) / 1000).alias("score_b"),
    )


SLICES = """s AS (
SELECT n_name AS vendor, CASE l_returnflag WHEN 'A' THEN 0.1::DOUBLE WHEN 'N' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS dose, p_brand AS method,
  o_custkey AS patient, l_orderkey AS series, l_linenumber AS slice, l_quantity AS psnr, l_extendedprice / 1000 AS cnr,
  l_extendedprice * (1 - l_discount) / 1000 AS score_a, l_extendedprice * (1 - l_tax) / 1000 AS score_b
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
JOIN orders ON l_orderkey = o_orderkey)"""
