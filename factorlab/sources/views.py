"""Rating views ``(u, i, r)`` over order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense view: quantity by supplier and part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("i"), F.col("l_quantity").alias("r"))


def customer_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse view: quantity by customer and part."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i"), F.col("l_quantity").alias("r"))


def supplier_part_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): a deterministic tenth of the dense view is held out."""
    items = table(spark, sf_dir, "lineitem")
    held_out = F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber"), F.lit(10)) == 0
    cols = [F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("i"), F.col("l_quantity").alias("r")]
    return items.filter(~held_out).select(cols), items.filter(held_out).select(cols)
