"""Tiling a sparse matrix in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replicate(ratings: DataFrame, repfact: int, m: int, n: int,
              num_partitions: int | None = None) -> DataFrame:
    """Each (u, i, r) becomes the repfact^2 entries (u + a*m, i + b*n, r). A narrow expansion.

    ``num_partitions`` spreads the small input first, for sources with few splits.
    """
    if repfact < 1:
        raise ValueError("repfact >= 1 is required")
    if num_partitions:
        ratings = ratings.repartition(num_partitions)
    last = repfact - 1
    return (ratings.withColumn("_a", F.expr(f"explode(sequence(0L, {last}L))"))
            .withColumn("_b", F.expr(f"explode(sequence(0L, {last}L))"))
            .select((F.col("u") + F.col("_a") * m).alias("u"), (F.col("i") + F.col("_b") * n).alias("i"), "r"))


def replicate_2x2(ratings: DataFrame, m: int, n: int) -> DataFrame:
    return replicate(ratings, 2, m, n)
