"""Synthetic low-rank matrices with sampled training and test cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.functions.seeding import hashed_normal
from factorlab.functions.vectors import dot
from factorlab.operators.sampling import sample_cells


def sample_sizes(m: int, n: int, rank: int, train_factor: float = 1.0,
                 test_factor: float = 0.1) -> tuple[int, int, int]:
    """(degrees of freedom, training cells, test cells) of an oversampled rank-k matrix."""
    freedom = rank * (m + n - rank)
    train = min(math.floor(train_factor * freedom + 0.5), math.floor(0.99 * m * n + 0.5))
    test = min(math.floor(train * test_factor + 0.5), m * n - train)
    return freedom, train, test


def size_table(dims: DataFrame, rank: int, train_factor: float, test_factor: float) -> DataFrame:
    """:func:`sample_sizes` as columns over a table (m, n)."""
    sized = dims.selectExpr("m", "n", f"{rank}L * (m + n - {rank}L) as freedom")
    trained = sized.selectExpr("*", f"least(cast(floor({train_factor}D * freedom + 0.5D) as bigint), "
                                    "cast(floor(0.99D * m * n + 0.5D) as bigint)) as train")
    return trained.selectExpr("*", f"least(cast(floor(train * {test_factor}D + 0.5D) as bigint), "
                                   "m * n - train) as test")


def normal_factors(spark: SparkSession, size: int, rank: int, tag: str) -> DataFrame:
    """(id, x): scaled standard normals, so that a product entry has variance 1 per sqrt(k)."""
    z = 1.0 / math.sqrt(math.sqrt(rank))
    entries = ", ".join(f"{hashed_normal(f'{tag}{j}', 'id')} * {z!r}D" for j in range(rank))
    return spark.range(size).select("id", F.expr(f"array({entries})").alias("x"))


def synth_ratings(spark: SparkSession, m: int, n: int, rank: int = 10, train_factor: float = 1.0,
                  test_factor: float = 0.1, noise: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) ratings sampled from A*B; only sampled cells are ever computed.

    ``noise`` is the standard deviation of the Gaussian added to training cells.
    """
    _, train, test = sample_sizes(m, n, rank, train_factor, test_factor)
    cells = sample_cells(spark, m, n, train, test, seed)
    a = normal_factors(spark, m, rank, f"{seed}/A").toDF("u", "xu")
    b = normal_factors(spark, n, rank, f"{seed}/B").toDF("i", "xi")
    # Cells are spread evenly over rows and columns by construction: no hot keys here.
    valued = cells.join(a, "u").join(b, "i").select("u", "i", dot("xu", "xi", rank).alias("r"), "is_test")
    trained = valued.filter("not is_test").select("u", "i", "r")
    if noise:
        trained = trained.withColumn("r", F.expr(f"r + {noise}D * {hashed_normal(f'{seed}/noise', 'u', 'i')}"))
    return trained, valued.filter("is_test").select("u", "i", "r")
