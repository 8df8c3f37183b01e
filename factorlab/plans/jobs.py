"""Data jobs that read and write rating files: generate, replicate, train on what was written."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.operators.tiling import replicate
from factorlab.plans.als import AlsResult, als_fit
from factorlab.session import cut
from factorlab.sources.synth import synth_ratings
from factorlab.sources.text import read_ratings, write_ratings


def replicated_path(path: str) -> str:
    return path.rstrip("/") + "_replicated"


def replicate_job(spark: SparkSession, path: str, repfact: int, m: int, n: int, partitions: int | None = None) -> str:
    """Read a 1-based ``u i r`` file, tile it, and write it 0-based next to the input; returns where."""
    out = replicated_path(path)
    write_ratings(replicate(read_ratings(spark, path), repfact, m, n, partitions), out, index_base=0)
    return out


def generate_job(spark: SparkSession, path: str, m: int, n: int, rank: int = 10, train_factor: float = 1.0,
                 test_factor: float = 0.1, noise: float = 0.0, seed: int = 0) -> tuple[str, str]:
    """Write a synthetic matrix as 1-based ``u i r`` files in column-major order: (training, test) paths."""
    made = synth_ratings(spark, m, n, rank, train_factor, test_factor, noise, seed)
    paths = f"{path.rstrip('/')}/train", f"{path.rstrip('/')}/test"
    for ratings, where in zip(made, paths):
        write_ratings(ratings, where, index_base=1, column_major=True)
    return paths


def run_metrics(fit: AlsResult, test: DataFrame, seconds: float) -> DataFrame:
    """One row of a run's log: (train_nnz, train_rmse, test_nnz, test_rmse, seconds)."""
    one = F.lit(1).alias("_one")
    train = fit.rmse().select(F.col("nnz").alias("train_nnz"), F.col("rmse").alias("train_rmse"), one)
    held = fit.rmse(test).select(F.col("nnz").alias("test_nnz"), F.col("rmse").alias("test_rmse"), one)
    return cut(train.join(F.broadcast(held), "_one").drop("_one").withColumn("seconds", F.lit(float(seconds))))


def pipeline_job(spark: SparkSession, path: str, m: int, n: int, data_rank: int = 10, train_factor: float = 1.0,
                 test_factor: float = 0.1, repfact: int = 1, noise: float = 0.0, seed: int = 0,
                 **fit_options) -> DataFrame:
    """Generate, tile and train through files below ``path``; the row of :func:`run_metrics`."""
    written = generate_job(spark, path, m, n, data_rank, train_factor, test_factor, noise, seed)
    train, test = (read_ratings(spark, replicate_job(spark, where, repfact, m, n), index_base=0) for where in written)
    started = time.monotonic()
    fit = als_fit(train, **fit_options)
    metrics = run_metrics(fit, test, time.monotonic() - started)
    fit.unpersist()
    return metrics
