"""Rating files: ``u i r`` lines, ``(u,i,r)`` lines, and the metrics log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parsed(fields: DataFrame, index_base: int) -> DataFrame:
    """Positions 0, 1, 2 of ``f``. Further fields are ignored, a bad token fails the job."""

    def token(pos: int, kind: str) -> str:
        return (f"coalesce(try_cast(get(f, {pos}) as {kind}), "
                f"cast(raise_error(concat('bad rating line: ', value)) as {kind}))")

    shift = f" - {index_base}" if index_base else ""
    return fields.selectExpr(f"{token(0, 'bigint')}{shift} as u", f"{token(1, 'bigint')}{shift} as i",
                             f"{token(2, 'double')} as r")


def read_ratings(spark: SparkSession, path: str, index_base: int = 1,
                 num_partitions: int | None = None) -> DataFrame:
    """``u i r`` text. Ids in memory are 0-based: ``index_base`` is subtracted."""
    lines = spark.read.text(path)
    if num_partitions:
        lines = lines.coalesce(num_partitions)
    return _parsed(lines.select("value", F.split("value", " ").alias("f")), index_base)


def read_tuples(spark: SparkSession, path: str, index_base: int = 0) -> DataFrame:
    """``(u,i,r)`` text: the outer characters go, the rest splits on commas."""
    inner = F.expr("split(substring(value, 2, length(value) - 2), ',')")
    return _parsed(spark.read.text(path).select("value", inner.alias("f")), index_base)


def read_bounded(spark: SparkSession, path: str, columns: int, index_base: int = 1) -> DataFrame:
    """``u i r`` text, keeping only entries whose column index is below ``columns``."""
    return read_ratings(spark, path, index_base).filter(F.col("i") < columns)


def write_ratings(ratings: DataFrame, path: str, index_base: int = 0, mode: str = "error",
                  column_major: bool = False) -> None:
    """``u i r`` text directory; ``column_major`` range-sorts by (i, u) first.

    The random tie-break lets the copies of one pair spread over several ranges.
    """
    if column_major:
        ratings = ratings.orderBy("i", "u", F.rand(0))
    ratings.selectExpr(f"concat_ws(' ', u + {index_base}, i + {index_base}, r) as value").write.mode(mode).text(path)


def write_tuples(ratings: DataFrame, path: str, mode: str = "error") -> None:
    """``(u,i,r)`` text directory."""
    ratings.selectExpr("concat('(', u, ',', i, ',', r, ')') as value").write.mode(mode).text(path)


def write_metrics(metrics: DataFrame, path: str, **run) -> None:
    """Append metric rows to a parquet log partitioned by the run's settings."""
    for name, value in run.items():
        metrics = metrics.withColumn(name, F.lit(value))
    metrics.write.mode("append").partitionBy(*run).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
