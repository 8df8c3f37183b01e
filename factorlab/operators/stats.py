"""Counts of a rating matrix and the analytic cost of a fit on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.operators.positions import ordered_positions


def degrees(ratings: DataFrame, side: str) -> DataFrame:
    """Ratings per id of one side; its ids define the side."""
    return ratings.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n"))


def matrix_stats(ratings: DataFrame) -> DataFrame:
    """One row: number of ratings, distinct ids and largest id on both sides.

    Built from two degree tables, whose map-side combining shrinks the data before the
    shuffle; two distinct counts in one aggregate would triple the rows instead.
    """
    u = degrees(ratings, "u").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"), F.count("*").alias("n_u"),
                                  F.max("id").alias("max_u"))
    i = degrees(ratings, "i").agg(F.count("*").alias("n_i"), F.max("id").alias("max_i"))
    one = F.lit(1).alias("_one")
    return u.select("*", one).join(F.broadcast(i.select("*", one)), "_one").select(
        "nnz", "n_u", "n_i", "max_u", "max_i")


def columns(ratings: DataFrame, chunk_rows: int = 65536) -> DataFrame:
    """Column form: per column, chunks of ``(u, r, n)`` entries in ascending order.

    Equal entries are counted first, and a chunk holds at most ``chunk_rows`` of them, so no
    column is ever gathered whole.
    """
    cells = ratings.groupBy("i", "u", "r").agg(F.count("*").alias("n"))
    numbered = ordered_positions(cells, ["i"], ["u", "r"])
    return numbered.groupBy("i", F.expr(f"pos div {chunk_rows}").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("u", "r", "n"))).alias("entries"))


def column_slice(ratings: DataFrame, column: int) -> DataFrame:
    """The sparse vector (u, r) of one column."""
    return ratings.filter(F.col("i") == column).select("u", "r")


def cost_report(ratings: DataFrame, settings: DataFrame) -> DataFrame:
    """Operations and messages of one iteration, per updated side and per setting (k, t).

    With R ratings, a = ids of the source side and b = ids of the updated side: joining
    touches R, combining R*k^2 + a*k + R*k, solving b*k^3 + b*k^2, and b*t*k*(k+1) numbers
    are sent when t machines combine locally first.
    """
    stats = matrix_stats(ratings)
    sides = stats.selectExpr("nnz", "stack(2, 'i', n_u, n_i, 'u', n_i, n_u) as (side, a, b)")
    one = F.lit(1).alias("_one")
    return F.broadcast(sides.select("*", one)).join(settings.select("*", one), "_one").selectExpr(
        "side", "k", "t", "nnz as join_ops", "nnz * k * k + a * k + nnz * k as combine_ops",
        "b * k * k * k + b * k * k as solve_ops", "b * t * k * (k + 1) as sent_values")
