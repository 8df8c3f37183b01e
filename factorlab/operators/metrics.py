"""Predictions and errors of a pair of factor tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.functions.vectors import dot, sqnorm
from factorlab.operators.ratings import check_columns, merge_copies
from factorlab.operators.skew import hot_limit, lookup_join, profile
from factorlab.session import cut


def attach(rows: DataFrame, factors: dict, sides, profiles: dict, how: str = "inner", near=()) -> DataFrame:
    """``rows`` with the vectors ``xu`` and ``xi`` of ``sides``; those of sides in ``near`` are few and broadcast."""
    for side in sides:
        vectors = factors[side].select(F.col("id").alias(side), F.col("x").alias(f"x{side}"))
        if side in near:
            rows = rows.join(F.broadcast(vectors), side, how)
        else:
            rows = lookup_join(rows, side, vectors, profiles[side].hot, how, profiles[side].few)
    return rows


def _profiles(rows: DataFrame, rank: int, near=()) -> dict:
    return {side: profile(rows, side, hot_limit(rows, rank), rank=rank) for side in ("u", "i") if side not in near}


def errors(scored: DataFrame, rank: int) -> DataFrame:
    """One row (nnz, sse) of rows ``(n, r, ss, xu, xi)``; without a vector the prediction is 0."""
    scored = scored.select("n", "r", "ss", F.coalesce(dot("xu", "xi", rank), F.lit(0.0)).alias("p"))
    return scored.agg(F.expr("cast(coalesce(sum(n), 0) as bigint)").alias("nnz"),
                      F.expr("coalesce(sum(n * (p - r) * (p - r) + ss), 0D)").alias("sse"))


def predict(u_factors: DataFrame, i_factors: DataFrame, ratings: DataFrame,
            rank: int | None = None, how: str = "inner") -> DataFrame:
    """``ratings`` plus ``pred``. Inner: rows with an unknown id drop out. Left: pred is 0.

    A null id is an unknown one. Ratings are not read, so they may be null or missing.
    """
    joined = attach(ratings, {"u": u_factors, "i": i_factors}, ("u", "i"), _profiles(ratings, rank or 0), how)
    pred = dot("xu", "xi", rank)
    if how == "left":
        pred = F.coalesce(pred, F.lit(0.0))
    return joined.withColumn("pred", pred).drop("xu", "xi")


def sse_compressed(u_factors: DataFrame, i_factors: DataFrame, obs: DataFrame, rank: int,
                   profiles: dict, how: str = "inner", near=()) -> DataFrame:
    """One row (nnz, sse) over compressed observations."""
    return errors(attach(obs, {"u": u_factors, "i": i_factors}, ("u", "i"), profiles, how, near), rank)


def sse(u_factors: DataFrame, i_factors: DataFrame, ratings: DataFrame, rank: int,
        how: str = "inner", near=()) -> DataFrame:
    """Sum of squared errors. Inner drops unseen ids; left counts their prediction as 0.

    The ratings are read once: with copies merged in the tasks that read them they are written,
    profiled and scored. A null among them fails the job, as it does in a fit. The vectors of
    sides in ``near`` are few: they are broadcast.
    """
    obs = cut(merge_copies(check_columns(ratings)))
    return sse_compressed(u_factors, i_factors, obs, rank, _profiles(obs, rank, near), how, near)


def rmse(errors: DataFrame) -> DataFrame:
    """(nnz, sse, rmse); rmse is null when nothing could be scored."""
    return errors.selectExpr("nnz", "sse", "sqrt(try_divide(sse, nnz)) as rmse")


def reg_cost(u_factors: DataFrame, i_factors: DataFrame, lam: float) -> DataFrame:
    """lam * (|U|^2 + |V|^2) as one row."""
    both = u_factors.select("x").unionByName(i_factors.select("x"))
    return both.agg((F.lit(lam) * F.coalesce(F.sum(sqnorm("x")), F.lit(0.0))).alias("reg_cost"))


def train_loss(errors: DataFrame, cost: DataFrame) -> DataFrame:
    # Two single-row aggregates side by side: joined on a constant, not a product of tables.
    left, right = errors.withColumn("_one", F.lit(1)), cost.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(right), "_one").select(
        "nnz", "sse", "reg_cost", (F.col("sse") + F.col("reg_cost")).alias("loss"))
