"""Divide - factor - combine: independent fits per column range, then one projection.

All partitions are fitted in one distributed plan: the row key becomes (part, u), encoded
in one bigint, and the columns of different partitions are disjoint anyway.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.functions.solve import lists_of, matrix_of
from factorlab.functions.vectors import dot
from factorlab.operators import ratings as R
from factorlab.operators.skew import BROADCAST_BYTES, hot_limit, lookup_join, profile, vector_bytes
from factorlab.plans.als import als_fit
from factorlab.session import cut


def with_part(ratings: DataFrame, parts: int, columns: int) -> DataFrame:
    """Contiguous column ranges of equal size; the last range takes the remainder."""
    size = max(columns // parts, 1)
    return ratings.withColumn("part", F.least(F.floor(F.col("i") / size), F.lit(parts - 1)).cast("bigint"))


def partition_stats(ratings: DataFrame, parts: int, columns: int) -> DataFrame:
    """Per partition: ratings, rows and columns that have any."""
    placed = with_part(ratings, parts, columns)
    rows = placed.groupBy("part", "u").agg(F.count("*").alias("n")).groupBy("part").agg(
        F.sum("n").alias("nnz"), F.count("*").alias("n_u"))
    cols = placed.groupBy("part", "i").count().groupBy("part").agg(F.count("*").alias("n_i"))
    return rows.join(cols, "part")


@dataclass
class DfcResult:
    """``w`` (part, u, x) and ``h`` (part, i, x) per partition; combined ``rows`` and ``cols``."""

    w: DataFrame
    h: DataFrame
    rows: DataFrame
    cols: DataFrame
    parts: int
    columns: int
    rank: int
    near: tuple[str, ...] = ()  # sides whose vectors are few enough to be broadcast

    def part_predictions(self, ratings: DataFrame) -> DataFrame:
        """Prediction from the factors of the cell's own partition; a missing factor counts as 0."""
        coded = with_part(ratings, self.parts, self.columns).withColumn("code", _code("u", self.parts))
        rows = self.w.select(_code("u", self.parts).alias("code"), F.col("x").alias("xu"))
        return _scored(coded, "code", rows, self.h.select("i", F.col("x").alias("xi")), self.rank, self.near)

    def predictions(self, ratings: DataFrame) -> DataFrame:
        """Prediction from the combined factors."""
        rows = self.rows.select(F.col("id").alias("u"), F.col("x").alias("xu"))
        return _scored(ratings, "u", rows, self.cols.select("i", F.col("x").alias("xi")), self.rank, self.near)

    def rmse(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """Three rows (metric, nnz, rmse): projected train and test, and per-partition test.

        Both inputs are read once, and what is left of their copies scored; a null fails the job.
        """
        train, test = (cut(R.merge_copies(R.check_columns(data))) for data in (train, test))
        named = (("train_projected", self.predictions(train)),
                 ("test_projected", self.predictions(test)),
                 ("test_partition", self.part_predictions(test)))
        out = None
        for name, scored in named:
            row = scored.agg(F.expr("cast(sum(n) as bigint)").alias("nnz"), F.expr(
                "sqrt(try_divide(sum(n * (pred - r) * (pred - r) + ss), sum(n)))").alias("rmse"))
            row = row.select(F.lit(name).alias("metric"), "nnz", "rmse")
            out = row if out is None else out.unionByName(row)
        return out


def _code(row: str, parts: int):
    """One bigint for (part, row id)."""
    return F.col(row) * parts + F.col("part")


def _scored(cells: DataFrame, row_key: str, rows: DataFrame, cols: DataFrame, rank: int, near=()) -> DataFrame:
    both = cells
    for side, key, table in (("u", row_key, rows), ("i", "i", cols)):
        if side in near:
            both = both.join(F.broadcast(table), key, "left")
        else:
            known = profile(cells, key, hot_limit(cells, rank), rank=rank)
            both = lookup_join(both, key, table, known.hot, "left", known.few)
    return both.withColumn("pred", F.coalesce(dot("xu", "xi", rank), F.lit(0.0))).drop("xu", "xi")


def projection_gram(w: DataFrame, rank: int) -> DataFrame:
    """Per partition p the sums C_p = sum_u w0(u) wp(u)T as a row-major array (C_0 is G_0)."""
    base = w.filter("part = 0").select("u", F.col("x").alias("a"))
    pairs = w.join(base, "u").select("part", "a", F.col("x").alias("b"))
    if rank * rank <= 100:
        entries = ", ".join(f"sum(a[{r}] * b[{c}])" for r in range(rank) for c in range(rank))
        return pairs.groupBy("part").agg(F.expr(f"array({entries})").alias("c"))

    def fold(batches):
        for batch in batches:
            part = batch.column("part").to_numpy()
            a, b = matrix_of(batch.column("a"), rank), matrix_of(batch.column("b"), rank)
            seen = np.unique(part)
            sums = np.stack([(a[part == p].T @ b[part == p]).ravel() for p in seen])
            yield pa.RecordBatch.from_arrays([pa.array(seen), lists_of(sums)], ["part", "c"])

    folded = pairs.mapInArrow(fold, "part bigint, c array<double>")
    entries = folded.select("part", F.posexplode("c").alias("pos", "v")).groupBy("part", "pos").agg(F.sum("v").alias("v"))
    return entries.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("e")).select(
        "part", F.col("e.v").alias("c"))


def column_gram(h: DataFrame, rank: int) -> DataFrame:
    """Gram matrix of partition 0's column factors, in the layout of :func:`projection_gram`."""
    mine = h.filter("part = 0").select("part", F.col("i").alias("u"), "x")
    return projection_gram(mine, rank)


def _pinv(grams: np.ndarray) -> np.ndarray:
    # Rounding leaves eigenvalues near 1e-16 of the largest where a Gram matrix is singular.
    return np.linalg.pinv(grams, rcond=1e-13, hermitian=True)


def combine(w: DataFrame, h: DataFrame, rank: int) -> tuple[DataFrame, DataFrame]:
    """Project every partition onto the row space of partition 0.

    Rows are W_0. Columns of p become T_p h with T_p = P pinv(G_0) C_p, where P projects
    onto the span of partition 0's column factors (the identity when they have full rank).
    """
    grams = projection_gram(w, rank)
    base = grams.filter("part = 0").select(F.col("c").alias("g"), F.lit(1).alias("_one"))
    span = column_gram(h, rank).select(F.col("c").alias("k"), F.lit(1).alias("_one"))
    # One k x k matrix per partition, next to two single rows: small by construction.
    inputs = grams.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one").join(F.broadcast(span), "_one")

    @F.arrow_udf("array<double>")
    def turn(part: pa.Array, c: pa.Array, g: pa.Array, k: pa.Array) -> pa.Array:
        c3, g3, k3 = (matrix_of(v, rank * rank).reshape(-1, rank, rank) for v in (c, g, k))
        project = (_pinv(k3) @ k3).transpose(0, 2, 1)
        t = project @ _pinv(g3) @ c3
        t[part.to_numpy() == 0] = np.eye(rank)
        return lists_of(t.reshape(len(t), -1))

    turned = inputs.select("part", turn("part", "c", "g", "k").alias("t"))
    # A partition that shares no row with partition 0 has C_p = 0, hence zero columns.
    turned = cut(turned)
    if turned.count() * rank * rank * 8 <= BROADCAST_BYTES:
        turned = F.broadcast(turned)
    cols = h.join(turned, "part", "left").select(
        "part", "i", F.expr(_product(rank)).alias("x"))
    return w.filter("part = 0").select(F.col("u").alias("id"), "x"), cols


def _product(rank: int) -> str:
    """``t`` times ``x``; written out for small ranks only, as generated code may not exceed 64 KB."""
    if rank <= 10:
        product = ", ".join("(" + " + ".join(f"t[{r * rank + c}] * x[{c}]" for c in range(rank)) + ")" for r in range(rank))
        return f"if(t is null, array_repeat(0D, {rank}), array({product}))"
    row = f"aggregate(zip_with(slice(t, r * {rank} + 1, {rank}), x, (a, b) -> a * b), 0D, (s, v) -> s + v)"
    return f"if(t is null, array_repeat(0D, {rank}), transform(sequence(0, {rank - 1}), r -> {row}))"


def dfc_fit(ratings: DataFrame, parts: int = 4, columns: int | None = None, rank: int = 10,
            lam: float = 0.01, iters: int = 5, strategy: str = "auto") -> DfcResult:
    """Fit ``parts`` column ranges independently (rows first) and combine them."""
    ratings = R.check_columns(ratings)
    if columns is None:
        columns = int(ratings.agg(F.max("i")).first()[0]) + 1
    coded = with_part(ratings, parts, columns).select(_code("u", parts).alias("u"), "i", "r")
    fit = als_fit(coded, rank, lam, iters, strategy, first="u")
    fit.unpersist()
    w = fit.u_factors.selectExpr(f"pmod(id, {parts}L) as part",
                                 f"(id - pmod(id, {parts}L)) div {parts}L as u", "x")
    h = with_part(fit.i_factors.withColumnRenamed("id", "i"), parts, columns).select("part", "i", "x")
    rows, cols = combine(w, h, rank)
    near = tuple(side for side, known in fit.profiles.items() if vector_bytes(known.keys, rank) <= BROADCAST_BYTES)
    return DfcResult(w, h, rows, cut(cols), parts, columns, rank, near)
