"""Rating tables ``(u, i, r)`` and their compressed form used by every fit."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a chunk whose copies are merged before anything is shuffled.
MERGE_ROWS = 200_000


def compress(ratings: DataFrame) -> DataFrame:
    """One row per (u, i): ``n`` copies, their mean ``r`` and squared spread ``ss``.

    Copies of a pair stay separate observations in every formula: the normal equations need
    n*x*xT and n*r*x only, and the squared error is n*(p - r)^2 + ss. Map-side combining
    makes a pair that holds a third of all rows as cheap as any other. The spread comes from
    merged variances: a difference of sums of squares would cancel for large, close ratings.
    """
    return ratings.groupBy("u", "i").agg(F.expr("cast(count(r) as double)").alias("n"), F.avg("r").alias("r"),
                                         F.expr("count(r) * var_pop(r)").alias("ss"))


def merge_copies(ratings: DataFrame) -> DataFrame:
    """The rows of :func:`compress` for copies of bounded chunks only: nothing is shuffled.

    A pair may come once for each chunk. Every formula adds such rows up, so they need not
    meet, and a pair that holds a third of all rows costs a row for each chunk.
    """

    def merged(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= MERGE_ROWS:
                yield from _merged(held)
                held, count = [], 0
        if count:
            yield from _merged(held)

    return ratings.select("u", "i", "r").mapInArrow(merged, "u bigint, i bigint, n double, r double, ss double")


def _merged(batches: list[pa.RecordBatch]):
    groups = pa.Table.from_batches(batches).group_by(["u", "i"], use_threads=False)
    made = groups.aggregate([("r", "count"), ("r", "mean"), ("r", "variance")])
    n = made["r_count"].cast(pa.float64())
    spread = pa.compute.multiply(n, made["r_variance"])
    yield from pa.table({"u": made["u"], "i": made["i"], "n": n, "r": made["r_mean"], "ss": spread}).to_batches()


def check_columns(ratings: DataFrame) -> DataFrame:
    missing = {"u", "i", "r"} - set(ratings.columns)
    if missing:
        raise ValueError(f"ratings need columns u, i, r; missing {sorted(missing)}")
    # A null would be a rating of nobody: fail, as a bad token in a file does.
    whole = [f"coalesce(cast({name} as {kind}), cast(raise_error('rating with null {name}') as {kind})) as {name}"
             for name, kind in (("u", "bigint"), ("i", "bigint"), ("r", "double"))]
    return ratings.selectExpr(*whole)
