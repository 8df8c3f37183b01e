"""Distributed row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlab.session import cut, shuffle_partitions


def ordered_positions(rows: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """0-based position of every row inside its group, ordered by ``order`` (unique per group).

    A window over the group would put a whole group into one task. Instead the rows are range
    partitioned by (group, order), numbered inside each slice, and shifted by what the slices
    before hold. A slice continues at most one group, so the shifts are one row per slice.
    """
    slices = shuffle_partitions(rows.sparkSession)
    placed = cut(rows.repartitionByRange(slices, *group, *order)
                 .withColumn("_slice", F.spark_partition_id()))
    counts = placed.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.sum("_n").over(before)).filter("_shift > 0").drop("_n")
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (placed.withColumn("_row", F.row_number().over(inside) - 1)
            .join(F.broadcast(shifts), [*group, "_slice"], "left")
            .withColumn(name, F.expr("cast(_row + coalesce(_shift, 0) as bigint)"))
            .drop("_slice", "_row", "_shift"))
