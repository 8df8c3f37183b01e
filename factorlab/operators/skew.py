"""Heavy keys: finding them, splitting them, and joining around them.

A key is *hot* when it alone would fill a good part of an average partition. With R rows
and a limit of H hot keys the threshold is R/H, so there are never more than H of them:
the table of hot keys is small by construction, whatever the data looks like. H is eight
per partition of the plan, so that no piece of a split key exceeds an eighth of a partition;
keys below MIN_HOT_ROWS rows are never worth splitting. A plan whose tasks hold fewer rows
than that names the most rows a key may keep in one place (``most``); then there can be more
than H hot keys, and where their table or vectors are too many to broadcast, they are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.session import cut, shuffle_partitions

# Bytes that a broadcast may take at most, anywhere in the package.
BROADCAST_BYTES = 256 << 20
MIN_HOT_ROWS = 10_000


def vector_bytes(keys: int, rank: int) -> int:
    """What the vectors of ``keys`` ids take as a broadcast."""
    return keys * (8 * rank + 48)


@dataclass(frozen=True)
class KeyProfile:
    """What a fit needs to know about one side: its ids, totals and hot keys."""

    ids: DataFrame  # (id, n): number of rows per id
    rows: int
    keys: int
    top: int  # rows of the most frequent id
    threshold: float  # ids with more rows than this are hot
    hot: DataFrame | None  # (id, n, pieces), or None
    few: bool = True  # whether the hot keys and their vectors may be broadcast


def hot_limit(df: DataFrame, rank: int = 0, partitions: int | None = None) -> int:
    """How many hot keys may exist: eight per partition, and their vectors must be broadcastable."""
    partitions = partitions or shuffle_partitions(df.sparkSession)
    return max(1, min(8 * partitions, BROADCAST_BYTES // (16 + 8 * rank)))


def hot_threshold(rows: int, limit: int, most: int | None = None) -> float:
    """Ids with more rows than this are hot: a share of all rows, but never above ``most``."""
    shared = max(rows / limit, float(MIN_HOT_ROWS))
    return shared if most is None else min(shared, float(most))


def profile(df: DataFrame, key: str, limit: int | None = None, most: int | None = None, rank: int = 0) -> KeyProfile:
    """Degrees of ``key`` (partial aggregation first) and its hot keys, materialized once."""
    limit = limit or hot_limit(df)
    ids = cut(df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")), tidy=True)
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"),
                    F.coalesce(F.max("n"), F.lit(0)).alias("top")).first()
    threshold = hot_threshold(total["rows"], limit, most)
    hot, few = None, True
    if total["top"] > threshold:
        pieces = F.ceil(F.col("n") / F.lit(threshold)).cast("int")
        hot = cut(ids.filter(F.col("n") > threshold).select("id", "n", pieces.alias("pieces")))
        few = hot.count() * (32 + 8 * rank) <= BROADCAST_BYTES
    return KeyProfile(ids, total["rows"], total["keys"], total["top"], threshold, hot, few)


def small(table: DataFrame, few: bool = True) -> DataFrame:
    """``table`` with a broadcast hint if its size has been found to allow it."""
    return F.broadcast(table) if few else table


def with_piece(df: DataFrame, key: str, spread_by: str, hot: DataFrame | None,
               name: str = "piece", few: bool = True) -> DataFrame:
    """Add the piece number: a stable hash of ``spread_by``, modulo the key's pieces.

    Ordinary keys have one piece. The rows of one key must differ in ``spread_by`` (compressed
    observations do), so that copies of one pair cannot end up together in a single piece.
    """
    if hot is None:
        return df.withColumn(name, F.lit(0))
    split = small(hot.select(F.col("id").alias(key), F.col("pieces").alias("_pieces")), few)
    piece = F.expr(f"cast(pmod(xxhash64({spread_by}), coalesce(_pieces, 1)) as int)")
    return df.join(split, key, "left").withColumn(name, piece).drop("_pieces")


def spread(table: DataFrame, key: str, hot: DataFrame | None, name: str = "piece", few: bool = True) -> DataFrame:
    """Repeat the row of every hot key once per piece (the other side of :func:`with_piece`)."""
    if hot is None:
        return table.withColumn(name, F.lit(0))
    split = small(hot.select(F.col("id").alias(key), F.col("pieces").alias("_pieces")), few)
    numbers = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    return table.join(split, key, "left").withColumn(name, F.explode(numbers)).drop("_pieces")


def lookup_join(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame | None,
                how: str = "inner", few: bool = True) -> DataFrame:
    """Attach ``table`` (one row per key) to ``rows``, safe for hot keys and for row copies.

    Rows of hot keys never move: the few table rows they need are broadcast. All other rows
    take an ordinary shuffled join, which Catalyst may turn into a broadcast by statistics.
    So do all rows if the hot keys' vectors are not ``few``; adaptive execution splits them.
    """
    if hot is None or not few:
        return rows.join(table, key, how)
    keys = F.broadcast(hot.select(F.col("id").alias(key)))
    near = rows.join(keys, key, "left_semi").join(
        F.broadcast(table.join(keys, key, "left_semi")), key, how)
    far = rows.join(keys, key, "left_anti").join(table, key, how)
    return near.unionByName(far)

