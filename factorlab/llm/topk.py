"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into m segments. Whoever differs from a query in fewer than m * (s + 1) bits
has a segment within s bits of the query's, so after all segments have been searched to
radius s every code up to distance m * (s + 1) - 1 has been seen. Each round looks up the
next shell of the ball around the segments of the queries that are still open, verifies
whole distances in the join, and closes the queries whose k-th distance is covered. The k-th
distance seen so far also tells which segments need the next shell at all: a code within b
bits differs in at most (b - j) // m bits in some segment j, counted from 0.

Equal codes are one entry of the tables, with the k smallest of their ids: ties go to the
smaller id, so no other id of the code can be among the k. Equal query codes are searched
once. Every code is indexed; the queries may be any table.

Vectors that are null, empty or hold a null or NaN have no code: they are neither found nor find.
Ids that are null are not found; fewer than k rows are returned only if there are fewer. Repeated
rows of one id count once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlab.session import cut

BITS = 64


def binary_code(vector: str = "embedding"):
    """Bit i is set if component i is positive; null for vectors without a code.

    A vector of more than 64 components fails the job, as its code would be that of a prefix.
    """
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(
        x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size(vector) > 0)
    fits = F.when(F.size(vector) > BITS, F.raise_error(F.lit("a code has 64 bits, the vector more components")).cast("boolean")
                  ).otherwise(True)
    return F.when(whole & fits, F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))


def segments_for(count: int) -> int:
    """Segments of about log2(count) - 2 bits: a lookup meets about four strangers.

    Wider ones would meet fewer, but balls grow faster with the width than strangers do.
    """
    width = max(8.0, np.log2(max(count, 2)) - 2)
    return max(1, min(8, round(BITS / width)))


def _segments(m: int) -> list[tuple[int, int]]:
    """First bit and width of each segment; the wider ones come first."""
    out, first = [], 0
    for j in range(m):
        width = BITS // m + (j < BITS % m)
        out.append((first, width))
        first += width
    return out


def _pieces(code: str, parts: list[tuple[int, int]]):
    """The segments of a code as an array of (seg, width, key)."""
    def key(first, width):
        moved = F.shiftrightunsigned(F.col(code), first)
        return moved if width == BITS else moved.bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(j).alias("seg"), F.lit(w).alias("width"), key(f, w).cast("bigint").alias("key"))
                     for j, (f, w) in enumerate(parts)])


def _smallest(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; the limit also acts before the shuffle."""
    return (rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col("nth") <= k))


def _shell(widths: set[int], radius: int):
    """The flips of exactly ``radius`` bits of a segment, by its ``width``."""
    def flips(width):
        masks = [sum(1 << i for i in c) for c in combinations(range(width), radius)]
        return F.lit(np.array([x - (1 << BITS) if x >> (BITS - 1) else x for x in masks], dtype=np.int64))
    wide, narrow = max(widths), min(widths)
    return flips(wide) if wide == narrow else F.when(F.col("width") == wide, flips(wide)).otherwise(flips(narrow))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None) -> DataFrame:
    """``(query_id, rank, id, distance)`` from ``rows(id, code)`` and ``queries(query_id, code)``."""
    coded = rows.where("id is not null and code is not null").select("id", "code").distinct()
    ids = cut(_smallest(coded, ["code"], ["id"], k).select("code", "id"))
    entries = cut(ids.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    m = segments or segments_for(entries.count())
    parts = _segments(m)
    index = cut(entries.select("code", "n", "first", F.explode(_pieces("code", parts)).alias("s"))
                .select("code", "n", "first", "s.seg", "s.key"))
    asked = queries.where("code is not null").select("query_id", "code")
    # bound: the k-th distance seen so far; nothing beyond it can still come in
    open_ = cut(asked.select(F.col("code").alias("q"), F.lit(BITS).alias("bound")).distinct())
    best = closed = None
    for radius in range(BITS):
        covered = min(BITS, m * (radius + 1) - 1)
        # who is within the bound b is within (b - j) // m bits in some segment j
        need = (open_.select("q", "bound", F.explode(_pieces("q", parts)).alias("s")).select("q", "bound", "s.*")
                .where((F.col("bound") - F.col("seg") >= radius * m) & (F.col("width") >= radius)))
        probes = (need.select("q", "bound", "seg", "key", F.explode(_shell({w for _, w in parts}, radius)).alias("flip"))
                  .select("q", "bound", "seg", F.col("key").bitwiseXOR(F.col("flip")).alias("key")))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        at = (probes.seg == index.seg) & (probes.key == index.key) & (distance <= F.col("bound"))
        seen = probes.join(index, at).select("q", "code", distance.alias("distance"), "n", "first")
        if best is not None:
            seen = seen.unionByName(best.join(open_.select("q"), "q", "left_semi"))
        best = cut(_smallest(seen.distinct(), ["q"], ["distance", "first"], k).drop("nth"))
        up = Window.partitionBy("q").orderBy("distance", "first").rowsBetween(Window.unboundedPreceding, 0)
        states = (best.withColumn("upto", F.sum("n").over(up)).groupBy("q")
                  .agg(F.min(F.when(F.col("upto") >= k, F.col("distance"))).alias("kth")))
        judged = cut(open_.select("q").join(states, "q", "left")
                     .select("q", F.coalesce("kth", F.lit(BITS)).alias("bound"),
                             (F.coalesce("kth", F.lit(BITS)) <= covered).alias("done")))
        ended = best.join(judged.where("done").select("q"), "q", "left_semi")
        closed = ended if closed is None else closed.unionByName(ended)
        open_ = judged.where("not done").select("q", "bound")
        if open_.isEmpty():
            break
    near = closed.join(ids, "code").select("q", "id", "distance")
    ranked = _smallest(near, ["q"], ["distance", "id"], k).select("q", "id", "distance", F.col("nth").alias("rank"))
    return asked.join(ranked, asked.code == ranked.q).select("query_id", "rank", "id", "distance")
