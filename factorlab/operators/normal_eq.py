"""Normal equations per entity, as three Spark aggregations.

The aggregations take rows ``(key, n, r, x)``, one per observation with the vector of its
other side, and return ``(key, xtx, xty)`` with the packed upper triangle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlab.functions.solve import lists_of, matrix_of, segment_grams, slice_size
from factorlab.functions.vectors import pack_symmetric, triangle
from factorlab.operators.ratings import check_columns, compress
from factorlab.operators.skew import BROADCAST_BYTES, KeyProfile, hot_limit, lookup_join, with_piece
from factorlab.operators.skew import profile as key_profile
from factorlab.session import cut, shuffle_partitions, table_partitions

# Above this rank one row of sums outweighs the vectors that are summed, and its columns no
# longer fit one generated method (100 fields): lists of vectors are gathered instead.
MAX_COLUMN_RANK = 10
# Rows per Arrow chunk that are pre-aggregated together on the map side.
_FOLD_ROWS = 200_000
# Sums by key that a task may hold in its hash table.
TASK_SUM_BYTES = 128 << 20
# Vectors that a task may hold in a hash table.
TASK_VECTOR_BYTES = 128 << 20
# Ratings with their vectors that a half-step may move, if sums of them would be less.
MOVED_BYTES = 1 << 30
# Observations one gathered list may hold on average.
LIST_ROWS = 50_000


def by_columns(rows: DataFrame, key: str, rank: int) -> DataFrame:
    """Partial and final HashAggregate over one sum column per distinct entry."""
    return _column_sums(_flat(rows, key, rank), key, rank)


def _flat(rows: DataFrame, key: str, rank: int) -> DataFrame:
    return rows.selectExpr(key, "n", "n * r as nr", *[f"x[{a}] as x{a}" for a in range(rank)])


def _column_sums(flat: DataFrame, key: str, rank: int) -> DataFrame:
    tri = ", ".join(f"sum(n * x{a} * x{b})" for a, b in triangle(rank))
    rhs = ", ".join(f"sum(nr * x{a})" for a in range(rank))
    return flat.groupBy(key).agg(F.expr(f"array({tri})").alias("xtx"),
                                 F.expr(f"array({rhs})").alias("xty"))


def by_moved_columns(rows: DataFrame, key: str, rank: int, profile: KeyProfile) -> DataFrame:
    """:func:`by_columns` over rows that have moved to their keys: a task holds the sums of its own keys only.

    Keys of more than LIST_ROWS rows are summed before they move, so that no task gets all rows of one.
    """
    many, few = long_keys(profile)
    width = table_partitions(rows.sparkSession, profile.rows)
    flat = _flat(rows, key, rank)
    if many is None:
        return _column_sums(_moved(flat, [key], width), key, rank)
    marks = many.select(F.col("id").alias(key))
    marks = F.broadcast(marks) if few else marks
    ordinary = _column_sums(_moved(flat.join(marks, key, "left_anti"), [key], width), key, rank)
    return ordinary.unionByName(_column_sums(flat.join(marks, key, "left_semi"), key, rank))


def _moved(rows: DataFrame, keys: list[str], width: int | None) -> DataFrame:
    """Rows by their keys, wider than the session only where its tasks would hold more than TASK_ROWS.

    Else adaptive execution may join small partitions.
    """
    return rows.repartition(width, *keys) if width and width > shuffle_partitions(rows.sparkSession) else rows.repartition(*keys)


def sum_arrays(parts: DataFrame, key: str, rank: int) -> DataFrame:
    """Add up partial (xtx, xty) rows per key, entry by entry, with map-side combining."""
    tri = rank * (rank + 1) // 2
    long = parts.select(key, F.posexplode(F.concat("xtx", "xty")).alias("pos", "v"))
    summed = long.groupBy(key, "pos").agg(F.sum("v").alias("v"))
    # At most k(k+3)/2 entries per key.
    whole = summed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("e"))
    values = F.col("e").getField("v")
    return whole.select(key, F.slice(values, 1, tri).alias("xtx"),
                        F.slice(values, tri + 1, rank).alias("xty"))


def by_arrow_fold(rows: DataFrame, key: str, rank: int) -> DataFrame:
    """Fold each Arrow chunk with matrix products, then merge in the JVM.

    What a chunk yields is cut into slices, so that memory does not grow with its ids.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    tri = rank * (rank + 1) // 2
    summed = _folded(rows, key, rank).groupBy(key).agg(Summarizer.sum(array_to_vector("s")).alias("s"))
    entries = vector_to_array("s")
    return summed.select(key, F.slice(entries, 1, tri).alias("xtx"),
                         F.slice(entries, tri + 1, rank).alias("xty"))


def _folded(rows: DataFrame, key: str, rank: int) -> DataFrame:
    """(key, s): the sums of each Arrow chunk."""

    def fold(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= _FOLD_ROWS:
                yield from _fold_chunk(held, key, rank)
                held, count = [], 0
        if count:
            yield from _fold_chunk(held, key, rank)

    schema = T.StructType([rows.schema[key], T.StructField("s", T.ArrayType(T.DoubleType()))])
    return rows.select(key, "n", "r", "x").mapInArrow(fold, schema)


def by_runs(rows: DataFrame, key: str, rank: int) -> DataFrame:
    """:func:`by_arrow_fold` of rows in order of ``key``: a partition has one sum of a key, or one for each chunk that it fills.

    There is nothing to combine before these move. They are added up in runs: no task holds the sums of all its keys.
    """
    tri, size = rank * (rank + 1) // 2, rank * (rank + 3) // 2
    moved = _moved(_folded(rows, key, rank), [key], None).sortWithinPartitions(key)
    schema = T.StructType([rows.schema[key], T.StructField("xtx", T.ArrayType(T.DoubleType())),
                           T.StructField("xty", T.ArrayType(T.DoubleType()))])

    def add(table: pa.Table):
        starts = _begins(table, [key])
        sums = np.add.reduceat(matrix_of(table["s"], size), starts, axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(table[key].to_numpy()[starts]), lists_of(sums[:, :tri]), lists_of(sums[:, tri:])], [key, "xtx", "xty"])

    return moved.mapInArrow(lambda batches: _in_runs(batches, [key], add, slice_size(rank)), schema)


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a run of equal ``keys`` begins."""
    new = np.zeros(table.num_rows - 1, bool)
    for name in keys:
        new |= np.diff(table[name].to_numpy()) != 0
    return np.r_[0, np.flatnonzero(new) + 1]


def _in_runs(batches, keys: list[str], summed, most: int):
    """What ``summed`` yields for chunks of ``most`` rows in order of ``keys``, cut between two runs."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= most:
            table = pa.Table.from_batches(held)
            whole = int(_begins(table, keys)[-1])  # the last run may go on
            if whole:
                yield from summed(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                count = table.num_rows - whole
    if held:
        yield from summed(pa.Table.from_batches(held))


def _fold_chunk(batches, key: str, rank: int):
    table = pa.Table.from_batches(batches)
    ids = table[key].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    ends = np.r_[starts[1:], len(ids)]
    x, n, r = matrix_of(table["x"], rank), table["n"].to_numpy()[order], table["r"].to_numpy()[order]
    for at in _slices(len(starts), rank):
        grams, rhs = segment_grams(x, order, n, r, starts[at], ends[at])
        packed = np.concatenate([pack_symmetric(grams), rhs], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[starts[at]]), lists_of(packed)], [key, "s"])


def _slices(groups: int, rank: int) -> list[slice]:
    """Runs of groups whose Gram matrices fit the stack budget together."""
    size = slice_size(rank)
    return [slice(at, at + size) for at in range(0, groups, size)]


def _seen(profile: KeyProfile, rows: float) -> float:
    """Keys that ``rows`` of them may see if evenly dealt."""
    return profile.keys * -np.expm1(-rows / profile.keys) if profile.keys else 0.0


def combining(rank: int, profile: KeyProfile, partitions: int) -> str:
    """How sums by key are best combined before the shuffle: ``columns``, ``fold``, or not at all (``gather``).

    Up to MAX_COLUMN_RANK sums of columns pay if they take less than the rows that a task sums, and as long as
    they stay within TASK_SUM_BYTES. Above that rank a partial sum is about k/2 vectors long, so folding pays if the rows
    that a task sums for a key are more than that.
    """
    share = profile.rows / max(partitions, 1)
    if rank <= MAX_COLUMN_RANK:
        held = _seen(profile, share) * _sum_bytes(rank) <= TASK_SUM_BYTES
        saved = moved_bytes(rank, profile, partitions, "columns") <= moved_bytes(rank, profile, partitions, "gather")
        return "columns" if held and saved else "gather"
    chunk = min(share, _FOLD_ROWS)
    keys = _seen(profile, chunk)
    return "fold" if keys and chunk / keys > (rank + 3) / 2 else "gather"


def _sum_bytes(rank: int) -> int:
    """A key with its sums in a hash table."""
    return 8 * (rank * (rank + 3) // 2 + 8)


def moved_bytes(rank: int, profile: KeyProfile, partitions: int, form: str) -> float:
    """What a combination of that form shuffles, about: partial sums, or ratings with their vectors."""
    if form == "gather":
        return profile.rows * 8.0 * (rank + 3)
    share = profile.rows / max(partitions, 1)
    chunk = min(share, _FOLD_ROWS) if form == "fold" else share
    return profile.rows / max(chunk, 1) * _seen(profile, chunk) * 8.0 * (rank * (rank + 3) // 2 + 1)


def combine(rows: DataFrame, key: str, rank: int, spread_by: str, profile: KeyProfile, form: str | None = None) -> DataFrame:
    """Sums by key; the physical form changes the cost, the result does not."""
    form = form or combining(rank, profile, rows.sparkSession.sparkContext.defaultParallelism)
    if form == "runs":
        return by_runs(rows, key, rank)
    if form == "gather":
        return by_moved_columns(rows, key, rank, profile) if rank <= MAX_COLUMN_RANK else gather(rows, key, rank, spread_by, profile)
    return by_columns(rows, key, rank) if form == "columns" else by_arrow_fold(rows.sortWithinPartitions(key), key, rank)


def long_keys(profile: KeyProfile) -> tuple[DataFrame | None, bool]:
    """Keys with more rows than a list may hold and their pieces, and whether these may be broadcast."""
    if profile.top <= LIST_ROWS:
        return None, True
    many = profile.ids.filter(F.col("n") > LIST_ROWS).select(
        "id", F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("pieces"))
    return many, profile.rows // LIST_ROWS * 32 <= BROADCAST_BYTES


def gather(rows: DataFrame, key: str, rank: int, spread_by: str, profile: KeyProfile) -> DataFrame:
    """Collect each entity's observations first, then fold each list at once.

    Entities of at most LIST_ROWS rows have one list each. Larger ones are gathered in several,
    split by the hash of ``spread_by``, whose folds are added up afterwards.
    """
    many, few = long_keys(profile)
    width = table_partitions(rows.sparkSession, profile.rows)
    if many is None:
        return _gathered(rows, [key], rank, width)
    marks = many.select(F.col("id").alias(key))
    marks = F.broadcast(marks) if few else marks
    ordinary = _gathered(rows.join(marks, key, "left_anti"), [key], rank, width)
    pieces = with_piece(rows.join(marks, key, "left_semi"), key, spread_by, many, few=few)
    return ordinary.unionByName(sum_arrays(_gathered(pieces, [key, "piece"], rank, width), key, rank))


def _gathered(rows: DataFrame, keys: list[str], rank: int, width: int | None = None) -> DataFrame:
    """(key, xtx, xty) of every list; ``keys[0]`` is the key.

    A list is a run of rows in order of its keys. A task reads them in chunks of _FOLD_ROWS, cut
    between two lists: its memory does not grow with the lists that it has.
    """
    key = keys[0]
    runs = _moved(rows.select(*keys, "n", "r", "x"), keys, width).sortWithinPartitions(*keys)
    schema = T.StructType([rows.schema[key], T.StructField("xtx", T.ArrayType(T.DoubleType())),
                           T.StructField("xty", T.ArrayType(T.DoubleType()))])

    def summed(table: pa.Table):
        starts = _begins(table, keys)
        ends = np.r_[starts[1:], table.num_rows]
        ids, x = table[key].to_numpy()[starts], matrix_of(table["x"], rank)
        n, r = table["n"].to_numpy(), table["r"].to_numpy()
        for at in _slices(len(starts), rank):
            grams, rhs = segment_grams(x, np.arange(len(x)), n, r, starts[at], ends[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), lists_of(pack_symmetric(grams)), lists_of(rhs)], [key, "xtx", "xty"])

    most = _FOLD_ROWS
    return runs.mapInArrow(lambda batches: _in_runs(batches, keys, summed, most), schema)


def attach_factors(ratings: DataFrame, factors: DataFrame, side: str, hot: DataFrame | None = None,
                   few: bool = True) -> DataFrame:
    """Ratings plus ``x``, the vector of their ``side``; rows without a vector drop out."""
    return lookup_join(ratings, side, factors.withColumnRenamed("id", side), hot, few=few)


def normal_equations(ratings: DataFrame, factors: DataFrame, side: str, rank: int,
                     how: str = "combine") -> DataFrame:
    """(id, xtx, xty) of every entity of ``side``, given the vectors of the other side.

    ``how``: combine (by rank), fold (partial sums in Arrow tasks) or gather. The ratings are
    read once; a null among them fails the job.
    """
    other = "i" if side == "u" else "u"
    obs = cut(compress(check_columns(ratings)))
    near = key_profile(obs, other, hot_limit(obs, rank), rank=rank)
    rows = attach_factors(obs, factors, other, near.hot, near.few)
    if how == "fold":
        normal = by_arrow_fold(rows, side, rank)
    else:
        normal = {"combine": combine, "gather": gather}[how](rows, side, rank, other, key_profile(obs, side))
    return normal.withColumnRenamed(side, "id")
