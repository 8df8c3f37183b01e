"""Block layout: entities hashed to blocks, one vector message per (source, block).

Relational form of the two link tables: ``out_links(src, blk)`` says which blocks need a
source's vector, ``in_links(blk, src, dst, n, r)`` holds the ratings a block owns. Fits use
``rating_table`` and ``send_table``, which come from one exchange of the ratings for each side:
a pair of blocks exchanges one message, whose vectors are known by their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlab.functions.solve import explained, lists_of, matrix_of, ridge_solve, segment_grams, slice_size
from factorlab.functions.vectors import pack_symmetric
from factorlab.operators.positions import ordered_positions
from factorlab.operators.skew import small


def block_of(key: Column | str, blocks: int) -> Column:
    """``id mod blocks``, never negative."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(key, F.lit(blocks)).cast("int")


def hashed_block(key: str, piece: str, blocks: int) -> Column:
    """Block by hash: ids with a common stride still spread evenly. Used by the fits."""
    return F.pmod(F.xxhash64(key, piece), F.lit(blocks)).cast("int")


def block_layout(ratings: DataFrame, blocks: int) -> DataFrame:
    """Block of each rating on both sides."""
    return ratings.select("*", block_of("u", blocks).alias("u_blk"), block_of("i", blocks).alias("i_blk"))


def block_positions(ids: DataFrame, blocks: int) -> DataFrame:
    """0-based position of every distinct id inside its block, ids ascending."""
    placed = ids.select("id", block_of("id", blocks).alias("blk")).distinct()
    return ordered_positions(placed, ["blk"], ["id"])


def out_links(ratings: DataFrame, src: str, dst: str, blocks: int) -> DataFrame:
    """Distinct (source, destination block) pairs."""
    return ratings.select(F.col(src).alias("src"), block_of(dst, blocks).alias("dst_blk")).distinct()


def in_links(ratings: DataFrame, src: str, dst: str, blocks: int) -> DataFrame:
    """Ratings owned by each destination block, one row per rating."""
    return ratings.select(block_of(dst, blocks).alias("dst_blk"), F.col(src).alias("src"),
                          F.col(dst).alias("dst"), "r")


def messages(links: DataFrame, factors: DataFrame) -> DataFrame:
    """One copy of a source vector per block that needs it."""
    return links.join(factors.withColumnRenamed("id", "src"), "src").select("dst_blk", "src", "x")


def pack_blocks(factors: DataFrame, blocks: int, chunk_rows: int = 65536) -> DataFrame:
    """Blocked factor table: per block, chunks of consecutive ids and their vectors."""
    placed = factors.select(block_of("id", blocks).alias("blk"), "id", "x")
    numbered = ordered_positions(placed, ["blk"], ["id"])
    packed = numbered.groupBy("blk", F.expr(f"pos div {chunk_rows}").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("id", "x"))).alias("rows"))
    return packed.select("blk", "chunk", F.col("rows.id").alias("ids"), F.col("rows.x").alias("xs"))


def unblock(packed: DataFrame) -> DataFrame:
    """Flatten blocked factors back to (id, x)."""
    flat = packed.select(F.explode(F.arrays_zip("ids", "xs")).alias("e"))
    return flat.select(F.col("e.ids").alias("id"), F.col("e.xs").alias("x"))


# The sender of a message that carries the vector of one hot source: it comes after all blocks.
LONE = (1 << 31) - 1
# The sender of a vector that the receiving block owns.
OWN = -1
# Rows whose residuals are computed at once.
SCORE_ROWS = 200_000

MESSAGE_SCHEMA = "to int, sender int, id bigint, x binary"


def rating_table(obs: DataFrame, dst: str, src: str, blocks: int, partitions: int, hot: dict, few: dict) -> DataFrame:
    """All ratings in the blocks that own their ``dst``, after one exchange; nothing moves them again.

    Rows ``(blk, to, dst, src, lone, split, n, r)``, partitioned by ``blk`` and in order of ``to`` and
    ``dst`` within it. ``to`` is the block that holds the same rating in the other side's table, so
    both tables know from their own rows which vectors a pair of blocks exchanges. Ids that are hot
    on the ``dst`` side (``split``) lie in several blocks; sources that are hot (``lone``) are sent
    by themselves. Where a source stands among all vectors that the block receives follows from
    these columns (:func:`picks`).
    """
    placed = obs.select("u", "i", "n", "r")
    for side, by in ((dst, src), (src, dst)):
        placed = _with_pieces(placed, side, by, hot[side], few[side])
    flat = placed.select(
        hashed_block(dst, f"_{dst}", blocks).alias("blk"), hashed_block(src, f"_{src}", blocks).alias("to"),
        F.col(dst).alias("dst"), F.col(src).alias("src"), F.col(f"_hot_{src}").alias("lone"), F.col(f"_hot_{dst}").alias("split"), "n", "r")
    return flat.repartition(partitions, "blk").sortWithinPartitions("blk", "to", "dst")


def with_picks(table: DataFrame) -> DataFrame:
    """A rating table with ``pick``: the place of the source among all vectors that its block receives.

    By sending block and id, the lone ones last by id. Fits find it block by block (:func:`picks`).
    """
    sender = F.when(F.col("lone"), LONE).otherwise(F.col("to"))
    return table.withColumn("pick", F.dense_rank().over(Window.partitionBy("blk").orderBy(sender, "src")) - 1)


def picks(owned: pa.Table) -> np.ndarray:
    """``pick`` of each rating of one block. A source has one sender, so its first rating tells which.

    A table that has them already (:func:`with_picks`) keeps them.
    """
    if "pick" in owned.column_names:
        return owned["pick"].to_numpy()
    ids, first, at = np.unique(owned["src"].to_numpy(), return_index=True, return_inverse=True)
    sender = np.where(owned["lone"].to_numpy()[first], LONE, owned["to"].to_numpy()[first])
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((ids, sender))] = np.arange(len(ids))
    return place[at]


def _with_pieces(df: DataFrame, key: str, by: str, hot: DataFrame | None, few: bool) -> DataFrame:
    """Add the piece ``_key`` that a hash of ``by`` gives a row of a hot key (others: 0), and ``_hot_key``."""
    if hot is None:
        return df.withColumn(f"_{key}", F.lit(0)).withColumn(f"_hot_{key}", F.lit(False))
    marks = small(hot.select(F.col("id").alias(key), F.col("pieces").alias("_pieces")), few)
    piece = F.expr(f"cast(pmod(xxhash64({by}), coalesce(_pieces, 1)) as int)")
    return (df.join(marks, key, "left").withColumn(f"_{key}", piece)
            .withColumn(f"_hot_{key}", F.col("_pieces").isNotNull()).drop("_pieces"))


def send_table(table: DataFrame) -> DataFrame:
    """``(blk, to, ids)``: which of its own vectors a block sends to another, ascending; no exchange, no sort.

    ``table`` is the rating table of the sending side: its rows come in the order of these lists.
    """

    @F.arrow_udf("array<bigint>")
    def different(dst: pa.Array) -> list[int]:
        return np.unique(dst.to_numpy()).tolist()

    return table.where("not split").groupBy("blk", "to").agg(different("dst").alias("ids"))


def _vectors(sent: pa.Table, rank: int) -> np.ndarray:
    """All vectors of messages, in the order that ``pick`` counts."""
    order = np.lexsort((sent["id"].to_numpy(), sent["sender"].to_numpy()))
    parts = sent["x"].combine_chunks().take(pa.array(order)) if len(order) else []
    data = b"".join(p.as_buffer() for p in parts)
    return np.frombuffer(data).reshape(-1, rank)


def binary_vectors(x: Column) -> Column:
    """Vectors ``array<double>`` as bytes."""

    @F.arrow_udf("binary")
    def packed(lists: pa.Array) -> pa.Array:
        values = lists.flatten().to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return pa.array([values[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:])], pa.binary())

    return packed(x)


def send_block(rank: int):
    """The cogroup function of a sending block: its vectors ``(id, x)`` and its send table -> one message a receiver."""

    def step(key, vectors: pa.Table, links: pa.Table) -> pa.Table:
        ids = vectors["id"].to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], matrix_of(vectors["x"], rank)[order]
        sent = [x[np.searchsorted(ids, wanted.values.to_numpy())].tobytes() for wanted in links["ids"]]
        return pa.table({"to": links["to"], "sender": links["blk"], "id": pa.nulls(len(sent), pa.int64()).fill_null(0),
                         "x": pa.array(sent, pa.binary())})

    return step


def _entities(owned: pa.Table, piece: str | None = None):
    """``(dst, starts, ends)`` of ratings that come in order of their ``dst``, and of its ``piece`` if there are any."""
    dst = owned["dst"].to_numpy()
    new = dst[1:] != dst[:-1]
    if piece:
        new = new | (np.diff(owned[piece].to_numpy()) != 0)
    starts = np.flatnonzero(np.r_[True, new]) if len(dst) else np.zeros(0, np.int64)
    return dst, starts, np.r_[starts[1:], len(dst)].astype(np.int64)


def solve_entities(dst, starts, ends, split, pick, n, r, x, rank: int, lam: float):
    """New vectors of consecutive runs of ratings as Arrow tables, in slices that bound the Gram matrices.

    Rows ``(id, x, gain, xtx, xty)``: solved entities have ``x`` and ``gain``; pieces of split ones
    their normal equations instead, which have to be added up first.
    """
    lists = pa.list_(pa.float64())
    most = slice_size(rank)
    for lo in range(0, len(starts), most):
        at = slice(lo, lo + most)
        grams, rhs = segment_grams(x, pick, n, r, starts[at], ends[at])
        ids, part = dst[starts[at]], split[starts[at]]
        whole = ~part
        w = ridge_solve(grams[whole], rhs[whole], lam)
        none = pa.nulls(int(whole.sum()), lists)
        yield pa.table([pa.array(ids[whole]), lists_of(w), pa.array(explained(grams[whole], rhs[whole], w)), none, none], SOLVED)
        if part.any():
            count = int(part.sum())
            yield pa.table([pa.array(ids[part]), pa.nulls(count, lists), pa.nulls(count, pa.float64()),
                            lists_of(pack_symmetric(grams[part])), lists_of(rhs[part])], SOLVED)


SOLVED = ["id", "x", "gain", "xtx", "xty"]
SOLVED_SCHEMA = "id bigint, x array<double>, gain double, xtx array<double>, xty array<double>"
_LISTS = pa.list_(pa.float64())
_EMPTY = pa.schema([("id", pa.int64()), ("x", _LISTS), ("gain", pa.float64()), ("xtx", _LISTS), ("xty", _LISTS)]).empty_table()


def update_block(rank: int, lam: float):
    """The cogroup function of one block: messages + its ratings -> new vectors, as :func:`solve_entities`."""

    def step(key, sent: pa.Table, owned: pa.Table) -> pa.Table:
        if not owned.num_rows:
            return _EMPTY
        order = np.argsort(owned["dst"].to_numpy(), kind="stable")
        pick, split, n, r = (values[order] for values in (picks(owned), *(owned[c].to_numpy() for c in ("split", "n", "r"))))
        dst, starts, ends = _entities(owned.select(["dst"]).take(pa.array(order)))
        return pa.concat_tables([_EMPTY, *solve_entities(dst, starts, ends, split, pick, n, r, _vectors(sent, rank), rank, lam)])

    return step


def score_block(rank: int):
    """The cogroup function for the training error: messages and the block's own vectors arrive together."""

    def step(key, sent: pa.Table, owned: pa.Table) -> pa.Table:
        total, own = 0.0, sent["sender"].to_numpy() == OWN
        x, mine = _vectors(sent.filter(pa.array(~own)), rank), sent.filter(pa.array(own))
        ids, w = np.sort(mine["id"].to_numpy()), _vectors(mine, rank)
        at = np.searchsorted(ids, owned["dst"].to_numpy())
        pick, n, r = picks(owned), owned["n"].to_numpy(), owned["r"].to_numpy()
        for lo in range(0, len(pick), SCORE_ROWS):
            part = slice(lo, lo + SCORE_ROWS)
            gap = np.einsum("ij,ij->i", x[pick[part]], w[at[part]]) - r[part]
            total += float(n[part] @ (gap * gap))
        return pa.table({"sse": [total]})

    return step
