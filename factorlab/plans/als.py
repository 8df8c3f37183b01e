"""Regularized alternating least squares with interchangeable distributed plans.

One half-step solves, for every entity e of one side and the vectors x of the other,
``(sum x xT + lam I) w = sum r x``. lam is added once per entity, not per rating.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlab.functions.seeding import initial_vector
from factorlab.functions.solve import matrix_of, solve_explained, solve_packed
from factorlab.operators import blocks as B
from factorlab.operators import metrics as M
from factorlab.operators import normal_eq as N
from factorlab.operators import ratings as R
from factorlab.operators import skew as S
from factorlab.plans.cost import estimate
from factorlab.session import cut, shuffle_partitions

STRATEGIES = ("auto", "join", "gather", "blocked", "broadcast")
OTHER = {"u": "i", "i": "u"}
# What a block may take in its Python worker on average: ratings, and up to a vector in and
# a vector out for each of them.
BLOCK_BYTES = 128 << 20
# Merged ratings per partition of a cached layout, at least and at most.
MIN_PARTITION_ROWS, MAX_PARTITION_ROWS = 50_000, 8_000_000
# Ratings that the broadcast plan reads before it solves the entities that are complete.
CHUNK_ROWS = 200_000


def rows_per_block(rank: int) -> int:
    """Ratings of a block, so that it stays near BLOCK_BYTES even if no two share an entity."""
    return max(1000, BLOCK_BYTES // (24 + 16 * rank))


@dataclass
class Prepared:
    """Ratings read, merged, profiled and, on first use, laid out once, for any number of fits.

    ``rank`` is the highest that a fit may have: blocks and hot keys are sized for it. Layouts
    do not depend on lam, iterations, starts or smaller ranks, and fits share them.
    """

    obs: DataFrame  # (u, i, n, r, ss)
    rank: int
    partitions: int
    blocks: int
    profiles: dict
    rows: int
    nnz: int
    within: float  # what copies of a pair differ from their mean, squared
    squares: float  # of all ratings, less ``within``
    layouts: dict = field(default_factory=dict, repr=False)
    kept: list = field(default_factory=list, repr=False)

    def keep(self, df: DataFrame) -> DataFrame:
        """Cache a layout now: only a built cache tells Catalyst how it is partitioned and sorted."""
        self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        df.count()
        return df

    def layout(self, name: str, make):
        """The layout ``name``, made on first use."""
        if name not in self.layouts:
            self.layouts[name] = make()
        return self.layouts[name]

    def hot(self) -> tuple[dict, dict]:
        return ({side: p.hot for side, p in self.profiles.items()}, {side: p.few for side, p in self.profiles.items()})

    def unpersist(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept, self.layouts = [], {}


def _narrow(rows: DataFrame) -> DataFrame:
    """``n`` as it is cached: a cache keeps runs of equal integers short, but eight bytes of every double."""
    return rows.withColumn("n", F.col("n").cast("int"))


def _whole(rows: DataFrame) -> DataFrame:
    """``n`` as the formulas use it."""
    return rows.withColumn("n", F.col("n").cast("double"))


def prepare(ratings: DataFrame, rank: int = 10, *, partitions: int | None = None, blocks: int | None = None,
            hot_rows: int | None = None) -> Prepared:
    """Read ``ratings`` once; copies are merged in the tasks that read them, nothing is shuffled but ids.

    Given ``partitions`` and ``blocks`` are raised where a task or block would hold more than ``rows_per_block``.
    """
    stored = _narrow(R.merge_copies(R.check_columns(ratings))).persist(StorageLevel.MEMORY_AND_DISK)
    obs = _whole(stored)
    total = obs.agg(F.count("*").alias("rows"), F.expr("cast(coalesce(sum(n), 0) as bigint)").alias("nnz"),
                    F.expr("coalesce(sum(ss), 0D)").alias("within"), F.expr("coalesce(sum(n * r * r), 0D)").alias("squares")).first()
    rows = total["rows"]
    least = -(-rows // rows_per_block(rank))
    partitions = max(partitions, least) if partitions else fitting_partitions(ratings.sparkSession, rows)
    most = hot_rows or rows_per_block(rank) // 4
    limit = S.hot_limit(obs, rank, partitions)
    profiles = {side: S.profile(obs, side, limit, most, rank) for side in ("u", "i")}
    blocks = blocks if blocks and blocks >= least else max(4 * partitions, least)
    return Prepared(obs, rank, partitions, blocks, profiles, rows, total["nnz"], total["within"], total["squares"], kept=[stored])


@dataclass
class AlsResult:
    """``strategy`` names the plan that ran, side by side if the sides differ."""

    u_factors: DataFrame
    i_factors: DataFrame
    trace: DataFrame | None
    strategy: str
    rank: int
    lam: float
    prepared: Prepared = field(repr=False)
    plan: _Plan = field(repr=False)
    owned: bool = field(default=True, repr=False)  # whether the prepared ratings were made for this fit
    step_seconds: list[float] = field(default_factory=list, repr=False)  # of each half-step

    @property
    def profiles(self) -> dict:
        return self.prepared.profiles

    def predict(self, ratings: DataFrame) -> DataFrame:
        return M.predict(self.u_factors, self.i_factors, ratings, self.rank)

    def sse(self, ratings: DataFrame | None = None) -> DataFrame:
        """One row (nnz, sse): on the training data, or on other ratings (unseen ids drop out)."""
        if ratings is not None:
            near = [side for side, p in self.profiles.items() if S.vector_bytes(p.keys, self.rank) <= S.BROADCAST_BYTES]
            return M.sse(self.u_factors, self.i_factors, ratings, self.rank, near=near)
        return self.plan.sse({"u": self.u_factors, "i": self.i_factors})

    def rmse(self, ratings: DataFrame | None = None) -> DataFrame:
        return M.rmse(self.sse(ratings))

    def reg_cost(self) -> DataFrame:
        return M.reg_cost(self.u_factors, self.i_factors, self.lam)

    def train_loss(self) -> DataFrame:
        return M.train_loss(self.sse(), self.reg_cost())

    def unpersist(self) -> None:
        """Drop the cached ratings, unless other fits share them. The factors are checkpointed and stay."""
        if self.owned:
            self.prepared.unpersist()


class _Plan:
    """One way to update one side from the other; subclasses differ in what they move."""

    name = ""

    def __init__(self, data: Prepared, rank: int, lam: float):
        self.data, self.rank, self.lam = data, rank, lam
        self.obs, self.profiles, self.partitions = data.obs, data.profiles, data.partitions
        self.ran: dict[str, str] = {}
        self.held: list[DataFrame] = []

    def hold(self, df: DataFrame) -> DataFrame:
        """Cache for the current half-step only."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def step(self, side: str, factors: DataFrame) -> DataFrame:
        """One materialized half-step: ``(id, x, gain)``."""
        done = cut(self.update(side, factors), tidy=True)
        while self.held:
            self.held.pop().unpersist()
        return done

    def update(self, side: str, factors: DataFrame) -> DataFrame:
        raise NotImplementedError

    def error(self, done: DataFrame) -> DataFrame:
        """The training error after a half-step, from its normal equations alone: one row ``sse``.

        For an entity with solution w, sum r^2 - 2 wT Xty + wT XtX w. The half-step has summed all
        of it, so no rating is read again. It is a difference of sums: its absolute error is about
        rank * 1e-16 * sum r^2, so a relative one of 1e-9 as long as a fit leaves a millionth of
        the squares. Below zero it is zero.
        """
        gain = F.coalesce(F.sum("gain"), F.lit(0.0))
        return done.agg((F.greatest(F.lit(0.0), F.lit(self.data.squares) - gain) + F.lit(self.data.within)).alias("sse"))

    def sse(self, factors: dict) -> DataFrame:
        """One row (nnz, sse) over the training data, rating by rating."""
        raise NotImplementedError

    def label(self) -> str:
        """What ran: the name of the plan, or of each side's if they differ."""
        names = set(self.ran.values()) or {self.name}
        return names.pop() if len(names) == 1 else " ".join(f"{side}:{self.ran[side]}" for side in ("u", "i"))

    def solved(self, normal: DataFrame, key: str) -> DataFrame:
        x = solve_explained(F.col("xtx"), F.col("xty"), self.rank, self.lam)
        return normal.select(F.col(key).alias("id"), x.alias("w")).select("id", "w.x", "w.gain")

    def added_up(self, updated: DataFrame, split: bool) -> DataFrame:
        """Solved entities as they are; the pieces of split ones are added up and solved."""
        if not split:
            return updated.select("id", "x", "gain")
        # Both branches read the results, so these are held for the length of the step.
        updated = self.hold(updated)
        summed = N.sum_arrays(updated.where("x is null"), "id", self.rank)
        return updated.where("x is not null").select("id", "x", "gain").unionByName(self.solved(summed, "id"))


def _by_entity(batches, solve):
    """What ``solve`` yields for chunks of rows in order of ``dst`` and ``piece``, cut between two of these."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= CHUNK_ROWS:
            rows = pa.Table.from_batches(held)
            _, starts, _ = B._entities(rows, "piece")
            whole = int(starts[-1])  # the last one may go on
            yield from solve(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
            count = rows.num_rows - whole
            if not whole:
                count = 0  # an entity of more rows than a chunk: read on
    if held:
        yield from solve(pa.Table.from_batches(held))


class JoinPlan(_Plan):
    """Ratings stay partitioned by one side; vectors are joined to them and sums combined before the shuffle.

    Where the other side's vectors are few they are joined as a broadcast to the ratings in order of
    the side that is solved: its sums are whole where they are made, and nothing is shuffled. The
    same layout then serves both sides and the training error.
    """

    name = "join"

    def __init__(self, data: Prepared, rank: int, lam: float, limit_bytes: int = S.BROADCAST_BYTES):
        super().__init__(data, rank, lam)
        self.limit_bytes = limit_bytes

    def fits(self, side: str) -> bool:
        """Whether the vectors of ``side`` may be broadcast."""
        return S.vector_bytes(self.profiles[side].keys, self.rank) <= self.limit_bytes

    def in_place(self, side: str) -> bool:
        """Whether sending the source's vectors to all tasks moves less than sums or ratings would."""
        src, profile = OTHER[side], self.profiles[side]
        form = N.combining(self.rank, profile, self.partitions)
        sent = S.vector_bytes(self.profiles[src].keys, self.rank) * self.obs.sparkSession.sparkContext.defaultParallelism
        return self.fits(src) and sent < N.moved_bytes(self.rank, profile, self.partitions, form)

    def ordered(self, side: str) -> int:
        """Partitions of the ratings by their source in which sums are folded in order of ``side``; 0 if that does not pay.

        It does where ratings with their vectors would move otherwise, and much of that. The fewer partitions, the fewer
        sums move: as many as occupy the cores, and hold few enough ratings and vectors. The highest rank of the
        data decides, so that its fits share a layout.
        """
        data, profile = self.data, self.profiles[side]
        if N.combining(data.rank, profile, self.partitions) != "gather":
            return 0
        moved = N.moved_bytes(data.rank, profile, self.partitions, "gather")
        vectors = S.vector_bytes(self.profiles[OTHER[side]].keys, data.rank)
        parts = max(min(self.partitions, self.obs.sparkSession.sparkContext.defaultParallelism),
                    -(-data.rows // MAX_PARTITION_ROWS), -(-vectors // N.TASK_VECTOR_BYTES))
        return parts if moved > N.MOVED_BYTES and N.moved_bytes(data.rank, profile, parts, "runs") < moved else 0

    def home(self, side: str) -> str:
        """The layout that has the ratings by ``side``, to update the other one."""
        return f"by {side} for {OTHER[side]}" if self.ordered(OTHER[side]) else f"by {side}"

    def placed(self, side: str, parts: int = 0):
        """(rows, keys): the ratings by ``side`` and in its order, hot ones in pieces; in ``parts``, in order of the other side."""
        def make():
            hot, few = self.profiles[side].hot, self.profiles[side].few
            keys = [side] if hot is None else [side, "piece"]
            rows = self.obs.select("u", "i", "n", "r")
            if hot is not None:
                rows = B._with_pieces(rows, side, OTHER[side], hot, few).withColumnsRenamed({f"_{side}": "piece", f"_hot_{side}": "split"})
            order = [OTHER[side]] if parts else keys
            return _whole(self.data.keep(_narrow(rows.repartition(parts or self.partitions, *keys).sortWithinPartitions(*order)))), keys
        return self.data.layout(self.home(side) if parts else f"by {side}", make)

    def attached(self, side: str, factors: DataFrame) -> DataFrame:
        """Rows (side, n, r, x): each rating with the vector of its other side."""
        src = OTHER[side]
        parts = self.ordered(side)
        rows, keys = self.placed(src, parts)
        vectors = factors.select(F.col("id").alias(src), "x")
        if self.profiles[src].hot is not None:
            vectors = S.spread(vectors, src, self.profiles[src].hot, few=self.profiles[src].few)
        if parts:
            vectors = vectors.hint("shuffle_hash")  # rows stay in their order
        return rows.join(vectors, keys).select("u", "i", "n", "r", "x")

    def update(self, side: str, factors: DataFrame) -> DataFrame:
        if self.in_place(side):
            self.ran[side] = "join"
            return self.updated_in_place(side, factors)
        rows, profile, parts = self.attached(side, factors), self.profiles[side], self.ordered(side)
        form = N.combining(self.rank, profile, parts or self.partitions)
        if parts and form != "columns":
            form = "runs"
        self.ran[side] = "join" if form != "gather" else "gather"
        return self.solved(N.combine(rows, side, self.rank, OTHER[side], profile, form), side)

    def updated_in_place(self, side: str, factors: DataFrame) -> DataFrame:
        rank, lam, split = self.rank, self.lam, self.profiles[side].hot is not None
        rows = self.placed(side)[0].join(F.broadcast(factors.select(F.col("id").alias(OTHER[side]), "x")), OTHER[side])
        if rank <= N.MAX_COLUMN_RANK:
            return self.solved(N.by_columns(rows, side, rank), side)  # pieces meet in the sums

        def solve(table: pa.Table):
            dst, starts, ends = B._entities(table, "piece")
            parts, n, r = (table[c].to_numpy() for c in ("split", "n", "r"))
            x = matrix_of(table["x"], rank)
            for made in B.solve_entities(dst, starts, ends, parts, np.arange(len(dst)), n, r, x, rank, lam):
                yield from made.to_batches()

        marks = ["piece", "split"] if split else [F.lit(0).alias("piece"), F.lit(False).alias("split")]
        rows = rows.select(F.col(side).alias("dst"), *marks, "n", "r", "x")
        return self.added_up(rows.mapInArrow(lambda batches: _by_entity(batches, solve), B.SOLVED_SCHEMA), split)

    def sse(self, factors: dict) -> DataFrame:
        """Rating by rating. Vectors that are few are broadcast; others are joined where a layout has the ratings by their side."""
        near = [side for side in ("u", "i") if self.fits(side)]
        home = [side for side in ("u", "i") if side not in near and self.home(side) in self.data.layouts][:1]
        rows = self.attached(OTHER[home[0]], factors[home[0]]).withColumnRenamed("x", f"x{home[0]}") if home else self.obs
        scored = M.attach(rows, factors, [side for side in ("u", "i") if side not in home], self.profiles, near=near)
        return M.errors(scored.withColumn("ss", F.lit(0.0)), self.rank).select(
            "nnz", (F.col("sse") + F.lit(self.data.within)).alias("sse"))


class GatherPlan(JoinPlan):
    """Same join, but the ratings of an entity are gathered before they are summed."""

    name = "gather"

    def ordered(self, side: str) -> int:
        return 0

    def update(self, side: str, factors: DataFrame) -> DataFrame:
        rows = self.attached(side, factors)
        return self.solved(N.gather(rows, side, self.rank, OTHER[side], self.profiles[side]), side)


class BroadcastPlan(_Plan):
    """The other side's factors go to every task as one array; the ratings never move.

    They are laid out once by the side that is solved, each with the place of its source in that
    array, so a half-step reads them in order, sums and solves in place: it has no exchange
    but that of the normal equations of split entities. Only factors of a checked size are sent;
    beyond the limit the same half-step runs as a shuffled join, and the label says so.
    """

    name = "broadcast"

    def __init__(self, data: Prepared, rank: int, lam: float, limit_bytes: int = S.BROADCAST_BYTES):
        super().__init__(data, rank, lam)
        self.limit_bytes = limit_bytes
        self.fallback = JoinPlan(data, rank, lam, limit_bytes)

    def fits(self, src: str) -> bool:
        return S.vector_bytes(self.profiles[src].keys, self.rank) <= self.limit_bytes

    def sse(self, factors: dict) -> DataFrame:
        return self.fallback.sse(factors)

    def ids(self, side: str) -> np.ndarray:
        """All ids of a side whose factors fit, ascending."""
        return self.data.layout(f"ids {side}", lambda: np.sort(
            self.profiles[side].ids.select("id").toArrow().column("id").to_numpy()))

    def placed(self, dst: str) -> DataFrame:
        """Rows (dst, split, pick, n, r) in order of ``dst``, each entity or piece in one partition."""
        src, hot, few = OTHER[dst], self.profiles[dst].hot, self.profiles[dst].few

        def make():
            known = self.obs.sparkSession.sparkContext.broadcast(self.ids(src))

            def picked(batches):
                for batch in batches:
                    at = np.searchsorted(known.value, batch.column(0).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns[1:]], names)

            rows = B._with_pieces(self.obs.select("u", "i", "n", "r"), dst, src, hot, few)
            names = ["pick", "dst", "piece", "split", "n", "r"]
            rows = rows.select(src, F.col(dst).alias("dst"), F.col(f"_{dst}").alias("piece"), F.col(f"_hot_{dst}").alias("split"), "n", "r")
            rows = rows.mapInArrow(picked, "pick int, dst bigint, piece int, split boolean, n double, r double")
            return self.data.keep(rows.repartition(self.partitions, "dst", "piece").sortWithinPartitions("dst", "piece"))
        return self.data.layout(f"for {dst}", make)

    def update(self, side: str, factors: DataFrame) -> DataFrame:
        src = OTHER[side]
        if not self.fits(src):
            done = self.fallback.update(side, factors)
            self.ran[side] = self.fallback.ran[side]
            return done
        self.ran[side] = self.name
        rank, lam = self.rank, self.lam
        table = factors.select("id", "x").toArrow()
        order = np.argsort(table["id"].to_numpy())
        sent = factors.sparkSession.sparkContext.broadcast(matrix_of(table["x"], rank)[order])

        def solve(rows: pa.Table):
            """The entities of complete runs of rows."""
            dst, starts, ends = B._entities(rows, "piece")
            split = rows["split"].to_numpy()
            pick, n, r = (rows[c].to_numpy() for c in ("pick", "n", "r"))
            for made in B.solve_entities(dst, starts, ends, split, pick, n, r, sent.value, rank, lam):
                yield from made.to_batches()

        updated = self.placed(side).mapInArrow(lambda batches: _by_entity(batches, solve), B.SOLVED_SCHEMA)
        return self.added_up(updated, self.profiles[side].hot is not None)


class BlockedPlan(_Plan):
    """Ratings stay with the block that owns their destination; only vectors move.

    Both link tables of a side come from one exchange of its ratings. A pair of blocks exchanges
    one message, with every vector that is needed there once. Hot destinations are split into
    pieces that live in different blocks and are summed before the solve; hot sources cost at most
    one message per block.
    """

    name = "blocked"

    def kept(self, dst: str) -> tuple[DataFrame, DataFrame]:
        """(ratings by the blocks of ``dst``, what these blocks send when the other side is updated)."""
        def make():
            hot, few = self.data.hot()
            rows = self.data.keep(B.rating_table(self.obs, dst, OTHER[dst], self.data.blocks, self.partitions, hot, few))
            return rows, self.data.keep(B.send_table(rows))
        return self.data.layout(f"blocks of {dst}", make)

    def tables(self, dst: str) -> tuple[DataFrame, DataFrame]:
        """:meth:`kept` with each rating's ``pick``, which the half-steps find block by block."""
        rows, links = self.kept(dst)
        return B.with_picks(rows), links

    def lone(self, src: str) -> DataFrame:
        """(id, to): the blocks that need the vector of a hot source."""
        def make():
            hot, few = self.data.hot()
            dst = OTHER[src]
            marks = S.small(hot[src].select(F.col("id").alias(src)), few[src])
            placed = B._with_pieces(self.obs.select("u", "i").join(marks, src, "left_semi"), dst, src, hot[dst], few[dst])
            block = B.hashed_block(dst, f"_{dst}", self.data.blocks)
            return self.data.keep(placed.select(F.col(src).alias("id"), block.alias("to")).distinct())
        return self.data.layout(f"lone {src}", make)

    def messages(self, side: str, factors: DataFrame) -> DataFrame:
        """One message from each block of the other side to each block of ``side`` that needs any of its vectors.

        Hot sources have their own.
        """
        src = OTHER[side]
        links = self.kept(src)[1]
        block = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(self.data.blocks)).cast("int")
        vectors = factors.select(block.alias("blk"), "id", "x")
        sent = vectors.groupBy("blk").cogroup(links.groupBy("blk")).applyInArrow(B.send_block(self.rank), B.MESSAGE_SCHEMA)
        if self.profiles[src].hot is None:
            return sent
        alone = factors.select("id", "x").join(self.lone(src), "id").select(
            "to", F.lit(B.LONE).alias("sender"), "id", B.binary_vectors(F.col("x")).alias("x"))
        return sent.unionByName(alone)

    def update(self, side: str, factors: DataFrame) -> DataFrame:
        updated = self.messages(side, factors).groupBy("to").cogroup(
            self.kept(side)[0].groupBy("blk")).applyInArrow(B.update_block(self.rank, self.lam), B.SOLVED_SCHEMA)
        return self.added_up(updated, self.profiles[side].hot is not None)

    def sse(self, factors: dict) -> DataFrame:
        """Training error in place: vectors of both sides travel to the ratings."""
        profile = self.profiles["i"]
        mine = S.spread(factors["i"].select("id", "x"), "id", profile.hot, few=profile.few)
        mine = mine.withColumn("to", B.hashed_block("id", "piece", self.data.blocks))
        if profile.hot is not None:
            mine = mine.dropDuplicates(["to", "id"])  # two pieces may share a block
        mine = mine.select("to", F.lit(B.OWN).alias("sender"), "id", B.binary_vectors(F.col("x")).alias("x"))
        gaps = self.messages("i", factors["u"]).unionByName(mine).groupBy("to").cogroup(
            self.kept("i")[0].groupBy("blk")).applyInArrow(B.score_block(self.rank), "sse double")
        return gaps.agg(F.lit(self.data.nnz).cast("bigint").alias("nnz"),
                        (F.coalesce(F.sum("sse"), F.lit(0.0)) + F.lit(self.data.within)).alias("sse"))


# A step between the seeds of different starts: odd, so that seeds do not meet shifted ids soon.
SEED_STRIDE = 1_000_000_007


def initial_factors(ids: DataFrame, rank: int, side: str, seed: int = 0) -> DataFrame:
    """Seeded start: an entity's generator seed is its id, or -id on the i side, plus a multiple of ``seed``."""
    own = "id" if side == "u" else "-id"
    return ids.select("id", initial_vector(f"({own} + {seed * SEED_STRIDE}L)" if seed else own, rank).alias("x"))


def _start(profile: S.KeyProfile, rank: int, side: str, given: DataFrame | None, seed: int) -> DataFrame:
    """Seeded start vectors, or given ones: exactly one for every id of the side."""
    if given is None:
        return initial_factors(profile.ids, rank, side, seed)
    used = cut(given.select("id", "x").join(profile.ids.select("id"), "id", "left_semi"))
    per_id = used.groupBy("id").agg(F.count("*").alias("n"))
    if per_id.agg(F.count("*"), F.max("n")).first()[:] != (profile.keys, 1):
        raise ValueError(f"init for side {side} needs exactly one vector per id")
    return used


def choose_strategy(data: Prepared, rank: int, broadcast_bytes: int = S.BROADCAST_BYTES) -> str:
    """The strategy whose half-steps cost least by :mod:`factorlab.plans.cost`."""
    keys = {side: p.keys for side, p in data.profiles.items()}
    cores = data.obs.sparkSession.sparkContext.defaultParallelism
    seconds = estimate(data.rows, keys["u"], keys["i"], rank, data.blocks, min(cores, data.partitions), broadcast_bytes)
    return min(seconds, key=seconds.get)


def fitting_partitions(spark, rows: int) -> int:
    """The session's shuffle width, unless its partitions would be tiny or too large."""
    return max(1, min(shuffle_partitions(spark), rows // MIN_PARTITION_ROWS + 1), rows // MAX_PARTITION_ROWS)


def als_fit(ratings: DataFrame | Prepared, rank: int = 10, lam: float = 0.01, iters: int = 10,
            strategy: str = "auto", *, first: str = "i", trace: bool = False,
            blocks: int | None = None, partitions: int | None = None,
            init: dict[str, DataFrame] | None = None, seed: int = 0, hot_rows: int | None = None,
            broadcast_bytes: int = S.BROADCAST_BYTES) -> AlsResult:
    """Fit ``r ~ x_u . x_i``.

    ``ratings`` may have been prepared for several fits (:func:`prepare`). ``first`` is the side
    updated first in each iteration; the start vectors of the other side therefore decide the
    result. Other values of ``seed`` give other starts. ``trace`` adds one row (iter, half, sse)
    per half-step. ``hot_rows`` is the number of ratings above which an id is split; by default it
    follows from the partitions and blocks, and it changes the plan only, never the result.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if rank < 1 or iters < 0 or first not in OTHER:
        raise ValueError("rank >= 1, iters >= 0 and first in ('u', 'i') are required")
    owned = not isinstance(ratings, Prepared)
    if not owned and (blocks, partitions, hot_rows) != (None, None, None):
        raise ValueError("blocks, partitions and hot_rows belong to prepare()")
    data = prepare(ratings, rank, partitions=partitions, blocks=blocks, hot_rows=hot_rows) if owned else ratings
    if rank > data.rank:
        raise ValueError(f"the ratings are prepared for ranks up to {data.rank}")
    strategy = choose_strategy(data, rank, broadcast_bytes) if strategy == "auto" else strategy
    plan = (JoinPlan(data, rank, lam, broadcast_bytes) if strategy == "join" else
            GatherPlan(data, rank, lam, broadcast_bytes) if strategy == "gather" else
            BlockedPlan(data, rank, lam) if strategy == "blocked" else
            BroadcastPlan(data, rank, lam, broadcast_bytes))

    factors = {side: _start(data.profiles[side], rank, side, (init or {}).get(side), seed) for side in ("u", "i")}
    errors: list[DataFrame] = []
    seconds: list[float] = []
    for it in range(iters):
        for half, side in enumerate((first, OTHER[first]), start=1):
            started = time.monotonic()
            done = plan.step(side, factors[OTHER[side]])
            factors[side] = done.select("id", "x")
            seconds.append(time.monotonic() - started)
            if trace:
                errors.append(cut(plan.error(done).select(F.lit(it).alias("iter"), F.lit(half).alias("half"), "sse")))

    steps = None
    for error in errors:
        steps = error if steps is None else steps.unionByName(error)
    return AlsResult(factors["u"], factors["i"], steps, plan.label(), rank, lam, data, plan, owned, seconds)


def grouped_ridge(df: DataFrame, key: str, features: list[Column | str], target: Column | str,
                  lam: float = 0.01) -> DataFrame:
    """One ridge regression per key: ``w = (XtX + lam I)^-1 Xty`` over the rows of the key.

    Rows with a null or NaN among the features, or as target, are incomplete and do not count,
    however many features there are; a key without complete rows has no regression. Null keys are one key.
    """
    cols = [F.col(f) if isinstance(f, str) else f for f in features]
    goal = F.col(target) if isinstance(target, str) else target
    rows = df.select(F.col(key).alias("key"), F.lit(1.0).alias("n"), goal.cast("double").alias("r"),
                     F.array(*[c.cast("double") for c in cols]).alias("x"))
    rows = rows.where("not isnan(r) and r is not null and forall(x, v -> v is not null and not isnan(v))")
    rank = len(cols)
    normal = N.by_columns(rows, "key", rank) if rank <= N.MAX_COLUMN_RANK else N.by_arrow_fold(rows, "key", rank)
    return normal.select(F.col("key").alias(key),
                         solve_packed(F.col("xtx"), F.col("xty"), len(cols), lam).alias("w"))
