"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source whose target is r times its size takes every document floor(r) times and, from the
rest f = r - floor(r), a sample without replacement. Each document draws a uniform u from a
hash of its id; its rank is the odds of u divided by the odds of its inclusion,
(u / (1-u)) / (p / (1-p)), and the documents of least rank are taken. Sizes differ, so the
fixed size of a sample is one of words: ranks are taken until the words owed are met as
nearly as whole documents allow.

No source is sorted or gathered. The rank at which to stop is found by counts: words are
summed by source and rank interval, the interval where the words owed are met is cut into
finer ones, and only the rows of the last such interval, about one in a million, are
put in order. What comes out is one row for each source, and documents compare themselves
with it where they are.

Null sources are a source of their own, ordered last; null texts and ids are allowed and count
no words and one hash. Rows of one id, or without one, draw the same u; where the last rank
taken is shared, as many of its rows are taken as the words owed allow, smaller ones first and
of equal ones any, so no group of tied rows is taken whole. Without rows there are no targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlab.operators.positions import ordered_positions
from factorlab.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
INTERVALS = 1024
#: Tables of sources up to this many rows are sent to the tasks; larger ones are joined by shuffles.
BROADCAST_SOURCES = 200_000
_WORD = "[^\\x20\\x09-\\x0D]+"


def words(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("bigint")


def uniform(id_col: str = "doc_id", seed: str = SEED):
    """A double in (0, 1) from the first 52 bits of an MD5 of the id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def _by_source(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """``rows`` with what ``sources`` (no null in ``no_source``, ``source_key``) knows of theirs."""
    few = F.broadcast(sources) if count <= BROADCAST_SOURCES else sources
    return rows.join(few, ["no_source", "source_key"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("no_source", F.col("source").isNull()) \
        .withColumn("source_key", F.coalesce(F.col("source").cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(no_source, source_key, source_size, target)`` from rows with ``size`` and a source.

    Weights repeat along the sources in code point order. ``share`` times all words are dealt
    out by weight; a target stops at ``most`` times its source's size, and the excess goes to
    the others by weight until none is above.
    """
    totals = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    placed = ordered_positions(totals, [], ["no_source", "source_key"], "nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("nth") % len(weights) + 1).cast("int"))
    rows = cut(placed.select("no_source", "source_key", "source_size", weight.alias("weight"),
                             (most * F.col("source_size")).alias("most")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    unit, stopped = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(unit) * F.col("weight")
        state = rows.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("used"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
                         F.sum(full.cast("int")).alias("n")).first()
        if not state["open"] or state["n"] == stopped:
            break
        stopped, unit = state["n"], (share * total - state["used"]) / state["open"]
    return rows.select("no_source", "source_key", "source_size",
                       F.least(F.col("most"), F.lit(unit) * F.col("weight")).alias("target"))


def _crossing(rows: DataFrame, keys: list[str], cell: str, name: str) -> DataFrame:
    """For each key the first ``cell`` at which its words exceed ``owed``, and what is owed inside it."""
    sums = rows.groupBy(*keys, "owed", cell).agg(F.sum("size").alias("w"))
    up = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    met = sums.withColumn("upto", F.sum("w").over(up)).where("upto > owed")
    first = met.groupBy(*keys).agg(F.min(F.struct(F.col(cell), F.col("upto"), F.col("w"), F.col("owed"))).alias("x"))
    return first.select(*keys, F.col(f"x.{cell}").alias(name),
                        (F.col("x.owed") - F.col("x.upto") + F.col("x.w")).alias("left"))


def stopping_ranks(sizes: DataFrame, targets: DataFrame, count: int) -> DataFrame:
    """``targets`` with ``copies`` (whole ones), and the last rank, id and size taken beyond, ``stop...``.

    Of the ``of`` rows that share these, ``take`` are taken. ``sizes`` has ``size``, ``u`` and
    ``doc_id``. A null ``stop`` takes all.
    """
    key = ["no_source", "source_key"]
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = cut(targets.withColumn("copies", F.floor(ratio).cast("bigint"))
               .withColumn("p", ratio - F.col("copies"))
               .withColumn("owed", F.col("target") - F.col("copies") * F.col("source_size")))
    # rank / (1 + rank) is in (0, 1) and has the order of the rank
    spread = cut(_by_source(sizes, plan.select(*key, "p", "owed"), count).where("p > 0")
                 .withColumn("rank", pareto_rank()).withColumn("place", F.col("rank") / (1 + F.col("rank")))
                 .select(*key, "owed", "doc_id", "size", "rank",
                         F.least(F.floor(F.col("place") * INTERVALS ** 2), F.lit(INTERVALS ** 2 - 1)).alias("fine"))
                 .withColumn("coarse", F.expr(f"fine div {INTERVALS}")))
    coarse = _crossing(spread, key, "coarse", "at_coarse")
    inside = (_by_source(spread.drop("owed"), coarse.withColumnRenamed("left", "owed"), count)
              .where("coarse = at_coarse"))
    fine = _crossing(inside, key, "fine", "at_fine")
    last = _by_source(inside.drop("owed"), fine.withColumnRenamed("left", "owed"), count).where("fine = at_fine")
    # rows of one rank, id and size are alike: counted first, so that many of them are one row here
    alike = last.groupBy(*key, "owed", "rank", "doc_id", "size").agg(F.count("*").alias("of"))
    order = Window.partitionBy(*key).orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = (alike.withColumn("room", F.col("owed") - F.sum(F.col("size") * F.col("of")).over(order) + F.col("size") * F.col("of"))
            .withColumn("whole", F.expr("cast(case when size = 0 then if(room >= 0, of, 0) "
                                        "else least(of, greatest(0, floor(room / size))) end as bigint)"))
            .withColumn("rest", F.expr("room - whole * size"))
            .withColumn("take", F.expr("whole + if(whole < of and rest > 0 and size - rest < rest, 1, 0)")))
    edge = ends.groupBy(*key).agg(
        F.max(F.when(F.col("take") > 0, F.struct("rank", "doc_id", "size", "take", "of"))).alias("yes"), F.min("rank").alias("none_from"))
    return (plan.join(edge, key, "left")
            .select(*key, "source_size", "target", "copies", "p",
                    F.coalesce("yes.rank", "none_from").alias("stop"), F.col("yes.doc_id").alias("stop_id"),
                    F.col("yes.size").alias("stop_size"), F.col("yes.take").alias("take"), F.col("yes.of").alias("of"),
                    F.col("yes").isNull().alias("before")))


def pareto_rank():
    """Random odds by inclusion odds; least if inclusion is certain, null if it is excluded."""
    odds = F.col("u") / (1 - F.col("u"))
    return F.when(F.col("p") >= 1, 0.0).otherwise(F.try_divide(odds * (1 - F.col("p")), F.col("p")))


def mix(docs: DataFrame, carry: list | None = None, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: str = SEED) -> DataFrame:
    """``(row, size, source_size, target, copies)``: every row of ``docs`` as a struct, and how often it is taken."""
    keyed = (docs.select("doc_id", "source", "text", F.struct(*(carry or ["*"])).alias("row"))
             .transform(_keyed).withColumn("size", words()).withColumn("u", uniform(seed=seed)))
    sizes = cut(keyed.select("no_source", "source_key", "doc_id", "size", "u"))
    targets = cut(source_targets(sizes, weights, share, most))
    count = targets.count()
    stops = cut(stopping_ranks(sizes, targets, count))
    rank, null_low = F.col("rank"), F.lit(-(1 << 63))
    own, last = F.coalesce("doc_id", null_low), F.coalesce("stop_id", null_low)
    at_stop = (rank == F.col("stop")) & ~F.col("before") & (F.col("p") > 0)
    alike = at_stop & (own == last) & (F.col("size") == F.col("stop_size"))
    sooner = (rank < F.col("stop")) | (at_stop & ((own < last) | ((own == last) & (F.col("size") < F.col("stop_size")))))
    extra = (F.when(F.col("p") <= 0, False).when(F.col("stop").isNull(), True)
             .when(F.coalesce(alike, F.lit(False)), F.col("take") == F.col("of")).otherwise(sooner))
    rows = _by_source(keyed, stops, count).withColumn("rank", pareto_rank())
    whole = rows.select("row", "size", "source_size", "target", (F.col("copies") + extra.cast("bigint")).alias("copies"))
    if stops.where("take < of").isEmpty():
        return whole
    # some of the rows that are alike at the stop are taken: as many as are owed, by their numbers
    split = F.coalesce(alike & (F.col("take") < F.col("of")), F.lit(False))
    key = ["no_source", "source_key"]
    some = cut(rows.where(split).select(*key, "row", "size", "source_size", "target", "copies", "take",
                                        F.monotonically_increasing_id().alias("nth")))
    numbered = ordered_positions(some, key, ["nth"])
    others = (rows.where(~split)
              .select("row", "size", "source_size", "target", (F.col("copies") + extra.cast("bigint")).alias("copies")))
    return others.unionByName(numbered.select(
        "row", "size", "source_size", "target", (F.col("copies") + (F.col("pos") < F.col("take")).cast("bigint")).alias("copies")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    return (mix(docs, **options).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*"))
