"""The registered queries: one Spark callable per operator, with its DuckDB counterpart.

Each entry reads whole tables of ``sf_dir``. Doubles are rounded on both sides, since the
order of floating sums differs between engines; ``+ 0.0`` turns a negative zero positive.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlab.functions.vectors import outer_packed, triangle
from factorlab.operators import blocks as B
from factorlab.operators import metrics as M
from factorlab.operators import normal_eq as N
from factorlab.operators import stats
from factorlab.operators.positions import ordered_positions
from factorlab.operators.sampling import sample_cells
from factorlab.operators.skew import profile
from factorlab.operators.tiling import replicate, replicate_2x2
from factorlab.plans import dfc as D
from factorlab.plans import jobs
from factorlab.plans.als import BlockedPlan, als_fit, grouped_ridge, initial_factors, prepare
from factorlab.plans.sweep import generate_tile_train, sweep
from factorlab.session import scratch_path, table_partitions
from factorlab.sources import text as T
from factorlab.sources.synth import sample_sizes, size_table, synth_ratings
from factorlab.sources.views import customer_part, supplier_part, supplier_part_split, table
from workload import als_sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LAM = 0.01
BLOCKS = 4
PARTS = 4


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def rounded(col: str, digits: int = 4) -> str:
    return f"round({col}, {digits}) + 0.0D as {col}"


def long_rows(factors: DataFrame, side: str | None = None, keys: tuple[str, ...] = ("id",),
              x: str = "x") -> DataFrame:
    # An inner explode makes Catalyst filter by the size of x, below the distinct that made the ids:
    # x would be computed once for each rating. No x is null or empty here.
    label = [F.lit(side).alias("side")] if side else []
    return factors.select(*label, *keys, F.posexplode_outer(x).alias("pos", "val")).where("pos is not null").selectExpr(
        *(["side"] if side else []), *keys, "cast(pos as bigint) as pos", "round(val, 4) + 0.0D as val")


def fit_rows(fit) -> DataFrame:
    return long_rows(fit.u_factors, "u").unionByName(long_rows(fit.i_factors, "i"))


def dims(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Rows and columns of the dense view: suppliers and parts."""
    return table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count()


SUPPLIERS = "(SELECT count(*) FROM supplier)"
PARTS_N = "(SELECT count(*) FROM part)"


# --- sources and sinks -------------------------------------------------------------------

@query(Q.SUPP_PART)
def q_read_triples_1based(spark, sf_dir):
    path = scratch_path(spark, "triples1")
    T.write_ratings(supplier_part(spark, sf_dir), path, index_base=1)
    return T.read_ratings(spark, path, index_base=1)


@query(Q.CUST_PART)
def q_read_triples_0based(spark, sf_dir):
    path = scratch_path(spark, "triples0")
    T.write_ratings(customer_part(spark, sf_dir), path)
    return T.read_ratings(spark, path, index_base=0, num_partitions=4)


@query(Q.SUPP_PART)
def q_read_tuple_text(spark, sf_dir):
    path = scratch_path(spark, "tuples")
    T.write_tuples(supplier_part(spark, sf_dir), path)
    return T.read_tuples(spark, path)


@query(f"SELECT * FROM ({Q.SUPP_PART}) WHERE i < {PARTS_N} // 2")
def q_bounded_columns(spark, sf_dir):
    path = scratch_path(spark, "bounded")
    T.write_ratings(supplier_part(spark, sf_dir), path, index_base=1)
    return T.read_bounded(spark, path, dims(spark, sf_dir)[1] // 2)


@query("SELECT l_orderkey AS u, l_linenumber::BIGINT AS i, l_extendedprice AS r FROM lineitem")
def q_text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "roundtrip")
    prices = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as u", "cast(l_linenumber as bigint) as i", "l_extendedprice as r")
    T.write_ratings(prices, path, index_base=1, column_major=True)
    return T.read_ratings(spark, path)


@query("SELECT l_orderkey AS u, l_linenumber::BIGINT AS i, l_discount AS r FROM lineitem")
def q_tuple_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "roundtrip")
    T.write_tuples(table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as u", "cast(l_linenumber as bigint) as i", "l_discount as r"), path)
    return T.read_tuples(spark, path)


# --- projections and expansions ----------------------------------------------------------

@query(f"SELECT (u % {BLOCKS})::INTEGER AS u_blk, (i % {BLOCKS})::INTEGER AS i_blk, count(*) AS n, "
       f"round(sum(r), 2) + 0.0 AS sum_r FROM ({Q.SUPP_PART}) GROUP BY 1, 2")
def q_block_layout(spark, sf_dir):
    return B.block_layout(supplier_part(spark, sf_dir), BLOCKS).groupBy("u_blk", "i_blk").agg(
        F.count("*").alias("n"), F.expr("round(sum(r), 2) + 0.0D").alias("sum_r"))


def _tiled_sql(source: str, f: int) -> str:
    return (f"SELECT u + a * {SUPPLIERS} AS u, i + b * {PARTS_N} AS i, r FROM ({source}), "
            f"range({f}) AS ra(a), range({f}) AS rb(b)")


@query(_tiled_sql(Q.SUPP_PART, 3))
def q_replicate_f3(spark, sf_dir):
    return replicate(supplier_part(spark, sf_dir), 3, *dims(spark, sf_dir))


@query(_tiled_sql(Q.SUPP_PART, 2))
def q_replicate_2x2(spark, sf_dir):
    return replicate_2x2(supplier_part(spark, sf_dir), *dims(spark, sf_dir))


@query(f"SELECT id, (id % {BLOCKS})::INTEGER AS blk, row_number() OVER (PARTITION BY id % {BLOCKS} "
       f"ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT i AS id FROM ({Q.SUPP_PART}))")
def q_block_positions(spark, sf_dir):
    ids = supplier_part(spark, sf_dir).select(F.col("i").alias("id"))
    return B.block_positions(ids, BLOCKS).selectExpr("id", "blk", "cast(pos as bigint) as pos")


def _starts_sql(side: str, rank: int) -> str:
    seed = "id" if side == "u" else "-id"
    ctes = [("ids", f"SELECT DISTINCT {side} AS id FROM ({Q.SUPP_PART})"),
            ("f", Q.start_vectors("ids", rank, seed))]
    return Q.with_ctes(ctes, Q.long_rows("f", rank))


def starts(spark, sf_dir, side: str, rank: int) -> DataFrame:
    return initial_factors(supplier_part(spark, sf_dir).select(F.col(side).alias("id")).distinct(), rank, side)


@query(_starts_sql("i", 3))
def q_unblock(spark, sf_dir):
    return long_rows(B.unblock(B.pack_blocks(starts(spark, sf_dir, "i", 3), BLOCKS)))


@query(f"SELECT i, u, r, count(*) AS n FROM ({Q.SUPP_PART}) GROUP BY ALL")
def q_column_slice(spark, sf_dir):
    entries = stats.columns(supplier_part(spark, sf_dir)).select("i", F.explode("entries").alias("e"))
    return entries.selectExpr("i", "e.u as u", "e.r as r", "e.n as n")


@query(f"SELECT u, r, count(*) AS n FROM ({Q.SUPP_PART}) WHERE i = (SELECT min(l_partkey) FROM lineitem) GROUP BY u, r")
def q_one_column(spark, sf_dir):
    ratings = supplier_part(spark, sf_dir)
    first = ratings.agg(F.min("i")).first()[0]
    return stats.column_slice(ratings, first).groupBy("u", "r").agg(F.count("*").alias("n"))


# --- joins ---------------------------------------------------------------------------------

def _start_ctes(rank: int) -> list[tuple[str, str]]:
    return Q.als_ctes(Q.SUPP_PART, rank, LAM, 0)[0]


@query(Q.with_ctes(_start_ctes(2), "SELECT u, i, count(*) AS n, round(sum(r * x0), 4) + 0.0 AS rx0, "
                   "round(sum(r * x1), 4) + 0.0 AS rx1 FROM t JOIN u_0 ON t.u = u_0.id GROUP BY u, i"))
def q_rating_factor_join(spark, sf_dir):
    ratings = supplier_part(spark, sf_dir)
    known = profile(ratings, "u")
    joined = N.attach_factors(ratings, starts(spark, sf_dir, "u", 2), "u", known.hot, known.few)
    # Hardly two ratings share a pair, so a task holds a row of sums for each rating that it is given.
    flat = joined.selectExpr("u", "i", "r * x[0] as rx0", "r * x[1] as rx1").repartition(table_partitions(spark, known.rows), "u", "i")
    return flat.groupBy("u", "i").agg(F.count("*").alias("n"), F.expr("round(sum(rx0), 4) + 0.0D").alias("rx0"),
                                      F.expr("round(sum(rx1), 4) + 0.0D").alias("rx1"))


@query(Q.with_ctes(_start_ctes(3), f"SELECT t.u, t.i, t.r, round({Q.dot(3)}, 4) + 0.0 AS pred FROM t "
                   "JOIN u_0 a ON t.u = a.id JOIN i_0 b ON t.i = b.id"))
def q_predict(spark, sf_dir):
    ratings = supplier_part(spark, sf_dir)
    return M.predict(starts(spark, sf_dir, "u", 3), starts(spark, sf_dir, "i", 3), ratings, 3).selectExpr(
        "u", "i", "r", rounded("pred"))


@query(Q.with_ctes(_start_ctes(2) + [("links", f"SELECT DISTINCT u AS src, (i % {BLOCKS})::INTEGER AS dst_blk FROM t")],
                   "SELECT dst_blk, src, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM links JOIN u_0 ON src = id"))
def q_messages(spark, sf_dir):
    links = B.out_links(supplier_part(spark, sf_dir), "u", "i", BLOCKS)
    return B.messages(links, starts(spark, sf_dir, "u", 2)).selectExpr(
        "dst_blk", "src", "round(x[0], 6) as x0", "round(x[1], 6) as x1")


# --- aggregations ----------------------------------------------------------------------------

@query(f"SELECT u AS id, count(*) AS n FROM ({Q.CUST_PART}) GROUP BY 1")
def q_degree_u(spark, sf_dir):
    return stats.degrees(customer_part(spark, sf_dir), "u")


@query(f"SELECT i AS id, count(*) AS n FROM ({Q.CUST_PART}) GROUP BY 1")
def q_degree_i(spark, sf_dir):
    return stats.degrees(customer_part(spark, sf_dir), "i")


@query(f"SELECT count(*) AS nnz, count(DISTINCT u) AS n_u, count(DISTINCT i) AS n_i, max(u) AS max_u, "
       f"max(i) AS max_i FROM ({Q.CUST_PART})")
def q_matrix_stats(spark, sf_dir):
    return stats.matrix_stats(customer_part(spark, sf_dir))


def _normal_sql(rank: int) -> str:
    names = [f"g{a}_{b}" for a, b in triangle(rank)] + [f"h{a}" for a in range(rank)]
    ctes = _start_ctes(rank) + [("ne", Q.normal_equations("t", "u_0", rank, "t.u = f.id", "t.i AS id", "t.i"))]
    return Q.with_ctes(ctes, " UNION ALL ".join(
        f"SELECT id, {p}::BIGINT AS pos, round({name}, 4) + 0.0 AS val FROM ne" for p, name in enumerate(names)))


def _normal_rows(spark, sf_dir, how: str) -> DataFrame:
    normal = N.normal_equations(supplier_part(spark, sf_dir), starts(spark, sf_dir, "u", 3), "i", 3, how)
    return long_rows(normal.select("id", F.concat("xtx", "xty").alias("x")))


@query(_normal_sql(3))
def q_normal_eq_r3(spark, sf_dir):
    return _normal_rows(spark, sf_dir, "combine")


@query(_normal_sql(3))
def q_normal_eq_fold_r3(spark, sf_dir):
    return _normal_rows(spark, sf_dir, "fold")


@query(_normal_sql(3))
def q_normal_eq_gather_r3(spark, sf_dir):
    return _normal_rows(spark, sf_dir, "gather")


@query(f"SELECT DISTINCT u AS src, (i % {BLOCKS})::INTEGER AS dst_blk FROM ({Q.CUST_PART})")
def q_out_links(spark, sf_dir):
    return B.out_links(customer_part(spark, sf_dir), "u", "i", BLOCKS)


@query(f"SELECT (i % {BLOCKS})::INTEGER AS dst_blk, u AS src, count(*) AS n, round(sum(r), 2) + 0.0 AS sum_r, "
       f"min(i) AS min_dst, max(i) AS max_dst FROM ({Q.CUST_PART}) GROUP BY 1, 2")
def q_in_links(spark, sf_dir):
    owned = B.in_links(customer_part(spark, sf_dir), "u", "i", BLOCKS)
    return owned.groupBy("dst_blk", "src").agg(
        F.count("*").alias("n"), F.expr("round(sum(r), 2) + 0.0D").alias("sum_r"),
        F.min("dst").alias("min_dst"), F.max("dst").alias("max_dst"))


@query(f"WITH t AS (SELECT least(i // ({PARTS_N} // {PARTS}), {PARTS - 1}) AS part, u, i FROM ({Q.CUST_PART})) "
       "SELECT part, count(*) AS nnz, count(DISTINCT u) AS n_u, count(DISTINCT i) AS n_i FROM t GROUP BY part")
def q_dfc_partition_stats(spark, sf_dir):
    return D.partition_stats(customer_part(spark, sf_dir), PARTS, dims(spark, sf_dir)[1])


# --- functions -------------------------------------------------------------------------------

@query(Q.with_ctes(_start_ctes(3), " UNION ALL ".join(
    f"SELECT id, {p}::BIGINT AS pos, round(x{a} * x{b}, 4) + 0.0 AS val FROM u_0"
    for p, (a, b) in enumerate(triangle(3)))))
def q_outer_packed(spark, sf_dir):
    return long_rows(starts(spark, sf_dir, "u", 3).select("id", outer_packed("x", 3).alias("x")))


_RIDGE = ("SELECT l_suppkey AS id, count(*) AS g0_0, sum(l_discount) AS g0_1, sum(l_tax) AS g0_2, "
          "sum(l_discount * l_discount) AS g1_1, sum(l_discount * l_tax) AS g1_2, sum(l_tax * l_tax) AS g2_2, "
          "sum(l_quantity) AS h0, sum(l_quantity * l_discount) AS h1, sum(l_quantity * l_tax) AS h2 "
          "FROM lineitem GROUP BY l_suppkey")


@query(Q.with_ctes([("ne", _RIDGE), ("w", Q.cholesky_solve("ne", 3, 0.1))], Q.long_rows("w", 3)))
def q_grouped_ridge(spark, sf_dir):
    fitted = grouped_ridge(table(spark, sf_dir, "lineitem"), "l_suppkey",
                           [F.lit(1.0), "l_discount", "l_tax"], "l_quantity", lam=0.1)
    return long_rows(fitted.withColumnRenamed("l_suppkey", "id"), x="w")


def _wide_ridge() -> tuple[list[str], str]:
    """13 features, one of them null in some rows; rows that lack one do not count."""
    bits = [f"cast(l_linenumber = {j} as double)" for j in range(1, 6)]
    powers = [f"l_discount{' * l_discount' * j}" for j in range(3)] + [f"l_tax{' * l_tax' * j}" for j in range(2)]
    return ["1.0D", *bits, *powers, "l_discount * l_tax", "case when l_linenumber < 7 then l_quantity / 50 end"], "l_quantity"


def _wide_ridge_sql() -> str:
    features = [f.replace("1.0D", "1.0::DOUBLE") for f in _wide_ridge()[0]]
    xs = ", ".join(f"{f} AS x{j}" for j, f in enumerate(features))
    tri = ", ".join(f"sum(x{a} * x{b}) AS g{a}_{b}" for a in range(13) for b in range(a, 13))
    rhs = ", ".join(f"sum(x{a} * r) AS h{a}" for a in range(13))
    rows = f"SELECT l_suppkey AS id, l_quantity AS r, {xs} FROM lineitem"
    return Q.with_ctes([("f", rows), ("ne", f"SELECT id, {tri}, {rhs} FROM f WHERE x12 IS NOT NULL GROUP BY id"),
                        ("w", Q.cholesky_solve("ne", 13, 0.1))], Q.long_rows("w", 13))


@query(_wide_ridge_sql())
def q_grouped_ridge_13(spark, sf_dir):
    features, target = _wide_ridge()
    fitted = grouped_ridge(table(spark, sf_dir, "lineitem"), "l_suppkey", [F.expr(f) for f in features], target, lam=0.1)
    return long_rows(fitted.withColumnRenamed("l_suppkey", "id"), x="w")


@query("SELECT id, unnest(range(3)) AS pos, round(unnest([0.0, s / 5, 2 * s / 5]), 4) + 0.0 AS val FROM (SELECT l_suppkey AS id, "
       "sum(l_quantity * l_discount) / sum(l_discount * l_discount) AS s FROM lineitem GROUP BY l_suppkey)")
def q_grouped_ridge_collinear(spark, sf_dir):
    """Without lam, a feature that is zero and two of which one is twice the other: the solution of least norm."""
    fitted = grouped_ridge(table(spark, sf_dir, "lineitem"), "l_suppkey",
                           [F.lit(0.0), "l_discount", F.col("l_discount") * 2], "l_quantity", lam=0.0)
    return long_rows(fitted.withColumnRenamed("l_suppkey", "id"), x="w")


@query(Q.with_ctes([("t", Q.SUPP_PART), ("u_0", Q.start_vectors("(SELECT DISTINCT u AS id FROM t)", 3, "id + 5::BIGINT * 1000000007")),
                    ("i_0", Q.start_vectors("(SELECT DISTINCT i AS id FROM t)", 3, "-id + 5::BIGINT * 1000000007"))],
                   Q.long_rows("u_0", 3, "u") + " UNION ALL " + Q.long_rows("i_0", 3, "i")))
def q_init_seeded(spark, sf_dir):
    return fit_rows(als_fit(supplier_part(spark, sf_dir), 3, LAM, 0, "join", seed=5))


def _init_sql(rank: int) -> str:
    return Q.with_ctes(_start_ctes(rank), Q.long_rows("u_0", rank, "u") + " UNION ALL " + Q.long_rows("i_0", rank, "i"))


@query(_init_sql(4))
def q_init_factors(spark, sf_dir):
    return long_rows(starts(spark, sf_dir, "u", 4), "u").unionByName(long_rows(starts(spark, sf_dir, "i", 4), "i"))


# --- whole fits ------------------------------------------------------------------------------

@query(Q.factors(Q.SUPP_PART, 2, LAM, 2))
def q_als_join_r2(spark, sf_dir):
    return fit_rows(als_fit(supplier_part(spark, sf_dir), 2, LAM, 2, "join"))


@query(Q.factors(Q.CUST_PART, 3, LAM, 2))
def q_als_join_r3(spark, sf_dir):
    return fit_rows(als_fit(customer_part(spark, sf_dir), 3, LAM, 2, "join"))


@query(Q.factors(Q.SUPP_PART, 2, LAM, 2))
def q_als_gather_r2(spark, sf_dir):
    return fit_rows(als_fit(supplier_part(spark, sf_dir), 2, LAM, 2, "gather"))


@query(Q.factors(Q.CUST_PART, 3, LAM, 2))
def q_als_blocked_r3(spark, sf_dir):
    return fit_rows(als_fit(customer_part(spark, sf_dir), 3, LAM, 2, "blocked"))


@query(Q.factors(Q.SUPP_PART, 2, LAM, 2, first="u"))
def q_als_broadcast_r2(spark, sf_dir):
    return fit_rows(als_fit(supplier_part(spark, sf_dir), 2, LAM, 2, "broadcast", first="u"))


@query(Q.factors(Q.SUPP_PART, 5, 0.1, 2))
def q_als_auto_r5(spark, sf_dir):
    return fit_rows(als_fit(supplier_part(spark, sf_dir), 5, 0.1, 2))


_FIT2 = Q.als_ctes(Q.SUPP_PART, 2, LAM, 2)
_SPLIT = Q.als_ctes(f"{Q.SUPP_PART} WHERE NOT ({Q.TEST_ROW})", 2, LAM, 2)


def dense_fit(spark, sf_dir, **options):
    return als_fit(supplier_part(spark, sf_dir), 2, LAM, 2, **options)


@query(Q.with_ctes(_FIT2[0], f"SELECT nnz, round(sse, 2) + 0.0 AS sse FROM ({Q.sse('t', _FIT2[1][-1], 2)})"))
def q_train_error(spark, sf_dir):
    return dense_fit(spark, sf_dir).sse().selectExpr("nnz", rounded("sse", 2))


@query(Q.with_ctes(_SPLIT[0] + [("held", f"{Q.SUPP_PART} WHERE {Q.TEST_ROW}")],
                   f"SELECT nnz, round(sse, 2) + 0.0 AS sse FROM ({Q.sse('held', _SPLIT[1][-1], 2)})"))
def q_test_error(spark, sf_dir):
    train, test = supplier_part_split(spark, sf_dir)
    path = scratch_path(spark, "held-out")
    T.write_ratings(test, path, index_base=1)
    return als_fit(train, 2, LAM, 2).sse(T.read_ratings(spark, path)).selectExpr("nnz", rounded("sse", 2))


@query(Q.with_ctes(_FIT2[0], f"SELECT round(reg_cost, 4) + 0.0 AS reg_cost FROM ({Q.reg_cost(_FIT2[1][-1], 2, LAM)})"))
def q_reg_cost(spark, sf_dir):
    return dense_fit(spark, sf_dir).reg_cost().selectExpr(rounded("reg_cost"))


def _loss_sql(state: dict, rank: int, ratings: str = "t") -> str:
    return (f"SELECT nnz, sse, reg_cost, sse + reg_cost AS loss FROM ({Q.sse(ratings, state, rank)}), "
            f"({Q.reg_cost(state, rank, LAM)})")


@query(Q.with_ctes(_FIT2[0], "SELECT nnz, round(sse, 2) + 0.0 AS sse, round(reg_cost, 2) + 0.0 AS reg_cost, "
                   f"round(loss, 2) + 0.0 AS loss FROM ({_loss_sql(_FIT2[1][-1], 2)})"))
def q_train_loss(spark, sf_dir):
    return dense_fit(spark, sf_dir).train_loss().selectExpr(
        "nnz", rounded("sse", 2), rounded("reg_cost", 2), rounded("loss", 2))


@query(Q.with_ctes(_FIT2[0], "SELECT nnz, round(sse, 2) + 0.0 AS sse, round(sqrt(sse / nnz), 6) + 0.0 AS rmse "
                   f"FROM ({Q.sse('t', _FIT2[1][-1], 2)})"))
def q_rmse(spark, sf_dir):
    return dense_fit(spark, sf_dir).rmse().selectExpr("nnz", rounded("sse", 2), rounded("rmse", 6))


@query(Q.with_ctes(_FIT2[0], " UNION ALL ".join(
    f"SELECT {(step - 1) // 2} AS iter, {(step - 1) % 2 + 1} AS half, round(sse, 2) + 0.0 AS sse "
    f"FROM ({Q.sse('t', _FIT2[1][step], 2)})" for step in range(1, 5))))
def q_als_trace(spark, sf_dir):
    return dense_fit(spark, sf_dir, trace=True, strategy="blocked").trace.selectExpr("iter", "half", rounded("sse", 2))


_FIT3 = Q.als_ctes(Q.SUPP_PART, 3, 0.1, 2)


def _strategy_marks(spark, sf_dir, side: str) -> DataFrame:
    """One number for each vector of a side by every strategy; all of them fit the ratings prepared once."""
    data, out = prepare(supplier_part(spark, sf_dir), 3), None
    for name in ("join", "gather", "blocked", "broadcast"):
        fit = als_fit(data, 3, 0.1, 2, name)
        marks = (fit.u_factors if side == "u" else fit.i_factors).selectExpr(
            f"'{name}' as strategy", "id", "round(x[0] + 2 * x[1] + 3 * x[2], 4) + 0.0D as mark")
        out = marks if out is None else out.unionByName(marks)
    data.unpersist()  # the factors are checkpointed
    return out


@query(Q.with_ctes(_FIT3[0], " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, id, round(x0 + 2 * x1 + 3 * x2, 4) + 0.0 AS mark FROM {_FIT3[1][-1]['u']}"
    for name in ("join", "gather", "blocked", "broadcast"))))
def q_strategy_agreement(spark, sf_dir):
    return _strategy_marks(spark, sf_dir, "u")


@query(Q.with_ctes(_FIT3[0], " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, id, round(x0 + 2 * x1 + 3 * x2, 4) + 0.0 AS mark FROM {_FIT3[1][-1]['i']}"
    for name in ("join", "gather", "blocked", "broadcast"))))
def q_strategy_agreement_i(spark, sf_dir):
    return _strategy_marks(spark, sf_dir, "i")


_EVENTS = ("SELECT user_id AS u, dense_rank() OVER (ORDER BY event_type) - 1 AS i, value AS r FROM events "
           "WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL")


def event_ratings(spark, sf_dir):
    """Value by user and event type: five columns, each of which holds a fifth of all rows."""
    events = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null and value is not null")
    kinds = ordered_positions(events.select("event_type").distinct(), [], ["event_type"], "i")
    return events.join(kinds, "event_type").selectExpr("user_id as u", "i", "value as r")


def _wide_fit(strategy: str, rank: int):
    """Fits above the rank up to which sums are columns; each label must name what ran."""
    def run(spark, sf_dir):
        fit = als_fit(supplier_part(spark, sf_dir), rank, 1.0, 1, strategy)
        assert set(fit.strategy.replace("u:", "").replace("i:", "").split()) <= {strategy, "gather"}, fit.strategy
        return fit_rows(fit)
    run.__name__ = f"q_als_{strategy}_r{rank}"
    return run


for _strategy, _rank in (("join", 12), ("gather", 12), ("blocked", 12), ("broadcast", 12), ("join", 20), ("broadcast", 20)):
    query(Q.factors(Q.SUPP_PART, _rank, 1.0, 1))(_wide_fit(_strategy, _rank))


def _traced(strategy: str):
    def run(spark, sf_dir):
        return dense_fit(spark, sf_dir, trace=True, strategy=strategy).trace.selectExpr("iter", "half", rounded("sse", 2))
    run.__name__ = f"q_als_trace_{strategy}"
    return run


for _strategy in ("join", "gather", "broadcast"):
    query(ORACLE["q_als_trace"])(_traced(_strategy))


def _hot_fit(strategy: str):
    def run(spark, sf_dir):
        return fit_rows(als_fit(event_ratings(spark, sf_dir), 3, 1.0, 2, strategy, hot_rows=40))
    run.__name__ = f"q_als_events_{strategy}"
    return run


for _strategy in ("blocked", "join", "gather", "broadcast"):
    query(Q.factors(_EVENTS, 3, 1.0, 2))(_hot_fit(_strategy))


@query(f"SELECT u, i, count(*)::DOUBLE AS n, round(avg(r), 6) + 0.0 AS r FROM ({Q.CUST_PART}) GROUP BY u, i")
def q_packed_ratings(spark, sf_dir):
    """The rating layout that blocked fits use, unpacked again: sources by position, entities by their ends."""
    plan = BlockedPlan(prepare(customer_part(spark, sf_dir), 3, hot_rows=50), 3, LAM)
    sent = plan.tables("u")[1].select("to", F.col("blk").alias("sender"), F.explode("ids").alias("u"))
    if plan.profiles["u"].hot is not None:
        sent = sent.unionByName(plan.lone("u").select("to", F.lit(B.LONE).alias("sender"), F.col("id").alias("u")))
    arrival = Window.partitionBy("to").orderBy("sender", "u")
    sources = sent.select(F.col("to").alias("blk"), "u", (F.row_number().over(arrival) - 1).alias("pick"))
    rows = plan.tables("i")[0].join(sources, ["blk", "pick"]).groupBy("u", F.col("dst").alias("i"))
    return rows.agg(F.sum("n").alias("n"), F.expr("round(sum(n * r) / sum(n), 6) + 0.0D").alias("r"))


def _first_messages(spark, sf_dir, hot_rows):
    """Every rating with the start vector that its block finds at the rating's place among all it was sent."""
    plan = BlockedPlan(prepare(supplier_part(spark, sf_dir), 2, hot_rows=hot_rows), 2, LAM)
    sent = plan.messages("i", starts(spark, sf_dir, "u", 2))

    def found(key, messages, owned):
        x = B._vectors(messages, 2)[B.picks(owned)]
        return pa.table({"i": owned["dst"], "x0": x[:, 0], "x1": x[:, 1], "n": owned["n"]})
    rows = sent.groupBy("to").cogroup(plan.kept("i")[0].groupBy("blk")).applyInArrow(found, "i bigint, x0 double, x1 double, n double")
    return rows.groupBy("i", "x0", "x1").agg(F.sum("n").alias("n")).selectExpr(
        "i", "round(x0, 6) + 0.0D as x0", "round(x1, 6) + 0.0D as x1", "n")


_FIRST_MESSAGES = Q.with_ctes(_start_ctes(2), "SELECT i, round(x0, 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1, "
                              "count(*)::DOUBLE AS n FROM t JOIN u_0 ON t.u = u_0.id GROUP BY i, u, x0, x1")


@query(_FIRST_MESSAGES)
def q_block_messages(spark, sf_dir):
    return _first_messages(spark, sf_dir, None)


@query(_FIRST_MESSAGES)
def q_block_messages_hot(spark, sf_dir):
    return _first_messages(spark, sf_dir, 400)


# --- divide, factor, combine -------------------------------------------------------------------

_DFC = Q.dfc_ctes(Q.CUST_PART, 2, LAM, 2, PARTS, "SELECT count(*) AS n FROM part")
_DFC_PROJECTED = _DFC[0] + Q.dfc_project_r2(_DFC[1], _DFC[2])


def dfc(spark, sf_dir, ratings=None):
    ratings = customer_part(spark, sf_dir) if ratings is None else ratings
    return D.dfc_fit(ratings, PARTS, dims(spark, sf_dir)[1], 2, LAM, 2)


@query(Q.with_ctes(_DFC[0], Q.long_rows(_DFC[1], 2, "u", keys="part, id") + " UNION ALL "
                   + Q.long_rows(_DFC[2], 2, "i", keys="part, id")))
def q_dfc_base_r2(spark, sf_dir):
    fit = dfc(spark, sf_dir)
    return long_rows(fit.w.withColumnRenamed("u", "id"), "u", ("part", "id")).unionByName(
        long_rows(fit.h.withColumnRenamed("i", "id"), "i", ("part", "id")))


@query(Q.with_ctes(_DFC_PROJECTED, "SELECT part, pos, round(val, 2) + 0.0 AS val FROM (" + " UNION ALL ".join(
    f"SELECT part, {r * 2 + c}::BIGINT AS pos, c{r}_{c} AS val FROM gram" for r in range(2) for c in range(2)) + ")"))
def q_dfc_projection_gram(spark, sf_dir):
    grams = D.projection_gram(dfc(spark, sf_dir).w, 2)
    return grams.select("part", F.posexplode("c").alias("pos", "val")).selectExpr(
        "part", "cast(pos as bigint) as pos", "round(val, 2) + 0.0D as val")


@query(Q.with_ctes(_DFC_PROJECTED, Q.long_rows("prows", 2, "u") + " UNION ALL " + Q.long_rows("pcols", 2, "i")))
def q_dfc_project_r2(spark, sf_dir):
    fit = dfc(spark, sf_dir)
    return long_rows(fit.rows, "u").unionByName(long_rows(fit.cols.withColumnRenamed("i", "id"), "i"))


def _dfc_rmse_sql() -> str:
    base = f"SELECT l_suppkey AS u, l_partkey AS i, l_quantity AS r FROM lineitem"
    train, w, h = Q.dfc_ctes(f"{base} WHERE NOT ({Q.TEST_ROW})", 2, LAM, 2, PARTS, "SELECT count(*) AS n FROM part")
    ctes = train + Q.dfc_project_r2(w, h) + [
        ("held", f"SELECT least(i // ((SELECT n FROM cols) // {PARTS}), {PARTS - 1}) AS part, * "
                 f"FROM ({base} WHERE {Q.TEST_ROW})")]

    def score(name, cells, rows, cols, extra=""):
        return (f"SELECT '{name}' AS metric, count(*) AS nnz, round(sqrt(avg(power(coalesce({Q.dot(2)}, 0) - t.r, 2))), 6) "
                f"+ 0.0 AS rmse FROM {cells} t LEFT JOIN {rows} a ON t.u = a.id{extra} LEFT JOIN {cols} b ON t.i = b.id")

    return Q.with_ctes(ctes, " UNION ALL ".join([
        score("train_projected", "t", "prows", "pcols"), score("test_projected", "held", "prows", "pcols"),
        score("test_partition", "held", w, h, " AND t.part = a.part")]))


@query(_dfc_rmse_sql())
def q_dfc_rmse(spark, sf_dir):
    train, test = supplier_part_split(spark, sf_dir)
    return dfc(spark, sf_dir, train).rmse(train, test).selectExpr("metric", "nnz", rounded("rmse", 6))


# --- synthetic data ------------------------------------------------------------------------------

_DIMS = f"SELECT {SUPPLIERS} AS m, {PARTS_N} AS n"


def _sizes_sql(rank: int, train: float, test: float) -> str:
    return (f"SELECT *, least(floor(train * {test}::DOUBLE + 0.5)::BIGINT, m * n - train) AS test FROM ("
            f"SELECT *, least(floor({train}::DOUBLE * freedom + 0.5)::BIGINT, floor(0.99::DOUBLE * m * n + 0.5)::BIGINT) AS train "
            f"FROM (SELECT m, n, {rank} * (m + n - {rank}) AS freedom FROM ({_DIMS})))")


@query(_sizes_sql(10, 2.0, 0.1))
def q_synth_sizes(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").agg(F.count("*").alias("m"), F.lit(1).alias("_one"))
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.lit(1).alias("_one"))
    return size_table(m.join(F.broadcast(n), "_one").select("m", "n"), 10, 2.0, 0.1)


def _hash_sql(tag: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{tag}'", *keys])
    return f"('0x' || substr(md5({text}), 1, 12))::BIGINT"


def _normal_value_sql(tag: str, *keys: str) -> str:
    u1, u2 = (f"(({_hash_sql(f'{tag}/{half}', *keys)} + 0.5) / 281474976710656.0)" for half in "ab")
    return f"sqrt(-2 * ln({u1}::DOUBLE)) * cos(2 * pi() * {u2}::DOUBLE)"


def _cells_ctes(rank: int, train: float, test: float, seed: int) -> list[tuple[str, str]]:
    # m * n has a divisor next below its square root here, so that no number of the grid is in excess
    grid = ("SELECT a, m * n // a AS b FROM size, range(1, ceil(sqrt(m * n))::BIGINT + 1) AS s(a) "
            "WHERE a > greatest(ceil(sqrt(m * n))::BIGINT - 10000, ceil(sqrt(m * n))::BIGINT // 2, 0) AND (m * n) % a = 0 "
            "ORDER BY a DESC LIMIT 1")
    sql = "SELECT pos, pos % a AS u, pos // a AS i, a, b, m, train FROM size, grid, range(train + test) AS p(pos)"
    for turn in range(4):
        sql = f"SELECT pos, (u + {_hash_sql(f'{seed}/{turn}/u', 'i')}) % a AS u, i, a, b, m, train FROM ({sql})"
        sql = f"SELECT pos, u, (i + {_hash_sql(f'{seed}/{turn}/i', 'u')}) % b AS i, a, b, m, train FROM ({sql})"
    return [("size", _sizes_sql(rank, train, test)), ("grid", grid),
            ("cells", f"SELECT idx % m AS u, idx // m AS i, idx, pos >= train AS is_test "
                      f"FROM (SELECT i * a + u AS idx, m, pos, train FROM ({sql}))")]


@query(Q.with_ctes(_cells_ctes(5, 1.0, 0.1, 7), "SELECT * FROM cells"))
def q_sample_cells(spark, sf_dir):
    m, n = dims(spark, sf_dir)
    _, train, test = sample_sizes(m, n, 5)
    return sample_cells(spark, m, n, train, test, seed=7)


@query(Q.with_ctes(_cells_ctes(5, 1.0, 0.1, 7), f"""
    SELECT s_suppkey, p_partkey, is_test, s_acctbal, p_retailprice FROM cells
    JOIN (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS u FROM supplier) USING (u)
    JOIN (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) USING (i)
    WHERE NOT EXISTS (SELECT 1 FROM ({Q.SUPP_PART}) l WHERE l.u = s_suppkey AND l.i = p_partkey)"""))
def q_sample_unseen_cells(spark, sf_dir):
    """Sampled (supplier, part) pairs that no order has, with what the tables know of both."""
    suppliers = ordered_positions(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), [], ["s_suppkey"], "u")
    parts = ordered_positions(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [], ["p_partkey"], "i")
    m, n = dims(spark, sf_dir)
    _, train, test = sample_sizes(m, n, 5)
    seen = supplier_part(spark, sf_dir).select(F.col("u").alias("s_suppkey"), F.col("i").alias("p_partkey")).distinct()
    named = sample_cells(spark, m, n, train, test, seed=7).join(suppliers, "u").join(parts, "i")
    return named.join(seen, ["s_suppkey", "p_partkey"], "left_anti").select(
        "s_suppkey", "p_partkey", "is_test", "s_acctbal", "p_retailprice")


def _synth_ctes(rank: int, train: float, test: float, seed: int, noise: float = 0.0) -> list[tuple[str, str]]:
    z = f"/ sqrt(sqrt({rank}::DOUBLE))"

    def side(tag: str, size: str) -> str:
        xs = ", ".join(f"({_normal_value_sql(f'{seed}/{tag}{j}', 'id')}) {z} AS x{j}" for j in range(rank))
        return f"SELECT id, {xs} FROM size, range({size}) AS s(id)"

    extra = f" + CASE WHEN is_test THEN 0 ELSE {noise} * {_normal_value_sql(f'{seed}/noise', 'u', 'i')} END" if noise else ""
    return _cells_ctes(rank, train, test, seed) + [
        ("fa", side("A", "m")), ("fb", side("B", "n")),
        ("synth", f"SELECT u, i, {Q.dot(rank)}{extra} AS r, is_test FROM cells "
                  "JOIN fa a ON u = a.id JOIN fb b ON i = b.id")]


@query(Q.with_ctes(_synth_ctes(3, 2.0, 0.1, 1, 0.1), "SELECT u, i, round(r, 6) + 0.0 AS r, is_test FROM synth"))
def q_synth_data(spark, sf_dir):
    train, test = synth_ratings(spark, *dims(spark, sf_dir), 3, 2.0, 0.1, noise=0.1, seed=1)
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return both.selectExpr("u", "i", rounded("r", 6), "is_test")


_TILED = Q.als_ctes("SELECT u + a * m AS u, i + b * n AS i, r FROM synth, size, range(2) AS ra(a), range(2) AS rb(b) "
                    "WHERE NOT is_test", 2, 0.1, 3)


@query(Q.with_ctes(
    _synth_ctes(2, 4.0, 0.1, 3) + _TILED[0]
    + [("held", "SELECT u + a * m AS u, i + b * n AS i, r FROM synth, size, range(2) AS ra(a), range(2) AS rb(b) WHERE is_test")],
    " UNION ALL ".join(f"SELECT '{name}' AS data, nnz, round(sqrt(sse / nnz), 4) + 0.0 AS rmse "
                       f"FROM ({Q.sse(cells, _TILED[1][-1], 2)})" for name, cells in (("train", "t"), ("test", "held")))))
def q_generate_tile_train(spark, sf_dir):
    fit, train, test = generate_tile_train(spark, *dims(spark, sf_dir), data_rank=2, train_factor=4.0, repfact=2,
                                           seed=3, rank=2, lam=0.1, iters=3)
    rows = fit.rmse().select(F.lit("train").alias("data"), "nnz", "rmse").unionByName(
        fit.rmse(test).select(F.lit("test").alias("data"), "nnz", "rmse"))
    return rows.selectExpr("data", "nnz", rounded("rmse"))


@query(Q.with_ctes(
    _synth_ctes(2, 4.0, 0.1, 3),
    "SELECT is_test, row_number() OVER (PARTITION BY is_test ORDER BY i, u) - 1 AS pos, u + 1 AS u, i + 1 AS i, "
    "round(r, 4) + 0.0 AS r FROM synth"))
def q_generate_files(spark, sf_dir):
    """The lines of the generator's files, numbered in file order."""
    paths, out = jobs.generate_job(spark, scratch_path(spark, "generated"), *dims(spark, sf_dir), 2, 4.0, 0.1, seed=3), None
    for path, is_test in zip(paths, (False, True)):
        lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"),
                                             F.col("_metadata.file_block_start").alias("block"),
                                             F.monotonically_increasing_id().alias("line"), F.split("value", " ").alias("f"))
        numbered = ordered_positions(lines, [], ["file", "block", "line"]).select(
            F.lit(is_test).alias("is_test"), "pos", F.expr("cast(f[0] as bigint)").alias("u"),
            F.expr("cast(f[1] as bigint)").alias("i"), F.expr("round(cast(f[2] as double), 4) + 0.0D").alias("r"))
        out = numbered if out is None else out.unionByName(numbered)
    return out


@query(_tiled_sql(Q.SUPP_PART, 2))
def q_replicate_job(spark, sf_dir):
    path = scratch_path(spark, "ratings")
    T.write_ratings(supplier_part(spark, sf_dir), path, index_base=1)
    return T.read_ratings(spark, jobs.replicate_job(spark, path, 2, *dims(spark, sf_dir)), index_base=0)


@query(Q.with_ctes(
    _synth_ctes(2, 4.0, 0.1, 3) + _TILED[0]
    + [("held", "SELECT u + a * m AS u, i + b * n AS i, r FROM synth, size, range(2) AS ra(a), range(2) AS rb(b) WHERE is_test"),
       ("train_e", Q.sse("t", _TILED[1][-1], 2)), ("test_e", Q.sse("held", _TILED[1][-1], 2))],
    "SELECT a.nnz AS train_nnz, round(sqrt(a.sse / a.nnz), 4) + 0.0 AS train_rmse, b.nnz AS test_nnz, "
    "round(sqrt(b.sse / b.nnz), 4) + 0.0 AS test_rmse, true AS timed FROM train_e a, test_e b"))
def q_pipeline(spark, sf_dir):
    metrics = jobs.pipeline_job(spark, scratch_path(spark, "pipeline"), *dims(spark, sf_dir), data_rank=2, train_factor=4.0,
                                repfact=2, seed=3, rank=2, lam=0.1, iters=3)
    return metrics.selectExpr("train_nnz", rounded("train_rmse"), "test_nnz", rounded("test_rmse"), "seconds > 0 as timed")


# --- sweeps and reports -----------------------------------------------------------------------------

def _sweep_sql(settings: list[tuple[int, int]], iters: int = 2) -> str:
    ctes, rows = [], []
    for repfact, rank in settings:
        tag = f"_{repfact}_{rank}_"
        fit = Q.als_ctes(Q.SUPP_PART if repfact == 1 else _tiled_sql(Q.SUPP_PART, repfact), rank, LAM, iters, tag=tag)
        ctes += fit[0]
        rows.append(f"SELECT {repfact} AS repfact, {rank} AS rank, nnz, round(sse, 1) + 0.0 AS sse, "
                    f"round(sqrt(sse / nnz), 6) + 0.0 AS rmse, round(loss, 1) + 0.0 AS loss "
                    f"FROM ({_loss_sql(fit[1][-1], rank, f't{tag}')})")
    return Q.with_ctes(ctes, " UNION ALL ".join(rows))


def _sweep_rows(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("repfact", "rank", "nnz", rounded("sse", 1), rounded("rmse", 6), rounded("loss", 1))


@query(_sweep_sql([(1, 1), (1, 2), (1, 3)]))
def q_rank_sweep(spark, sf_dir):
    return _sweep_rows(sweep(supplier_part(spark, sf_dir), ranks=(1, 2, 3), lam=LAM, iters=2))


@query(_sweep_sql([(1, 4), (1, 10), (1, 12)]))
def q_rank_sweep_high(spark, sf_dir):
    return _sweep_rows(sweep(supplier_part(spark, sf_dir), ranks=(4, 10, 12), strategies=("broadcast",), lam=LAM, iters=2))


@query(Q.with_ctes(
    _SPLIT[0] + [("held", f"{Q.SUPP_PART} WHERE {Q.TEST_ROW}"), ("a", Q.sse("t", _SPLIT[1][-1], 2)),
                 ("b", Q.sse("held", _SPLIT[1][-1], 2))],
    "SELECT partitions, blocks, a.nnz, round(sqrt(a.sse / a.nnz), 6) + 0.0 AS rmse, b.nnz AS test_nnz, round(sqrt(b.sse / b.nnz), 6) + 0.0 "
    "AS test_rmse, true AS timed FROM a, b, (VALUES (2), (5)) AS p(partitions), (VALUES (3), (16)) AS q(blocks)"))
def q_block_sweep(spark, sf_dir):
    """Partitions and blocks change the cost of a fit and nothing else; every setting scores held-out ratings."""
    train, test = supplier_part_split(spark, sf_dir)
    rows = sweep(train, ranks=(2,), strategies=("blocked",), partitions=(2, 5), blocks=(3, 16), lam=LAM, iters=2, test=test)
    return rows.selectExpr("partitions", "blocks", "nnz", rounded("rmse", 6), "test_nnz", rounded("test_rmse", 6), "seconds > 0 as timed")


@query(_sweep_sql([(1, 10), (2, 10)], iters=10))
def q_scale_sweep(spark, sf_dir):
    """The reference's data scaling: ten iterations of rank 10 on the ratings as they are and tiled 2 x 2."""
    m, n = dims(spark, sf_dir)
    return _sweep_rows(sweep(supplier_part(spark, sf_dir), ranks=(10,), repfacts=(1, 2), m=m, n=n, lam=LAM, iters=10))


@query(Q.with_ctes(
    _SPLIT[0] + [("held", f"{Q.SUPP_PART} WHERE {Q.TEST_ROW}"), ("a", Q.sse("t", _SPLIT[1][-1], 2)),
                 ("b", Q.sse("held", _SPLIT[1][-1], 2))],
    "SELECT 2 AS rank, 2 AS maxiter, a.nnz AS train_nnz, round(sqrt(a.sse / a.nnz), 6) + 0.0 AS train_rmse, b.nnz AS test_nnz, "
    "round(sqrt(b.sse / b.nnz), 6) + 0.0 AS test_rmse, true AS timed FROM a, b"))
def q_run_metrics(spark, sf_dir):
    """Both errors and the seconds of a fit, through the metrics log."""
    path, started = scratch_path(spark, "metrics"), time.monotonic()
    train, test = supplier_part_split(spark, sf_dir)
    fit = als_fit(train, 2, LAM, 2)
    T.write_metrics(jobs.run_metrics(fit, test, time.monotonic() - started), path, rank=2, maxiter=2)
    return T.read_metrics(spark, path).selectExpr("rank", "maxiter", "train_nnz", rounded("train_rmse", 6), "test_nnz",
                                                  rounded("test_rmse", 6), "seconds > 0 as timed")


_SWEEP = [(name, rank) for rank in (2, 4) for name in ("blocked", "broadcast")]


@query(" UNION ALL ".join(f"SELECT '{name}' AS strategy, * FROM ({_sweep_sql([(1, rank)])})" for name, rank in _SWEEP))
def q_strategy_sweep(spark, sf_dir):
    rows = sweep(supplier_part(spark, sf_dir), ranks=(2, 4), strategies=("blocked", "broadcast"), lam=LAM, iters=2)
    return rows.selectExpr("strategy", "repfact", "rank", "nnz", rounded("sse", 1), rounded("rmse", 6), rounded("loss", 1))


@query(Q.with_ctes(_FIT2[0], "SELECT 2 AS rank, 2 AS maxiter, nnz, round(sqrt(sse / nnz), 6) + 0.0 AS rmse "
                   f"FROM ({Q.sse('t', _FIT2[1][-1], 2)})"))
def q_metrics_sink(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    T.write_metrics(dense_fit(spark, sf_dir).rmse(), path, train="supplier_part", rank=2, maxiter=2)
    return T.read_metrics(spark, path).selectExpr("rank", "maxiter", "nnz", rounded("rmse", 6))


_COST = " UNION ALL ".join(
    f"SELECT '{side}' AS side, k, t, nnz AS join_ops, nnz * k * k + {a} * k + nnz * k AS combine_ops, "
    f"{b} * k * k * k + {b} * k * k AS solve_ops, {b} * t * k * (k + 1) AS sent_values FROM s, g"
    for side, a, b in (("i", "n_u", "n_i"), ("u", "n_i", "n_u")))


@query("WITH s AS (SELECT count(*) AS nnz, count(DISTINCT u) AS n_u, count(DISTINCT i) AS n_i "
       f"FROM ({Q.CUST_PART})), g AS (SELECT k, t FROM (VALUES (10::BIGINT), (20), (30), (100)) AS ks(k), "
       f"(VALUES (4::BIGINT), (8), (16)) AS ts(t)) {_COST}")
def q_cost_model(spark, sf_dir):
    settings = spark.range(1).select(F.explode(F.array(*[F.lit(k).cast("bigint") for k in (10, 20, 30, 100)])).alias("k"))
    settings = settings.withColumn("t", F.explode(F.array(*[F.lit(t).cast("bigint") for t in (4, 8, 16)])))
    return stats.cost_report(customer_part(spark, sf_dir), settings)
