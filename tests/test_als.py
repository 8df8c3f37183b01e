import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from factorlab.operators import blocks as B
from factorlab.operators import metrics as M
from factorlab.operators import normal_eq as N
from factorlab.operators import ratings as R
from factorlab.operators import skew as S
from factorlab.plans import als as A
from factorlab.plans.sweep import sweep
from factorlab.session import DROP_SHUFFLES, cut
from tests import brute

STRATEGIES = ["join", "gather", "blocked", "broadcast"]


def check(ratings_of, rows, rank, lam, iters, strategy, first="i", **options):
    fit = A.als_fit(ratings_of(rows), rank, lam, iters, strategy, first=first, **options)
    u, i = brute.als(rows, rank, lam, iters, first)
    brute.assert_same(brute.collected(fit.u_factors), u)
    brute.assert_same(brute.collected(fit.i_factors), i)
    got = fit.sse().first()
    assert got["nnz"] == len(rows)
    assert got["sse"] == pytest.approx(brute.sse(rows, u, i), rel=1e-7, abs=1e-9)
    return fit


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("first", ["i", "u"])
def test_tiny_fit_equals_brute_force(ratings_of, strategy, first):
    check(ratings_of, brute.TINY, 2, 0.1, 2, strategy, first)


def skewed_rows():
    """One u and one i hold a third of the rows each, and copies of one pair another part."""
    rng = np.random.default_rng(5)
    rows = [(int(u), int(i), float(r)) for u, i, r in
            zip(rng.integers(0, 60, 300), rng.integers(0, 50, 300), rng.integers(1, 6, 300))]
    rows += [(7, i, float(i % 5)) for i in range(300)]
    rows += [(u, 3, float(u % 4)) for u in range(300)]
    rows += [(11, 12, 2.0)] * 150 + [(11, 12, 4.0)] * 150
    return rows


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_hot_keys_and_copies_keep_results_whole(ratings_of, strategy, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 40)
    monkeypatch.setattr(S, "MIN_HOT_ROWS", 1)
    fit = check(ratings_of, skewed_rows(), 3, 0.5, 2, strategy)
    assert all(fit.profiles[side].hot is not None for side in "ui")


@pytest.mark.parametrize("how", ["combine", "fold", "gather"])
def test_normal_equations_of_hot_keys(spark, ratings_of, how, monkeypatch):
    monkeypatch.setattr(S, "MIN_HOT_ROWS", 1)
    monkeypatch.setattr(N, "LIST_ROWS", 30)
    rows = skewed_rows()
    start = brute.start({r[1] for r in rows}, 2, -1)
    factors = spark.createDataFrame([(e, v.tolist()) for e, v in start.items()], "id bigint, x array<double>")
    got = {r["id"]: r for r in N.normal_equations(ratings_of(rows), factors, "u", 2, how).collect()}
    assert set(got) == {r[0] for r in rows}
    for e in got:
        x = np.array([start[i] for u, i, _ in rows if u == e])
        y = np.array([r for u, _, r in rows if u == e])
        gram = x.T @ x
        np.testing.assert_allclose(got[e]["xtx"], [gram[0, 0], gram[0, 1], gram[1, 1]], rtol=1e-9)
        np.testing.assert_allclose(got[e]["xty"], x.T @ y, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("blocks", [1, 4, 7, 200])
def test_any_number_of_blocks(ratings_of, blocks):
    check(ratings_of, brute.TINY + [(0, 0, 1)], 2, 0.1, 1, "blocked", blocks=blocks)


@pytest.mark.parametrize("strategy", ["join", "blocked"])
def test_entities_with_fewer_ratings_than_rank(ratings_of, strategy):
    check(ratings_of, [(0, 0, 3), (1, 1, 2), (1, 0, 1)], 3, 0.1, 1, strategy)


@pytest.mark.parametrize("strategy", ["join", "gather", "blocked"])
def test_rank_above_the_sum_column_limit(ratings_of, strategy):
    rng = np.random.default_rng(1)
    rows = [(int(u), int(i), float(r)) for u, i, r in
            zip(rng.integers(0, 12, 200), rng.integers(0, 9, 200), rng.normal(size=200))]
    check(ratings_of, rows, 14, 1.0, 1, strategy)


def test_no_iterations_return_the_start(ratings_of):
    fit = A.als_fit(ratings_of(brute.TINY), 3, iters=0)
    brute.assert_same(brute.collected(fit.u_factors), brute.start(range(4), 3), 0)
    brute.assert_same(brute.collected(fit.i_factors), brute.start(range(3), 3, -1), 0)


def test_broadcast_beyond_its_limit_joins_instead(ratings_of):
    check(ratings_of, brute.TINY, 2, 0.1, 1, "broadcast", broadcast_bytes=10)


@pytest.mark.parametrize("strategy", ["join", "blocked"])
def test_trace_with_hot_keys(ratings_of, strategy, monkeypatch):
    monkeypatch.setattr(S, "MIN_HOT_ROWS", 1)
    rows = skewed_rows()
    fit = A.als_fit(ratings_of(rows), 2, 0.5, 1, strategy, trace=True)
    got = [r["sse"] for r in fit.trace.orderBy("half").collect()]
    u0 = brute.start({r[0] for r in rows}, 2)
    i1 = brute.half_step(rows, u0, 2, 0.5, 1)
    u1 = brute.half_step(rows, i1, 2, 0.5, 0)
    assert got == pytest.approx([brute.sse(rows, u0, i1), brute.sse(rows, u1, i1)], rel=1e-7)


def test_objective_never_increases_and_row_order_is_irrelevant(ratings_of):
    rows = skewed_rows()
    fit = A.als_fit(ratings_of(rows), 2, 0.1, 3, trace=True)
    errors = [r["sse"] for r in fit.trace.orderBy("iter", "half").collect()]
    assert len(errors) == 6
    u, i = brute.als(rows, 2, 0.1, 3)
    assert errors[-1] == pytest.approx(brute.sse(rows, u, i), rel=1e-7)
    again = A.als_fit(ratings_of(rows[::-1]), 2, 0.1, 3)
    brute.assert_same(brute.collected(again.u_factors), u, 1e-7)
    loss = [A.als_fit(ratings_of(rows), 2, 0.1, k).train_loss().first()["loss"] for k in (1, 2)]
    assert loss[1] <= loss[0]


def test_large_lambda_drives_factors_to_zero(ratings_of):
    fit = A.als_fit(ratings_of(brute.TINY), 2, 1e12, 1)
    assert max(abs(v).max() for v in brute.collected(fit.i_factors).values()) < 1e-9


def test_given_start_vectors_are_used(spark, ratings_of):
    start = spark.createDataFrame([(e, [1.0 * e, 1.0]) for e in range(4)], "id bigint, x array<double>")
    fit = A.als_fit(ratings_of(brute.TINY), 2, 0.1, 1, "join", init={"u": start})
    want = brute.half_step(brute.TINY, {e: np.array([e, 1.0]) for e in range(4)}, 2, 0.1, 1)
    brute.assert_same(brute.collected(fit.i_factors), want)


def test_incomplete_start_vectors_raise(spark, ratings_of):
    for ids in (range(3), [0, 1, 2, 3, 3]):
        start = spark.createDataFrame([(e, [1.0, 1.0]) for e in ids], "id bigint, x array<double>")
        with pytest.raises(ValueError, match="exactly one vector"):
            A.als_fit(ratings_of(brute.TINY), 2, 0.1, 1, init={"u": start})


def test_nothing_to_score_and_nulls(spark, ratings_of):
    fit = A.als_fit(ratings_of(brute.TINY), 2, 0.1, 1)
    row = fit.rmse(ratings_of([(99, 99, 1)])).first()
    assert (row["nnz"], row["rmse"]) == (0, None)
    broken = spark.createDataFrame([(0, 0, 1.0), (None, 1, 2.0)], "u bigint, i bigint, r double")
    with pytest.raises(Exception, match="rating with null u"):
        A.als_fit(broken, 2)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_no_ratings_at_all(ratings_of, strategy):
    fit = A.als_fit(ratings_of(brute.TINY).filter("u < 0"), 2, 0.1, 1, strategy)
    assert fit.u_factors.count() == 0 and fit.sse().first()["nnz"] == 0


def test_unseen_test_ids_drop_out(ratings_of):
    fit = A.als_fit(ratings_of(brute.TINY), 2, 0.1, 2)
    test = [(0, 2, 3), (99, 0, 1), (1, 77, 2)]
    row = fit.rmse(ratings_of(test)).first()
    u, i = brute.als(brute.TINY, 2, 0.1, 2)
    assert row["nnz"] == 1
    assert row["rmse"] == pytest.approx(abs(u[0] @ i[2] - 3))


def test_predictions_of_hot_rows_and_copies(ratings_of, monkeypatch):
    monkeypatch.setattr(S, "MIN_HOT_ROWS", 1)
    rows = skewed_rows()
    fit = A.als_fit(ratings_of(rows), 2, 0.5, 1)
    u, i = brute.als(rows, 2, 0.5, 1)
    got = sorted((r["u"], r["i"], r["r"], round(r["pred"], 6)) for r in fit.predict(ratings_of(rows)).collect())
    assert got == sorted((a, b, r, round(float(u[a] @ i[b]), 6)) for a, b, r in rows)


def test_grouped_ridge(spark):
    rng = np.random.default_rng(2)
    data = [(k, float(a), float(b), float(y)) for k, (a, b, y) in
            zip(rng.integers(0, 3, 40).tolist(), rng.normal(size=(40, 3)))]
    got = {r["k"]: r["w"] for r in A.grouped_ridge(
        spark.createDataFrame(data, "k bigint, a double, b double, y double"), "k", ["a", "b"], "y", 0.3).collect()}
    for key in range(3):
        x = np.array([d[1:3] for d in data if d[0] == key])
        y = np.array([d[3] for d in data if d[0] == key])
        np.testing.assert_allclose(got[key], np.linalg.solve(x.T @ x + 0.3 * np.eye(2), x.T @ y))


def test_wrong_options_raise(ratings_of):
    with pytest.raises(TypeError):
        A.als_fit(ratings_of(brute.TINY), npslits=4)
    with pytest.raises(ValueError):
        A.als_fit(ratings_of(brute.TINY), strategy="fast")
    with pytest.raises(ValueError):
        A.als_fit(ratings_of(brute.TINY).drop("r"))


def nodes(df, name):
    """Number of nodes in the plan of ``df`` whose names begin with ``name``, outside of its cached relations."""
    def count(node):
        children = node.children()
        return node.nodeName().startswith(name) + sum(
            count(children.apply(k)) for k in range(children.size()))
    plan = df._jdf.queryExecution().executedPlan()
    return count(plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan)


def exchanges(df):
    return nodes(df, "Exchange")


@pytest.fixture()
def shuffled_joins(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("partitions", [2, 4, 9])
def test_ratings_are_not_moved_by_a_half_step(ratings_of, shuffled_joins, partitions):
    data = A.prepare(ratings_of(brute.TINY), 2, partitions=partitions)
    factors = cut(A.initial_factors(data.profiles["u"].ids, 2, "u"))
    # The vectors go to the blocks that send them, the messages to those that need them.
    assert exchanges(A.BlockedPlan(data, 2, 0.1).update("i", factors)) == 2
    # The vectors go to the ratings, the partial sums to their entity.
    assert exchanges(A.JoinPlan(data, 2, 0.1).update("i", factors)) == 2
    # The factors are broadcast, the ratings are read where they are.
    assert exchanges(A.BroadcastPlan(data, 2, 0.1).update("i", factors)) == 0
    data.unpersist()


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_both_link_tables_of_a_side_take_one_exchange_of_the_ratings(ratings_of, hot_rows):
    data = A.prepare(ratings_of(skewed_rows()), 3, partitions=3, blocks=5, hot_rows=hot_rows)
    assert exchanges(data.obs) == 0
    hot, few = data.hot()
    assert (hot["u"] is None) == (hot_rows is None)
    plan = A.BlockedPlan(data, 3, 0.1)
    for dst, src in (("u", "i"), ("i", "u")):
        made = B.rating_table(data.obs, dst, src, data.blocks, data.partitions, hot, few)
        assert nodes(made, "Exchange") == 1
        rows, links = plan.tables(dst)
        assert exchanges(B.send_table(rows)) == 0
        assert {r["blk"] for r in rows.select("blk").distinct().collect()} <= set(range(5))


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_a_pair_of_blocks_exchanges_one_message(ratings_of, hot_rows):
    rows = skewed_rows()
    data = A.prepare(ratings_of(rows), 3, partitions=3, blocks=5, hot_rows=hot_rows)
    plan = A.BlockedPlan(data, 3, 0.1)
    sent = plan.messages("i", A.initial_factors(data.profiles["u"].ids, 3, "u")).collect()
    among = [(r["to"], r["sender"]) for r in sent if r["sender"] != B.LONE]
    assert len(among) == len(set(among)) <= 5 * 5
    alone = [(r["to"], r["id"]) for r in sent if r["sender"] == B.LONE]
    assert len(alone) == len(set(alone)) and (len(alone) > 0) == (hot_rows is not None)
    # every vector that a rating needs, once for each block that needs it
    table = plan.tables("i")[0].groupBy("blk").agg(F.max("pick").alias("last")).collect()
    counts = {}
    for r in sent:
        counts[r["to"]] = counts.get(r["to"], 0) + len(r["x"]) // 24
    assert {r["blk"]: r["last"] + 1 for r in table} == counts


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_ratings_of_one_chunk_at_a_time(ratings_of, strategy, monkeypatch):
    monkeypatch.setattr(R, "MERGE_ROWS", 7)
    monkeypatch.setattr(A, "CHUNK_ROWS", 11)
    monkeypatch.setattr(B, "SCORE_ROWS", 13)
    monkeypatch.setattr(N, "_FOLD_ROWS", 9)
    check(ratings_of, skewed_rows(), 12, 0.5, 1, strategy)


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("rank", [2, 12])
def test_singular_systems_have_the_least_norm(ratings_of, strategy, rank):
    """Without lam an entity of fewer ratings than the rank has many solutions; the shortest is taken."""
    rows = brute.TINY + [(9, 9, 2.0)]
    fit = A.als_fit(ratings_of(rows), rank, 0.0, 1, strategy)
    u, i = brute.collected(fit.u_factors), brute.collected(fit.i_factors)
    start = brute.start({r[0] for r in rows}, rank)
    for found, mine, theirs, side in ((i, 1, start, 0), (u, 0, i, 1)):
        for e, w in found.items():
            x = np.array([theirs[r[side]] for r in rows if r[mine] == e])
            y = np.array([r[2] for r in rows if r[mine] == e])
            np.testing.assert_allclose(x @ w, x @ (np.linalg.pinv(x, rcond=1e-7) @ y), rtol=1e-5, atol=1e-6)
            assert np.linalg.norm(w) <= np.linalg.norm(np.linalg.pinv(x, rcond=1e-7) @ y) * (1 + 1e-5)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_the_trace_reads_no_ratings(ratings_of, strategy, monkeypatch):
    monkeypatch.setattr(S, "MIN_HOT_ROWS", 1)
    rows = skewed_rows()
    fit = A.als_fit(ratings_of(rows), 2, 0.5, 1, strategy, trace=True)
    u0 = brute.start({r[0] for r in rows}, 2)
    i1 = brute.half_step(rows, u0, 2, 0.5, 1)
    u1 = brute.half_step(rows, i1, 2, 0.5, 0)
    got = [r["sse"] for r in fit.trace.orderBy("half").collect()]
    assert got == pytest.approx([brute.sse(rows, u0, i1), brute.sse(rows, u1, i1)], rel=1e-9)
    done = fit.plan.step("i", fit.u_factors)
    error = fit.plan.error(done)
    assert nodes(error, "Exchange") <= 1 and not any(kind in error._jdf.queryExecution().toString() for kind in ("Join", "MapIn", "FlatMap"))


def test_sums_are_combined_before_the_shuffle_where_that_saves_rows(ratings_of):
    dense = [(u, i, float((u * i) % 5)) for u in range(40) for i in range(30)]
    sparse = [(u, u // 2, 1.0 + u % 3) for u in range(60)]
    for rows, ran, folds in ((dense, "join", True), (sparse, "gather", False)):
        fit = check(ratings_of, rows, 12, 1.0, 1, "join", partitions=1)
        assert fit.strategy == ran
        assert (nodes(fit.plan.update("i", fit.u_factors), "MapInArrow") == 1) and N.combining(12, fit.profiles["i"], 1) == ("fold" if folds else "gather")
        assert ("collect_list" in fit.plan.update("i", fit.u_factors)._jdf.queryExecution().toString()) == (not folds)


def test_prepared_ratings_serve_several_fits(spark, ratings_of):
    rows, reads = skewed_rows(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch
    watched = ratings_of(rows).mapInArrow(counted, "u bigint, i bigint, r double")
    made = sweep(watched, ranks=(1, 2, 3, 12), strategies=("blocked", "broadcast"), lam=0.5, iters=1, blocks=(None, 3), test=ratings_of(rows[:50])).collect()
    assert reads.value == 2 * len(rows)  # once for each number of blocks
    assert len(made) == 16 and {r["blocks"] for r in made} >= {3}
    for r in made:
        u, i = brute.als(rows, r["rank"], 0.5, 1)
        assert r["sse"] == pytest.approx(brute.sse(rows, u, i), rel=1e-7)
        assert r["test_nnz"] == 50 and r["test_rmse"] == pytest.approx((brute.sse(rows[:50], u, i) / 50) ** 0.5, rel=1e-7)
    data = A.prepare(ratings_of(rows), 3)
    fits = [A.als_fit(data, rank, 0.5, 1, s) for rank in (2, 3) for s in STRATEGIES]
    fits[0].unpersist()
    assert data.layouts and len({round(f.sse().first()["sse"], 6) for f in fits}) == 2
    with pytest.raises(ValueError, match="up to 3"):
        A.als_fit(data, 4)
    with pytest.raises(ValueError, match="prepare"):
        A.als_fit(data, 2, blocks=4)


def test_partitions_follow_the_data(spark):
    assert A.fitting_partitions(spark, 0) == 1
    assert A.fitting_partitions(spark, 10 ** 6) == 4
    assert A.fitting_partitions(spark, 10 ** 9) == 125


def test_large_data_raise_the_number_of_blocks_and_partitions(ratings_of, monkeypatch):
    rows = skewed_rows()
    monkeypatch.setattr(A, "rows_per_block", lambda rank: 40)
    data = A.prepare(ratings_of(rows), 2, partitions=2, blocks=3)
    least = -(-data.rows // 40)
    assert data.partitions == least > 3 and data.blocks == 4 * least
    data.unpersist()
    made = sweep(ratings_of(rows), ranks=(2,), strategies=("blocked",), partitions=(2,), blocks=(3,), lam=0.5, iters=1).first()
    assert (made["partitions"], made["blocks"], made["ran_partitions"], made["ran_blocks"]) == (2, 3, least, 4 * least)
    u, i = brute.als(rows, 2, 0.5, 1)
    assert made["sse"] == pytest.approx(brute.sse(rows, u, i), rel=1e-7)


def wide_rows():
    """Few u, many i, one of which many u's copies make hot."""
    return [(u, i, float((u * i) % 5 + 1)) for u in range(4) for i in range(500) if (u + i) % 3] + [(u, 7, 2.0 + u) for u in range(4)]


@pytest.mark.parametrize("rank", [2, 12])
@pytest.mark.parametrize("hot_rows", [None, 3])
def test_few_vectors_come_to_ratings_that_stay_for_both_sides(ratings_of, shuffled_joins, rank, hot_rows):
    fit = check(ratings_of, wide_rows(), rank, 0.5, 2, "join", partitions=4, hot_rows=hot_rows)
    assert fit.strategy.split(":")[-1] in ("join", "gather") and list(fit.prepared.layouts) == ["by i"]
    made = fit.plan.update("i", fit.u_factors)
    assert exchanges(made) == 0 if hot_rows is None else exchanges(made) <= 4
    if hot_rows is None:
        assert exchanges(fit.sse()) == 1  # that of the one row


def test_training_errors_do_not_move_ratings_whose_vectors_fit(ratings_of, shuffled_joins):
    for strategy in ("join", "gather", "broadcast"):
        fit = A.als_fit(ratings_of(skewed_rows()), 2, 0.5, 1, strategy)
        assert exchanges(fit.sse()) == 1
        assert exchanges(M.sse(fit.u_factors, fit.i_factors, ratings_of(skewed_rows()), 2, near=("u", "i"))) == 1


def test_sums_that_a_task_could_not_hold_are_gathered(ratings_of, monkeypatch):
    monkeypatch.setattr(N, "TASK_SUM_BYTES", 100)
    monkeypatch.setattr("factorlab.session.TASK_ROWS", 100)
    fit = check(ratings_of, skewed_rows(), 3, 0.5, 2, "join", broadcast_bytes=10)
    assert fit.strategy == "gather"


@pytest.mark.parametrize("list_rows", [50_000, 40])
def test_moved_rows_of_low_rank_are_summed_by_columns(ratings_of, monkeypatch, list_rows):
    monkeypatch.setattr(N, "TASK_SUM_BYTES", 100)
    monkeypatch.setattr(N, "LIST_ROWS", list_rows)
    monkeypatch.setattr("factorlab.session.TASK_ROWS", 100)
    fit = check(ratings_of, skewed_rows(), 2, 0.5, 2, "join", broadcast_bytes=10)
    made = fit.plan.update("i", fit.u_factors)
    assert fit.strategy == "gather" and nodes(made, "MapInArrow") == 0
    assert nodes(made, "HashAggregate") == (2 if list_rows > 1000 else 4)


def test_sums_that_would_be_no_fewer_than_their_rows_are_not_made_before_the_shuffle(ratings_of):
    sparse = [(u, u // 2, 1.0 + u % 3) for u in range(60)]
    dense = [(u, i, float((u * i) % 5)) for u in range(40) for i in range(30)]
    for rows, form in ((sparse, "gather"), (dense, "columns")):
        fit = check(ratings_of, rows, 3, 1.0, 1, "join", partitions=4, broadcast_bytes=10)
        assert N.combining(3, fit.profiles["u"], 4) == form


def test_copy_counts_are_cached_as_integers(ratings_of):
    data = A.prepare(ratings_of(skewed_rows()), 2)
    rows, _ = A.JoinPlan(data, 2, 0.5).placed("u")
    for kept in data.kept:
        assert dict(kept.dtypes)["n"] == "int"
    assert len(data.kept) == 2 and dict(data.obs.dtypes)["n"] == dict(rows.dtypes)["n"] == "double"
    assert rows.agg(F.sum("n")).first()[0] == len(skewed_rows())
    data.unpersist()
    assert not data.kept


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_block_tables_are_sorted_once_and_know_their_picks(ratings_of, hot_rows):
    data = A.prepare(ratings_of(skewed_rows()), 3, partitions=3, blocks=5, hot_rows=hot_rows)
    hot, few = data.hot()
    made = B.rating_table(data.obs, "u", "i", data.blocks, data.partitions, hot, few)
    assert nodes(made, "Sort") == 1 and nodes(made, "Window") == 0
    plan = A.BlockedPlan(data, 3, 0.1)
    rows, links = plan.kept("u")
    assert nodes(B.send_table(rows), "Sort") == 0
    for block in range(5):
        owned = plan.tables("u")[0].where(F.col("blk") == block).toArrow()
        assert not owned.num_rows or B.picks(owned).tolist() == owned["pick"].to_pylist()


@pytest.mark.parametrize("strategy,rank,hot_rows", [("join", 2, None), ("join", 12, 20), ("broadcast", 12, None)])
def test_sums_are_folded_where_the_vectors_are_if_ratings_would_move(ratings_of, shuffled_joins, monkeypatch, strategy, rank, hot_rows):
    rows = [(u, i, float((u * i) % 5 + i % 3)) for u in range(40) for i in range(30) if (u + i) % 7] + [(0, 0, 3.0)] * 30
    options = {"partitions": 2, "hot_rows": hot_rows, "broadcast_bytes": 10}
    monkeypatch.setattr(N, "TASK_SUM_BYTES", 100)
    monkeypatch.setattr(N, "_FOLD_ROWS", 50)
    monkeypatch.setattr(N, "slice_size", lambda rank: 20)
    assert check(ratings_of, rows, rank, 0.5, 1, strategy, **options).strategy == "gather"
    monkeypatch.setattr(N, "MOVED_BYTES", 0)
    fit = check(ratings_of, rows, rank, 0.5, 2, strategy, **options)
    assert fit.strategy == "join" and list(fit.prepared.layouts) == ["by u for i", "by i for u"]
    join = getattr(fit.plan, "fallback", fit.plan)
    made = join.update("i", fit.u_factors)
    # The vectors go to the ratings, which keep their order, and sums to their entity, where they are sorted.
    assert nodes(made, "ShuffledHashJoin") == 1 and nodes(made, "Sort") == 1
    assert exchanges(made) == 2 and exchanges(join.attached("i", fit.u_factors)) == 1


def test_a_ratings_layout_in_order_serves_all_ranks_of_the_data(ratings_of, monkeypatch):
    rows = [(u, i, float((u * i) % 5 + i % 3)) for u in range(40) for i in range(30) if (u + i) % 7]
    monkeypatch.setattr(N, "_FOLD_ROWS", 50)
    monkeypatch.setattr(N, "MOVED_BYTES", 0)
    data = A.prepare(ratings_of(rows), 12)
    for rank in (2, 12):
        fit = A.als_fit(data, rank, 0.5, 1, "join", broadcast_bytes=10)
        assert fit.sse().first()["sse"] == pytest.approx(brute.sse(rows, *brute.als(rows, rank, 0.5, 1)), rel=1e-7)
    assert fit.strategy == "join" and list(data.layouts) == ["by u for i", "by i for u"]
    data.unpersist()


def test_what_a_tidy_cut_shuffled_is_dropped(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {name.split("_")[1] for name in blocks.split() if name.startswith("shuffle_")}
    before = shuffled()
    kept = cut(spark.range(100).groupBy(F.expr("id % 7 as k")).count())
    left = shuffled() - before
    assert kept.count() == 7 and left
    before = shuffled()
    made = cut(spark.range(100).groupBy(F.expr("id % 7 as k")).count(), tidy=True)
    until = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert sum(r["count"] for r in made.collect()) == 100 and spark.conf.get(DROP_SHUFFLES) == "false"
