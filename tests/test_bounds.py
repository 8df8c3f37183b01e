"""Nulls, labels, seeds, sampling of thin matrices, and what a task may hold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorlab import session
from factorlab.functions.solve import slice_size
from factorlab.operators import blocks as B
from factorlab.operators import metrics as M
from factorlab.operators import normal_eq as N
from factorlab.operators import skew as S
from factorlab.operators.ratings import compress
from factorlab.operators.sampling import _shifted_number, grid_side, permuted_cells, sample_cells
from factorlab.plans import als as A
from factorlab.plans import dfc as D
from factorlab.plans import jobs
from factorlab.plans.cost import estimate
from factorlab.sources import text as T
from workload import queries as W

TINY = [(0, 0, 5.0), (0, 1, 3.0), (1, 0, 4.0), (1, 1, 1.0), (2, 0, 1.0), (2, 1, 5.0)]


@pytest.mark.parametrize("where", ["u", "i", "r"])
def test_null_ratings_fail_wherever_they_are_scored(spark, ratings_of, where):
    fit = A.als_fit(ratings_of(TINY), 2, 0.1, 2, "join")
    bad = ratings_of(TINY).selectExpr(*[f"nullif({c}, 1) as {c}" if c == where else c for c in "uir"])
    for run in (lambda: fit.sse(bad).collect(), lambda: M.sse(fit.u_factors, fit.i_factors, bad, 2).collect(),
                lambda: N.normal_equations(bad, fit.u_factors, "i", 2).collect(),
                lambda: D.dfc_fit(ratings_of(TINY), 1, 2, 2, 0.1, 1).rmse(bad, bad).collect()):
        with pytest.raises(Exception, match="rating with null"):
            run()
    assert fit.sse(ratings_of(TINY)).first()["nnz"] == 6


def test_spread_of_large_close_copies(ratings_of):
    row = compress(ratings_of([(0, 0, 1e9), (0, 0, 1e9 + 1), (0, 1, 3.0)])).orderBy("i").collect()
    assert row[0]["ss"] == pytest.approx(0.5) and row[0]["r"] == 1e9 + 0.5 and (row[1]["ss"], row[1]["r"]) == (0, 3)


def test_incomplete_rows_do_not_count_whatever_the_width(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 13)), rng.normal(size=60)
    x[::12, 1], y[7] = np.nan, np.nan
    rows = [(0 if i < 58 else 1, *[None if np.isnan(v) and i % 24 else float(v) for v in x[i]], float(y[i])) for i in range(60)]
    rows += [(2, *[None] * 13, 1.0)]
    frame = spark.createDataFrame(rows, "k int, " + ", ".join(f"x{j} double" for j in range(13)) + ", y double")
    for width in (3, 10, 11, 13):
        got = {r["k"]: r["w"] for r in A.grouped_ridge(frame, "k", [f"x{j}" for j in range(width)], "y", 0.1).collect()}
        keep = ~np.isnan(x[:58, :width]).any(axis=1) & ~np.isnan(y[:58])
        a, b = x[:58, :width][keep], y[:58][keep]
        assert set(got) == {0, 1}
        assert got[0] == pytest.approx(np.linalg.solve(a.T @ a + 0.1 * np.eye(width), a.T @ b))


def test_the_label_says_what_ran(ratings_of):
    ratings = ratings_of(TINY)
    fits = {limit: A.als_fit(ratings, 2, 0.1, 1, "broadcast", broadcast_bytes=limit) for limit in (1 << 20, 10, 150)}
    assert {limit: fit.strategy for limit, fit in fits.items()} == {1 << 20: "broadcast", 10: "join", 150: "u:broadcast i:join"}
    marks = [sorted((r["id"], *np.round(r["x"], 9)) for r in f.u_factors.collect()) for f in fits.values()]
    assert marks[0] == marks[1] == marks[2]
    auto = A.als_fit(ratings, 3, 0.1, 1)
    assert auto.strategy == A.choose_strategy(auto.prepared, 3) == "broadcast"
    assert A.als_fit(ratings, 3, 0.1, 1, broadcast_bytes=10).strategy == "join"


@pytest.mark.parametrize("rows,u,i,rank,cores,limit,want", [
    (52_000, 100, 2_000, 2, 2, 1 << 28, "broadcast"), (52_000, 100, 2_000, 20, 2, 1 << 28, "broadcast"),
    (597_000, 1_000, 20_000, 2, 2, 1 << 28, "join"), (597_000, 1_000, 20_000, 10, 2, 1 << 28, "broadcast"),
    (10 ** 9, 10 ** 7, 10 ** 5, 40, 500, 1 << 28, "blocked"), (10 ** 8, 2 * 10 ** 6, 10 ** 5, 10, 1000, 1 << 28, "blocked"),
    (10 ** 9, 5 * 10 ** 5, 2 * 10 ** 4, 10, 200, 1 << 28, "broadcast")])
def test_the_cheapest_strategy_is_chosen(rows, u, i, rank, cores, limit, want):
    seconds = estimate(rows, u, i, rank, max(4 * cores, rows // A.rows_per_block(rank)), cores, limit)
    assert min(seconds, key=seconds.get) == want
    assert ("broadcast" in seconds) == (max(u, i) * (8 * rank + 48) <= limit)


def test_seeds_give_other_starts(ratings_of):
    starts = [tuple(A.als_fit(ratings_of(TINY), 2, 0.1, 0, seed=s).u_factors.orderBy("id").first()["x"]) for s in (0, 0, 1, -1)]
    assert starts[0] == starts[1] and len(set(starts)) == 3


@pytest.mark.parametrize("m,n", [(1, 1000), (2, 500), (1000, 1), (1, 997), (3, 7), (1, 1), (1, 2)])
def test_thin_matrices_are_shuffled(spark, m, n):
    cells = m * n
    rows = permuted_cells(spark.range(cells).withColumnRenamed("id", "pos"), m, n, 3).collect()
    assert {(r["u"], r["i"]) for r in rows} == {(u, i) for u in range(m) for i in range(n)}
    if cells >= 900:
        part = sorted(r["i"] * m + r["u"] for r in sample_cells(spark, m, n, 100, seed=5).collect())
        runs = 1 + sum(b - a > 1 for a, b in zip(part, part[1:]))
        assert runs > 75 and part[0] < 60 and part[-1] > cells - 60


def test_grids_are_near_square_with_little_excess():
    for cells in [1, 2, 3, 10, 997, 10 ** 6, 10 ** 6 + 3, 20_000_000, 17770 * 480189, 10 ** 12 + 39]:
        a, excess = grid_side(cells)
        assert (cells + excess) % a == 0 and a <= (cells + excess) // a + 1
        assert excess <= 200 and a > cells ** 0.5 / 2 - 1


@pytest.mark.parametrize("m,n,excess", [(1, 997, 2), (1, 2017, 4), (1, 4201, 8)])
def test_numbers_in_excess_add_no_rounds_to_the_plan(spark, m, n, excess):
    """Number by number, who leaves the cells walks on; the plan hashes as often as for a grid without excess."""
    a, more = grid_side(m * n)
    assert more == excess
    b = (m * n + excess) // a

    def walked(pos):
        x = _shifted_number(pos, a, b, 3)
        while x >= m * n:
            x = _shifted_number(x, a, b, 3)
        return x
    placed = permuted_cells(spark.range(m * n).withColumnRenamed("id", "pos"), m, n, 3)
    assert {r["pos"]: r["i"] * m + r["u"] for r in placed.collect()} == {pos: walked(pos) for pos in range(m * n)}
    even = permuted_cells(spark.range(2500).withColumnRenamed("id", "pos"), 50, 50, 3)
    hashes = [df._jdf.queryExecution().analyzed().toString().count("md5(") for df in (placed, even)]
    assert hashes[0] == hashes[1] == 8


def test_no_key_above_a_quarter_of_a_block_stays_whole():
    for rows in (10 ** 6, 10 ** 10, 10 ** 12):
        for partitions in (1, 8, 200, 10_000):
            for rank in (3, 10, 100):
                limit = max(1, min(8 * partitions, S.BROADCAST_BYTES // (16 + 8 * rank)))
                most = A.rows_per_block(rank) // 4
                assert S.hot_threshold(rows, limit, most) <= most


def test_blocks_shrink_with_the_rank():
    for rank in (1, 10, 100, 500):
        assert A.rows_per_block(rank) * (24 + 16 * rank) <= A.BLOCK_BYTES or A.rows_per_block(rank) == 1000


def test_a_block_of_many_small_entities_is_solved_in_slices(monkeypatch):
    rank, entities = 100, 4000
    rng = np.random.default_rng(2)
    x = rng.normal(size=(entities, rank))
    sent = pa.table({"sender": [0], "id": [0], "x": pa.array([x.tobytes()], pa.binary())})
    owned = pa.table({"dst": np.arange(entities), "pick": np.arange(entities), "n": np.ones(entities),
                      "r": rng.normal(size=entities), "split": np.zeros(entities, bool)})
    sizes, grams = [], B.segment_grams

    def watched(*args):
        sizes.append(len(args[4]))
        return grams(*args)
    monkeypatch.setattr(B, "segment_grams", watched)
    out = B.update_block(rank, 0.1)((), sent, owned)
    assert max(sizes) <= slice_size(rank) < entities and sum(sizes) == entities == out.num_rows
    i = 17
    want = np.linalg.solve(np.outer(x[i], x[i]) + 0.1 * np.eye(rank), x[i] * owned["r"][i].as_py())
    assert out["x"][out["id"].to_pylist().index(i)].as_py() == pytest.approx(want)


@pytest.mark.parametrize("rank", [3, 12])
def test_long_lists_are_split_and_ordinary_keys_are_not(spark, ratings_of, monkeypatch, rank):
    rng = np.random.default_rng(3)
    rows = [(u, 0, float(rng.integers(1, 9))) for u in range(90)] + [(u, 1 + u % 5, 2.0) for u in range(90)]
    ratings = ratings_of(rows)
    start = A.initial_factors(spark.range(90).toDF("id"), rank, "u")
    whole = {r["id"]: (r["xtx"], r["xty"]) for r in N.normal_equations(ratings, start, "i", rank, "gather").collect()}
    monkeypatch.setattr(N, "LIST_ROWS", 20)
    split = N.normal_equations(ratings, start, "i", rank, "gather")
    for r in split.collect():
        assert r["xtx"] == pytest.approx(whole[r["id"]][0]) and r["xty"] == pytest.approx(whole[r["id"]][1])
    many, few = N.long_keys(S.profile(compress(ratings), "i"))
    assert few and {r["id"]: r["pieces"] for r in many.collect()} == {0: 5}


def test_gathered_lists_are_folded_in_chunks(spark, tmp_path, monkeypatch):
    """No task holds all its lists: 40 lists of 50 rows in one partition are folded about 120 rows at a time."""
    rng = np.random.default_rng(4)
    cells = [(u, i, float(rng.integers(1, 9)), rng.normal(size=2).tolist()) for u in range(40) for i in range(50)]
    rows = spark.createDataFrame(cells, "u bigint, i bigint, r double, x array<double>").selectExpr("u", "1D as n", "r", "x")
    grams, seen = N.segment_grams, str(tmp_path)

    def watched(x, *args):
        open(f"{seen}/{len(x)}", "w").close()
        return grams(x, *args)
    monkeypatch.setattr(N, "segment_grams", watched)
    monkeypatch.setattr(N, "_FOLD_ROWS", 120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 60)
    try:
        got = {r["u"]: (r["xtx"], r["xty"]) for r in N._gathered(rows, ["u"], 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40 and max(int(p.name) for p in tmp_path.iterdir()) <= 180
    for u in range(40):
        x = np.array([c[3] for c in cells if c[0] == u])
        r = np.array([c[2] for c in cells if c[0] == u])
        assert got[u][0] == pytest.approx((x.T @ x)[np.triu_indices(2)]) and got[u][1] == pytest.approx(x.T @ r)


def test_scoring_reads_its_input_once(spark, ratings_of):
    fit = A.als_fit(ratings_of(TINY), 2, 0.1, 1, "join")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch
    watched = ratings_of(TINY).mapInArrow(counted, "u bigint, i bigint, r double")
    assert fit.sse(watched).first()["nnz"] == 6 and reads.value == 6
    parts = D.dfc_fit(ratings_of(TINY), 1, 2, 2, 0.1, 1)
    before = reads.value
    assert parts.rmse(watched, ratings_of(TINY)).count() == 3 and reads.value == before + 6


@pytest.mark.parametrize("rank", [10, 12, 40])
def test_turned_columns_do_not_depend_on_how_the_product_is_written(spark, rank):
    rng = np.random.default_rng(rank)
    t, x = rng.normal(size=(rank, rank)), rng.normal(size=rank)
    frame = spark.createDataFrame([(t.ravel().tolist(), x.tolist()), (None, x.tolist())], "t array<double>, x array<double>")
    got = [r["y"] for r in frame.select(F.expr(D._product(rank)).alias("y")).collect()]
    assert got[0] == pytest.approx(t @ x) and got[1] == [0.0] * rank


def test_jobs_through_files(spark, tmp_path):
    train, test = jobs.generate_job(spark, str(tmp_path / "made"), 12, 9, 2, 2.0, 0.5, seed=1)
    lines = T.read_ratings(spark, train)
    assert lines.agg(F.min("u"), F.max("i")).first()[0] >= 0 and lines.count() == 2 * 2 * (12 + 9 - 2)
    where = jobs.replicate_job(spark, test, 3, 12, 9)
    assert where == test + "_replicated" and T.read_ratings(spark, where, 0).count() == 9 * T.read_ratings(spark, test).count()
    row = jobs.pipeline_job(spark, str(tmp_path / "run"), 12, 9, 2, 2.0, 0.5, 2, rank=2, lam=0.01, iters=3).first()
    assert row["train_nnz"] == 4 * lines.count() and row["train_rmse"] < 0.5 and row["seconds"] > 0


def test_start_vectors_are_computed_for_ids_not_for_ratings(spark):
    plan = W.q_outer_packed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "size(" not in plan.split("Aggregate", 1)[1]


def test_sums_by_pair_are_spread_by_the_number_of_ratings(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    made = W.q_rating_factor_join(spark, "/root/testdata/sf0.001")  # 6,000 ratings
    assert made.rdd.getNumPartitions() == 12 and made.agg(F.sum("n")).first()[0] == 6000
