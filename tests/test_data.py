import math
import uuid

import numpy as np
import pytest

from factorlab.operators import blocks as B
from factorlab.operators import stats
from factorlab.operators.positions import ordered_positions
from factorlab.operators.sampling import sample_cells
from factorlab.operators.tiling import replicate, replicate_2x2
from factorlab.plans.als import als_fit
from factorlab.plans.dfc import dfc_fit
from factorlab.plans.sweep import generate_tile_train, sweep
from factorlab.sources import text as T
from factorlab.sources.synth import sample_sizes, synth_ratings
from tests import brute
from workload import queries as W


def rows_of(df):
    return sorted((r["u"], r["i"], r["r"]) for r in df.collect())


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def write_lines(spark, path, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").write.text(path)


def test_text_formats(spark, path):
    write_lines(spark, path, ["1 2 3.0", "4 1 2.5 extra"])
    assert rows_of(T.read_ratings(spark, path)) == [(0, 1, 3.0), (3, 0, 2.5)]
    assert rows_of(T.read_ratings(spark, path, index_base=0)) == [(1, 2, 3.0), (4, 1, 2.5)]
    assert rows_of(T.read_bounded(spark, path, 1)) == [(3, 0, 2.5)]


@pytest.mark.parametrize("line", ["1 x 3.0", "1 2", "1 2 y"])
def test_bad_tokens_fail(spark, path, line):
    write_lines(spark, path, [line])
    with pytest.raises(Exception, match="bad rating line"):
        T.read_ratings(spark, path).collect()


def test_round_trips(ratings_of, spark, path):
    rows = [(0, 1, 0.1), (2, 0, 1e-9), (5, 7, -3.25)] + [(1, 1, 2.0)] * 3
    T.write_ratings(ratings_of(rows), path + "a", index_base=1, column_major=True)
    assert rows_of(T.read_ratings(spark, path + "a")) == sorted(rows)
    T.write_tuples(ratings_of(rows), path + "b")
    assert rows_of(T.read_tuples(spark, path + "b")) == sorted(rows)


def test_metrics_append(spark, path):
    for rank in (1, 2):
        T.write_metrics(spark.createDataFrame([(0.5,)], "rmse double"), path, train="x", rank=rank)
    assert sorted(r["rank"] for r in T.read_metrics(spark, path).collect()) == [1, 2]


def test_tiling(ratings_of):
    rows = [(0, 0, 1.0), (1, 2, 5.0), (1, 2, 5.0)]
    want = sorted((u + a * 2, i + b * 3, r) for u, i, r in rows for a in range(3) for b in range(3))
    assert rows_of(replicate(ratings_of(rows), 3, 2, 3)) == want
    assert len(rows_of(replicate_2x2(ratings_of(rows), 2, 3))) == 12


def test_tiled_factors_scale_the_error(ratings_of, spark):
    fit = als_fit(ratings_of(brute.TINY), 2, 0.1, 1)
    one = fit.sse().first()["sse"]
    u, i = brute.collected(fit.u_factors), brute.collected(fit.i_factors)
    rows = [(a + x * 4, b + y * 3, r) for a, b, r in brute.TINY for x in range(2) for y in range(2)]
    tiled_u = {e + x * 4: v for e, v in u.items() for x in range(2)}
    tiled_i = {e + y * 3: v for e, v in i.items() for y in range(2)}
    assert brute.sse(rows, tiled_u, tiled_i) == pytest.approx(4 * one)


def test_positions_of_one_large_group(spark):
    rows = spark.range(500).selectExpr("'g' as g", "id * 7 % 500 as v").unionAll(
        spark.range(3).selectExpr("'h' as g", "id * 10 as v"))
    got = {(r["g"], r["v"]): r["pos"] for r in ordered_positions(rows, ["g"], ["v"]).collect()}
    assert got == {**{("g", v): v for v in range(500)}, ("h", 0): 0, ("h", 10): 1, ("h", 20): 2}


def test_block_tables(ratings_of):
    rows = brute.TINY + [(0, 0, 9)]
    links = {(r["src"], r["dst_blk"]) for r in B.out_links(ratings_of(rows), "u", "i", 2).collect()}
    assert links == {(u, i % 2) for u, i, _ in rows}
    owned = B.in_links(ratings_of(rows), "u", "i", 2).collect()
    assert sorted((r["dst_blk"], r["src"], r["dst"], r["r"]) for r in owned) == sorted(
        (i % 2, u, i, float(r)) for u, i, r in rows)


def test_pack_and_unblock(spark):
    factors = spark.range(100).selectExpr("id", "array(id * 1D, 2D) as x")
    packed = B.pack_blocks(factors, 3, chunk_rows=10)
    assert max(len(r["ids"]) for r in packed.collect()) <= 10
    assert sorted(tuple(r["x"]) for r in B.unblock(packed).collect()) == [(float(e), 2.0) for e in range(100)]


def test_columns_are_chunked(ratings_of):
    rows = [(u, 0, float(u % 3)) for u in range(50)] + [(1, 1, 4.0)] * 5
    got = stats.columns(ratings_of(rows), chunk_rows=8).collect()
    assert max(len(r["entries"]) for r in got) <= 8
    flat = sorted((e["u"], r["i"], e["r"]) for r in got for e in r["entries"] for _ in range(e["n"]))
    assert flat == sorted(rows)
    assert rows_of(stats.column_slice(ratings_of(rows), 1).selectExpr("u", "1L as i", "r")) == [(1, 1, 4.0)] * 5


def test_matrix_stats(ratings_of):
    row = stats.matrix_stats(ratings_of(brute.TINY + [(9, 0, 1)])).first()
    assert tuple(row) == (9, 5, 3, 9, 2)


@pytest.mark.parametrize("m,n", [(1, 1), (7, 5), (16, 16), (3, 100)])
def test_cells_are_a_permutation(spark, m, n):
    cells = sample_cells(spark, m, n, m * n - m * n // 3, m * n // 3, seed=4).collect()
    assert sorted((r["u"], r["i"]) for r in cells) == [(u, i) for u in range(m) for i in range(n)]
    assert sum(r["is_test"] for r in cells) == m * n // 3
    assert all(r["idx"] == r["i"] * m + r["u"] for r in cells)


def test_cells_are_spread_evenly(spark):
    cells = sample_cells(spark, 200, 300, 6000, seed=1).collect()
    assert len({(r["u"], r["i"]) for r in cells}) == 6000
    per_row = np.bincount([r["u"] for r in cells], minlength=200)
    per_col = np.bincount([r["i"] for r in cells], minlength=300)
    # 30 and 20 expected, binomial spread.
    assert 10 <= per_row.min() and per_row.max() <= 60
    assert 4 <= per_col.min() and per_col.max() <= 45


def test_sizes():
    assert sample_sizes(500, 500, 10, 20.0) == (9900, 198000, 19800)
    assert sample_sizes(10, 10, 5, 3.0, 0.5) == (75, 99, 1)


def test_noiseless_low_rank_data_is_recovered(spark):
    train, test = synth_ratings(spark, 60, 40, rank=2, train_factor=6.0, test_factor=0.2)
    fit = als_fit(train, 2, 1e-6, 15)
    assert fit.rmse().first()["rmse"] < 1e-3
    assert fit.rmse(test).first()["rmse"] < 1e-2


def test_noise_is_applied_to_training_cells_only(spark):
    plain, plain_test = synth_ratings(spark, 50, 50, 2, 4.0)
    noisy, noisy_test = synth_ratings(spark, 50, 50, 2, 4.0, noise=0.1)
    gaps = [b[2] - a[2] for a, b in zip(rows_of(plain), rows_of(noisy))]
    assert 0.08 < np.std(gaps) < 0.12 and abs(np.mean(gaps)) < 0.02
    assert rows_of(plain_test) == rows_of(noisy_test)


def brute_dfc(rows, parts, columns, rank, lam, iters):
    size = columns // parts
    fits = []
    for p in range(parts):
        mine = [r for r in rows if min(r[1] // size, parts - 1) == p]
        fits.append(brute.als(mine, rank, lam, iters, "u"))
    m = max(r[0] for r in rows) + 1

    def dense(vectors, ids):
        return np.array([vectors.get(e, np.zeros(rank)) for e in ids])

    w = [dense(f[0], range(m)) for f in fits]
    cols = {}
    h0 = dense(fits[0][1], range(size))
    for p, (_, h) in enumerate(fits):
        t = np.eye(rank) if p == 0 else (h0.T @ np.linalg.pinv(h0, 1e-9).T) @ (np.linalg.pinv(w[0], 1e-9) @ w[p])
        cols.update({i: t @ v for i, v in h.items()})
    return fits, {u: w[0][u] for u in range(m)}, cols


@pytest.mark.parametrize("rank", [2, 11])
def test_divide_factor_combine(ratings_of, rank):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(i), float(r)) for u, i, r in
            zip(rng.integers(0, 30, 700), rng.integers(0, 22, 700), rng.normal(3, 1, 700))]
    fit = dfc_fit(ratings_of(rows), 3, 22, rank, 0.1, 2)
    fits, row_factors, col_factors = brute_dfc(rows, 3, 22, rank, 0.1, 2)
    for p in range(3):
        brute.assert_same(brute.collected(fit.w.filter(f"part = {p}"), "u"), fits[p][0], 1e-7)
        brute.assert_same(brute.collected(fit.h.filter(f"part = {p}"), "i"), fits[p][1], 1e-7)
    brute.assert_same(brute.collected(fit.cols, "i"), col_factors, 1e-6)
    test = [(0, 1, 2.0), (99, 3, 4.0), (2, 21, 1.0)]
    got = {r["metric"]: (r["nnz"], r["rmse"]) for r in fit.rmse(ratings_of(rows), ratings_of(test)).collect()}

    def score(cells):
        zero = np.zeros(rank)
        gaps = [row_factors.get(u, zero) @ col_factors.get(i, zero) - r for u, i, r in cells]
        return math.sqrt(np.mean(np.square(gaps)))

    assert got["train_projected"] == (700, pytest.approx(score(rows), rel=1e-6))
    assert got["test_projected"] == (3, pytest.approx(score(test), rel=1e-6))


def test_sweep_and_generated_run(spark, ratings_of):
    rows = sweep(ratings_of(brute.TINY), (1, 2), ("join", "blocked"), (1, 2), lam=0.1, iters=1).collect()
    assert len(rows) == 8
    for repfact in (1, 2):
        for rank in (1, 2):
            a, b = [r for r in rows if r["repfact"] == repfact and r["rank"] == rank]
            assert a["nnz"] == 8 * repfact ** 2 and a["loss"] == pytest.approx(b["loss"])
    fit, train, test = generate_tile_train(spark, 20, 20, 2, 4.0, repfact=2, rank=2, lam=0.01, iters=2)
    assert train.count() == 4 * sample_sizes(20, 20, 2, 4.0)[1]
    assert fit.rmse(test).first()["nnz"] == test.count()


def test_the_scale_sweep_runs_ten_iterations_of_rank_ten(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(u, i, int(rng.integers(1, 90))) for u in range(1, 25) for i in range(1, 21) if (u + i) % 4]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(24).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(20).write.parquet(str(tmp_path / "part.parquet"))
    got = {r["repfact"]: r for r in W.q_scale_sweep(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2]
    for f in got:
        tiled = [(u + 24 * a, i + 20 * b, r) for u, i, r in rows for a in range(f) for b in range(f)]
        want = brute.sse(tiled, *brute.als(tiled, 10, 0.01, 10))
        assert (got[f]["rank"], got[f]["nnz"]) == (10, len(tiled)) and got[f]["sse"] == pytest.approx(want, rel=1e-4)
        assert want < 0.9 * brute.sse(tiled, *brute.als(tiled, 10, 0.01, 2))
