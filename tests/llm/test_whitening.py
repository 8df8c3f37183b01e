"""Whitening against dense eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.llm import whitening as W
from factorlab.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def dense(vectors, count=8):
    """x, n, S, and the leading eigenvectors of the covariance built whole."""
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    gaps = x - x.mean(axis=0)
    values, found = np.linalg.eigh(gaps.T @ gaps / len(x))
    return x, x.sum(axis=0), values[::-1][:count], found[:, ::-1][:, :count], gaps


def test_query_equals_dense_version(spark):
    kept = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
            if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    x, sums, values, vectors, gaps = dense([v for _, v in kept])
    n = len(kept)
    rows = {(r["vec_id"], r["component"]): r for r in QUERIES["op11_whitening"](spark, SMALL).collect()}
    assert len(rows) == 8 * n
    whitened = gaps @ vectors / np.sqrt(values)
    got = np.array([[rows[i, k + 1]["whitened"] for k in range(8)] for i, _ in kept])
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - sign * whitened).max() < 1e-9
    for at, (i, _) in enumerate(kept):
        r = rows[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at], sums))
    trace = (gaps * gaps).sum() / n
    assert np.allclose([rows[kept[0][0], k + 1]["explained"] for k in range(8)], values / trace, rtol=1e-12)
    assert len({r["identity_error"] for r in rows.values()}) == 1 and 0 <= rows[kept[0][0], 1]["identity_error"] < 1e-10


@pytest.mark.parametrize("size", [1, 2, 7, 9, 30, 120])
def test_eigenpairs_of_any_size(size):
    chance = np.random.default_rng(size)
    b = chance.standard_normal((size, 2 * size))
    a = b @ b.T
    values, vectors = W.eigenpairs(lambda t: a @ t, size, 8)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    assert len(values) == min(8, size) and np.allclose(values, want, rtol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


@pytest.mark.parametrize("spectrum", [np.ones(30), np.r_[np.ones(5), np.linspace(.5, .9, 40)], 10.0 ** -np.arange(40.0),
                                      np.r_[1.0, np.zeros(29)], np.r_[np.linspace(1, .9, 12), np.linspace(.89, .1, 38)], np.zeros(12)])
def test_eigenpairs_of_ties_and_zeros(spectrum):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(spectrum),) * 2))[0]
    a = (q * spectrum) @ q.T
    values, vectors = W.eigenpairs(lambda t: a @ t, len(a), 8)
    assert np.abs(values - np.sort(spectrum)[::-1][:8]).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12


def test_minres_solves_the_projected_equations():
    chance = np.random.default_rng(4)
    b = chance.standard_normal((25, 40))
    a = b @ b.T
    values, vectors = np.linalg.eigh(a)
    basis, shift = vectors[:, -4:], values[-3:] * 1.001
    rhs = chance.standard_normal((25, 3))
    rhs -= basis @ (basis.T @ rhs)
    got = W.minres(lambda t: a @ t, shift, basis, rhs, 1e-13, 60)
    left = a @ got - got * shift
    assert np.abs(left - basis @ (basis.T @ left) - rhs).max() < 1e-9 and np.abs(basis.T @ got).max() < 1e-12


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x string, whitened string, n int, kept string")


def test_vectors_left_out_ties_and_clashing_columns(spark):
    chance = np.random.default_rng(1)
    good = [(i, [float(c) for c in chance.standard_normal(5)], "x", "w", 1, "k") for i in range(40)]
    bad = [(100, None, None, None, None, None), (101, [], "", "", 0, ""), (102, [1.0, None, 1.0, 1.0, 1.0], "", "", 0, ""),
           (103, [float("nan")] * 5, "", "", 0, ""), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0], "", "", 0, ""), (105, [1.0, 2.0], "", "", 0, "")]
    again = [good[3], good[3], (None, [9.0] * 5, None, None, None, None)]
    rows, model = W.whiten(frame(spark, good + bad + again))
    out = rows.collect()
    x, sums, values, vectors, gaps = dense([r[1] for r in good + again])
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in good + again)
    assert model.n == 43 and (model.sums == sums).all() and len(model.values) == 5 and np.allclose(model.values, values)
    assert rows.columns == ["vec_id", "embedding", "n", "kept", "x", "whitened", "deviation"]
    assert len({tuple(r["whitened"]) for r in out if r["vec_id"] == 3}) == 1


def test_no_variance_no_components(spark):
    for rows in ([], [(1, [1.0, 2.0], None, None, None, None)], [(i, [0.5, -0.5, 2.0], None, None, None, None) for i in range(9)]):
        out, model = W.whiten(frame(spark, rows))
        assert model.n == len(rows) and len(model.values) == 0
        assert [(r["whitened"], int(r["deviation"])) for r in out.collect()] == [([], 0)] * len(rows)


def test_deviations_beyond_64_bits_and_entries_beyond_the_lattice(spark):
    rows = [(i, [float(i % 3) * 2.0 ** 30, 1.0], None, None, None, None) for i in range(9)]
    out, model = W.whiten(frame(spark, rows))
    x, sums, *_ = dense([r[1] for r in rows])
    want = {i: sum((9 * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums)) for i in range(9)}
    assert {r["vec_id"]: int(r["deviation"]) for r in out.collect()} == want and max(want.values()) > 1 << 63
    with pytest.raises(Exception, match="lattice"):
        W.fit(frame(spark, [(1, [1e300], None, None, None, None)]))


def test_repeated_groups_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 64)
    base = spark.range(500).select((F.when(F.col("id") < 300, 7).otherwise(F.col("id"))).alias("vec_id"))
    made = base.select("vec_id", F.array(*[F.sin(F.col("vec_id") * (j + 1)) for j in range(10)]).alias("embedding"))
    model = W.fit(made)
    *_, values, vectors, _ = dense([r["embedding"] for r in made.collect()])
    assert np.allclose(model.values, values, rtol=1e-11) and model.identity_error < 1e-9
    assert np.abs(np.abs(np.sum(model.vectors * vectors, axis=0)) - 1).max() < 1e-11
