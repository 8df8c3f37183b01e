import numpy as np
import pytest

from factorlab.functions.seeding import initial_vector
from factorlab.functions.solve import lists_of, matrix_of, segment_grams
from factorlab.functions.vectors import dot, outer_packed, pack_symmetric, scale, sqnorm, unpack_symmetric
from tests import brute


def test_start_vectors_equal_the_stepped_generator(spark):
    ids = [-5, -1, 0, 1, 4, 12345678901]
    got = spark.createDataFrame([(e,) for e in ids], "id bigint").select("id", initial_vector("id", 5).alias("x"))
    brute.assert_same(brute.collected(got), brute.start(ids, 5), 0)


def test_vector_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], 2.0)], "x array<double>, y array<double>, r double")
    row = df.select(dot("x", "y").alias("a"), dot("x", "y", 3).alias("b"), sqnorm("x").alias("c"),
                    scale("x", "r").alias("d"), outer_packed("x", 3).alias("e")).first()
    assert (row.a, row.b, row.c, row.d) == (32.0, 32.0, 14.0, [2.0, 4.0, 6.0])
    assert row.e == [1.0, 2.0, 3.0, 4.0, 6.0, 9.0]


def test_packing_is_symmetric():
    full = np.arange(18.0).reshape(2, 3, 3)
    full = full + full.transpose(0, 2, 1)
    np.testing.assert_array_equal(unpack_symmetric(pack_symmetric(full), 3), full)
    np.testing.assert_array_equal(matrix_of(lists_of(full.reshape(2, 9)), 9), full.reshape(2, 9))


@pytest.mark.parametrize("budget", [30, 4_000_000])
def test_segment_grams(monkeypatch, budget):
    monkeypatch.setattr("factorlab.functions.solve._STACK_BUDGET", budget)
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 0, 40, 2, 2, 7])
    ends = np.cumsum(lengths)
    starts, rows = ends - lengths, int(ends[-1])
    x, pick = rng.normal(size=(9, 3)), rng.integers(0, 9, rows)
    w, t = rng.integers(1, 4, rows).astype(float), rng.normal(size=rows)
    grams, rhs = segment_grams(x, pick, w, t, starts, ends)
    for g, (s, e) in enumerate(zip(starts, ends)):
        v = x[pick[s:e]]
        np.testing.assert_allclose(grams[g], (v * w[s:e, None]).T @ v, atol=1e-12)
        np.testing.assert_allclose(rhs[g], (v * w[s:e, None]).T @ t[s:e], atol=1e-12)
