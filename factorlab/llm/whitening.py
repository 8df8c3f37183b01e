"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

Vectors are put on a lattice, ``x = floor(scale * c) + offset`` as long, so sums and centres are
exact. The covariance is never built: a product with it is one pass over the centred rows, each
task adding ``Ct (C t)`` of its blocks for all vectors ``t`` asked at once, and Spark adding the
tasks' sums. On the driver are only matrices with one row for each dimension and few columns.

A search space is kept; Rayleigh-Ritz in it gives the leading pairs. For each pair that has not
converged, and a few beyond as guards, the correction equation, projected away from locked and
current vectors, is solved by MINRES; all of these solves go in step, so a step of all costs one
pass. The corrections widen the space. A pair is locked as soon as its residual is at rounding
level, leading ones first, and the rest of the space is kept apart from it. The residuals of the
locked pairs are computed anew in the end; if one is above rounding level, the search goes on.

Vectors that are null or empty, or hold null or non-finite entries, are left out; so are those of
another length than most (of two lengths equally frequent, the longer counts). Entries beyond
2^52 / scale fail the job, as the lattice is not exact there. Repeated rows count as often as
they come, rows without an id like others. Directions without variance beyond rounding are no
components, so constant, single or no vectors have none. Of two opposite eigenvectors the one
whose largest entry is positive is taken. Other columns pass through unless they have a
result's name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import add_columns
from factorlab.session import scratch_path

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
GUARDS = 2
#: Entries of a packed block of rows.
BLOCK_ENTRIES = 1 << 19
#: Packed bytes that a task of a pass reads.
TASK_BYTES = 64 << 20
#: Steps of MINRES for a correction, and how many times as wide as the wanted pairs the space gets: few
#: steps in a wide space took the fewest passes over flat and falling spectra of 50 to 300 dimensions.
_INNER, _WIDEST = 4, 6
_OUTER = 100


def usable(vector: Column | str) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))


def lattice(vector: Column | str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """``floor(scale * c) + offset`` of every entry as long."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def place(c):
        value = c.cast("double") * F.lit(float(scale))
        # rows that are left out may get here before they are: Spark is free to evaluate this first
        return F.when(F.abs(value) < 2.0 ** 52, F.floor(value) + F.lit(offset)).when(
            F.abs(value) < float("inf"), F.raise_error(F.lit("an entry is too large for the lattice")).cast("bigint"))
    return F.transform(v, place)


@dataclass(frozen=True)
class Model:
    """Sums over ``n`` vectors, components as columns of ``vectors`` and what they explain."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def minres(product: Callable[[np.ndarray], np.ndarray], shift: np.ndarray, basis: np.ndarray, rhs: np.ndarray,
           tolerance: float, most: int) -> np.ndarray:
    """Solutions of ``P (A - shift_j) P x_j = rhs_j`` with ``P = I - basis basisT``, all columns in step."""

    def projected(v):
        return v - basis @ (basis.T @ v)

    def lengths(v):
        return np.sqrt(np.einsum("ij,ij->j", v, v))

    v = projected(rhs)
    beta = lengths(v)
    first = np.where(beta > 0, beta, 1.0)
    x, w, w_before, before = (np.zeros_like(rhs) for _ in range(4))
    v = v / first
    eta, gap = beta.copy(), beta.copy()
    cos, cos_before = np.ones_like(beta), np.ones_like(beta)
    sin, sin_before = np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    live = first * 0 + (gap > 0)
    for _ in range(most):
        if not live.any():
            break
        y = projected(product(v) - v * shift)
        alpha = np.einsum("ij,ij->j", v, y)
        y = projected(y - v * alpha - before * beta)
        beta_next = lengths(y)
        delta = cos * alpha - cos_before * sin * beta
        rho = np.hypot(delta, beta_next)
        over = sin * alpha + cos_before * cos * beta
        far = sin_before * beta
        safe = np.where(rho > 0, rho, 1.0)
        w_before, w = w, np.where(live > 0, (v - w_before * far - w * over) / safe, w)
        cos_before, sin_before, cos, sin = cos, sin, delta / safe, beta_next / safe
        x = x + w * (cos * eta * live)
        eta, gap = -sin * eta, gap * np.abs(sin)
        live = live * (gap > tolerance * first) * (rho > 0) * (beta_next > 1e-14 * np.abs(shift))
        before, v = v, y / np.where(beta_next > 0, beta_next, 1.0)
        beta = beta_next
    return projected(x)


def _orthonormal(t: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of ``t`` without what ``against`` spans; columns that vanish are left out."""
    kept = np.zeros((len(t), 0))
    for j in range(t.shape[1]):
        v = t[:, j]
        size = np.linalg.norm(v)
        for _ in range(3):
            for b in (*against, kept):
                v = v - b @ (b.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size:
            kept = np.column_stack([kept, v / left])
    return kept


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], size: int, count: int, seed: int = 1,
               guards: int = GUARDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric ``size`` x ``size`` operator, falling, and their vectors.

    ``product`` multiplies a matrix of few columns. Residuals end below ``size`` units of
    rounding of the largest eigenvalue.
    """
    chance = np.random.default_rng(seed)
    count = min(count, size)
    widest = min(size, _WIDEST * (count + guards))
    locked, values = np.zeros((size, 0)), np.zeros(0)
    space = _orthonormal(chance.standard_normal((size, min(size, count + guards))), [])
    image = product(space)
    inner = 0.3
    for _ in range(_OUTER):
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max(float(values[0]) if len(values) else 0.0, float(np.abs(theta[0])) if len(theta) else 0.0)
        limit = max(size, 16) * np.finfo(float).eps * top
        rest = image - space * theta
        rest -= locked @ (locked.T @ rest)
        off = np.linalg.norm(rest, axis=0)
        done = 0
        while done < len(theta) and len(values) + done < count and off[done] <= limit:
            done += 1
        locked = np.column_stack([locked, space[:, :done]])
        values = np.concatenate([values, theta[:done]])
        space, image, theta, rest = space[:, done:], image[:, done:], theta[done:], rest[:, done:]
        if len(values) == count:
            fresh = product(locked)
            worst = np.linalg.norm(fresh - locked * values, axis=0)
            if (worst <= 4 * limit).all():
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order]
            # a residual of recurrences was wrong: all goes back into the space
            space, image = _orthonormal(np.column_stack([locked, space]), []), None
            image = product(space)
            locked, values = np.zeros((size, 0)), np.zeros(0)
            continue
        wanted = min(count - len(values) + guards, len(theta))
        near = space[:, :wanted]
        asked = _orthonormal(near, [locked])
        steps = minres(product, theta[:wanted], np.column_stack([locked, asked]), -rest[:, :wanted], inner, _INNER)
        inner = max(inner * 0.3, 1e-3)
        if space.shape[1] + wanted > widest:
            space, image = space[:, :wanted], image[:, :wanted]
        fresh = _orthonormal(steps, [locked, space])
        missing = count - len(values) + guards - wanted
        if not fresh.shape[1] or missing > 0:
            more = chance.standard_normal((size, max(1, missing)))
            fresh = np.column_stack([fresh, _orthonormal(more, [locked, space, fresh])])
        if fresh.shape[1]:
            space, image = np.column_stack([space, fresh]), np.column_stack([image, product(fresh)])
        else:  # the space is whole: what is left is rounding, so the products are made anew
            image = product(space)
    raise ArithmeticError("residuals did not reach rounding level")


def _centred(batches, base: np.ndarray, shift: np.ndarray):
    """The rows of packed blocks as doubles, minus their exact means."""
    for batch in batches:
        for wide, data in zip(batch.column(0), batch.column(1)):
            rows = np.frombuffer(data.as_buffer(), np.int64 if wide.as_py() else np.int32).reshape(-1, len(base))
            yield rows - shift


class Centred:
    """The fit list as packed, centred blocks in a written table; products and sums are passes over it."""

    def __init__(self, x: DataFrame, size: int, n: int, sums: np.ndarray):
        spark = x.sparkSession
        self.size, self.n, self.sums, self.passes = size, n, sums, 0
        self.base = base = np.array([int(s) // n for s in sums], np.int64)
        self.shift = np.array([float(int(s) - n * int(b)) / n for s, b in zip(sums, base)])
        most = max(1, BLOCK_ENTRIES // size)

        def pack(batches):
            for batch in batches:
                column = batch.column(0)
                for at in range(0, len(column), most):
                    rows = column.slice(at, most).flatten().to_numpy().reshape(-1, size) - base
                    wide = bool(np.abs(rows).max() >= 1 << 31)
                    data = rows.astype(np.int64 if wide else np.int32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([wide]), pa.array([data], pa.binary())], names=["wide", "data"])

        path = scratch_path(spark, "centred")
        tasks = max(spark.sparkContext.defaultParallelism, n * size * 4 // TASK_BYTES)
        x.mapInArrow(pack, "wide boolean, data binary").coalesce(tasks).write.parquet(path)
        self.blocks = spark.read.parquet(path).persist(StorageLevel.MEMORY_AND_DISK)

    def total(self, add: Callable, width: int) -> np.ndarray:
        """The sum over all rows of what ``add`` makes of a block."""
        base, shift = self.base, self.shift

        def sums(batches):
            total = np.zeros(width)
            for rows in _centred(batches, base, shift):
                total += add(rows)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

        self.passes += 1
        parts = self.blocks.mapInArrow(sums, "s array<double>")
        row = parts.agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).first()
        return np.zeros(width) if row["s"] is None else np.array(row["s"])

    def product(self, t: np.ndarray) -> np.ndarray:
        """The covariance (divisor ``n``) times ``t``."""
        return self.total(lambda rows: (rows.T @ (rows @ t)).ravel(), t.size).reshape(t.shape) / self.n

    def identity_error(self, whitener: np.ndarray) -> float:
        """How far the covariance of the whitened rows is from the identity, over all rows."""
        k = whitener.shape[1]
        mean = self.total(lambda rows: (rows @ whitener).sum(axis=0), k) / self.n

        def spread(rows):
            w = rows @ whitener - mean
            return (w.T @ w).ravel()
        return float(np.abs(self.total(spread, k * k).reshape(k, k) / self.n - np.eye(k)).max())

    def close(self) -> None:
        self.blocks.unpersist()


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
        offset: int = OFFSET) -> Model:
    rows = df.select(F.col(vector_col).alias("v")).where(usable("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return Model(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    size, n = lengths["d"], lengths["count"]
    x = rows.where(F.size("v") == size).select(lattice("v", scale, offset).alias("x"))
    sums = x.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).collect()
    total = np.zeros(size, np.int64)
    for r in sums:
        total[r["at"]] = r["s"]
    data = Centred(x, size, n, total)
    try:
        trace = float(data.total(lambda rows: np.array([np.einsum("ij,ij->", rows, rows)]), 1)[0] / n)
        if trace > 0:
            values, vectors = eigenpairs(data.product, size, components)
            real = values > size * np.finfo(float).eps * trace
            values, vectors = values[real], vectors[:, real]
        else:
            values, vectors = np.zeros(0), np.zeros((size, 0))
        if len(values):
            vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
            error = data.identity_error(vectors / np.sqrt(values))
        else:
            error = 0.0
        return Model(n, total, vectors, values, trace, error, data.passes)
    finally:
        data.close()


def transform(df: DataFrame, model: Model, vector_col: str = "embedding", scale: int = SCALE,
              offset: int = OFFSET) -> DataFrame:
    """The rows that the model counts, with ``x``, ``whitened`` (one entry for each component) and ``deviation``.

    ``deviation`` is the sum over dimensions of ``(n x - S)^2``, exact, as decimal(38, 0).
    """
    n, size = model.n, len(model.sums)
    rows = df.where(usable(vector_col) & (F.size(vector_col) == size)) if size else df.limit(0)
    rows = rows.withColumn("x", lattice(vector_col, scale, offset))
    whitener = model.vectors / np.sqrt(model.values) if len(model.values) else np.zeros((size, 0))
    base = model.sums // max(n, 1)
    left = model.sums - n * base

    def made(columns: list[pa.Array]) -> list[pa.Array]:
        column = columns[0]
        x = column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, size), np.int64)
        rest = x - base
        largest = int(np.abs(rest).max()) + 1 if rest.size else 0
        if (n * largest) ** 2 * max(size, 1) < 1 << 62:
            gaps = n * rest - left
            deviation = np.einsum("ij,ij->i", gaps, gaps).tolist()
        else:  # beyond 64 bits: the same in whole numbers of any size
            deviation = [sum((n * int(r) - int(s)) ** 2 for r, s in zip(row, left)) for row in rest]
        whitened = (rest - left / max(n, 1)) @ whitener
        k = whitener.shape[1]
        bounds = pa.array(np.arange(0, (len(x) + 1) * k, k) if k else np.zeros(len(x) + 1), pa.int32())
        return [column, pa.ListArray.from_arrays(bounds, pa.array(whitened.ravel())),
                pa.array(deviation, pa.decimal128(38, 0))]

    return add_columns(rows, ["x"], "x array<bigint>, whitened array<double>, deviation decimal(38,0)", made)


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Model]:
    """``transform`` by a model of the same rows, and the model."""
    model = fit(df, vector_col, components)
    return transform(df, model, vector_col), model
