"""Batched dense algebra for Arrow tasks: segment Gram matrices and ridge solves.

These are the only places where numpy works; Spark has already partitioned the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from factorlab.functions.vectors import unpack_symmetric

# Doubles held at once: by the padded stacks in segment_grams, and by the Gram matrices of a slice (32 MB).
_STACK_BUDGET = 4_000_000


def slice_size(rank: int) -> int:
    """How many entities' Gram matrices may be held at once."""
    return max(1, _STACK_BUDGET // (rank * (rank + 1)))


def matrix_of(lists, width: int) -> np.ndarray:
    """An Arrow list<double> (array or chunked array) of equal lengths as a 2-d view."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def lists_of(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, max(width, 1), dtype=np.int32)[: rows + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def segment_grams(x, pick, weight, target, starts, ends):
    """Weighted normal equations of consecutive row segments.

    Row j stands for vector ``x[pick[j]]`` with ``weight[j]`` and ``target[j]``. Returns
    XtWX as (g, k, k) and XtWt as (g, k). Segments of similar length are padded to one
    stack so that a whole stack is a single batched matrix product.
    """
    groups, rank = len(starts), x.shape[1]
    out = np.zeros((groups, rank, rank + 1))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    at = int(np.searchsorted(lengths[order], 1))
    while at < groups:
        # Longest segment that still shares a stack with the current one: 1.25x its length.
        longest = int(lengths[order[at]] * 1.25)
        stop = int(np.searchsorted(lengths[order], longest, side="right"))
        stop = min(stop, at + max(1, _STACK_BUDGET // (longest * (rank + 1))))
        members = order[at:stop]
        width = int(lengths[members[-1]])
        for piece in range(0, width, max(1, _STACK_BUDGET // (rank + 1))):
            span = np.arange(piece, min(width, piece + max(1, _STACK_BUDGET // (rank + 1))))
            inside = span[None, :] < lengths[members][:, None]
            rows = np.where(inside, starts[members][:, None] + span[None, :], 0)
            w = np.where(inside, weight[rows], 0.0)
            stack = np.empty(rows.shape + (rank + 1,))
            stack[..., :rank] = x[pick[rows]]
            stack[..., rank] = target[rows]
            left = stack[..., :rank] * w[..., None]
            out[members] += np.matmul(left.transpose(0, 2, 1), stack)
        at = stop
    return out[:, :, :rank], out[:, :, rank]


def ridge_solve(xtx: np.ndarray, xty: np.ndarray, lam: float) -> np.ndarray:
    """Solve (XtX + lam I) w = Xty for a whole stack; lam is added once per system.

    The systems are symmetric and, if lam is positive, definite: one batched Cholesky solves
    them. Systems that are singular up to rounding (no lam, and fewer or collinear
    observations) get their least-squares solution of least norm, and only these.
    """
    if not len(xtx):
        return np.zeros(xty.shape)
    return _definite_or_least_norm(xtx + lam * np.eye(xtx.shape[-1]), xty)


def _definite_or_least_norm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return _least_norm(a, b)
        half = len(a) // 2  # a stack fails as a whole: halves find the systems that do
        return np.concatenate([_definite_or_least_norm(a[:half], b[:half]), _definite_or_least_norm(a[half:], b[half:])])
    pivots = np.diagonal(low, axis1=1, axis2=2) ** 2
    sure = pivots.min(axis=1) > _singular(a.shape[-1]) * np.diagonal(a, axis1=1, axis2=2).max(axis=1)
    out = _substituted(low, b)
    if not sure.all():
        out[~sure] = _least_norm(a[~sure], b[~sure])
    return out


def _singular(rank: int) -> float:
    """What part of the largest diagonal entry or eigenvalue is rounding."""
    return 16 * rank * np.finfo(float).eps


def _substituted(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Forward and back substitution, all systems of the stack in step."""
    y = np.empty(b.shape)
    for j in range(b.shape[1]):
        y[:, j] = (b[:, j] - np.einsum("nk,nk->n", low[:, j, :j], y[:, :j])) / low[:, j, j]
    for j in reversed(range(b.shape[1])):
        y[:, j] = (y[:, j] - np.einsum("nk,nk->n", low[:, j + 1:, j], y[:, j + 1:])) / low[:, j, j]
    return y


def _least_norm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(a)
    real = values > _singular(a.shape[-1]) * np.abs(values).max(axis=1, keepdims=True)
    parts = np.einsum("nij,ni->nj", vectors, b) * np.where(real, 1 / np.where(real, values, 1.0), 0.0)
    return np.einsum("nij,nj->ni", vectors, parts)


def explained(xtx: np.ndarray, xty: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``2 wT Xty - wT XtX w``: what a system's solution takes off its sum of squared targets."""
    return 2 * np.einsum("ni,ni->n", w, xty) - np.einsum("ni,nij,nj->n", w, xtx, w)


def _solved(tri: pa.Array, rhs: pa.Array, rank: int, lam: float):
    full, right = unpack_symmetric(matrix_of(tri, rank * (rank + 1) // 2), rank), matrix_of(rhs, rank)
    return full, right, ridge_solve(full, right, lam)


def solve_packed(xtx: Column, xty: Column, rank: int, lam: float) -> Column:
    """Column form of :func:`ridge_solve` on packed triangles, one Arrow batch at a time."""

    @F.arrow_udf("array<double>")
    def batch(tri: pa.Array, rhs: pa.Array) -> pa.Array:
        return lists_of(_solved(tri, rhs, rank, lam)[2])

    return batch(xtx, xty)


def solve_explained(xtx: Column, xty: Column, rank: int, lam: float) -> Column:
    """As :func:`solve_packed`, a struct of the solution ``x`` and what it explains, ``gain``."""

    @F.arrow_udf("struct<x: array<double>, gain: double>")
    def batch(tri: pa.Array, rhs: pa.Array) -> pa.Array:
        full, right, w = _solved(tri, rhs, rank, lam)
        return pa.StructArray.from_arrays([lists_of(w), pa.array(explained(full, right, w))], ["x", "gain"])

    return batch(xtx, xty)
