"""Column expressions over ``array<double>`` vectors, and the packed-triangle layout.

A symmetric k x k matrix travels as its upper triangle, row by row:
(0,0) (0,1) ... (0,k-1) (1,1) ... (k-1,k-1).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def triangle(rank: int) -> list[tuple[int, int]]:
    """The (row, col) pairs of the packed upper triangle, in storage order."""
    return [(a, b) for a in range(rank) for b in range(a, rank)]


def dot(x: str, y: str, rank: int | None = None) -> Column:
    """Inner product of two columns. With a known rank it is plain arithmetic (codegen)."""
    if rank is None:
        return F.expr(f"aggregate(zip_with({x}, {y}, (a, b) -> a * b), 0D, (s, v) -> s + v)")
    return F.expr(" + ".join(f"{x}[{a}] * {y}[{a}]" for a in range(rank)))


def sqnorm(x: str) -> Column:
    return F.expr(f"aggregate({x}, 0D, (s, v) -> s + v * v)")


def scale(x: str, by: str) -> Column:
    return F.expr(f"transform({x}, v -> v * {by})")


def outer_packed(x: str, rank: int) -> Column:
    """Upper triangle of x xT as one array."""
    return F.expr(f"array({', '.join(f'{x}[{a}] * {x}[{b}]' for a, b in triangle(rank))})")


def unpack_symmetric(packed: np.ndarray, rank: int) -> np.ndarray:
    """(n, k(k+1)/2) packed triangles -> (n, k, k) full matrices."""
    rows, cols = np.triu_indices(rank)
    full = np.empty((len(packed), rank, rank))
    full[:, rows, cols] = packed
    full[:, cols, rows] = packed
    return full


def pack_symmetric(full: np.ndarray) -> np.ndarray:
    rows, cols = np.triu_indices(full.shape[-1])
    return full[:, rows, cols]
