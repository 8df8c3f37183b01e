"""Exact sampling of matrix cells without replacement, with no shuffle and no sort.

Sampling s of m*n cells by ordering all of them costs m*n work. Here the positions
0..s-1 are mapped through a seeded permutation of the cell numbers instead. A number is a
pair of coordinates on a near-square grid (whatever the shape of the matrix, so that one row
or column is shuffled as well as any other), and each round shifts one coordinate, modulo its
own size, by a hash of the other. Every round is invertible, so different positions give
different cells, and disjoint position ranges give disjoint samples. The grid may have a few
numbers more than there are cells; who lands there goes on until it lands on a cell. Where
each of these few numbers ends is worked out once, so a plan has the rounds once, too.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession

from factorlab.functions.seeding import hashed_int, hashed_int_of

ROUNDS = 4
SIDES_TRIED = 10_000


def grid_side(cells: int) -> tuple[int, int]:
    """(side, excess) of the grid: of the sides next below the square root, the one with least excess."""
    root = isqrt(max(cells, 1) - 1) + 1
    return min(((a, -cells % a) for a in range(root, max(root - SIDES_TRIED, root // 2, 0), -1)),
               key=lambda s: (s[1], -s[0]))


def _shifted(cells: DataFrame, a: int, b: int, seed: int) -> DataFrame:
    """(pos, x) -> (pos, x, y): number x of the a x b grid goes to y."""
    # The coalesce only tells Catalyst that coordinates are never null. Otherwise every join on
    # them infers a null filter, which is pushed through all rounds and repeats their hashes.
    cells = cells.selectExpr("pos", "x", f"coalesce(x % {a}L, 0L) as u", f"coalesce(x div {a}L, 0L) as i")
    for turn in range(ROUNDS):
        down, along = hashed_int(f"{seed}/{turn}/u", "i"), hashed_int(f"{seed}/{turn}/i", "u")
        cells = cells.selectExpr("pos", "x", f"coalesce((u + {down}) % {a}L, 0L) as u", "i")
        cells = cells.selectExpr("pos", "x", "u", f"coalesce((i + {along}) % {b}L, 0L) as i")
    return cells.selectExpr("pos", "x", f"coalesce(i * {a}L + u, 0L) as y")


def _shifted_number(x: int, a: int, b: int, seed: int) -> int:
    """:func:`_shifted` for one number."""
    u, i = x % a, x // a
    for turn in range(ROUNDS):
        u = (u + hashed_int_of(f"{seed}/{turn}/u", i)) % a
        i = (i + hashed_int_of(f"{seed}/{turn}/i", u)) % b
    return i * a + u


def excess_ends(cells: int, a: int, b: int, seed: int) -> list[int]:
    """The cell on which each number of the a x b grid that is none goes on to land.

    No way there leads over more than all numbers in excess; on a round trip of such numbers
    alone, which no cell ever enters, the last one stands for it.
    """
    ends = []
    for x in range(cells, a * b):
        for _ in range(a * b - cells):
            if x < cells:
                break
            x = _shifted_number(x, a, b, seed)
        ends.append(x)
    return ends


def permuted_cells(positions: DataFrame, m: int, n: int, seed: int) -> DataFrame:
    """(pos) -> (pos, u, i): position ``pos`` of the shuffled cells of an m x n matrix."""
    cells = m * n
    a, excess = grid_side(cells)
    b = (cells + excess) // a
    placed = _shifted(positions.selectExpr("pos", "pos as x"), a, b, seed).selectExpr("pos", "y as x")
    if excess:
        ends = ",".join(map(str, excess_ends(cells, a, b, seed)))
        placed = placed.selectExpr("pos", f"if(x >= {cells}L, cast(split('{ends}', ',') as array<bigint>)[x - {cells}L], x) as x")
    return placed.selectExpr("pos", f"coalesce(x % {m}L, 0L) as u", f"coalesce(x div {m}L, 0L) as i")


def sample_cells(spark: SparkSession, m: int, n: int, train: int, test: int = 0, seed: int = 0) -> DataFrame:
    """``train`` + ``test`` distinct cells (u, i, is_test); idx is the column-major cell number."""
    if train + test > m * n:
        raise ValueError("more cells asked for than the matrix has")
    positions = spark.range(train + test).withColumnRenamed("id", "pos")
    return permuted_cells(positions, m, n, seed).selectExpr(
        "u", "i", f"i * {m}L + u as idx", f"pos >= {train}L as is_test")
