"""Seeded start vectors and engine-neutral random numbers, all as plain columns.

Start vectors follow the public 48-bit linear congruential generator of the Java
class library: vector j of a seed is the j-th uniform double it yields. Rather than
iterating, each step is jumped to directly, s_j = A_j * s_0 + C_j (mod 2^48), so the
expression for one element does not contain the previous ones. The helpers build SQL text:
one parsed expression per vector is far cheaper on the driver than thousands of Columns.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public generator.
LCG_MULTIPLIER = 0x5DEECE66D
LCG_INCREMENT = 0xB
LCG_BITS = 48

_HALF = 24
_LOW = (1 << _HALF) - 1
_MASK = (1 << LCG_BITS) - 1


def lcg_jump(steps: int) -> tuple[int, int]:
    """(A, C) such that ``steps`` generator steps map s to A*s + C (mod 2^48)."""
    mult, add = 1, 0
    for _ in range(steps):
        mult = mult * LCG_MULTIPLIER & _MASK
        add = (add * LCG_MULTIPLIER + LCG_INCREMENT) & _MASK
    return mult, add


def _advance(state: str, steps: int) -> str:
    # BIGINT overflow raises under ANSI, hence the product in 24-bit halves.
    mult, add = lcg_jump(steps)
    low, high = f"({state} & {_LOW})", f"shiftright({state}, {_HALF})"
    cross = f"({high} * {mult & _LOW}L + {low} * {mult >> _HALF}L)"
    carried = f"shiftleft({cross} & {_LOW}L, {_HALF})"
    return f"(({low} * {mult & _LOW}L + {carried} + {add}L) & {_MASK}L)"


def lcg_uniform(seed: str, index: int) -> str:
    """Uniform double number ``index`` (from 0) of the generator seeded with ``seed``."""
    state = f"((cast({seed} as bigint) ^ {LCG_MULTIPLIER}L) & {_MASK}L)"
    high = f"shiftright({_advance(state, 2 * index + 1)}, {LCG_BITS - 26})"
    low = f"shiftright({_advance(state, 2 * index + 2)}, {LCG_BITS - 27})"
    return f"(cast({high} * {1 << 27}L + {low} as double) / {1 << 53}D)"


def initial_vector(seed: str, rank: int) -> Column:
    """The first ``rank`` uniforms of a seed expression as one array."""
    return F.expr(f"array({', '.join(lcg_uniform(seed, j) for j in range(rank))})")


def hashed_int(tag: str, *keys: str) -> str:
    """A 48-bit integer from the md5 of ``tag:key:...``: the same in any SQL engine."""
    text = ", ".join(f"cast({key} as string)" for key in keys)
    return f"cast(conv(substring(md5(concat_ws(':', '{tag}', {text})), 1, 12), 16, 10) as bigint)"


def hashed_int_of(tag: str, *keys: int) -> int:
    """The value of :func:`hashed_int` for given keys."""
    return int(md5(":".join([tag, *map(str, keys)]).encode()).hexdigest()[:12], 16)


def hashed_uniform(tag: str, *keys: str) -> str:
    """Uniform in (0, 1), never 0 or 1."""
    return f"(({hashed_int(tag, *keys)} + 0.5D) / {1 << 48}D)"


def hashed_normal(tag: str, *keys: str) -> str:
    """Standard normal by the Box-Muller transform of two hashed uniforms."""
    radius = f"sqrt(-2D * ln({hashed_uniform(tag + '/a', *keys)}))"
    return f"({radius} * cos(2D * pi() * {hashed_uniform(tag + '/b', *keys)}))"
