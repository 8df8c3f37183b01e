"""Brute-force results in plain Python and numpy for small fixtures."""

import numpy as np

TINY = [(0, 0, 5), (0, 1, 3), (1, 0, 4), (1, 2, 1), (2, 1, 2), (2, 2, 5), (3, 0, 1), (3, 2, 4)]


class Lcg:
    """The public 48-bit generator, stepped one draw at a time."""

    def __init__(self, seed):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, count):
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - count)

    def double(self):
        return ((self.bits(26) << 27) + self.bits(27)) / float(1 << 53)


def start(ids, rank, sign=1):
    out = {}
    for e in ids:
        gen = Lcg(sign * e)
        out[e] = np.array([gen.double() for _ in range(rank)])
    return out


def half_step(rows, other, rank, lam, side):
    new = {}
    for e in {row[side] for row in rows}:
        mine = [(other[row[1 - side]], row[2]) for row in rows if row[side] == e]
        x = np.array([v for v, _ in mine])
        new[e] = np.linalg.solve(x.T @ x + lam * np.eye(rank), x.T @ np.array([r for _, r in mine], float))
    return new


def als(rows, rank, lam, iters, first="i"):
    u, i = start({r[0] for r in rows}, rank), start({r[1] for r in rows}, rank, -1)
    for _ in range(iters):
        for side in (("i", "u") if first == "i" else ("u", "i")):
            if side == "i":
                i = half_step(rows, u, rank, lam, 1)
            else:
                u = half_step(rows, i, rank, lam, 0)
    return u, i


def sse(rows, u, i):
    return sum((u[a] @ i[b] - r) ** 2 for a, b, r in rows if a in u and b in i)


def collected(factors, key="id"):
    return {row[key]: np.array(row["x"]) for row in factors.collect()}


def assert_same(got, want, tol=1e-8):
    assert set(got) == set(want)
    for e in want:
        np.testing.assert_allclose(got[e], want[e], rtol=tol, atol=tol)
