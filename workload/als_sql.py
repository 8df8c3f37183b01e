"""DuckDB SQL for whole fits: seeded start, normal equations, unrolled Cholesky solves.

Written independently of the Spark code paths (iterated generator, scalar algebra), so
that equal results mean something. Every function returns SQL text; a *table* argument is
the name of a CTE or view, and vectors are scalar columns x0, x1, ...
"""

from __future__ import annotations

SUPP_PART = "SELECT l_suppkey AS u, l_partkey AS i, l_quantity AS r FROM lineitem"
CUST_PART = ("SELECT o_custkey AS u, l_partkey AS i, l_quantity AS r "
             "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
TEST_ROW = "(l_orderkey * 31 + l_linenumber) % 10 = 0"

_MULT, _ADD, _MOD = 25214903917, 11, 1 << 48


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes)
    return f"WITH {body}\n{final}"


def start_vectors(ids: str, rank: int, seed: str = "id", keys: str = "id") -> str:
    """Seeded uniforms by stepping the generator 2*rank times from each seed."""
    sql = f"SELECT {keys}, xor(({seed})::BIGINT, {_MULT}) & {_MOD - 1} AS s0 FROM {ids}"
    for j in range(1, 2 * rank + 1):
        sql = f"SELECT *, ((s{j - 1}::HUGEINT * {_MULT} + {_ADD}) % {_MOD})::BIGINT AS s{j} FROM ({sql})"
    xs = ", ".join(f"((s{2 * j + 1} >> 22) * 134217728 + (s{2 * j + 2} >> 21))::DOUBLE / 9007199254740992.0"
                   f" AS x{j}" for j in range(rank))
    return f"SELECT {keys}, {xs} FROM ({sql})"


def normal_equations(ratings: str, factors: str, rank: int, match: str, keys: str, group: str) -> str:
    tri = ", ".join(f"sum(f.x{a} * f.x{b}) AS g{a}_{b}" for a in range(rank) for b in range(a, rank))
    rhs = ", ".join(f"sum(f.x{a} * t.r) AS h{a}" for a in range(rank))
    return f"SELECT {keys}, {tri}, {rhs} FROM {ratings} t JOIN {factors} f ON {match} GROUP BY {group}"


def cholesky_solve(normal: str, rank: int, lam: float, keys: str = "id") -> str:
    """(G + lam I) x = h, one scalar per nested layer."""
    sql = f"SELECT * FROM {normal}"

    def layer(name: str, value: str) -> None:
        nonlocal sql
        sql = f"SELECT *, {value} AS {name} FROM ({sql})"

    for c in range(rank):
        done = "".join(f" - l{c}_{p} * l{c}_{p}" for p in range(c))
        layer(f"l{c}_{c}", f"sqrt(g{c}_{c} + {lam}{done})")
        for r in range(c + 1, rank):
            done = "".join(f" - l{r}_{p} * l{c}_{p}" for p in range(c))
            layer(f"l{r}_{c}", f"(g{c}_{r}{done}) / l{c}_{c}")
    for r in range(rank):
        done = "".join(f" - l{r}_{p} * z{p}" for p in range(r))
        layer(f"z{r}", f"(h{r}{done}) / l{r}_{r}")
    for r in reversed(range(rank)):
        done = "".join(f" - l{p}_{r} * x{p}" for p in range(r + 1, rank))
        layer(f"x{r}", f"(z{r}{done}) / l{r}_{r}")
    return f"SELECT {keys}, {', '.join(f'x{a}' for a in range(rank))} FROM ({sql})"


def als_ctes(ratings_sql: str, rank: int, lam: float, iters: int, first: str = "i",
             tag: str = "") -> tuple[list[tuple[str, str]], list[dict[str, str]]]:
    """CTEs of a whole fit, and the names of the u and i tables after every half-step."""
    t = f"t{tag}"
    now = {"u": f"u{tag}_0", "i": f"i{tag}_0"}
    ctes = [(t, ratings_sql),
            (now["u"], start_vectors(f"(SELECT DISTINCT u AS id FROM {t})", rank)),
            (now["i"], start_vectors(f"(SELECT DISTINCT i AS id FROM {t})", rank, "-id"))]
    states = [dict(now)]
    order = ("i", "u") if first == "i" else ("u", "i")
    for step in range(1, iters + 1):
        for side in order:
            src = "u" if side == "i" else "i"
            normal, solved = f"n{tag}_{side}{step}", f"{side}{tag}_{step}"
            ctes.append((normal, normal_equations(t, now[src], rank, f"t.{src} = f.id",
                                                  f"t.{side} AS id", f"t.{side}")))
            ctes.append((solved, cholesky_solve(normal, rank, lam)))
            now[side] = solved
            states.append(dict(now))
    return ctes, states


def dot(rank: int, left: str = "a", right: str = "b") -> str:
    return " + ".join(f"{left}.x{j} * {right}.x{j}" for j in range(rank))


def sse(ratings: str, state: dict[str, str], rank: int) -> str:
    """Scalar-row SQL with nnz and sse (inner joins)."""
    return (f"SELECT count(*) AS nnz, sum(power({dot(rank)} - t.r, 2)) AS sse FROM {ratings} t "
            f"JOIN {state['u']} a ON t.u = a.id JOIN {state['i']} b ON t.i = b.id")


def reg_cost(state: dict[str, str], rank: int, lam: float) -> str:
    norm = " + ".join(f"x{j} * x{j}" for j in range(rank))
    return (f"SELECT {lam} * sum(q) AS reg_cost FROM (SELECT {norm} AS q FROM {state['u']} "
            f"UNION ALL SELECT {norm} AS q FROM {state['i']})")


def long_rows(table: str, rank: int, side: str | None = None, digits: int = 4, keys: str = "id") -> str:
    """(side, id, pos, val) rows of a factor table."""
    label = f"'{side}' AS side, " if side else ""
    return " UNION ALL ".join(
        f"SELECT {label}{keys}, {j}::BIGINT AS pos, round(x{j}, {digits}) + 0.0 AS val FROM {table}"
        for j in range(rank))


def factors(ratings_sql: str, rank: int, lam: float, iters: int, first: str = "i") -> str:
    ctes, states = als_ctes(ratings_sql, rank, lam, iters, first)
    last = states[-1]
    return with_ctes(ctes, long_rows(last["u"], rank, "u") + " UNION ALL " + long_rows(last["i"], rank, "i"))


# --- divide, factor, combine -------------------------------------------------------------

def dfc_ctes(ratings_sql: str, rank: int, lam: float, iters: int, parts: int, cols_sql: str):
    """Per-partition fits with row key (part, u), rows first, start from the columns."""
    ctes = [("cols", cols_sql),
            ("t", f"SELECT least(i // greatest((SELECT n FROM cols) // {parts}, 1), {parts - 1}) AS part, "
                  f"u, i, r FROM ({ratings_sql})"),
            ("i_0", start_vectors("(SELECT DISTINCT part, i AS id FROM t)", rank, "-id", "part, id"))]
    i_now = "i_0"
    for step in range(1, iters + 1):
        ctes.append((f"nu{step}", normal_equations("t", i_now, rank, "t.i = f.id", "t.part, t.u AS id", "t.part, t.u")))
        ctes.append((f"w_{step}", cholesky_solve(f"nu{step}", rank, lam, "part, id")))
        ctes.append((f"ni{step}", normal_equations("t", f"w_{step}", rank, "t.u = f.id AND t.part = f.part",
                                                   "t.part, t.i AS id", "t.part, t.i")))
        ctes.append((f"h_{step}", cholesky_solve(f"ni{step}", rank, lam, "part, id")))
        i_now = f"h_{step}"
    return ctes, f"w_{iters}", i_now


def dfc_gram(w: str, rank: int) -> str:
    """Per partition: G0 (entries g) and C_p (entries c) over rows of partition 0."""
    c = ", ".join(f"sum(a.x{r} * b.x{s}) AS c{r}_{s}" for r in range(rank) for s in range(rank))
    return f"SELECT b.part, {c} FROM {w} a JOIN {w} b ON a.id = b.id AND a.part = 0 GROUP BY b.part"


def dfc_project_r2(w: str, h: str) -> list[tuple[str, str]]:
    """Rank 2: T_p = G0^-1 C_p by the closed-form 2 x 2 inverse; columns become T_p h."""
    g = f"SELECT sum(x0*x0) AS g00, sum(x0*x1) AS g01, sum(x1*x1) AS g11 FROM {w} WHERE part = 0"
    turn = ("SELECT part, (g11*c0_0 - g01*c1_0)/d AS t00, (g11*c0_1 - g01*c1_1)/d AS t01, "
            "(g00*c1_0 - g01*c0_0)/d AS t10, (g00*c1_1 - g01*c0_1)/d AS t11 "
            "FROM (SELECT *, g00*g11 - g01*g01 AS d FROM gram, g0)")
    cols = (f"SELECT h.part, h.id, CASE WHEN h.part = 0 THEN x0 ELSE t00*x0 + t01*x1 END AS x0, "
            f"CASE WHEN h.part = 0 THEN x1 ELSE t10*x0 + t11*x1 END AS x1 "
            f"FROM {h} h LEFT JOIN turn ON h.part = turn.part")
    rows = f"SELECT id, x0, x1 FROM {w} WHERE part = 0"
    return [("gram", dfc_gram(w, 2)), ("g0", g), ("turn", turn), ("pcols", cols), ("prows", rows)]
