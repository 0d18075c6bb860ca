"""Small helpers to write the DuckDB oracle SQL from the *definitions*."""

from __future__ import annotations

from ..operators.binning import linspace_edges


def dbl(x: float) -> str:
    """Exact double literal (repr round-trips)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def bin_rc(x: str, n: int) -> str:
    """(lo, hi] bins via np.digitize(right=True) - 1 = #(edges < x) - 1."""
    return "(" + " + ".join(f"CAST({dbl(e)} < {x} AS INTEGER)" for e in linspace_edges(n)) + " - 1)"


def bin_lc(x: str, edges) -> str:
    """[lo, hi) bins, last closed; NULL outside."""
    n = len(edges) - 1
    raw = "(" + " + ".join(f"CAST({dbl(e)} <= {x} AS INTEGER)" for e in edges) + " - 1)"
    return (f"(CASE WHEN {x} < {dbl(edges[0])} OR {x} > {dbl(edges[-1])} THEN NULL "
            f"WHEN {x} = {dbl(edges[-1])} THEN {n - 1} ELSE {raw} END)")


def bin_cut(x: str, edges) -> str:
    raw = "(" + " + ".join(f"CAST({dbl(e)} < {x} AS INTEGER)" for e in edges) + " - 1)"
    return (f"(CASE WHEN {x} < {dbl(edges[0])} OR {x} > {dbl(edges[-1])} THEN NULL "
            f"WHEN {x} = {dbl(edges[0])} THEN 0 ELSE {raw} END)")


def edge_values(n: int) -> str:
    """VALUES rows (bin, lo, hi) for linspace edges."""
    e = linspace_edges(n)
    return ", ".join(f"({i}, {dbl(e[i])}, {dbl(e[i + 1])})" for i in range(n))


def edge_values_of(edges) -> str:
    return ", ".join(f"({i}, {dbl(edges[i])}, {dbl(edges[i + 1])})" for i in range(len(edges) - 1))


# ------------------------------------------------- hash uniforms and gamma draws
_ATTEMPTS = 12      # all but one draw in 10^15 are accepted before


def _key(seed: int, draw: int) -> int:
    return (seed * 0x9E3779B97F4A7C15 + draw * 0xD6E8FEB86659FD93 + 1) % 2**64


def _mixed_sql(source: str, x: str) -> str:
    """``source`` with column ``x`` (UBIGINT) through splitmix64's finaliser."""
    def times(c: int) -> str:
        return f"CAST((CAST(m AS UHUGEINT) * {c}) % 18446744073709551616 AS UBIGINT)"
    q = f"SELECT *, xor({x}, {x} >> 30) AS m FROM ({source})"
    q = f"SELECT * REPLACE ({times(0xBF58476D1CE4E5B9)} AS m) FROM ({q})"
    q = f"SELECT * REPLACE (xor(m, m >> 27) AS m) FROM ({q})"
    q = f"SELECT * REPLACE ({times(0x94D049BB133111EB)} AS m) FROM ({q})"
    return f"SELECT * EXCLUDE (m, {x}), xor(m, m >> 31) AS {x} FROM ({q})"


def gamma_ctes(ids: str, seed: int, shapes: dict[int, str], choices: bool = False) -> str:
    """CTEs from ``ids`` (a CTE or view with a column ``id``): ``gamma`` (id, stream, g),
    Gamma(shape, 1) by the squeeze method of Marsaglia and Tsang, and, with ``choices``,
    ``choice`` (id, u), the uniform that chooses a row's parameter.  ``shapes``: an
    expression over ``ids`` for each stream."""
    keys = [(s, j, k, _key(seed, (s << 32) + (0 if j < 0 else 3 * j + k))) for s in shapes
            for j in range(-1, _ATTEMPTS) for k in ((0,) if j < 0 else (1, 2, 3))]
    keys += [(-1, -1, 0, _key(seed, 0))]
    rows = ", ".join(f"({s}, {j}, {k}, CAST({v} AS UBIGINT))" for s, j, k, v in keys)
    first = f"""SELECT id, stream, attempt, k, key, CAST((CAST(id AS UHUGEINT) + CAST(key AS UHUGEINT)) % 18446744073709551616 AS UBIGINT) AS x
  FROM (SELECT DISTINCT id FROM {ids}), (VALUES {rows}) keys(stream, attempt, k, key)"""
    second = f"SELECT * REPLACE (xor(x, key) AS x) FROM ({_mixed_sql(first, 'x')})"
    shape = " ".join(f"WHEN {s} THEN {e}" for s, e in shapes.items())
    return f"""uniform AS (SELECT id, stream, attempt, k, (CAST(x >> 11 AS DOUBLE) + 0.5) / 9007199254740992.0 AS u FROM ({_mixed_sql(second, 'x')})),
choice AS (SELECT id, u FROM uniform WHERE stream = -1),
tried AS (SELECT id, stream, attempt, max(u) FILTER (k = 1) AS u, max(u) FILTER (k = 2) AS w, max(u) FILTER (k = 3) AS a
  FROM uniform WHERE stream >= 0 AND attempt >= 0 GROUP BY ALL),
shaped AS (SELECT DISTINCT i.id, s.stream, CASE s.stream {shape} END AS shape FROM {ids} i, (VALUES {', '.join(f'({s})' for s in shapes)}) s(stream)
  {'JOIN choice c ON c.id = i.id' if choices else ''}),
normal AS (SELECT t.*, shape, CASE WHEN shape < 1 THEN shape + 1 ELSE shape END - 1 / 3.0 AS d, sqrt(-2 * ln(u)) * cos(2 * pi() * w) AS x
  FROM tried t JOIN shaped s ON s.id = t.id AND s.stream = t.stream),
cubed AS (SELECT *, pow(1 + x / sqrt(9 * d), 3) AS v FROM normal),
taken AS (SELECT id, stream, any_value(shape) AS shape, arg_min(d * v, attempt) AS g FROM cubed
  WHERE v > 0 AND ln(a) < 0.5 * x * x + d * (1 - v + ln(CASE WHEN v > 0 THEN v ELSE 1 END)) GROUP BY id, stream),
gamma AS (SELECT t.id, t.stream, CASE WHEN shape < 1 THEN g * pow(b.u, 1 / shape) ELSE g END AS g
  FROM taken t JOIN uniform b ON b.id = t.id AND b.stream = t.stream AND b.attempt = -1)"""
