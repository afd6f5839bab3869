"""DuckDB SQL of the smoothers, written from their definitions: bases by recurrence, solves by elimination."""

from __future__ import annotations

from collections.abc import Iterable


def values(rows: Iterable[tuple], names: str) -> str:
    """A table of literal rows."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(f'{x!r}::double' if isinstance(x, float) else str(x) for x in r) + ')' for r in rows)}) AS v({names}))"


def _knot(i: str) -> str:
    return f"greatest(0.0::double, least(1.0::double, ({i} - 3) / (n - 3)::double))"


def splines(terms: Iterable[int], steps: int, name: str = "b", places: str | None = None) -> str:
    """name(n, t, k, v): n clamped uniform cubic B-splines on ``steps`` points of [0, 1], by the Cox-de Boor recurrence.

    ``places`` is a table (t, x) of other points.
    """
    share = lambda top, low, x: f"CASE WHEN {_knot(top)} > {_knot(low)} THEN {x} / ({_knot(top)} - {_knot(low)}) ELSE 0 END"
    grid = places or f"(SELECT t, t / {steps - 1}.0::double AS x FROM (SELECT unnest(range({steps})) AS t))"
    return f"""{name}0(d, n, t, x, k, v) AS (
SELECT 0, n, t, x, k, CASE WHEN (x < 1 AND x >= {_knot('k')} AND x < {_knot('(k + 1)')}) OR (x >= 1 AND k = n - 1) THEN 1.0::double ELSE 0 END
FROM (SELECT unnest({list(terms)}) AS n), {grid}, (SELECT unnest(range({max(terms) + 3})) AS k) WHERE k < n + 3
UNION ALL
SELECT d + 1, n, t, x, k, {share('(k + d + 1)', 'k', f"(x - {_knot('k')})")} * v + {share('(k + d + 2)', '(k + 1)', f"({_knot('(k + d + 2)')} - x)")} * u
FROM (SELECT *, lead(v) OVER (PARTITION BY n, t ORDER BY k) AS u FROM {name}0) WHERE d < 3 AND u IS NOT NULL),
{name} AS (SELECT n, t, k, v FROM {name}0 WHERE d = 3)"""


def legendre(terms: int, steps: int) -> str:
    """b(n, t, k, v): Legendre polynomials on [-1, 1], by their three-term recurrence."""
    return f"""b0(t, k, x, v, w) AS (
SELECT t, 0, 2 * t / {steps - 1}.0::double - 1, 1.0::double, 0.0::double FROM (SELECT unnest(range({steps})) AS t)
UNION ALL SELECT t, k + 1, x, ((2 * k + 1) * x * v - k * w) / (k + 1), v FROM b0 WHERE k < {terms - 1}),
b AS (SELECT {terms} AS n, t, k, v FROM b0)"""


def fourier(frequencies: int, steps: int, first: str = "cos", name: str = "b") -> str:
    """name(n, t, k, v): 1, then ``first`` and the other of sine and cosine of each frequency."""
    odd, even = ("cos", "sin") if first == "cos" else ("sin", "cos")
    angle = f"2 * pi() * ((k + 1) // 2) * t / {steps - 1}"
    return f"""{name} AS (SELECT {frequencies} AS n, t, k, CASE WHEN k = 0 THEN 1.0::double WHEN k % 2 = 1 THEN {odd}({angle}) ELSE {even}({angle}) END AS v
FROM (SELECT unnest(range({steps})) AS t), (SELECT unnest(range({2 * frequencies + 1})) AS k))"""


#: Of two splines: the sum of products of second differences, over the places where both have one.
DIFFERENCES = "coalesce((SELECT sum(list_extract([1, -2, 1], (i - r + 1)::int) * list_extract([1, -2, 1], (j - r + 1)::int)) FROM (SELECT unnest(range(64)) AS r) WHERE r <= n - 3 AND i - r BETWEEN 0 AND 2 AND j - r BETWEEN 0 AND 2), 0)"
CURVATURES = "CASE WHEN i = j AND i > 0 THEN pow(2 * pi() * ((i + 1) // 2), 4) ELSE 0 END"


def projector(grid: str = "(SELECT DISTINCT n, 0.0::double AS lam FROM b)", penalty: str = "0") -> str:
    """pj(n, lam, k, t, v): (B'B + lam P)^-1 B' of the basis b for each row (n, lam) of ``grid``, by Gauss-Jordan steps."""
    return f"""gd AS (SELECT * FROM {grid}),
ij AS (SELECT *, {penalty} AS p FROM (SELECT x.n, x.k AS i, y.k AS j, sum(x.v * y.v) AS s FROM b x JOIN b y ON x.n = y.n AND x.t = y.t GROUP BY ALL)),
nm AS (SELECT n, lam, list(r ORDER BY i) AS m FROM (SELECT n, lam, i, list(s + lam * p ORDER BY j) || list(CASE WHEN i = j THEN 1.0::double ELSE 0 END ORDER BY j) AS r FROM ij JOIN gd USING (n) GROUP BY n, lam, i) GROUP BY n, lam),
gj(q, n, lam, m) AS (SELECT 1, n, lam, m FROM nm UNION ALL
SELECT q + 1, n, lam, list_transform(m, lambda r, i: CASE WHEN i = q THEN list_transform(r, lambda x: x / r[q]) ELSE list_transform(r, lambda x, j: x - r[q] * m[q][j] / m[q][q]) END) FROM gj WHERE q <= len(m)),
iv AS (SELECT n, lam, i - 1 AS i, unnest(range(len(r) // 2)) AS j, unnest(r[len(r) // 2 + 1 :]) AS v FROM (SELECT n, lam, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS r FROM gj WHERE q = len(m) + 1)),
pj AS (SELECT iv.n, lam, iv.i AS k, b.t, sum(iv.v * b.v) AS v FROM iv JOIN b ON b.n = iv.n AND b.k = iv.j GROUP BY ALL)"""


#: Coefficients of the curves p(s, f, t, v).
COEFFICIENTS = "co AS (SELECT s, f, k, sum(pj.v * p.v) AS c FROM p JOIN pj USING (t) GROUP BY ALL)"


def scores(steps: int) -> str:
    """(terms, lam, df, gcv) of the smoothers B (B'B + lam P)^-1 B' over the curves p."""
    return f""", h AS (SELECT pj.n, lam, b.t AS i, pj.t AS j, sum(b.v * pj.v) AS v FROM b JOIN pj USING (n, k) GROUP BY ALL),
df AS (SELECT n, lam, sum(v) AS df FROM h WHERE i = j GROUP BY ALL),
cv AS (SELECT a.t AS i, c.t AS j, sum(a.v * c.v) AS v FROM p a JOIN p c ON a.s = c.s AND a.f = c.f GROUP BY ALL), cn AS (SELECT count(DISTINCT (s, f)) AS c FROM p),
re AS (SELECT n, lam, i, j, CASE WHEN i = j THEN 1.0::double ELSE 0 END - v AS v FROM h),
rs AS (SELECT x.n, x.lam, sum(x.v * u.v) AS rss FROM re x JOIN (SELECT re.n, re.lam, re.i, cv.j, sum(re.v * cv.v) AS v FROM re JOIN cv ON re.j = cv.i GROUP BY ALL) u ON x.n = u.n AND x.lam = u.lam AND x.i = u.i AND x.j = u.j GROUP BY ALL)
SELECT n AS terms, lam, round(df, 6) AS df, round({steps} * rss / c / ({steps} - df) / ({steps} - df), 3) AS gcv FROM rs JOIN df USING (n, lam), cn"""


def wavelet(levels: int, steps: int, low: tuple[float, ...]) -> str:
    """Levels of the curves p: a1, d1, a2, d2, ... (s, f, k, v), by sums of the filter over the mirrored signal."""
    w = len(low)
    taps = values(((m, low[m], low[w - 1 - m] * (-1.0) ** (m + 1)) for m in range(w)), "m, lo, hi")
    out, n = [f"tp AS {taps}", "a0 AS (SELECT s, f, t AS k, v FROM p)"], steps
    for lv in range(1, levels + 1):
        size = (n + w - 1) // 2
        at = f"((2 * o.k + 1 - m) % {2 * n} + {2 * n}) % {2 * n}"
        place = f"CASE WHEN {at} < {n} THEN {at} ELSE {2 * n - 1} - ({at}) END"
        out.append(f"x{lv} AS (SELECT s, f, o.k, sum(lo * a.v) AS a, sum(hi * a.v) AS d FROM (SELECT unnest(range({size})) AS k) o, tp JOIN a{lv - 1} a ON a.k = {place} GROUP BY ALL)")
        out += [f"a{lv} AS (SELECT s, f, k, a AS v FROM x{lv})", f"d{lv} AS (SELECT s, f, k, d AS v FROM x{lv})"]
        n = size
    return ", ".join(out)


def unwavelet(levels: int, steps: int, low: tuple[float, ...], cut: str, key: str = "s, f") -> str:
    """z0(key, k, v): the signal from shrunk levels; ``cut`` names (key, level, k, a, d) with a on the last level alone."""
    w, sizes = len(low), [steps]
    for _ in range(levels):
        sizes.append((sizes[-1] + w - 1) // 2)
    taps = values(((m, low[w - 1 - m], low[m] * (-1.0) ** (w - m)) for m in range(w)), "m, lo, hi")
    out = [f"ts AS {taps}", f"z{levels} AS (SELECT {key}, k, a AS v FROM {cut} WHERE level = {levels})"]
    for lv in range(levels, 0, -1):
        n = sizes[lv]
        out.append(f"z{lv - 1} AS (SELECT {key}, k2 AS k, sum(v) AS v FROM (SELECT {key}, 2 * z.k + m - {w - 2} AS k2, lo * z.v AS v FROM z{lv} z, ts WHERE z.k < {n} UNION ALL SELECT {key}, 2 * k + m - {w - 2}, hi * d FROM {cut}, ts WHERE level = {lv}) WHERE k2 BETWEEN 0 AND {2 * n - w + 1} GROUP BY ALL)")
    return ", ".join(out)
