"""Test statistics from small aggregates: contingency tables, rank sums, group moments."""

from __future__ import annotations

import math

from tallyframe.functions.distributions import chi2_tail, f_tail, mann_whitney_exact, normal_two_sided, t_two_sided


def chi_square(cells: dict) -> dict:
    """Independence of rows and columns from {(row, column): count}; 2 x 2 tables get Yates' correction."""
    rows, columns = sorted({r for r, _ in cells}, key=repr), sorted({c for _, c in cells}, key=repr)
    total = sum(cells.values())
    of_row = {r: sum(cells.get((r, c), 0) for c in columns) for r in rows}
    of_column = {c: sum(cells.get((r, c), 0) for r in rows) for c in columns}
    df = (len(rows) - 1) * (len(columns) - 1)
    x = 0.0
    for r in rows:
        for c in columns:
            expected = of_row[r] * of_column[c] / total
            gap = abs(cells.get((r, c), 0) - expected)
            if df == 1:
                gap -= min(0.5, gap)
            x += gap * gap / expected
    return independence_test(x, total, len(rows), len(columns))


def independence_test(x: float, total: int, rows: int, columns: int) -> dict:
    """The test of a table from its chi-square; a table without cells, or with one row or column, shows no dependence."""
    df = max(0, (rows - 1) * (columns - 1))
    if total == 0 or df == 0:
        x = 0.0
    return {"chi2": x, "p_value": chi2_tail(x, df), "dof": df, "n": total, "shape": (rows, columns)}


def cramers_v(test: dict) -> float:
    least = min(test["shape"]) - 1
    return math.sqrt(test["chi2"] / (test["n"] * least)) if test["n"] > 0 and least > 0 else 0.0


def phi(test: dict) -> float:
    if test["shape"] != (2, 2):
        raise ValueError("phi needs a 2 x 2 table")
    return math.sqrt(test["chi2"] / test["n"]) if test["n"] else 0.0


def kruskal_wallis(squares: float, k: int, n: float, ties: float) -> tuple[float, float]:
    """H with tie correction and its probability, from the groups' sum of squared rank sums by count and their number."""
    h = 12 / (n * (n + 1)) * squares - 3 * (n + 1)
    correction = 1 - ties / (n**3 - n) if n > 1 else 0.0
    if correction <= 0:
        return float("nan"), float("nan")
    return h / correction, chi2_tail(h / correction, k - 1)


def mann_whitney(groups: list, n: float, ties: float) -> tuple[float, float]:
    """U of the first group and its two-sided probability: exact for a group of 8 or fewer without ties, else normal."""
    (_, m, r), (_, k, _) = groups
    u = r - m * (m + 1) / 2
    if min(m, k) <= 8 and ties == 0:
        return u, mann_whitney_exact(u, int(m), int(k))
    spread = math.sqrt(m * k / 12 * ((n + 1) - ties / (n * (n - 1))))
    if spread == 0:
        return u, 1.0
    z = (max(u, m * k - u) - m * k / 2 - 0.5) / spread
    return u, min(1.0, normal_two_sided(z) if z > 0 else 1.0)


def pooled_t(a: tuple, b: tuple) -> tuple[float, float]:
    """t and its two-sided probability from two (count, mean, sample variance)."""
    (n, x, v), (m, y, w) = a, b
    df = n + m - 2
    pooled = ((n - 1) * (v or 0.0) + (m - 1) * (w or 0.0)) / df if df > 0 else 0.0
    se = math.sqrt(pooled * (1 / n + 1 / m))
    t = (x - y) / se if se else (math.copysign(math.inf, x - y) if x != y else float("nan"))
    return t, t_two_sided(t, df)


def one_way_anova(between: float, within: float, n: int, k: int) -> tuple[float, float]:
    """F and its probability from the sums of squares between and within k groups of n values in all."""
    between, within = between / (k - 1), within / (n - k) if n > k else 0.0
    f = between / within if within else (math.inf if between else float("nan"))
    return f, f_tail(f, k - 1, n - k)


def spearman_p(rho: float, n: int) -> float:
    if n < 3:
        return float("nan") if n else 1.0
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
