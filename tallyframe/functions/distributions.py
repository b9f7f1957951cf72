"""Tail probabilities of the usual test statistics, from the standard library alone."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

_TINY = 1e-300


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b) by a continued fraction on its fast side."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or _TINY)
        c = 1 + step / c or _TINY
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def chi2_tail(x: float, df: float) -> float:
    """Above a million degrees of freedom by Wilson and Hilferty's cube root, whose error is then below 1e-6."""
    if df > 1_000_000:
        spread = 2 / (9 * df)
        return NormalDist().cdf((1 - spread - (x / df) ** (1 / 3)) / math.sqrt(spread))
    return gamma_tail(df / 2, x / 2) if df > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else (0.0 if math.isinf(t) else float("nan"))


def f_tail(f: float, df1: float, df2: float) -> float:
    if not math.isfinite(f):
        return 0.0 if f > 0 else float("nan")
    return beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def normal_two_sided(z: float) -> float:
    return 2 * NormalDist().cdf(-abs(z))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


@lru_cache(maxsize=64)
def _u_counts(m: int, n: int) -> tuple[int, ...]:
    """Number of orders of m and n values for each U, as the coefficients of the Gaussian binomial."""
    counts = [1] + [0] * (m * n)
    for k in range(1, m + 1):
        for u in range(m * n, n + k - 1, -1):
            counts[u] -= counts[u - n - k]
        for u in range(k, m * n + 1):
            counts[u] += counts[u - k]
    return tuple(counts)


def mann_whitney_exact(u: float, m: int, n: int) -> float:
    """Two-sided probability of U without ties, for all n where the smaller group has few members."""
    m, n, top = min(m, n), max(m, n), max(u, m * n - u)
    counts = _u_counts(m, n)
    return min(1.0, 2 * sum(counts[math.ceil(top) :]) / math.comb(m + n, m))
