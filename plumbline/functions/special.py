"""Distribution functions for scalars on the driver: aggregates come from Spark, these turn them into p-values."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, Lentz's continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h / a


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2) if x > 0 else 1.0


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_two_sided(t: float, df: float) -> float:
    return min(1.0, 2 * t_sf(abs(t), df))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def inverse(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """Bisection; high is doubled until it brackets."""
    while cdf(high) < p:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    return inverse(lambda x: 1 - t_sf(x, df), p, 0.0, 8.0)


def simpson(f: Callable[[float], float], low: float, high: float, steps: int = 200) -> float:
    h = (high - low) / steps
    return h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(low + i * h) for i in range(steps + 1))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(Q > q) by integrating the range of k normals over the scale's distribution."""
    if q <= 0:
        return 1.0

    def range_cdf(w: float) -> float:
        density = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return k * simpson(lambda z: density(z) * (normal_cdf(z) - normal_cdf(z - w)) ** (k - 1), -8.0, 8.0 + w, 160)

    if df > 20_000:
        return max(0.0, 1 - range_cdf(q))
    log_norm = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
    spread = 8 / math.sqrt(2 * df)
    low, high = max(1e-6, 1 - spread), 1 + spread
    scale = lambda s: math.exp(log_norm + (df - 1) * math.log(s) - df * s * s / 2)
    return min(1.0, max(0.0, 1 - simpson(lambda s: scale(s) * range_cdf(q * s), low, high, 80)))


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    low, high = 0.0, 10.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - studentized_range_sf(middle, k, df) < p else (low, middle)
    return (low + high) / 2


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic p-value of the Kolmogorov-Smirnov distance with the usual small-sample correction."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k successes in n at one half."""
    k = min(k, n - k)
    return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))


def hypergeometric_pmf(a: int, row: int, column: int, total: int) -> float:
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return math.exp(choose(row, a) + choose(total - row, column - a) - choose(total, column))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    row, column, total = a + b, a + c, a + b + c + d
    own = hypergeometric_pmf(a, row, column, total)
    low, high = max(0, row + column - total), min(row, column)
    return min(1.0, sum(p for i in range(low, high + 1) if (p := hypergeometric_pmf(i, row, column, total)) <= own * (1 + 1e-7)))
