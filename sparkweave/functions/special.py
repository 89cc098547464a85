"""Special functions as Column expressions, and scalar ones in Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps by which the argument is raised before Stirling's series is used.
_SHIFT = 10
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma1p(x: Column) -> Column:
    """ln of gamma(x + 1) for x >= 0, exactly 0 at 0 and 1; NaN below 0. Raised by the recurrence, then Stirling's series."""
    x = x.cast("double")
    z = x + 1
    product = F.lit(1.0)
    for i in range(_SHIFT):
        product = product * (z + i)
    y = z + _SHIFT
    series = F.lit(0.0)
    for i, c in reversed(list(enumerate(_STIRLING))):
        series = series / (y * y) + F.lit(c) if i < len(_STIRLING) - 1 else F.lit(c)
    value = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series / y - F.ln(product)
    return F.when((x == 0) | (x == 1), F.lit(0.0)).when(x < 0, F.lit(float("nan"))).otherwise(value)


def safelog(x: Column) -> Column:
    """ln x, and 0 for 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.ln(x.cast("double")))


def xlogx(x: Column) -> Column:
    return x * safelog(x)


def lbinom(n: Column, k: Column) -> Column:
    """ln of n over k; 0 where n or k is 0 or k is n or more."""
    value = lgamma1p(n) - lgamma1p(k) - lgamma1p(n - k)
    return F.when((n == 0) | (k == 0) | (k >= n), F.lit(0.0)).otherwise(value)


def log_sum_exp(a: float, b: float) -> float:
    high, low = max(a, b), min(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def log_q(n: int, k: int, exact: int = 1024) -> float:
    """ln of the number of partitions of n into at most k parts; beyond `exact` by the asymptotic form for k parts."""
    k = min(n, k)
    if n == 0:
        return 0.0
    if k < 1:
        return -math.inf
    if n <= exact:
        row = [0.0] + [-math.inf] * n
        for part in range(1, k + 1):
            for m in range(part, n + 1):
                row[m] = log_sum_exp(row[m], row[m - part])
        return row[n]
    if k < n**0.25:
        return math.lgamma(n) - math.lgamma(k) - math.lgamma(n - k + 1) - math.lgamma(k + 1)
    u = k / math.sqrt(n)
    v = u
    for _ in range(200):  # v = u sqrt(dilog(1 - exp(-v)))
        new = u * math.sqrt(max(_dilog_one_minus(math.exp(-v)), 1e-300))
        if abs(new - v) < 1e-12:
            break
        v = new
    lf = math.log(v) - math.log1p(-math.exp(-v) * (1 + u * u / 2)) / 2 - math.log(2) * 1.5 - math.log(u) - math.log(math.pi)
    g = 2 * v / u - u * math.log1p(-math.exp(-v))
    return lf - math.log(n) + math.sqrt(n) * g


def _dilog_one_minus(q: float) -> float:
    """Integral of t / (e^t - 1) from 0 to -ln q."""
    total, v = 0.0, -math.log(q) if q > 0 else 50.0
    total = math.pi**2 / 6
    term = 1.0
    for j in range(1, 400):
        term = math.exp(-j * v)
        if term < 1e-18:
            break
        total -= term * (v / j + 1 / (j * j))
    return total
