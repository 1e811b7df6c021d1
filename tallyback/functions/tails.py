"""Tail probabilities for the few rows of a test table, vectorised over a batch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

_TINY = 1e-300
_STEPS = 100_000


def gamma_upper_tail(shape: float, x: float) -> float:
    """Regularised upper incomplete gamma function by its series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + shape * math.log(x) - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1.0 / shape
        for i in range(1, _STEPS):
            term *= x / (shape + i)
            total += term
            if term < total * 1e-16:
                break
        else:
            raise ArithmeticError(f"series for shape {shape} and {x} did not settle")
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - shape
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, _STEPS):
        a = -i * (i - shape)
        b += 2
        d = a * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + a / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    else:
        raise ArithmeticError(f"continued fraction for shape {shape} and {x} did not settle")
    return scale * h


def chi_square_upper_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    def one(x: float, k: float) -> float | None:
        if x is None or k is None or math.isnan(x) or k <= 0:
            return None
        return gamma_upper_tail(k / 2, x / 2)

    return pd.Series([one(x, k) for x, k in zip(statistic, dof)], dtype="float64")


def beta_lower_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower_tail(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, _STEPS):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + numerator / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    else:
        raise ArithmeticError(f"continued fraction for {a}, {b} and {x} did not settle")
    return front * h


def _log_pmf(k: int, n: int, p: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Exact two-sided p-value: total probability of all outcomes no likelier than ``k``.

    The outcomes on the far side start where the falling probability first
    drops to that of ``k`` (relative slack 1e-7); bisection finds it, and both
    tails come from the incomplete beta function, so the cost does not grow with n.
    """
    if n == 0:
        return 1.0
    if p <= 0 or p >= 1:
        return 1.0 if k == round(n * p) else 0.0
    mode = math.floor((n + 1) * p)
    bar = _log_pmf(k, n, p) + math.log1p(1e-7)
    at_most = lambda j: 1.0 if j >= n else (0.0 if j < 0 else 1.0 - beta_lower_tail(j + 1, n - j, p))
    at_least = lambda j: 1.0 if j <= 0 else (0.0 if j > n else beta_lower_tail(j, n - j + 1, p))
    if _log_pmf(min(mode, n), n, p) <= bar:
        return 1.0
    if k < mode:
        lo, hi = mode, n + 1  # first far outcome no likelier than k
        while lo < hi:
            mid = (lo + hi) // 2
            if _log_pmf(mid, n, p) <= bar:
                hi = mid
            else:
                lo = mid + 1
        return min(1.0, at_most(k) + at_least(lo))
    lo, hi = -1, mode  # last near outcome no likelier than k
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if _log_pmf(mid, n, p) <= bar:
            lo = mid
        else:
            hi = mid - 1
    return min(1.0, at_most(lo) + at_least(k))


def binomial_p_values(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    values = [binomial_two_sided(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)]
    return pd.Series(np.asarray(values, dtype="float64"))
