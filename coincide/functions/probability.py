"""ST02 / ST04 / ST05: exact tail probabilities, one summary row per case and width.

Spark has no ``lgamma`` or ``erfc``, so these scalars are computed in one Arrow-batched function
on rows that are already aggregated. Tails are summed from the observed value away from the mode
by term ratios, which stops after a few standard deviations however large the counts are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_SMALLEST = 5e-324
_BLOCK = 4096


def _geometric_like_sum(ratio, steps: int) -> float:
    """1 + r(0) + r(0)r(1) + ... for ratios that fall below one; ``steps`` terms at most."""
    total, term, done = 1.0, 1.0, 0
    while done < steps and term > 0.0:
        i = np.arange(done, min(done + _BLOCK, steps), dtype=float)
        terms = term * np.cumprod(ratio(i))
        total += float(terms.sum())
        term, done = float(terms[-1]), done + len(i)
        if term < total * 1e-18:
            break
    return total


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _bounded(log_first: float, series: float) -> float:
    exponent = log_first + math.log(series)
    return min(max(math.exp(exponent) if exponent > -744 else 0.0, _SMALLEST), 1.0)


def binomial_tail(k: int, n: int, p: float) -> float | None:
    """P(X >= k) for X ~ Binomial(n, p)."""
    if n == 0:
        return None
    if k <= 0 or p >= 1.0:
        return 1.0
    if p <= 0.0:
        return _SMALLEST
    odds = p / (1.0 - p)

    def log_pmf(x: int) -> float:
        return _log_choose(n, x) + x * math.log(p) + (n - x) * math.log1p(-p)

    if k > (n + 1) * p:
        up = _geometric_like_sum(lambda i: (n - k - i) / (k + i + 1) * odds, n - k)
        return _bounded(log_pmf(k), up)
    below = k - 1
    down = _geometric_like_sum(lambda i: (below - i) / (n - below + i + 1) / odds, below)
    return max(1.0 - _bounded(log_pmf(below), down), _SMALLEST)


def fisher_tail(a: int, b: int, c: int, d: int) -> float:
    """One-sided Fisher exact p: tables with the same margins and at least ``a``."""
    row, rest, col = a + b, c + d, a + c
    total = row + rest
    if min(row, rest, col, total - col) == 0:
        return 1.0
    least, most = max(0, col - rest), min(row, col)

    def log_pmf(x: int) -> float:
        return _log_choose(row, x) + _log_choose(rest, col - x) - _log_choose(total, col)

    if a <= least:
        return 1.0
    if a > (row + 1) * (col + 1) / (total + 2):
        up = _geometric_like_sum(
            lambda i: (row - a - i) * (col - a - i) / ((a + i + 1) * (rest - col + a + i + 1)),
            most - a,
        )
        return _bounded(log_pmf(a), up)
    x = a - 1
    down = _geometric_like_sum(
        lambda i: (x - i) * (rest - col + x - i) / ((row - x + i + 1) * (col - x + i + 1)),
        x - least,
    )
    return max(1.0 - _bounded(log_pmf(x), down), _SMALLEST)


@F.pandas_udf(DoubleType())
def _binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(x), int(y), float(z)) for x, y, z in zip(k, n, p)])


@F.pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_tail(*map(int, cells)) for cells in zip(a, b, c, d)])


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def binomial_p(hits: Column, n: Column, p0: Column) -> Column:
    """ST02; NULL when there are no anchors."""
    return _binomial(hits, n, p0)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ST04."""
    return _fisher(a, b, c, d)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sample odds ratio: infinite without counter-examples, NULL when undefined."""
    margins = (a + b) * F.lit(1.0) * (c + d) * (a + c) * (b + d)
    cross = b.cast("double") * c
    return (
        F.when(margins == 0, F.lit(None).cast("double"))
        .when(cross > 0, F.try_divide(a.cast("double") * d, cross))
        .when(a.cast("double") * d > 0, F.lit(float("inf")))
    )


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ST05: Yates-corrected, one degree of freedom; NULL with an empty margin."""
    total = (a + b + c + d).cast("double")
    margins = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    excess = F.greatest(
        F.abs(a.cast("double") * d - b.cast("double") * c) - total / 2, F.lit(0.0)
    )
    return F.when(margins > 0, F.try_divide(excess * excess * total, margins))


def chi_square_p(chi2: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return _erfc(F.sqrt(chi2 / 2))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """AGG13: Wilson score interval of a share."""
    p = F.try_divide(successes.cast("double"), n)
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = (z / scale) * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    low = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(centre - half, F.lit(0.0)))
    high = F.when(n == 0, F.lit(1.0)).otherwise(F.least(centre + half, F.lit(1.0)))
    return low, high
