"""Exact statistics over the small count vectors that Spark aggregates return."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from fractions import Fraction

#: Discordant pairs up to which McNemar's test is worked out in whole numbers.
EXACT = 2000


def _rest(n: int) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m)) / m) / m) / n


def _away(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by its series where x is near the mean."""
    d = (x - mean) / mean
    if abs(d) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, power, j = 0.0, d * d, 2
    while abs(power) > 1e-20 * max(total, 1e-300):
        total += power / (j * (j - 1)) * (1 if j % 2 == 0 else -1)
        power, j = power * d, j + 1
    return mean * total


def binomial_term(k: int, n: int, p: float) -> float:
    """P(X = k), 0 < p < 1, from small differences rather than large logarithms, so that large n keep their digits."""
    if k == 0 or k == n:
        return math.exp(n * (math.log1p(-p) if k == 0 else math.log(p)))
    far = _away(k, n * p) + _away(n - k, n * (1 - p))
    return math.exp(_rest(n) - _rest(k) - _rest(n - k) - far) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of Bin(n, p).

    Terms are added from the one next to k away from the mode, each from the one before, on the side of k that doesn't hold the mode, until
    they no longer count: some multiple of the standard deviation of them at most.
    """
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    below = k < (n + 1) * p
    i, odds, step = (k, (1 - p) / p, -1) if below else (k + 1, p / (1 - p), 1)
    term, terms = binomial_term(i, n, p), []
    while term > 0 and 0 <= i <= n:
        terms.append(term)
        if term < terms[0] * 1e-18:
            break
        term *= odds * (i / (n - i + 1) if below else (n - i) / (i + 1))
        i += step
    total = math.fsum(terms)
    return min(1.0, total) if below else max(0.0, 1 - total)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of Bin(n, p)."""
    if k <= 0:
        return 1.0
    return binomial_cdf(n - k, n, 1 - p)  # of the failures, so that small tails keep their digits


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """One-sided lower and upper limits, each at level alpha, by bisection on the distribution function."""

    def solve(too_high) -> float:  # noqa: ANN001
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if too_high(mid) else (mid, high)
        return (low + high) / 2

    upper = 1.0 if k == n else solve(lambda p: binomial_cdf(k, n, p) < alpha)
    lower = 0.0 if k == 0 else solve(lambda p: 1 - binomial_cdf(k - 1, n, p) > alpha)
    return lower, upper


def wilson(k: int, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    """Limits of a share; of no items it may be anything."""
    if not n:
        return 0.0, 1.0
    p, d = k / n, 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / d, (mid + half) / d


def mcnemar(only_a: int, only_b: int) -> float:
    """Two-sided exact p of the discordant counts; above EXACT of them from the distribution function, to its digits."""
    n = only_a + only_b
    if not n:
        return 1.0
    if n > EXACT:
        return min(1.0, 2 * binomial_cdf(min(only_a, only_b), n, 0.5))
    tail = sum(math.comb(n, i) for i in range(min(only_a, only_b) + 1))
    return float(min(Fraction(1), Fraction(2 * tail, 2**n)))


def bootstrap_ratio(both: int, only_a: int, only_b: int, neither: int, resamples: int = 10_000, alpha: float = 0.05, seed: int = 1234) -> tuple[float, float, float]:
    """Point and percentile limits of accuracy(a) / accuracy(b) over paired items: items are resampled jointly, as four cells.

    Resamples in which b is never right are left out. If b is never right at all, or there are no items, there is no ratio: all three are NaN.
    """
    if not both + only_b:
        return math.nan, math.nan, math.nan
    cells, rng = (both, only_a, only_b, neither), random.Random(seed)
    n = sum(cells)
    ratios = []
    for _ in range(resamples):
        left, drawn, rest = n, [], 1.0
        for c in cells[:3]:
            x = rng.binomialvariate(left, min(1.0, c / n / rest)) if left and rest > 0 else 0
            drawn.append(x)
            left, rest = left - x, rest - c / n
        if drawn[0] + drawn[2]:
            ratios.append((drawn[0] + drawn[1]) / (drawn[0] + drawn[2]))
    ratios.sort()
    m = len(ratios)
    return (both + only_a) / (both + only_b), ratios[math.floor(alpha / 2 * m)], ratios[math.ceil((1 - alpha / 2) * m) - 1]


def promote(both: int, only_a: int, only_b: int, neither: int, least_ratio: float = 0.85, level: float = 0.05) -> bool:
    """a replaces b where it gains nothing to chance: the ratio's lower limit, the exact test, and the direction all hold."""
    return bootstrap_ratio(both, only_a, only_b, neither)[1] >= least_ratio and mcnemar(only_a, only_b) < level and only_a > only_b


def certify(curve: Sequence[tuple[float, int, int]], alpha: float, delta: float) -> float | None:
    """The lowest threshold, going down from the highest, whose risk is shown to be under alpha at level delta; stops at the first failure.

    curve: (threshold, covered, errors) by strictly falling threshold. The p-value is P(Bin(covered, alpha) <= errors).
    """
    found = None
    for (t, n, e), before in zip(curve, [None, *curve], strict=False):
        if before and t >= before[0]:
            raise ValueError("thresholds must fall")
        if not n or binomial_cdf(e, n, alpha) > delta:
            break
        found = t
    return found
