"""Rational approximation of a function on an interval from its Chebyshev series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rational:
    """p(t) / q(t) with t the interval mapped to [-1, 1]; coefficients of Chebyshev polynomials, q's first one being 1."""

    p: np.ndarray
    q: np.ndarray
    low: float
    high: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        t = (2 * np.asarray(x) - self.low - self.high) / (self.high - self.low)
        return np.polynomial.chebyshev.chebval(t, self.p) / np.polynomial.chebyshev.chebval(t, self.q)

    def power_form(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of numerator and denominator in x, lowest power first."""
        kind, domain = np.polynomial.Polynomial, [self.low, self.high]
        return tuple(np.polynomial.Chebyshev(c, domain=domain).convert(kind=kind, domain=[-1, 1], window=[-1, 1]).coef for c in (self.p, self.q))


def chebyshev_series(f: Callable[[np.ndarray], np.ndarray], degree: int, low: float, high: float) -> np.ndarray:
    """Coefficients of the interpolant at the Chebyshev points."""
    k = np.arange(degree + 1)
    t = np.cos(np.pi * (k + 0.5) / (degree + 1))
    y = f((low + high) / 2 + (high - low) / 2 * t)
    c = 2 / (degree + 1) * np.cos(np.outer(k, np.pi * (k + 0.5) / (degree + 1))) @ y
    c[0] /= 2
    return c


def _one_sided(c: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """Numerator from the series c_0 + c_1 z + ... in place of the two-sided one: with g_s = sum_j b_j c_{s-j} for s up to max(m, n) + 1, where c is taken through
    max(m, n), p_k = sum_j b_j (g_{j+k} + g_{j-k}), g_{j-k} for k > 0 alone."""
    n, top = len(b) - 1, max(m, len(b) - 1) + 1
    c_at = lambda s: c[s] if 0 <= s < top else 0.0
    g = {s: sum(b[j] * c_at(s - j) for j in range(n + 1)) for s in range(top + 1)}
    return np.array([sum(b[j] * (g.get(j + k, 0.0) + (g.get(j - k, 0.0) if k else 0.0)) for j in range(n + 1)) for k in range(m + 1)])


def clenshaw_lord(f: Callable[[np.ndarray], np.ndarray], degree: int, domain: tuple[float, float], m: int, n: int, two_sided: bool = True) -> Rational:
    """Degrees (m, n) such that the series of p / q agrees with that of f through m + n: the approximant of Clenshaw and Lord, Rational approximations from Chebyshev series (1974).

    In z with t = (z + 1/z) / 2 the series is a two-sided one in z^k, mirrored at 0. A polynomial b(z) that makes its product with the series vanish in
    degrees m + 1 to m + n solves a Toeplitz system; q = b(z) b(1/z) is a sum of z^k + z^-k, and p is what is left of q's
    product with the series through degree m. Without ``two_sided``, p is the less accurate one of ``_one_sided``.
    """
    low, high = domain
    c = chebyshev_series(f, max(degree, m + n), low, high)
    full = lambda k: c[abs(k)] * (2.0 if k == 0 else 1.0)
    if n:
        rows = np.array([[full(m + 1 + r - j) for j in range(1, n + 1)] for r in range(n)])
        b = np.concatenate(([1.0], np.linalg.lstsq(rows, -np.array([full(m + 1 + r) for r in range(n)]), rcond=None)[0]))
    else:
        b = np.array([1.0])
    q = np.array([sum(b[i] * b[i + k] for i in range(n + 1 - k)) * (1.0 if k == 0 else 2.0) for k in range(n + 1)])
    p = np.polynomial.chebyshev.chebmul(c, q)[: m + 1] if two_sided else _one_sided(c, b, m)
    return Rational(p / q[0], q / q[0], low, high)
