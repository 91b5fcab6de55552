"""Special functions as column expressions: Spark has none of them built in."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of Lanczos' series for the Gamma function (g = 7, 9 terms).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Fixed values of the rational approximation to the normal quantile by P. J. Acklam: centre (a/b) and tails (c/d).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
#: The Bessel function: terms of the series up to 2, points of the trapezoid beyond.
TERMS, POINTS = 14, 20


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def log_gamma(x: Column) -> Column:
    """Natural log of Gamma for x > 0; null otherwise."""
    z = x - 1.0
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], start=1):
        series = series + c / (z + float(k))
    t = z + 7.5
    return F.when(x > 0, 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series))


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal: a series near 0, Laplace's continued fraction in the tails."""
    a = F.abs(x)
    square = a * a
    centre = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, k: F.struct((s["term"] * square / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * square / (2 * k + 1)).alias("sum")),
        lambda s: s["sum"],
    )
    density = F.exp(-square / 2) / math.sqrt(2 * math.pi)
    tail = a
    for k in range(40, 0, -1):
        tail = a + k / tail
    upper = F.when(a < 3.5, 0.5 - density * a * centre).otherwise(density / F.greatest(tail, F.lit(1e-300)))
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """Inverse of ``normal_cdf``: a rational guess (relative error 1e-9). 0 and 1 give infinities; null outside."""
    q = p - 0.5
    r = q * q
    centre = _horner(r, QUANTILE_A) * q / (_horner(r, (*QUANTILE_B, 1.0)))

    def tail(x: Column) -> Column:
        s = F.sqrt(-2 * F.log(F.greatest(x, F.lit(1e-300))))
        return _horner(s, QUANTILE_C) / _horner(s, (*QUANTILE_D, 1.0))

    return (
        F.when(p == 0, float("-inf")).when(p == 1, float("inf")).when((p > 0) & (p < 0.02425), tail(p)).when((p > 0) & (p <= 1 - 0.02425), centre).when((p > 0) & (p < 1), -tail(1 - p))
    )


def _near_zero(mu: float) -> tuple[list[float], ...]:
    """Coefficients in (x / 2)^2 of what multiplies f_0, p_0 and q_0 in Temme's series for K_mu and for x K_(mu+1) / 2, |mu| <= 1/2.

    f_k = (k f_(k-1) + p_(k-1) + q_(k-1)) / (k^2 - mu^2), p_k = p_(k-1) / (k - mu), q_k = q_(k-1) / (k + mu) are linear in their first
    members; K_mu sums f_k and x K_(mu+1) / 2 sums p_k - k f_k, each over (x / 2)^(2k) / k!.
    """
    f, p, q = (1.0, 0.0, 0.0), 1.0, 1.0
    sums: tuple[list[float], ...] = ([], [], [], [], [], [])
    for k in range(TERMS + 1):
        if k:
            f = (k * f[0] / (k * k - mu * mu), (k * f[1] + p) / (k * k - mu * mu), (k * f[2] + q) / (k * k - mu * mu))
            p, q = p / (k - mu), q / (k + mu)
        for i, c in enumerate((*f, -k * f[0], p - k * f[1], -k * f[2])):
            sums[i].append(c / math.factorial(k))
    return sums


def _bessel_near_zero(order: float, x: Column) -> Column:
    """exp(x) K_order(x) for 0 < x <= 2: Temme's series at the order's fraction, then upward recurrence."""
    up = math.floor(order + 0.5)
    mu = order - up
    if abs(mu) < 1e-4:  # Euler's constant and the next term of 1 / Gamma's series
        g1 = -(0.5772156649015329 - 0.0420026350340952 * mu * mu)
    else:
        g1 = (1 / math.gamma(1 - mu) - 1 / math.gamma(1 + mu)) / (2 * mu)
    g2 = (1 / math.gamma(1 - mu) + 1 / math.gamma(1 + mu)) / 2
    log = F.log(2 / x)
    s = mu * log
    ratio = F.lit(1.0) if mu == 0 else F.when(F.abs(s) < 1e-5, 1 + s * s / 6).otherwise(F.sinh(s) / s)
    angle = math.pi * mu
    f0 = (angle / math.sin(angle) if mu else 1.0) * (g1 * F.cosh(s) + g2 * ratio * log)
    p0, q0 = 0.5 * math.gamma(1 + mu) * F.exp(s), 0.5 * math.gamma(1 - mu) * F.exp(-s)
    sums, z = _near_zero(mu), x * x / 4
    low, high = (sum((c * _horner(z, tuple(t[::-1])) for c, t in zip((f0, p0, q0), part, strict=True)), F.lit(0.0)) for part in (sums[:3], sums[3:]))
    high = high * 2 / x
    for k in range(1, up):
        low, high = high, low + (2 * (mu + k) / x) * high
    return F.exp(x) * (low if up == 0 else high)


def _bessel_far(order: float, x: Column) -> Column:
    """exp(x) K_order(x) for x >= 2: trapezoid of exp(-x (cosh t - 1)) cosh(order t), up to where that is below exp(-38)."""
    y = (38 + 2 * order * order) / x
    step = F.log(1 + y + F.sqrt(y * (y + 2))) / POINTS
    points = F.array(*[F.lit(float(k)) for k in range(1, POINTS + 1)])
    total = F.aggregate(F.transform(points, lambda k: k * step), F.lit(0.5), lambda s, t: s + F.exp(-x * (F.cosh(t) - 1)) * F.cosh(t * order))
    return step * total


def scaled_bessel_k(order: float, x: Column) -> Column:
    """exp(x) K_order(x) for x > 0, null otherwise; order >= 0. Half-integer orders are finite sums."""
    half = order - 0.5
    if half == int(half):
        n = int(half)
        inner = _horner(1 / x, tuple(math.factorial(n + k) / (math.factorial(k) * math.factorial(n - k) * 2.0**k) for k in range(n, -1, -1)))
        return F.when(x > 0, F.sqrt(math.pi / (2 * x)) * inner)
    return F.when(x > 2, _bessel_far(order, x)).when(x > 0, _bessel_near_zero(order, x))


def log_bessel_k(order: float, x: Column) -> Column:
    return F.log(scaled_bessel_k(order, x)) - x


def matern(h: Column, order: float) -> Column:
    """Matern correlation at scaled distance h = kappa * distance: closed forms at 1/2, 3/2, 5/2, else by the Bessel function, or, below 1e-8, its first terms there:
    1 - Gamma(1 - order) / Gamma(1 + order) * (h / 2)^(2 order), which is 1 for orders from 1 on."""
    if order == 0.5:
        return F.exp(-h)
    if order == 1.5:
        return (1 + h) * F.exp(-h)
    if order == 2.5:
        return (1 + h + h * h / 3) * F.exp(-h)
    scale = 2 ** (1 - order) / math.gamma(order)
    body = scale * F.pow(h, F.lit(order)) * scaled_bessel_k(order, h) * F.exp(-h)
    near = 1 - math.gamma(1 - order) / math.gamma(1 + order) * F.pow(h / 2, F.lit(2.0 * order)) if order < 1 else F.lit(1.0)
    return F.when(h < 1e-8, near).otherwise(body)


def matern_by_range(distance: Column, order: float, range_: Column | float) -> Column:
    """kappa = sqrt(8 order) / range."""
    return matern(distance * math.sqrt(8 * order) / range_, order)


def matern_derivatives(distance: Column, order: float, kappa: Column) -> tuple[Column, Column]:
    """Derivatives of the correlation by order (central difference, relative step 1e-4) and by kappa (-distance h^order K_{order-1}(h) 2^(1-order)/Gamma(order))."""
    step = 1e-4 * order
    by_order = (matern(distance * kappa, order + step) - matern(distance * kappa, order - step)) / (2 * step)
    h = distance * kappa
    scale = 2 ** (1 - order) / math.gamma(order)
    by_kappa = F.when(h < 1e-8, 0.0).otherwise(-distance * scale * F.pow(h, F.lit(order)) * scaled_bessel_k(abs(order - 1), h) * F.exp(-h))
    return by_order, by_kappa
