"""Marginal distributions as column expressions: Box-Cox and the normal-inverse-Gaussian (NIG) law."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.special import log_bessel_k

_ZERO = 100 * 2.220446049250313e-16
#: Largest alpha * delta of a fitted law; beyond it the law is as good as Gaussian.
CAP = 100.0


def box_cox(x: Column, power: Column | float) -> Column:
    """(x^p - 1) / p, log x where p is 0 within rounding; null for x <= 0."""
    p = F.lit(power) if not isinstance(power, Column) else power
    return F.when(x > 0, F.when(F.abs(p) <= _ZERO, F.log(x)).otherwise((F.pow(x, p) - 1) / p))


def box_cox_slope(x: Column, power: Column | float) -> Column:
    """Derivative of ``box_cox`` by the power: (x^p (p log x - 1) + 1) / p^2, half the squared log at 0."""
    p = F.lit(power) if not isinstance(power, Column) else power
    return F.when(x > 0, F.when(F.abs(p) <= _ZERO, F.pow(F.log(x), 2.0) / 2).otherwise((F.pow(x, p) * (p * F.log(x) - 1) + 1) / (p * p)))


def box_cox_inverse(y: Column, power: Column | float) -> Column:
    p = F.lit(power) if not isinstance(power, Column) else power
    return F.when(F.abs(p) <= _ZERO, F.exp(y)).when(p * y + 1 > 0, F.pow(p * y + 1, 1 / p))


def nig_log_pdf(y: Column, alpha: Column, beta: Column, mu: Column, delta: Column) -> Column:
    """Log density; an infinite alpha is the Gaussian with mean mu and standard deviation delta."""
    a, b, x = alpha * delta, beta * delta, (y - mu) / delta
    q = F.sqrt(1 + x * x)
    body = F.log(a / math.pi) + F.sqrt(a * a - b * b) + b * x - F.log(q) + log_bessel_k(1.0, a * q) - F.log(delta)
    gauss = -0.5 * x * x - F.log(delta) - 0.5 * math.log(2 * math.pi)
    return F.when(alpha == float("inf"), gauss).otherwise(body)


def nig_log_pdf_of_log(y: Column, alpha: Column, beta: Column, mu: Column, delta: Column) -> Column:
    """For a variable whose logarithm is NIG."""
    return F.when(y > 0, nig_log_pdf(F.log(y), alpha, beta, mu, delta) - F.log(y))


def nig_tail_log_pdf(y: Column, alpha: Column, beta: Column, mu: Column, delta: Column) -> Column:
    """Limit of the log density far out: the Bessel function replaced by its leading term."""
    a, b, x = alpha * delta, beta * delta, (y - mu) / delta
    q = F.sqrt(1 + x * x)
    return F.log(a / math.pi) + F.sqrt(a * a - b * b) + b * x - F.log(q) + 0.5 * F.log(math.pi / (2 * a * q)) - a * q - F.log(delta)


def nig_statistics(alpha: Column, beta: Column, mu: Column, delta: Column) -> dict[str, Column]:
    """mean, variance, sd, skewness and excess kurtosis from the parameters."""
    gauss = alpha == float("inf")
    g = F.sqrt(alpha * alpha - beta * beta)
    variance = F.when(gauss, delta * delta).otherwise(delta * alpha * alpha / (g * g * g))
    return {
        "mean": F.when(gauss, mu).otherwise(mu + delta * beta / g),
        "variance": variance,
        "sd": F.sqrt(variance),
        "skewness": F.when(gauss, 0.0).otherwise(3 * beta / (alpha * F.sqrt(delta * g))),
        "kurtosis": F.when(gauss, 0.0).otherwise(3 * (1 + 4 * beta * beta / (alpha * alpha)) / (delta * g)),
    }


def nig_shift(params: dict[str, Column], by: Column | float, scale: Column | float, scale_location: bool = True) -> dict[str, Column]:
    """Law of scale * Y + by; with ``scale_location`` off the location is moved but not scaled (shape a, b of the standard form stay)."""
    mu = params["mu"] * scale + by if scale_location else params["mu"] + by
    return {"alpha": params["alpha"] / scale, "beta": params["beta"] / scale, "mu": mu, "delta": params["delta"] * scale}


def nig_cap(alpha: Column, beta: Column, delta: Column) -> dict[str, Column]:
    """alpha * delta held at ``CAP`` by scaling alpha and beta alike."""
    scale = F.when(alpha * delta > CAP, CAP / (alpha * delta)).otherwise(1.0)
    return {"alpha": alpha * scale, "beta": beta * scale, "delta": delta}


def nig_by_moments(mean: Column, variance: Column, skewness: Column, kurtosis: Column) -> dict[str, Column]:
    """Parameters from moments (kurtosis in excess). A kurtosis of 0 or less counts as 0.1; where 3 k < 5 s^2 no NIG law fits, and
    the symmetric one with k = 2 s^2 is taken. alpha * delta is capped."""
    k = F.when(kurtosis <= 0, 0.1).otherwise(kurtosis)
    poor = 3 * k < 5 * skewness * skewness
    k = F.when(poor, 2 * skewness * skewness).otherwise(k)
    s = F.when(poor, 0.0).otherwise(skewness)
    # With rho = 3 k / s^2 - 4 > 1: delta gamma = 9 / (3 k - 5 s^2 + s^2) scaled; solved for steepness z = delta * gamma.
    z = 3 / (k - 4.0 / 3.0 * s * s)
    chi = s * F.sqrt(z) / 3
    a_over_g = 1 / F.sqrt(1 - chi * chi)
    delta = F.sqrt(variance * z) / a_over_g
    g = z / delta
    alpha, beta = g * a_over_g, g * a_over_g * chi
    capped = nig_cap(alpha, beta, delta)
    return {"alpha": capped["alpha"], "beta": capped["beta"], "mu": mean - delta * beta / g, "delta": delta}


def nig_gauss(mean: Column, variance: Column) -> dict[str, Column]:
    """The Gaussian as a NIG law with alpha * delta at the cap."""
    sd = F.sqrt(variance)
    return {"alpha": math.sqrt(CAP) / sd, "beta": F.lit(0.0) * sd, "mu": mean, "delta": math.sqrt(CAP) * sd}
