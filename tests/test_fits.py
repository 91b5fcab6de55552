"""Marginal fits in few passes."""

import math

import numpy as np

from gridloom.functions.marginals import CAP
from gridloom.operators import distributions


def test_one_sided_values_settle_at_the_bound_in_few_passes(spark):
    y = -np.log1p(-(np.arange(2000) + 0.5) / 2000) * 30
    data = spark.createDataFrame([("a", float(v)) for v in y], "g string, value double")
    r = distributions.fit_gradient(data, "g", "value", rounds=40).first()
    assert r.settled and abs(r.alpha * r.delta - CAP) < 1e-6
    law = np.array([r.alpha, r.beta, r.mu, r.delta])
    at = distributions.log_density(y, *law).sum()
    assert abs(at - r.log_likelihood) < 1e-6
    for k, step in ((1, 1e-4), (2, 1e-2), (3, None)):  # alpha * delta stays at its bound
        for sign in (1, -1):
            moved = law.copy()
            if step is None:
                moved[3] *= 1 + sign * 1e-3
                moved[0], moved[1] = CAP / moved[3], law[1] * law[3] / moved[3]
            else:
                moved[k] += sign * step
            assert distributions.log_density(y, *moved).sum() <= at + 1e-6


def test_derivatives_are_those_of_the_log_density():
    z, t = np.linspace(-2, 3, 50), np.array([1.0, 0.7, -0.5, 0.2])

    def value(u):
        alpha = math.exp(u[0] - u[3])
        return distributions.log_density(z, alpha, alpha * math.tanh(u[1]), u[2], math.exp(u[3])).sum()

    v, e = distributions._derivatives(z, t), 1e-5 * np.eye(4)
    assert abs(v[0] - value(t)) < 1e-9
    assert np.allclose(v[1:5], [(value(t + d) - value(t - d)) / 2e-5 for d in e], atol=1e-5)
    bend = [(distributions._derivatives(z, t + d) - distributions._derivatives(z, t - d))[1:5] / 2e-5 for d in e]
    assert np.allclose(v[5:], np.array(bend)[np.triu_indices(4)], atol=1e-5)
