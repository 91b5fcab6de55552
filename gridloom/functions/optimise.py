"""A minimiser for costs that a Spark job returns, such as a model's negative log-likelihood: a few numbers on the driver, no slopes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nelder_mead(cost: Callable[[np.ndarray], float], start: np.ndarray, step: float | np.ndarray = 0.1, tolerance: float = 1e-6, most: int = 500) -> tuple[np.ndarray, float, bool]:
    """(point, cost, whether the simplex shrank below ``tolerance``) after ``most`` evaluations at most. A cost that is not a number counts as infinite."""
    start = np.asarray(start, float)
    n, used = len(start), 0

    def f(x: np.ndarray) -> float:
        nonlocal used
        used += 1
        y = float(cost(x))
        return y if y == y else np.inf

    points = np.concatenate((start[None], start + np.diag(np.broadcast_to(step, n))))
    values = np.array([f(x) for x in points])
    while True:
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        small = np.abs(points[1:] - points[0]).max() <= tolerance
        if small or used >= most:
            return points[0], float(values[0]), bool(small)
        centre = points[:-1].mean(axis=0)
        away = centre - points[-1]
        x, y = centre + away, f(centre + away)
        if y < values[0]:
            further = f(centre + 2 * away)
            x, y = (centre + 2 * away, further) if further < y else (x, y)
        elif y >= values[-2]:
            x = centre + (0.5 if y < values[-1] else -0.5) * away
            y = f(x)
            if y >= values[-1]:
                points[1:] = (points[1:] + points[0]) / 2
                values[1:] = [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = x, y
