"""Triangulation and linear resampling against brute force, on uneven, regular and degenerate places."""

from pathlib import Path

import numpy as np

from gridloom.operators import triangulate
from gridloom.operators.triangulate import delaunay, resampled_linear

DATA = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else float(x), float(y), None if v is None else float(v)) for i, x, y, v in rows], "point_id long, px double, py double, value double")


def by_circles(p, least=1e-8):
    """Triangles that are first at the left of all three of their edges."""
    after, scale = {}, np.ptp(p, axis=0).max()
    for a in range(len(p)):
        for b in range(len(p)):
            d = p[b] - p[a]
            e = p - (p[a] + p[b]) / 2
            side = e @ np.array([-d[1], d[0]])
            left = side > least * scale * np.hypot(*d)
            left[[a, b]] = False
            if left.any():
                t = np.where(left, ((e * e).sum(axis=1) - d @ d / 4) / np.where(left, side, 1), np.inf)
                after[a, b] = int(t.argmin())
    return {min((a, b, c), (b, c, a), (c, a, b)) for (a, b), c in after.items() if after.get((b, c)) == a and after.get((c, a)) == b}


def test_triangles_of_uneven_places_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    # A third of the places in one small heap, and an empty region between two more.
    p = np.concatenate([rng.random((110, 2)), rng.normal(size=(130, 2)) * 1e-3 + 0.3, rng.normal(size=(60, 2)) * 1e-2 + 5])
    got = [tuple(t) for t in delaunay(table(spark, [(i, x, y, 0) for i, (x, y) in enumerate(p)])).collect()]
    assert len(got) == len(set(got)) and set(got) == by_circles(p)


def test_lattice_is_covered_once_and_a_linear_function_reproduced(spark):
    p = [(i, j) for j in range(9) for i in range(12)]
    rows = [(n, x, y, 3 * x - 2 * y + 1) for n, (x, y) in enumerate(p)]
    # Repeated places count with their mean, rows without a place not at all.
    rows += [(500, 4, 4, 3 * 4 - 2 * 4 + 11), (501, 4, 4, 3 * 4 - 2 * 4 - 9), (502, None, 1, 7), (503, float("nan"), 1, 7), (504, float("inf"), 1, 7)]
    points = table(spark, rows)
    t = [tuple(r) for r in delaunay(points).collect()]
    q = np.array(p, dtype=float)[np.array(t)]
    areas = ((q[:, 1, 0] - q[:, 0, 0]) * (q[:, 2, 1] - q[:, 0, 1]) - (q[:, 2, 0] - q[:, 0, 0]) * (q[:, 1, 1] - q[:, 0, 1])) / 2
    assert len(t) == 2 * 11 * 8 and np.allclose(areas, 0.5)
    got = {(r.x, r.y): r.value for r in resampled_linear(points, (-1.0, 0.0), (11.0, 8.0), (25, 33)).collect()}
    assert len(got) == 25 * 33
    for (i, j), value in got.items():
        x, y = -1 + i * 0.5, j * 0.25
        assert value is None if x < 0 else abs(value - (3 * x - 2 * y + 1)) < 1e-9


def test_few_places_places_on_a_line_and_missing_values(spark):
    assert delaunay(table(spark, [])).count() == 0
    assert delaunay(table(spark, [(1, 0, 0, 1), (2, 1, 1, 1), (3, 1, 1, 5)])).count() == 0
    assert delaunay(table(spark, [(n, n * 0.1, n * 0.3, 1) for n in range(7)])).count() == 0
    corner = table(spark, [(9, 0, 0, 1), (7, 4, 0, 2), (8, 0, 4, None)])
    assert [tuple(r) for r in delaunay(corner).collect()] == [(7, 8, 9)]
    assert all(r.value is None for r in resampled_linear(corner, (0.0, 0.0), (4.0, 4.0), (3, 3)).collect())


def test_customers_resampled_equal_brute_force(spark):
    import pandas as pd

    from gridloom.plans.scatter_queries import resample_customers

    c = pd.read_parquet(Path(DATA) / "customer.parquet")
    k = c["c_custkey"].to_numpy("int64")
    p = np.stack([k * 7919 % 36000 / 100 - 180, k * 104729 % 16001 / 100 - 80], axis=1)
    z = c["c_acctbal"].to_numpy("float64")
    want = {}
    gx, gy = np.meshgrid(np.arange(361) - 180.0, np.arange(161) - 80.0)
    for t in by_circles(p):
        w = np.linalg.solve(np.concatenate([p[list(t)].T, np.ones((1, 3))]), np.stack([gx.ravel(), gy.ravel(), np.ones(gx.size)]))
        for n in np.flatnonzero((w >= -1e-9).all(axis=0)):
            want[int(n % 361), int(n // 361)] = float(z[list(t)] @ w[:, n])
    got = {(r.x, r.y): r.value for r in resample_customers(spark, DATA).collect()}
    assert len(got) == 361 * 161 and {k for k, v in got.items() if v is not None} == set(want)
    assert all(abs(got[k] - v) < 1e-5 for k, v in want.items())


def test_a_small_front_is_closed_in_one_task_and_a_large_one_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random((300, 2)), rng.random((40, 2)) * [0.3, 4] + [7, -2], np.stack([np.linspace(0, 5, 60), np.full(60, 9.0)], axis=1)])
    points, want, rounds = table(spark, [(i, x, y, 0) for i, (x, y) in enumerate(p)]), by_circles(p), []
    third = triangulate._third
    monkeypatch.setattr(triangulate, "_third", lambda *a: rounds.append(1) or third(*a))
    assert [set(map(tuple, delaunay(points).collect())) == want, rounds] == [True, []]
    monkeypatch.setattr(triangulate, "FRONT", 120)
    got = [tuple(t) for t in delaunay(points).collect()]
    assert len(got) == len(set(got)) and set(got) == want and rounds


def test_edges_meet_the_first_circle_of_all_places():
    rng = np.random.default_rng(5)
    for xy in (rng.random((500, 2)), np.stack(np.meshgrid(np.arange(20.0), np.arange(20.0)), axis=-1).reshape(-1, 2) / 19, rng.random((3, 2))):
        p, q = rng.integers(len(xy), size=(2, 300))
        p, q = p[p != q], q[p != q]
        f = triangulate._Front(xy)
        t = f._met(p[:, None], q[:, None], np.arange(len(xy))[None])
        t[np.arange(len(p)), p] = t[np.arange(len(p)), q] = np.inf
        assert (f.third(p, q) == np.where(np.isfinite(t.min(axis=1)), t.argmin(axis=1), -1)).all()
