"""Distances through triangles: against a fixed point in numpy, first order on plane and sphere, and at the edges of what is defined."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import marching


def across(ta, tb, a, b, c, n=400):
    """By search over the side's points."""
    s = np.linspace(0, 1, n + 1)[:, None]
    return float((ta + (tb - ta) * s[:, 0] + np.linalg.norm(c - (a + s * (b - a)), axis=1)).min())


def grid(spark, n, lift=None, step=1):
    """The unit square in 2 n^2 triangles, as tables; ``step`` spreads ids over blocks."""
    at = {(i, j): (i * (n + 1) + j) * step for i in range(n + 1) for j in range(n + 1)}
    x = {k: [i / n, j / n] if lift is None else lift(i / n, j / n) for (i, j), k in at.items()}
    tri = [t for i in range(n) for j in range(n) for t in ([at[i, j], at[i + 1, j], at[i + 1, j + 1]], [at[i, j], at[i + 1, j + 1], at[i, j + 1]])]
    nodes = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in x.items()], "node_id long, x array<double>")
    return nodes, spark.createDataFrame(list(enumerate(tri)), "simplex_id long, v array<long>"), at, x, tri


def starts(spark, *rows):
    return spark.createDataFrame([(o, n, float(d)) for o, n, d in rows], "origin long, node_id long, distance double")


def test_blocks_reach_the_fixed_point_of_all_triangles(spark):
    nodes, simplices, at, x, tri = grid(spark, 5, step=700)
    whole = marching.sides(nodes, simplices, 2)
    found = marching.marched(whole, starts(spark, (1, at[0, 2], 0.0), (1, at[0, 2], 3.0), (2, at[5, 5], 0.25), (2, at[0, 0], 0.0))).collect()
    for origin, first in ((1, {at[0, 2]: 0.0}), (2, {at[5, 5]: 0.25, at[0, 0]: 0.0})):
        t, p = dict(first), {k: np.array(v) for k, v in x.items()}
        for _ in range(30):
            for v in tri:
                for i in range(3):
                    a, b, c = v[i], v[(i + 1) % 3], v[(i + 2) % 3]
                    known = [n for n in (a, b) if n in t]
                    if len(known) == 2:
                        t[c] = min(t.get(c, math.inf), across(t[a], t[b], p[a], p[b], p[c]))
                    elif known:
                        t[c] = min(t.get(c, math.inf), t[known[0]] + float(np.linalg.norm(p[c] - p[known[0]])))
        got = {r.node_id: r.distance for r in found if r.origin == origin}
        assert set(got) == set(x) and all(abs(got[k] - t[k]) < 1e-4 for k in x)


def test_plane_and_sphere_converge(spark):
    def sphere(u, v):
        # By lines through the centre, so that great circles between places stay in the mesh.
        p = np.array([u - 0.5, v - 0.5, 1.0])
        return list(p / np.linalg.norm(p))

    for lift, d in ((None, 2), (sphere, 3)):
        off = []
        for n in (6, 12, 24):
            nodes, simplices, at, x, _ = grid(spark, n, lift)
            o = np.array(x[at[0, 0]])
            got = {r.node_id: r.distance for r in marching.marched(marching.sides(nodes, simplices, d), starts(spark, (0, at[0, 0], 0.0))).collect()}
            straight = {k: float(np.linalg.norm(np.array(v) - o)) if lift is None else 2 * math.asin(float(np.linalg.norm(np.array(v) - o)) / 2) for k, v in x.items()}
            off.append(max(abs(got[k] - straight[k]) for k in x))
        assert off[0] < 0.2 and off[1] < off[0] / 1.35 and off[2] < off[1] / 1.35  # h log(1 / h)


def test_points_under_a_metric(spark):
    nodes, simplices, *_ = grid(spark, 8)
    a = [[4.0, 0.5], [0.5, 1.0]]
    metric = simplices.withColumn("tensor", F.array(*[F.array(*[F.lit(c) for c in row]) for row in a]))
    place = {1: [0.31, 0.42], 2: [0.32, 0.41], 3: [0.9, 0.2], 4: [0.0, 1.0], 5: [3.0, 0.5], 6: [0.05, 0.77]}
    points = spark.createDataFrame(list(place.items()), "point_id long, x array<double>")
    rows = marching.distances_between(nodes, metric, points.where("point_id < 3 OR point_id = 5"), points, 2, 0.125).collect()
    got = {(r.origin, r.end): r.distance for r in rows}
    assert set(got) == {(o, e) for o in (1, 2) for e in (1, 2, 3, 4, 6)} and len(rows) == len(got)
    for (o, e), d in got.items():
        step = np.array(place[e]) - np.array(place[o])
        straight = float(np.sqrt(step @ np.array(a) @ step))
        assert straight - 1e-9 <= d <= 1.1 * straight + 0.153  # half of the longest side: values are linear along sides
    assert got[1, 1] == 0.0 == got[2, 2]


def test_parts_that_do_not_hang_together_and_empty_tables(spark):
    t = spark.createDataFrame([(0, [1, 2, 3], [3.0, 4.0, 5.0]), (1, [7, 8, 9], [1.0, 1.0, 1.0]), (2, None, None)], "simplex_id long, v array<long>, sides array<double>")
    got = {r.node_id: r.distance for r in marching.marched(t, starts(spark, (0, 1, 0.0), (0, 7, float("nan")))).collect()}
    assert got == {1: 0.0, 2: 3.0, 3: 5.0}
    assert marching.marched(t, starts(spark)).count() == 0
    assert [(r.node_id, r.distance) for r in marching.marched(t.where("simplex_id > 5"), starts(spark, (0, 1, 0.0))).collect()] == [(1, 0.0)]


def test_ends_are_read_once_and_not_broadcast(spark, tmp_path):
    """Files say less than rows in memory: an end joined with itself would be broadcast while its file is small."""
    nodes, simplices, *_ = grid(spark, 4)
    path = str(tmp_path / "ends")
    spark.createDataFrame([(k, [k / 7, 0.4]) for k in range(8)] + [(3, [3 / 7, 0.4])], "point_id long, x array<double>").write.parquet(path)
    ends = spark.read.parquet(path)
    found = marching.distances_between(nodes, simplices, ends.where("point_id = 0"), ends, 2, 0.25)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted(r.end for r in found.collect()) == list(range(8))
