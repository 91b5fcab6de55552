"""Models given observations that are folded onto the nodes: the dense results, without a table of points by nodes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import exact, fields, locate, models
from gridloom.sources import meshes


def dense(m, n):
    out = np.zeros((n, n))
    for r in m.collect():
        out[r.i, r.j] += r.v
    return out


def test_folded_observations_give_the_dense_results(spark):
    """A point beside the mesh, one without a value, which counts among the precisions, and noise that differs."""
    nodes, simplices = meshes.grid(spark, [0.0], [1.0], 0.1)
    f = models.matern_field(nodes, simplices, 2, 1, fields.Matern(1.5, 0.6, 1.2, 1), robin=-0.3)
    rows = [(0, [0.4], 1.4, 0.3), (1, [0.83], 0.2, 0.5), (2, [7.0], 1.0, 0.3), (3, [0.07], None, 0.2), (4, [0.5], -0.4, 0.4)]
    points = spark.createDataFrame(rows, "point_id long, x array<double>, value double, sd double")
    at = locate.located(points, nodes, simplices, 2, 1, 0.1, 1e-9, keep=("value", "sd"))
    normal = fields.folded(at, 2, every=True)
    n = nodes.count()
    prior = np.linalg.inv(dense(f.precision(), n))
    a, y, sd = np.zeros((4, n)), np.array([1.4, 0.2, 0.0, -0.4]), np.array([0.3, 0.5, 0.2, 0.4])
    for r in at.where("v IS NOT NULL").collect():
        a[{0: 0, 1: 1, 3: 2, 4: 3}[r.point_id], r.v] = r.w
    v = a @ prior @ a.T + np.diag(sd**2)
    assert normal.count == 4 and normal.seen == 3
    want = prior @ a.T @ np.linalg.solve(v, y)
    q = exact.posterior_given(f, nodes, 1, normal)
    assert exact.means_given(f, q, normal).orderBy("i").toPandas()["v"].to_numpy() == pytest.approx(want, rel=1e-7, abs=1e-9)
    assert models.means_given(f, normal, 1e-10).orderBy("i").toPandas()["v"].to_numpy() == pytest.approx(want, rel=1e-5, abs=1e-7)
    density = -0.5 * (np.linalg.slogdet(v)[1] + 4 * math.log(2 * math.pi) + y @ np.linalg.solve(v, y))
    assert exact.log_likelihood_given(f, nodes, 1, normal) == pytest.approx(density, rel=1e-8)
    two = fields.folded(at.withColumn("rep", F.when(F.col("point_id") < 2, 5).otherwise(6).cast("long")), 2, every=True)
    got = models.means_given(f, two, 1e-10).toPandas().pivot(index="i", columns="rep", values="v")
    assert got[5].to_numpy() + got[6].to_numpy() == pytest.approx(want, rel=1e-5, abs=1e-7)
