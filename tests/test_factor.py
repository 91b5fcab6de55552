"""The sparse factor, its solutions, determinant and selected inverse, and the exact field models, against dense algebra."""

import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import exact, factor, fields, locate, models, multilevel
from gridloom.sources import meshes


def dense(m, n, order=None):
    out, rows = np.zeros((n, n)), m.toPandas()
    order = np.arange(n) if order is None else order
    np.add.at(out, (order[rows.i], order[rows.j]), rows.v)
    return out


@pytest.fixture(scope="module")
def lattice(spark):
    """A symmetric positive definite matrix on a lattice of 23 x 16 places (and one node apart), its dense form, and its factor in many small blocks and parts."""
    rng = np.random.Generator(np.random.PCG64(3))
    wide, high, entries = 23, 16, {}
    for a in range(wide):
        for b in range(high):
            i = a * high + b
            entries[i, i] = 8 + rng.random()
            for c, d in ((a + 1, b), (a, b + 1), (a + 1, b + 1)):
                if c < wide and d < high:
                    entries[i, c * high + d] = entries[c * high + d, i] = float(rng.normal())
    n = wide * high + 1
    entries[n - 1, n - 1] = 2.0
    m = spark.createDataFrame(pd.DataFrame([(*k, v) for k, v in entries.items()], columns=["i", "j", "v"]))
    x = [[float(i // high), float(i % high)] for i in range(n - 1)] + [[-5.0, 3.0], [0.5, 0.5]]  # the last place has no row
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(x)], "i long, x array<double>")
    kept = factor.WITHIN, factor.PART
    factor.WITHIN, factor.PART = 100, 2
    f = factor.factored(m, nodes, 2, 17)
    yield m, n, f
    factor.WITHIN, factor.PART = kept


def test_factor_and_its_order(lattice):
    m, n, f = lattice
    order = f.order.toPandas().sort_values(["block", "place"])
    place = np.empty(n, int)
    place[order.i] = np.arange(n)
    assert sorted(order.i) == list(range(n)) and order.groupby("block").size().max() <= 17
    a, low = dense(m, n, place), dense(factor.lower(f), n, place)
    assert np.abs(np.triu(low, 1)).max() == 0 and np.abs(low @ low.T - a).max() < 1e-13
    assert (np.abs(low) > 0).sum() < 0.3 * n * n / 2  # it stays sparse
    assert factor.log_determinant(f) == pytest.approx(np.linalg.slogdet(a)[1], rel=1e-12)


def test_product_of_the_factor_by_tiles(spark, lattice):
    """The matrix again, in both triangles, and no table of entries or tiles is sent to the driver to be broadcast, however little its files seem to hold."""
    m, n, f = lattice
    got = factor.squared(f)
    rows = got.toPandas()
    assert np.abs(dense(got, n) - dense(m, n)).max() < 1e-13 and not rows.duplicated(["i", "j"]).any()
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20  # tiles' files are smaller
    for named in (factor.lower(f), factor.selected_inverse(f)):
        plan = named._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_solutions(spark, lattice):
    m, n, f = lattice
    a, rng = dense(m, n), np.random.Generator(np.random.PCG64(1))
    b = rng.normal(size=(n, 5))
    reps = [-7, 0, 3, 200, 10**12]
    rows = [(reps[k], i, float(b[i, k])) for i in range(n) for k in range(5)] + [(0, 10**6, 1.0)]
    right = spark.createDataFrame(rows, "rep long, i long, v double")
    x = factor.solve_factored(f, right).toPandas()
    got = x.pivot(index="i", columns="rep", values="v").loc[range(n), reps].to_numpy()
    assert np.abs(a @ got - b).max() < 1e-12
    half = factor.solve_factored(f, right.where("rep = 3"), half=True).toPandas()
    assert (half.v**2).sum() == pytest.approx(b[:, 2] @ np.linalg.solve(a, b[:, 2]))
    one = factor.solve_factored(f, spark.createDataFrame([(0, n - 1, 6.0)], "rep long, i long, v double")).where("v <> 0").collect()
    assert len(one) == 1 and one[0].i == n - 1 and one[0].v == pytest.approx(3.0)


def test_inverse_where_the_factor_holds_something(lattice):
    m, n, f = lattice
    inverse, z = np.linalg.inv(dense(m, n)), factor.selected_inverse(f).toPandas()
    assert np.abs(inverse[z.i, z.j] - z.v).max() < 1e-13 and not z.duplicated(["i", "j"]).any()
    assert set(zip(m.toPandas().i, m.toPandas().j, strict=True)) <= set(zip(z.i, z.j, strict=True))


def test_a_step_s_files_go_when_it_is_done(spark, lattice):
    """What the inverse leaves in the shared folder is its result, not the steps' tables; and the diagonal alone is the same."""
    m, n, f = lattice
    root = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    tables = lambda: {p for p in root.rglob("rdd-*") if p.is_dir()}
    before = tables()
    d = factor.selected_inverse(f, diagonal=True).toPandas()
    assert len(tables() - before) == 1 and f.steps > 3
    assert np.abs(np.diag(np.linalg.inv(dense(m, n)))[d.i] - d.v).max() < 1e-13 and sorted(d.i) == sorted(d.j) == list(range(n))


def test_not_positive_definite(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 2.0), (1, 0, 2.0)], "i long, j long, v double")
    with pytest.raises(Exception, match="not positive definite"):
        factor.factored(m, spark.createDataFrame([(0, [0.0]), (1, [1.0])], "i long, x array<double>"), 1)


@pytest.mark.parametrize("order", [1.5, 0.9])
def test_exact_models(spark, order):
    """Whole and rational powers, each observation with its own noise, two replicates."""
    nodes, simplices = meshes.grid(spark, [0.0], [1.0], 0.05)
    f = models.matern_field(nodes, simplices, 2, 1, fields.Matern(order, 0.6, 1.2, 1), robin=-0.3)
    points = spark.createDataFrame([(0, [0.4], 0.3), (1, [0.83], 0.5), (2, [7.0], 0.3), (3, [0.07], 0.1)], "point_id long, x array<double>, sd double")
    weights = locate.observation_weights(points.select("point_id", "x"), nodes, simplices, 2, 1, 0.05)
    values = {0: [1.4, 0, 0, -0.85], 1: [0.2, 0.3, 5.0, 0.1]}
    y = spark.createDataFrame([(rep, k, float(v)) for rep, row in values.items() for k, v in enumerate(row)], "rep long, point_id long, value double")
    n = nodes.count()
    pr = np.eye(n) if f.pr is None else dense(f.pr, n)
    prior = pr @ np.linalg.inv(dense(f.precision(), n)) @ pr.T
    a = np.zeros((3, n))
    for r in weights.where("node_id IS NOT NULL").collect():
        a[[0, 1, None, 2][r.point_id], r.node_id] = r.w
    v = a @ prior @ a.T + np.diag([0.09, 0.25, 0.01])
    seen = np.array([[row[0], row[1], row[3]] for row in values.values()])
    q, observed = exact.posterior(f, nodes, 1, weights, points.select("point_id", "sd"), leaf=5)
    got = exact.variances(f, q).orderBy("i").toPandas()
    assert got.v.to_numpy() == pytest.approx(np.diag(prior - prior @ a.T @ np.linalg.solve(v, a @ prior)), rel=1e-8)
    mean = exact.means(f, q, observed, y, points.select("point_id", "sd")).toPandas().pivot(index="i", columns="rep", values="v").to_numpy()
    assert mean == pytest.approx(prior @ a.T @ np.linalg.solve(v, seen.T), rel=1e-7, abs=1e-9)
    want = -0.5 * (np.linalg.slogdet(v)[1] + 3 * math.log(2 * math.pi) + np.mean([s @ np.linalg.solve(v, s) for s in seen]))
    assert exact.log_likelihood(f, nodes, 1, weights, y, points.select("point_id", "sd"), leaf=5) == pytest.approx(want, rel=1e-8)
    column = exact.covariance_times(f, exact.prior(f, nodes, 1, leaf=5), spark.createDataFrame([(0, 3, 1.0)], "rep long, i long, v double")).orderBy("i").toPandas()
    assert column.v.to_numpy() == pytest.approx(prior[:, 3], rel=1e-7)
    again = models.posterior_means(f, weights, y, points.select("point_id", "sd"), 1e-10).toPandas().pivot(index="i", columns="rep", values="v").to_numpy()
    assert again == pytest.approx(mean, rel=1e-5, abs=1e-7)


def test_boxes_of_few_places(spark):
    nodes = spark.createDataFrame([(i, [0.0, float(i % 2)]) for i in range(40)], "i long, x array<double>")
    got = factor.boxes(nodes, 2, 3).toPandas()
    assert got.groupby("code").size().tolist() == [20, 20] and set(got.depth) == {1}
    assert factor.boxes(nodes.withColumn("x", F.slice("x", 1, 1)), 1, 3).toPandas().depth.max() == 0


def laplacian(spark, side):
    """-Laplace u + u / 50 on a square of nodes."""
    rows = []
    for a in range(side):
        for b in range(side):
            i = a * side + b
            near = [(a + c) * side + b + d for c, d in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= a + c < side and 0 <= b + d < side]
            rows += [(i, i, len(near) + 0.02), *((i, j, -1.0) for j in near)]
    m = spark.createDataFrame(pd.DataFrame(rows, columns=["i", "j", "v"]))
    nodes = m.select("i").distinct().select("i", F.array(F.floor(F.col("i") / side).cast("double"), (F.col("i") % side).cast("double")).alias("x"))
    return m, nodes


def test_multilevel_solutions(spark, monkeypatch):
    monkeypatch.setattr(multilevel, "COARSEST", 20)
    taken = []
    for side in (16, 32):  # three levels and four
        m, nodes = laplacian(spark, side)
        h = multilevel.hierarchy(m, nodes, 2)
        rng = np.random.Generator(np.random.PCG64(side))
        b = rng.normal(size=(2, side**2))
        right = spark.createDataFrame([(rep, i, float(b[rep, i])) for rep in range(2) for i in range(side**2)] + [(7, 0, 0.0)], "rep long, i long, v double")
        x, steps = multilevel.solve(m, right, h, 1e-9)
        x = x.where("rep < 7").toPandas().pivot(index="rep", columns="i", values="v").to_numpy()
        assert np.abs(dense(m, side**2) @ x.T - b.T).max() < 1e-6
        taken.append(steps)
    assert len(h.smooth) == 3 and taken[1] <= taken[0] + 4
    with pytest.raises(RuntimeError, match="3 steps"):
        multilevel.solve(m, right, h, 1e-12, most=3)


def test_multilevel_steps_broadcast_nothing_and_leave_no_files(spark, monkeypatch):
    monkeypatch.setattr(multilevel, "COARSEST", 2)
    m, nodes = laplacian(spark, 8)
    whole = multilevel.hierarchy(m, nodes, 2)
    monkeypatch.setattr(multilevel, "WITHIN", 20)
    h, root = multilevel.hierarchy(m, nodes, 2), Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    right = spark.createDataFrame([(0, i, float(i % 5)) for i in range(64)], "rep long, i long, v double")
    one, two = (multilevel.cycle(k, right).orderBy("i").toPandas() for k in (whole, h))
    assert (whole.wide, h.wide, len(h.smooth)) == (0, 1, 2) and "Join" not in multilevel.cycle(whole, right)._jdf.queryExecution().sparkPlan().toString()
    assert one.v.to_numpy() == pytest.approx(two.v.to_numpy(), rel=1e-12) and list(one.i) == list(two.i) == list(range(64))
    plan = multilevel.cycle(h, right)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    tables = lambda: {p for p in root.rglob("rdd-*") if p.is_dir()}
    before = tables()
    x, steps = multilevel.solve(m, right, h, 1e-4)
    assert steps > 1 and len(tables() - before) == 1
    x = x.orderBy("i").toPandas().v.to_numpy()
    assert np.abs(dense(m, 64) @ x - np.arange(64) % 5).max() < 1e-2


def test_factor_of_a_strip_stays_near_its_own_size(spark):
    """Tiles of boxes are full: on a strip four nodes wide they must not be many times the matrix."""
    ids = spark.range(1600).withColumnRenamed("id", "i")
    at = ids.select("i", F.array(F.floor(F.col("i") / 4).cast("double"), (F.col("i") % 4).cast("double")).alias("x"))
    beside = ids.select("i", F.explode(F.array(F.lit(-4), F.lit(4), F.when(F.col("i") % 4 > 0, -1), F.when(F.col("i") % 4 < 3, 1))).alias("s"))
    off = beside.select("i", (F.col("i") + F.col("s")).alias("j"), F.lit(-1.0).alias("v")).where("j BETWEEN 0 AND 1599")
    m = off.unionByName(ids.select("i", F.col("i").alias("j"), F.lit(5.0).alias("v")))
    f = factor.factored(m, at, 2)
    assert f.tiles.every().agg(F.sum(F.length("v"))).first()[0] < 2_000_000
    a = np.zeros((1600, 1600))
    for r in m.collect():
        a[r.i, r.j] = r.v
    assert factor.log_determinant(f) == pytest.approx(np.linalg.slogdet(a)[1], rel=1e-10)
