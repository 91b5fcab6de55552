"""Observations located in one step and folded by simplex: the same sums as from weights by point, and nothing sent for a point of a small mesh."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fields, locate
from gridloom.sources import meshes


def test_folded_observations_are_the_same(spark):
    nodes, simplices = meshes.grid(spark, [0.0, 0.0], [1.0, 1.0], 0.25)
    at = spark.range(3000).select(F.col("id").alias("point_id"), F.array((F.col("id") % 41) / 40.0, (F.col("id") % 53) / 40.0).alias("x"), F.when(F.col("id") % 7 > 0, F.sin("id")).alias("value"), (0.5 + F.col("id") % 3).alias("sd"))
    store = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(k) for k in range(s.size())])(store.executorList(False)))
    found = locate.located(at, nodes, simplices, 3, 2, 0.25, 1e-9, keep=("value", "sd"))
    mesh = sent()
    got = fields.folded(found, 3)
    ata, aty = got.ata.toPandas(), got.aty.toPandas()
    assert sent() - mesh < 60_000  # 3000 points were sent twice before
    held = locate.containing(at, nodes, simplices, 3, 2, 0.25, 1e-9).groupBy("point_id").agg(F.min("simplex_id").alias("least"))
    assert found.join(held, "point_id", "left").where("NOT simplex_id <=> least").isEmpty() and found.count() == 3000
    want = fields.normal_equations(locate.observation_weights(at.select("point_id", "x"), nodes, simplices, 3, 2, 0.25, 1e-9), at)
    a, y = want.ata.toPandas().set_index(["i", "j"])["v"], want.aty.toPandas().set_index("i")["v"]
    assert len(a) == len(ata) and ata.set_index(["i", "j"])["v"].loc[a.index].to_numpy() == pytest.approx(a.to_numpy(), abs=1e-9)
    assert len(y) == len(aty) and aty.set_index("i")["v"].loc[y.index].to_numpy() == pytest.approx(y.to_numpy(), abs=1e-9)
    assert got.count == want.count and got.yty == pytest.approx(want.yty) and got.log_q == pytest.approx(want.log_q)


def test_nearest_sites_of_far_points_make_no_lists_of_their_own(spark, monkeypatch):
    """Points far from a lattice of sites: bins share their few sites (some 18 bins of sites for each bin of points before), and ties go to the least site."""
    sites = spark.range(440).select(F.col("id").alias("site_id"), F.array((F.col("id") % 40).cast("double"), F.floor(F.col("id") / 40).cast("double")).alias("x"))
    at = spark.range(6000).select(F.col("id").alias("point_id"), F.array(F.col("id") / 2.0 - 100.0, (F.col("id") % 51) / 5.0).alias("x"))
    sizes, reach = [], locate._in_reach

    def counted(p0, s0, *more):
        out = reach(p0, s0, *more)
        sizes.append((p0.count(), out.count()))
        return out

    monkeypatch.setattr(locate, "_in_reach", counted)
    got = {r.point_id: (r.site_id, r.distance) for r in locate.nearest(at, sites, 2, 2.0).collect()}
    y = np.array([[i % 40, i // 40] for i in range(440)], dtype=float)
    for i in range(6000):
        d2 = (i / 2.0 - 100.0 - y[:, 0]) ** 2 + (i % 51 / 5.0 - y[:, 1]) ** 2
        assert got[i] == (d2.argmin(), pytest.approx(d2.min() ** 0.5))
    assert len(got) == 6000 and sizes[0][1] < 2 * sizes[0][0]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_nearest_sites_of_uneven_places_equal_brute_force(spark, d):
    """Clusters, single far sites and points, copies at one place, a large offset and many levels: with distances as doubles, the least site where they are equal."""
    rng = np.random.default_rng(d)
    sites = np.concatenate((rng.normal(0, 1e-3, (300, d)), rng.integers(-4, 5, (300, d)).astype(float), rng.uniform(-1e4, 1e4, (100, d)), np.full((300, d), 7.25))) + 1e6
    at = np.concatenate((rng.normal(0, 2e-3, (100, d)), rng.integers(-9, 9, (200, d)) / 2.0, rng.uniform(-1e5, 1e5, (100, d)), rng.uniform(6, 9, (50, d)))) + 1e6
    table = lambda p, name: spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(p)], f"{name} long, x array<double>")
    got = {r.point_id: (r.site_id, r.distance) for r in locate.nearest(table(at, "point_id"), table(sites, "site_id"), d, 1.0).collect()}
    d2 = sum((at[:, None, i] - sites[None, :, i]) ** 2 for i in range(d))
    assert got == {i: (row.argmin(), np.sqrt(row.min())) for i, row in enumerate(d2)}
