"""Tiled meshes without copies against written-out ones; refinement up to a number of nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import locate, tiled, topology
from gridloom.sources import meshes


@pytest.mark.parametrize("d,copies,offset", [(2, [2, 3], [-1.5, 4.0]), (1, [4], [0.25])])
def test_tiled_location_and_neighbors(spark, d, copies, offset):
    nodes, simplices = meshes.grid(spark, [1.0] * d, [2.0] * d, 0.5)
    every_node, every = meshes.tile(nodes, simplices, copies, offset)
    stride = simplices.agg(F.max("simplex_id")).first()[0] + 1
    rng = np.random.Generator(np.random.PCG64(d))
    x = [[float(o + v) for o, v in zip(offset, row, strict=True)] for row in rng.random((60, d)) * (np.array(copies) + 0.4) - 0.2]
    x += [[o + k for o in offset] for k in (0.0, 0.5, 1.0, 1.5, 2.0, float(max(copies)))]  # nodes, common faces and corners
    points = spark.createDataFrame([(i, p) for i, p in enumerate(x)] + [(1000, None), (1001, [None] * d)], "point_id long, x array<double>")
    vertices = d + 1
    name = lambda r: (r.point_id, None if r.sector is None else r.sector * stride + r.simplex_id)
    got = sorted(map(name, tiled.tiled_located(points, nodes, simplices, vertices, d, copies, offset, 0.5, 1e-9).collect()))
    want = sorted((r.point_id, r.simplex_id) for r in locate.located(points, every_node, every, vertices, d, 0.5, 1e-9).collect())
    assert got == want and sum(s is not None for _, s in got) > 30
    got = sorted((*name(r), round(sum(r.w), 9)) for r in tiled.tiled_containing(points, nodes, simplices, vertices, d, copies, offset, 0.5, 1e-9).collect())
    want = sorted((r.point_id, r.simplex_id, 1.0) for r in locate.containing(points, every_node, every, vertices, d, 0.5, 1e-9).collect())
    assert got == want and len(got) > len({g[0] for g in got}) > 30
    sectors = spark.range(-1, int(np.prod(copies)) + 1).withColumnRenamed("id", "sector")
    near = tiled.tiled_neighbors(nodes, simplices, vertices, d, copies, simplices.select("simplex_id").crossJoin(sectors)).collect()
    got = sorted((r.sector * stride + r.simplex_id, r.neighbor_sector * stride + r.neighbor_id) for r in near)
    assert got == sorted(map(tuple, topology.neighbors(every, vertices).collect()))


def test_longest_edges(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [(int(a), int(b), float(v)) for a, b, v in zip(rng.permutation(300), rng.integers(0, 50, 300), np.concatenate([rng.random(150) * 9, rng.integers(1, 4, 150)]), strict=True)]
    table = spark.createDataFrame(rows, "a long, b long, length double")
    order = sorted(rows, key=lambda r: (-round(r[2] * 1e9), r[0], r[1]))
    for most in (0, 1, 40, 117, 299, 300, 5000):
        assert sorted(map(tuple, topology.longest(table, most, bins=5).collect())) == sorted(order[:most]), most
    assert topology.longest(table.limit(0), 5).count() == 0


@pytest.mark.parametrize("cap", [61, 90])
def test_refinement_stops_at_the_cap(spark, cap):
    nodes, simplices = meshes.grid(spark, [0.0, 0.0], [2.0, 1.0], 0.25)
    start = nodes.count()
    assert start == 45
    more, split = topology.refine(nodes.withColumn("limit", F.lit(0.01)), simplices, 3, 2, most_nodes=cap)
    assert more.count() == cap and split.agg(F.max("simplex_id") + 1).first()[0] == split.count()
    shared = topology.facets(split, 3, 2).select(F.size("simplices").alias("n")).groupBy("n").count().collect()
    assert {r.n for r in shared} == {1, 2}
    from gridloom.operators import fem

    assert fem.elements(more, split, 3, 2).agg(F.sum("area")).first()[0] == pytest.approx(2.0)
    assert topology.refine(nodes.withColumn("limit", F.lit(0.01)), simplices, 3, 2, most_nodes=start)[0].count() == start
