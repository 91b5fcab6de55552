"""Paths and distances over long meshes: few rounds, and the same values whatever the blocks."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import marching, paths
from gridloom.operators.paths import BLOCK


@pytest.fixture(scope="module")
def ladder(spark):
    """Two rows of 6000 nodes, as a mesh of a long table has them: ids 16 ix + iy."""
    at = spark.range(5999).withColumnRenamed("id", "ix")
    a, b, c, d = F.col("ix") * 16, F.col("ix") * 16 + 16, F.col("ix") * 16 + 1, F.col("ix") * 16 + 17
    root = F.lit(math.sqrt(2))
    triangles = at.select(F.array(a, b, d).alias("v"), F.array(F.lit(1.0), F.lit(1.0), root).alias("sides")).unionByName(at.select(F.array(a, c, d).alias("v"), F.array(F.lit(1.0), F.lit(1.0), root).alias("sides")))
    return triangles.withColumn("simplex_id", F.monotonically_increasing_id())


def test_a_long_mesh_takes_few_rounds(spark, ladder):
    first = spark.createDataFrame([(0, 0, 0.0)], "origin long, node_id long, distance double")
    got = {r.node_id: r.distance for r in marching.marched(ladder, first, most_rounds=4).collect()}
    assert len(got) == 12_000 and abs(got[16 * 5999] - 5999) < 1e-6
    links = ladder.select(F.explode(F.array(*[F.struct(F.get("v", i).alias("a"), F.get("v", (i + 1) % 3).alias("b"), F.get("sides", i).alias("length")) for i in range(3)])).alias("e")).select("e.*")
    found = {r.node_id: (r.distance, r.prior) for r in paths.shortest_paths(links, first.select("origin"), most_rounds=4).collect()}
    assert len(found) == 12_000 and found[0] == (0.0, None)
    assert all(abs(found[16 * k + 1][0] - (k - 1 + math.sqrt(2) if k else 1.0)) < 1e-6 for k in range(6000))
    assert all(found[16 * k][1] == 16 * (k - 1) for k in range(1, 6000))


def test_blocks_do_not_change_paths_and_distances(spark):
    """The same grid within a block and with its columns in five; the nearest way from a block leads back into it."""
    n = 4
    out = []
    for step in (1, BLOCK // 3):
        at = {(i, j): i * step * 4 + j for i in range(n + 1) for j in range(n + 1)} if step > 1 else {(i, j): i * (n + 1) + j for i in range(n + 1) for j in range(n + 1)}
        tri = [t for i in range(n) for j in range(n) for t in ((at[i, j], at[i + 1, j], at[i + 1, j + 1]), (at[i, j], at[i, j + 1], at[i + 1, j + 1]))]
        whole = spark.createDataFrame([(k, list(t), [1.0, 1.0, 1.2]) for k, t in enumerate(tri)], "simplex_id long, v array<long>, sides array<double>")
        wall = {frozenset((at[1, j], at[2, j])) for j in range(n)}  # the first columns meet the others at one end, and come back from there
        links = sorted({(min(t[i], t[(i + 1) % 3]), max(t[i], t[(i + 1) % 3]), 1.2 if i == 2 else 1.0) for t in tri for i in range(3)})
        links = [e for e in links if frozenset(e[:2]) not in wall and not (e[2] == 1.2 and e[0] in {at[1, j] for j in range(n)} and e[1] in {at[2, j] for j in range(n + 1)})]
        e = spark.createDataFrame(links, "a long, b long, length double")
        s = spark.createDataFrame([(at[2, 0], at[2, 0], 0.0), (at[0, 0], at[0, 0], 0.5)], "origin long, node_id long, distance double")
        name = {k: v for v, k in at.items()}
        marched = {(name[r.origin], name[r.node_id]): round(r.distance, 9) for r in marching.marched(whole, s).collect()}
        walked = {(name[r.origin], name[r.node_id]): (round(r.distance, 9), r.prior and name[r.prior]) for r in paths.shortest_paths(e, s.select("origin")).collect()}
        out.append((marched, {k: v[0] for k, v in walked.items()}))
    assert out[0] == out[1] and len(out[0][0]) == len(out[0][1]) == 50
