"""Conjugate gradients by blocks: the same solutions whatever the blocks, and little sent between them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import conjugate, sparse


@pytest.mark.parametrize(("rows", "slot"), [(1 << 14, 4), (50, 1), (7, 2)])
def test_blocks_do_not_change_solutions(spark, monkeypatch, rows, slot):
    """A square of nodes with ids that leave gaps, three right sides, one of them zero but for a row that the matrix doesn't have."""
    monkeypatch.setattr(conjugate, "ROWS", rows)
    monkeypatch.setattr(conjugate, "SLOT", slot)
    n = 14
    a = np.zeros((n * n, n * n))
    for i in range(n):
        for j in range(n):
            for k, l in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
                if k < n and l < n:
                    a[i * n + j, k * n + l] = a[k * n + l, i * n + j] = -1.0
    a += np.diag(0.05 + np.abs(a).sum(axis=1) + np.arange(n * n) % 3)
    name = lambda i: int(i) // n * 1000 + int(i) % n - 3000
    m = spark.createDataFrame([(name(i), name(j), float(a[i, j])) for i, j in zip(*map(list, np.nonzero(a)), strict=True)], "i long, j long, v double")
    right = {7: np.sin(np.arange(n * n)), 9: (np.arange(n * n) == 5).astype(float), -4: np.zeros(n * n)}
    b = spark.createDataFrame([(rep, name(i), float(v)) for rep, y in right.items() for i, v in enumerate(y) if v] + [(-4, 10**9, 1.0)], "rep long, i long, v double")
    got = sparse.solve_many(m, b, 1e-10).toPandas().pivot(index="i", columns="rep", values="v")
    assert list(got.index) == [name(i) for i in range(n * n)] and sorted(got.columns) == [-4, 7, 9]
    for rep, y in right.items():
        assert got[rep].to_numpy() == pytest.approx(np.linalg.solve(a, y), abs=1e-8)
    one = sparse.solve(m, b.where("rep = 7").select("i", "v"), 1e-10).orderBy("i").toPandas()["v"].to_numpy()
    assert one == pytest.approx(np.linalg.solve(a, right[7]), abs=1e-8)
    assert (sparse.solve(m, b.where("rep = 8").select("i", "v")).toPandas()["v"] == 0).all()


def test_a_step_sends_no_row_for_an_entry(spark):
    """The vectors of 3000 rows in a line, one block: a row for it a step; before, one for each entry."""
    at = spark.range(3000).select(F.col("id").alias("i"), F.explode(F.array("id", F.col("id") - 1, F.col("id") + 1)).alias("j")).where("j BETWEEN 0 AND 2999")
    m = at.select("i", "j", F.when(F.col("i") == F.col("j"), 2.5).otherwise(-1.0).alias("v"))
    b = spark.range(3000).select(F.lit(0).cast("long").alias("rep"), F.col("id").alias("i"), F.lit(0.5).alias("v"))
    store = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(k) for k in range(s.size())])(store.executorList(False)))
    x0 = sent()
    x = sparse.solve_many(m, b, 1e-8)
    x1 = sent()
    assert x.count() == 3000 and x1 - x0 < 6_000_000
