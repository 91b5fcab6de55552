"""Sparse matrices as ``i long, j long, v double``: products are joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import conjugate
from gridloom.operators.cut_lineage import checkpointed


def summed(m: DataFrame) -> DataFrame:
    """Entries of one place added up."""
    return m.groupBy("i", "j").agg(F.sum("v").alias("v"))


def add(*terms: tuple[float, DataFrame]) -> DataFrame:
    """Weighted sum of matrices."""
    out = None
    for c, m in terms:
        m = m.select("i", "j", (F.col("v") * c).alias("v"))
        out = m if out is None else out.unionByName(m)
    return summed(out)


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """a @ b: one join on the inner index, one grouped sum."""
    right = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    return a.join(right, "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v")).select("i", F.col("k").alias("j"), "v")


def times_vector(m: DataFrame, x: DataFrame) -> DataFrame:
    """``i, v`` of m @ x, x having ``i, v``."""
    right = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    return m.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def times_vectors(m: DataFrame, x: DataFrame) -> DataFrame:
    """``rep, i, v`` of m @ x for vectors ``rep, i, v``."""
    right = x.select("rep", F.col("i").alias("j"), F.col("v").alias("x"))
    return m.join(right, "j").groupBy("rep", "i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def row_sums(m: DataFrame) -> DataFrame:
    """``i, v``; of a mass matrix, the lumped mass."""
    return m.groupBy("i").agg(F.sum("v").alias("v"))


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j").select("i", "v")


def permuted(m: DataFrame, order: DataFrame) -> DataFrame:
    """Rows and columns renamed by ``i, to``."""
    a, b = order.select("i", F.col("to").alias("ti")), order.select(F.col("i").alias("j"), F.col("to").alias("tj"))
    return m.join(a, "i").join(b, "j").select(F.col("ti").alias("i"), F.col("tj").alias("j"), "v")


def without(m: DataFrame, fixed: DataFrame) -> DataFrame:
    """Rows and columns of the indices in ``fixed`` (``i``) left out, as for Dirichlet nodes."""
    return m.join(fixed.select("i"), "i", "left_anti").join(fixed.select(F.col("i").alias("j")), "j", "left_anti").select("i", "j", "v")


def solve(m: DataFrame, b: DataFrame, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """``i, v`` with m @ x = b for a symmetric positive definite matrix, by conjugate gradients with Jacobi's preconditioner (see ``operators.conjugate``).

    For systems that a single machine cannot hold; ``operators.fields`` has a dense kernel for small ones. Raises if ``most`` steps do not reach ``tolerance``.
    Rows without a right side have zero, right sides of rows that m doesn't have are left out.
    """
    rows = diagonal(m).select(F.lit(0).cast("long").alias("rep"), "i", F.lit(0.0).alias("v"))  # all rows, should b have none of them
    return conjugate.solve_many(m, rows.unionByName(b.select(F.lit(0).cast("long").alias("rep"), "i", "v")), tolerance, most).select("i", "v")


def solve_many(m: DataFrame, b: DataFrame, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """``rep, i, v``: ``solve`` for each right side of ``b`` (``rep, i, v``), all in one step; a right side that has reached ``tolerance`` stays.

    The driver sees one number for each right side and block of rows a step. Raises if ``most`` steps do not do.
    """
    return conjugate.solve_many(m, b, tolerance, most)


def lanczos(m: DataFrame, start: DataFrame, steps: int) -> dict[int, tuple[list[float], list[float]]]:
    """For each start vector (``rep, i, v``): diagonal and off-diagonal of the tridiagonal matrix of so many Lanczos steps (fewer where they end early). One product a
    step for all vectors; two numbers for each reach the driver."""
    m, out = checkpointed(m), {}
    norms = start.groupBy("rep").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    state = checkpointed(start.join(norms, "rep").select("rep", "i", (F.col("v") / F.col("n")).alias("v"), F.lit(0.0).alias("before"), F.lit(0.0).alias("off")))
    for _ in range(steps):
        w = times_vectors(m, state.select("rep", "i", "v")).withColumnRenamed("v", "w")
        met = state.join(w, ["rep", "i"], "left").select("rep", "i", "v", (F.coalesce("w", F.lit(0.0)) - F.col("off") * F.col("before")).alias("w"))
        met = checkpointed(met)
        a = met.groupBy("rep").agg(F.sum(F.col("v") * F.col("w")).alias("a"))
        rest = met.join(a, "rep").withColumn("w", F.col("w") - F.col("a") * F.col("v"))
        b = rest.groupBy("rep").agg(F.first("a").alias("a"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("b"))
        b = checkpointed(b)
        for r in b.collect():
            diagonal_, off = out.setdefault(r["rep"], ([], []))
            diagonal_.append(r["a"])
            off.append(r["b"])
        state = rest.drop("a").join(b.where("b > 1e-12"), "rep").select("rep", "i", (F.col("w") / F.col("b")).alias("v"), F.col("v").alias("before"), F.col("b").alias("off"))
        state = checkpointed(state)
    return {k: (d, o[: len(d) - 1]) for k, (d, o) in out.items()}
