"""Field models on tables, for meshes of any size: systems, means, realisations, conditioning, covariance and likelihood.

A field is x = Pr v / tau with v of precision Pl^T C^-1 Pl, where Pl = C p(L), Pr = q(L), L = C^-1 K and p(L) / q(L) is L to the power alpha / 2,
exactly where that is whole and rationally otherwise. All of these are sparse tables (``i, j, v``); solves are conjugate gradients over tables,
for many right sides (``rep``) at once; log-determinants and variances come from random probes, with their standard errors.
The driver sees scalars, for each replicate or probe at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rational import clenshaw_lord
from gridloom.operators import fem, sparse
from gridloom.operators.cut_lineage import checkpointed
from gridloom.operators.fields import Matern, Normal, polynomial, varying_coefficients


@dataclass(frozen=True)
class Field:
    """pl, pr (None: the identity): ``i, j, v``; lumped: ``i, v``; tau a number, for all nodes alike."""

    k: DataFrame
    lumped: DataFrame
    pl: DataFrame
    pr: DataFrame | None
    tau: float

    def transfer(self, x: DataFrame) -> DataFrame:
        """Pr times vectors ``rep, i, v``."""
        return x if self.pr is None else sparse.times_vectors(self.pr, x)

    def precision(self) -> DataFrame:
        """tau^2 Pl^T C^-1 Pl."""
        half = self.pl.join(self.lumped.select("i", F.col("v").alias("c")), "i")
        scaled = half.select("i", "j", (F.col("v") * self.tau**2 / F.col("c")).alias("v"))
        return sparse.product(sparse.transposed(self.pl), scaled)


def largest_eigenvalue_bound(k: DataFrame, lumped: DataFrame) -> float:
    """Of C^-1 K, from absolute row sums."""
    rows = k.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).join(lumped.select("i", F.col("v").alias("c")), "i")
    return float(rows.agg(F.max(F.col("s") / F.col("c")).alias("m")).first()["m"])


def field(k: DataFrame, lumped: DataFrame, alpha: float, tau: float, low: float = 10**-2.5, degree: int = 20) -> Field:
    """The model of K and the lumped mass, without its fixed nodes. Fractional powers are approximated by degrees (2, 2) for eigenvalues of L between ``low`` and
    1 times the largest; below, they are less exact, but positive (which is checked)."""
    k, lumped = checkpointed(k), checkpointed(lumped)
    whole = math.floor(alpha / 2 + 1e-12)
    part = alpha / 2 - whole
    ids = lumped.select("i")
    inverse = k.join(lumped.select("i", F.col("v").alias("c")), "i")
    if abs(part) < 1e-9:
        pl = k
        for _ in range(whole - 1):  # K, K C^-1 K, ...
            pl = sparse.product(k, pl.join(lumped.select("i", F.col("v").alias("c")), "i").select("i", "j", (F.col("v") / F.col("c")).alias("v")))
        return Field(k, lumped, checkpointed(pl), None, tau)
    most = largest_eigenvalue_bound(k, lumped)
    r = clenshaw_lord(lambda x: x**part, degree, (low, 1.0), 2, 2)
    p, q = r.power_form()
    at = np.linspace(0, 1, 1001)
    if min(np.polynomial.polynomial.polyval(at, p).min(), np.polynomial.polynomial.polyval(at, q).min()) <= 0:
        raise ValueError("the rational approximation is not positive; take another range or degree")
    unit = checkpointed(inverse.select("i", "j", (F.col("v") / F.col("c") / most).alias("v")))
    scale = most ** (alpha / 2)
    pl = polynomial(unit, [0.0] * whole + [float(c * scale) for c in p], ids)
    pl = pl.join(lumped.select("i", F.col("v").alias("c")), "i").select("i", "j", (F.col("v") * F.col("c")).alias("v"))
    return Field(k, lumped, checkpointed(pl), checkpointed(polynomial(unit, [float(c) for c in q], ids)), tau)


def matern_field(nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, model: Matern, robin: float = 0.0, fixed: DataFrame | None = None) -> Field:
    """The stationary model; nodes in ``fixed`` (``i``) are held at zero."""
    return _built(nodes, simplices, vertices, d, model.mass, model.stiffness, None, None, model.alpha, model.tau, robin, fixed)


def varying_field(
    nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, parameters: DataFrame, ranges: Callable[[], list[Column]], frame: Callable[[], list[list[Column]]], order: float, sigma: float, fixed: DataFrame | None = None
) -> Field:
    """A model whose ranges and frame are columns of ``parameters`` (one row for each ``simplex_id``): anisotropic where they are constants."""
    dims = vertices - 1
    mass, tensor = varying_coefficients(ranges(), frame(), order)
    alpha = order + dims / 2
    tau = math.sqrt(math.gamma(order) / (math.gamma(alpha) * (4 * math.pi) ** (dims / 2))) / sigma
    return _built(nodes, simplices, vertices, d, mass, None, tensor, parameters, alpha, tau, 0.0, fixed)


def _built(nodes, simplices, vertices, d, mass, stiffness, tensor, parameters, alpha, tau, robin, fixed) -> Field:
    e = checkpointed(fem.elements(nodes, simplices, vertices, d))
    k = fem.system(nodes, simplices, vertices, d, mass, stiffness, robin=robin, tensor=tensor, parameters=parameters, e=e)
    lumped = sparse.row_sums(fem.assembled(fem.mass(e, vertices)))
    if fixed is not None:
        k, lumped = sparse.without(k, fixed), lumped.join(fixed.select("i"), "i", "left_anti")
    return field(k, lumped, alpha, tau)


def implicit_mean(k: DataFrame, load: DataFrame, fixed: DataFrame | None = None, tolerance: float = 1e-10) -> DataFrame:
    """``i, v`` with K v = load off the nodes of ``fixed`` (``i, v``), which have their own values: the mean that a source and the constant of a Robin
    condition (both in ``load``) and values on the boundary give a field of whole order alpha = 2. Nodes without a load have none."""
    if fixed is None:
        return sparse.solve(k, load, tolerance)
    known = sparse.times_vector(k, fixed).select("i", (-F.col("v")).alias("v"))
    right = load.select("i", "v").unionByName(known).groupBy("i").agg(F.sum("v").alias("v")).join(fixed.select("i"), "i", "left_anti")
    return sparse.solve(sparse.without(k, fixed), right, tolerance).unionByName(fixed.select("i", "v"))


def normal_noise(seed: int, *keys: str) -> Column:
    """A standard normal number for each row that depends on the seed and the keys alone, whatever the partitions."""
    u = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *keys), 11).cast("double") + 0.5) / 2.0**53 for k in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def realisations(f: Field, reps: DataFrame, seed: int = 0, tolerance: float = 1e-8) -> DataFrame:
    """``rep, i, v``: one draw of the field for each row of ``reps`` (``rep long``): Pr Pl^-1 C^1/2 z / tau. Draws are the same whatever the partitions."""
    each = reps.select("rep").distinct().crossJoin(f.lumped)  # asked for as such: every node of every draw
    noise = each.select("rep", "i", (normal_noise(seed, "rep", "i") * F.sqrt("v")).alias("v"))
    return f.transfer(sparse.solve_many(f.pl, noise, tolerance)).select("rep", "i", (F.col("v") / f.tau).alias("v"))


def covariance_times(f: Field, columns: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """``rep, i, v``: the covariance Pr Pl^-1 C Pl^-1 Pr^T / tau^2 times columns ``rep, i, v``. Pr is a polynomial of C^-1 K: its transpose acts through C."""
    right = columns if f.pr is None else sparse.times_vectors(sparse.transposed(f.pr), columns)
    inner = sparse.solve_many(f.pl, right, tolerance).join(f.lumped.select("i", F.col("v").alias("c")), "i").select("rep", "i", (F.col("v") * F.col("c")).alias("v"))
    return f.transfer(sparse.solve_many(f.pl, inner, tolerance)).select("rep", "i", (F.col("v") / f.tau**2).alias("v"))


def with_precisions(rows: DataFrame, sd: float | DataFrame) -> DataFrame:
    """``rows`` of points ``i`` with their noise's precision ``q``: one for all, or ``point_id, sd``."""
    if isinstance(sd, DataFrame):
        return rows.join(sd.select(F.col("point_id").alias("i"), (1 / (F.col("sd") * F.col("sd"))).alias("q")), "i")
    return rows.withColumn("q", F.lit(1.0 / sd**2))


def seen(y: DataFrame) -> DataFrame:
    """``rep, i, v`` of observations ``rep, point_id, value``, without nulls."""
    return y.where("value IS NOT NULL").select("rep", F.col("point_id").alias("i"), F.col("value").alias("v"))


def observed(f: Field, weights: DataFrame, sd: float | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posterior precision of v, A Pr): ``weights`` are ``point_id, node_id, w``, sd the noise of all points or of each (``point_id, sd``); points without a node are left out."""
    a = weights.where("node_id IS NOT NULL").select(F.col("point_id").alias("i"), F.col("node_id").alias("j"), F.col("w").alias("v"))
    a = a.join(f.lumped.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j", "v")
    a = checkpointed(a if f.pr is None else sparse.product(a, f.pr))
    scaled = with_precisions(a, sd).select("i", "j", (F.col("v") * F.col("q")).alias("v"))
    return checkpointed(sparse.add((1.0, f.precision()), (1.0, sparse.product(sparse.transposed(a), scaled)))), a


def posterior_means(f: Field, weights: DataFrame, y: DataFrame, sd: float | DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """``rep, i, v``: the field's mean given each replicate's observations (``rep, point_id, value``), with noise ``sd`` (see ``observed``) and all points seen in every
    replicate (a point without a value counts as 0)."""
    q, a = observed(f, weights, sd)
    right = sparse.times_vectors(sparse.transposed(a), with_precisions(seen(y), sd).select("rep", "i", (F.col("v") * F.col("q")).alias("v")))
    return f.transfer(sparse.solve_many(q, right, tolerance))


def given(f: Field, normal: Normal) -> DataFrame:
    """Posterior precision of v given observations folded onto the nodes: without a table of points."""
    free = f.lumped.select("i")
    ata = normal.ata.join(free, "i", "left_semi").join(free.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "v")
    if f.pr is not None:
        ata = sparse.product(sparse.transposed(f.pr), sparse.product(ata, f.pr))
    return checkpointed(sparse.add((1.0, f.precision()), (1.0, ata)))


def loads(f: Field, normal: Normal) -> DataFrame:
    """``rep, i, v``: (A Pr)^T Q y."""
    right = normal.aty if "rep" in normal.aty.columns else normal.aty.withColumn("rep", F.lit(0).cast("long"))
    right = right.join(f.lumped.select("i"), "i", "left_semi").select("rep", "i", "v")
    return right if f.pr is None else sparse.times_vectors(sparse.transposed(f.pr), right)


def means_given(f: Field, normal: Normal, tolerance: float = 1e-8) -> DataFrame:
    """``posterior_means`` of observations folded onto the nodes (``fields.folded`` of all points, ``every``)."""
    return f.transfer(sparse.solve_many(given(f, normal), loads(f, normal), tolerance))


def log_determinant(m: DataFrame, probes: int = 16, steps: int = 30, seed: int = 0) -> tuple[float, float]:
    """(estimate, standard error) of a symmetric positive definite matrix's log-determinant by Lanczos quadrature from random signs."""
    ids = m.select("i").distinct()
    n = ids.count()
    reps = m.sparkSession.range(probes).withColumnRenamed("id", "rep")
    start = ids.crossJoin(F.broadcast(reps)).select("rep", "i", F.when(F.pmod(F.xxhash64(F.lit(seed), "rep", "i"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v"))
    each = []
    for diagonal, off in sparse.lanczos(m, start, min(steps, n)).values():
        values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
        each.append(n * float((vectors[0] ** 2 * np.log(np.maximum(values, 1e-300))).sum()))
    return float(np.mean(each)), float(np.std(each, ddof=1) / math.sqrt(len(each))) if len(each) > 1 else math.inf


def posterior_variances(f: Field, weights: DataFrame, sd: float | DataFrame, probes: int = 64, seed: int = 0, tolerance: float = 1e-6) -> DataFrame:
    """``i, v, error``: estimates of the field's variances given observations, from as many draws of the posterior's noise, and their standard errors
    (v sqrt(2 / probes)). A draw is Q^-1 (tau Pl^T C^-1/2 z + (A Pr)^T w / sd). ``operators.exact`` has them exact."""
    q, a = observed(f, weights, sd)
    reps = q.sparkSession.range(probes).withColumnRenamed("id", "rep")
    z = f.lumped.crossJoin(F.broadcast(reps))
    z = z.select("rep", "i", (normal_noise(seed, "rep", "i") * f.tau / F.sqrt("v")).alias("v"))
    w = with_precisions(a.select("i").distinct(), sd).crossJoin(F.broadcast(reps))
    w = w.select("rep", "i", (normal_noise(seed + 1, "rep", "i") * F.sqrt("q")).alias("v"))
    right = sparse.times_vectors(sparse.transposed(f.pl), z).unionByName(sparse.times_vectors(sparse.transposed(a), w)).groupBy("rep", "i").agg(F.sum("v").alias("v"))
    draws = f.transfer(sparse.solve_many(q, right, tolerance))
    v = F.sum(F.col("v") * F.col("v")) / probes
    return draws.groupBy("i").agg(v.alias("v"), (v * math.sqrt(2 / probes)).alias("error"))


def log_likelihood(f: Field, weights: DataFrame, y: DataFrame, sd: float, probes: int = 16, steps: int = 30, seed: int = 0) -> tuple[float, float]:
    """(estimate, standard error) of the observations' log-likelihood, averaged over replicates (see ``posterior_means``). The quadratic terms are exact to the
    solver's tolerance; the determinants are estimated with the same probes."""
    q, a = observed(f, weights, sd)
    y = checkpointed(y.where("value IS NOT NULL").select("rep", F.col("point_id").alias("i"), F.col("value").alias("v")).join(a.select("i").distinct(), "i", "left_semi").select("rep", "i", "v"))
    right = checkpointed(sparse.times_vectors(sparse.transposed(a), y).select("rep", "i", (F.col("v") / sd**2).alias("v")))
    mean = sparse.solve_many(q, right, 1e-8)
    form = mean.join(right.withColumnRenamed("v", "b"), ["rep", "i"]).agg(F.sum(F.col("v") * F.col("b")).alias("s")).first()["s"] or 0.0
    one = y.agg(F.sum(F.col("v") * F.col("v")).alias("yy"), F.count_distinct("rep").alias("m")).first()
    m, n = max(one["m"], 1), a.select("i").distinct().count()
    prior, after = log_determinant(f.precision(), probes, steps, seed), log_determinant(q, probes, steps, seed)
    value = 0.5 * (prior[0] - after[0] - n * math.log(2 * math.pi * sd**2) - ((one["yy"] or 0.0) / sd**2 - form) / m)
    return value, 0.5 * math.hypot(prior[1], after[1])
