"""Exact likelihoods, means and variances of field models on tables, by the sparse factor of their precisions.

The estimates of ``operators.models`` need no factor and so no memory for one; these have no error but rounding.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import sparse
from gridloom.operators.cut_lineage import checkpointed
from gridloom.operators.factor import BLOCK, Factored, factored, log_determinant, selected_inverse, solve_factored
from gridloom.operators.fields import Normal
from gridloom.operators.models import Field, given, loads, observed, seen, with_precisions


def prior(f: Field, nodes: DataFrame, dims: int, leaf: int = BLOCK) -> Factored:
    """The factor of the precision of the field's v (x = Pr v), at ``nodes`` (``node_id, x``)."""
    return factored(f.precision(), nodes.select(F.col("node_id").alias("i"), "x"), dims, leaf)


def posterior(f: Field, nodes: DataFrame, dims: int, weights: DataFrame, sd: float | DataFrame, leaf: int = BLOCK) -> tuple[Factored, DataFrame]:
    """The same given observations, and A Pr; see ``models.observed``."""
    q, a = observed(f, weights, sd)
    return factored(q, nodes.select(F.col("node_id").alias("i"), "x"), dims, leaf), a


def posterior_given(f: Field, nodes: DataFrame, dims: int, normal: Normal, leaf: int = BLOCK) -> Factored:
    """The factor given observations folded onto the nodes (``fields.folded`` with ``every``)."""
    return factored(given(f, normal), nodes.select(F.col("node_id").alias("i"), "x"), dims, leaf)


def means_given(f: Field, q: Factored, normal: Normal) -> DataFrame:
    """``rep, i, v``: ``means`` of these."""
    return f.transfer(solve_factored(q, loads(f, normal)))


def means(f: Field, q: Factored, a: DataFrame, y: DataFrame, sd: float | DataFrame) -> DataFrame:
    """``rep, i, v``: the field's mean given each replicate's observations (``rep, point_id, value``)."""
    right = sparse.times_vectors(sparse.transposed(a), with_precisions(seen(y), sd).select("rep", "i", (F.col("v") * F.col("q")).alias("v")))
    return f.transfer(solve_factored(q, right))


def variances(f: Field, q: Factored) -> DataFrame:
    """``i, v``: the field's variances, from the inverse of its precision at the places that Pr meets."""
    if f.pr is None:
        return selected_inverse(q, diagonal=True).select("i", "v")
    z = selected_inverse(q)
    rows = f.pr.select("i", F.col("j").alias("a"), F.col("v").alias("x")).join(f.pr.select("i", F.col("j").alias("b"), F.col("v").alias("y")), "i")
    met = rows.join(z.select(F.col("i").alias("a"), F.col("j").alias("b"), "v"), ["a", "b"])
    return met.groupBy("i").agg(F.sum(F.col("x") * F.col("y") * F.col("v")).alias("v"))


def covariance_times(f: Field, q: Factored, columns: DataFrame) -> DataFrame:
    """``rep, i, v``: the field's covariance times columns ``rep, i, v``; q is the factor of its precision, before or after observations."""
    right = columns if f.pr is None else sparse.times_vectors(sparse.transposed(f.pr), columns)
    return f.transfer(solve_factored(q, right))


def log_likelihood(f: Field, nodes: DataFrame, dims: int, weights: DataFrame, y: DataFrame, sd: float | DataFrame, leaf: int = BLOCK) -> float:
    """Of the observations, the field integrated out, averaged over replicates. Points without a node are left out, and so are null values (all points are taken to be seen in each replicate)."""
    before = prior(f, nodes, dims, leaf)
    after, a = posterior(f, nodes, dims, weights, sd, leaf)
    points = with_precisions(a.select("i").distinct(), sd)
    y = checkpointed(with_precisions(seen(y), sd).join(a.select("i").distinct(), "i", "left_semi"))
    right = checkpointed(sparse.times_vectors(sparse.transposed(a), y.select("rep", "i", (F.col("v") * F.col("q")).alias("v"))))
    form = solve_factored(after, right).join(right.withColumnRenamed("v", "b"), ["rep", "i"]).agg(F.sum(F.col("v") * F.col("b")).alias("s")).first()["s"] or 0.0
    one = y.agg(F.sum(F.col("v") * F.col("v") * F.col("q")).alias("yy"), F.count_distinct("rep").alias("m")).first()
    noise = points.agg(F.count("*").alias("n"), F.sum(F.log("q")).alias("log_q")).first()
    return 0.5 * (log_determinant(before) - log_determinant(after) + (noise["log_q"] or 0.0) - noise["n"] * math.log(2 * math.pi) - ((one["yy"] or 0.0) - form) / max(one["m"], 1))


def log_likelihood_given(f: Field, nodes: DataFrame, dims: int, normal: Normal, replicates: int = 1, leaf: int = BLOCK) -> float:
    """``log_likelihood`` of observations folded onto the nodes (``fields.folded`` with ``every``)."""
    before, after = prior(f, nodes, dims, leaf), posterior_given(f, nodes, dims, normal, leaf)
    right = checkpointed(loads(f, normal))
    form = solve_factored(after, right).join(right.withColumnRenamed("v", "b"), ["rep", "i"]).agg(F.sum(F.col("v") * F.col("b")).alias("s")).first()["s"] or 0.0
    return 0.5 * (log_determinant(before) - log_determinant(after) + normal.log_q - normal.count * math.log(2 * math.pi) - (normal.yty - form) / replicates)
