"""Queries on the sparse factor of the meshes' systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import exact, factor, fem, locate, multilevel, sparse
from gridloom.operators.fields import folded
from gridloom.plans.data import MESH_SQL, mesh, points
from gridloom.plans.mesh_queries import ORACLES as MESHES
from gridloom.plans.mesh_queries import r
from gridloom.plans.model_queries import _varying

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _factored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, factor.Factored]:
    """The system of ``fem_system``, its nodes and its factor."""
    nodes, simplices = mesh(spark, sf_dir)
    k = fem.system(nodes, simplices, 3, 2, 1.5, 0.25, robin=-0.5)
    return k, nodes, factor.factored(k, nodes.select(F.col("node_id").alias("i"), "x"), 2)


@query(f"SELECT i, j, v FROM ({MESHES['fem_system']}) WHERE v <> 0")
def factor_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L times its transpose: the system again, and zero where only L holds something."""
    return factor.squared(_factored(spark, sf_dir)[2]).select("i", "j", r("v", 8).alias("v")).where("v <> 0")


@query(f"WITH {MESH_SQL} SELECT node_id AS i, round(sin(px) + py * py, 6) + 0.0 AS v FROM nodes")
def factor_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values whose product with the system is given: sin(x) + y^2 at the nodes."""
    k, nodes, f = _factored(spark, sf_dir)
    values = nodes.select(F.col("node_id").alias("i"), (F.sin(F.get("x", 0)) + F.get("x", 1) * F.get("x", 1)).alias("v"))
    right = sparse.times_vector(k, values).select(F.lit(0).cast("long").alias("rep"), "i", "v")
    return factor.solve_factored(f, right).select("i", r("v").alias("v"))


@query(f"WITH {MESH_SQL} SELECT node_id AS i, 1.0::DOUBLE AS v FROM nodes")
def factor_inverse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of the system times the same column of its inverse, which the selected inverse has at all places it takes: 1."""
    k, _, f = _factored(spark, sf_dir)
    z = factor.selected_inverse(f).select("i", "j", F.col("v").alias("z"))
    return k.join(z, ["i", "j"]).groupBy("i").agg(F.round(F.sum(F.col("v") * F.col("z")), 8).alias("v"))


@query()
def field_posterior_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact variances of the non-stationary field given lineitems, whose noise grows with their tax."""
    f, nodes, simplices = _varying(spark, sf_dir)
    noisy = points(spark, sf_dir, (0.5 + F.col("l_tax")).alias("noise")).drop("sd").withColumnRenamed("noise", "sd")
    at = locate.located(noisy, nodes, simplices, 3, 2, 1.0, 1e-9, keep=("value", "sd"))
    q = exact.posterior_given(f, nodes, 2, folded(at, 3, every=True))
    return exact.variances(f, q)


@query(f"WITH {MESH_SQL} SELECT node_id AS i, round(sin(px) + py * py, 5) + 0.0 AS v FROM nodes")
def multilevel_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``factor_solution``, by conjugate gradients with the multilevel cycle."""
    nodes, simplices = mesh(spark, sf_dir)
    k, places = fem.system(nodes, simplices, 3, 2, 1.5, 0.25, robin=-0.5), nodes.select(F.col("node_id").alias("i"), "x")
    values = places.select("i", (F.sin(F.get("x", 0)) + F.get("x", 1) * F.get("x", 1)).alias("v"))
    right = sparse.times_vector(k, values).select(F.lit(0).cast("long").alias("rep"), "i", "v")
    return multilevel.solve(k, right, multilevel.hierarchy(k, places, 2), 1e-9)[0].select("i", r("v", 5).alias("v"))
