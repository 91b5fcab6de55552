"""Queries on field models by tables, extended and tiled meshes, ranks, tails and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import frame_from_angle
from gridloom.operators import fem, locate, models, sparse, tiled, topology
from gridloom.operators.distributions import tail_slopes
from gridloom.operators.fields import Matern, folded, varying_coefficients
from gridloom.operators.topology import subset
from gridloom.plans.data import MESH_SQL, POINTS_SQL, mesh, point_id, points, table
from gridloom.plans.mesh_queries import _PAIRS, r
from gridloom.sources import meshes
from gridloom.sources.extended import Levels, extended_cells, extended_located, extended_neighbors, extended_nodes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_points: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {MESH_SQL}{',' + POINTS_SQL if with_points else ''}{sql}" if sql.startswith((",", " ")) else sql
        return f

    return register


@query(" SELECT simplex_id, round(sqrt(greatest((ax - bx) ** 2 + (ay - by_) ** 2, (ax - cx) ** 2 + (ay - cy) ** 2, (bx - cx) ** 2 + (by_ - cy) ** 2)), 9) AS diameter FROM triangles")
def simplex_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fem.diameters(*mesh(spark, sf_dir), 3, 2).select("simplex_id", r("diameter", 9).alias("diameter"))


#: Two further dimensions: four intervals of a half from 0, two of 5 from -1.
LEVELS = Levels((0.0, -1.0), (0.5, 5.0), (4, 2))
_STRIDES = ", t AS (SELECT (SELECT max(simplex_id) + 1 FROM simplices) AS ss, (SELECT max(node_id) + 1 FROM nodes) AS ns)"



@query(_STRIDES + " SELECT c * ns + node_id AS node_id, px AS x, py AS y, (c % 5) * 0.5::DOUBLE AS s, -1 + (c // 5) * 5.0::DOUBLE AS t FROM nodes, t, range(15) AS r(c)")
def extended_mesh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = extended_nodes(mesh(spark, sf_dir)[0], LEVELS)
    return n.select("node_id", *[F.get("x", i).alias(c) for i, c in enumerate("xyst")])


@query(_STRIDES + " SELECT p * ss + simplex_id AS simplex_id, " + ", ".join(f"v[{j + 1}] + (p % 4 + {a} + (p // 4 + {b}) * 5) * ns AS v{(2 * b + a) * 3 + j}" for b in (0, 1) for a in (0, 1) for j in range(3)) + " FROM simplices, t, range(8) AS r(p)")
def extended_mesh_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = extended_cells(*mesh(spark, sf_dir), LEVELS)
    return c.select("simplex_id", *[F.get("v", i).alias(f"v{i}") for i in range(12)])


@query(
    _STRIDES + ", facets AS (SELECT least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b, simplex_id FROM corners p JOIN corners q USING (simplex_id) WHERE p.place < q.place),"
    " base AS (SELECT DISTINCT p.simplex_id, q.simplex_id AS neighbor_id FROM facets p JOIN facets q USING (a, b) WHERE p.simplex_id <> q.simplex_id)"
    " SELECT p * ss + simplex_id AS simplex_id, p * ss + neighbor_id AS neighbor_id FROM base, t, range(8) AS r(p)"
    " UNION ALL SELECT p * ss + simplex_id, q * ss + simplex_id FROM simplices, t, range(8) AS r(p), range(8) AS u(q) WHERE (p // 4 = q // 4 AND abs(p - q) = 1) OR abs(p - q) = 4"
)
def extended_mesh_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, simplices = mesh(spark, sf_dir)
    return extended_neighbors(simplices, topology.neighbors(simplices, 3), LEVELS)


@query(
    _STRIDES + ", spot AS (SELECT point_id, l.simplex_id AS base, x.s / 0.5::DOUBLE AS s, (x.t + 1) / 5.0::DOUBLE AS t FROM located l JOIN (SELECT ((l_orderkey * 8 + l_linenumber) * 67108864 + l_partkey * 1024 + l_suppkey % 1024) * 64 + l_quantity::BIGINT AS point_id, any_value(l_discount * 25) AS s, any_value(l_tax * 100 + 1) AS t FROM lineitem GROUP BY 1) x USING (point_id)),"
    " lev AS (SELECT point_id, base, CASE WHEN s >= 4 AND s <= 4 + 1e-9 THEN 3 ELSE floor(s)::BIGINT END AS i, CASE WHEN t >= 2 AND t <= 2 + 1e-9 THEN 1 ELSE floor(t)::BIGINT END AS j FROM spot)"
    " SELECT point_id, CASE WHEN i BETWEEN 0 AND 3 AND j BETWEEN 0 AND 1 THEN (i + 4 * j) * ss + base ELSE -1 END AS simplex_id FROM lev, t",
    with_points=True,
)
def extended_mesh_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with discount and tax as further coordinates; some are above the last levels (-1)."""
    at = [F.col("l_partkey") / 20, F.col("l_quantity") / 5, F.col("l_discount") * 25, F.col("l_tax") * 100 + 1]
    t = table(spark, sf_dir, "lineitem").groupBy(point_id().alias("point_id")).agg(*[F.first(c).alias(f"x{k}") for k, c in enumerate(at)])  # numbers, not an array: no sort
    t = t.select("point_id", F.array(*[f"x{k}" for k in range(4)]).alias("x"))
    return extended_located(t, *mesh(spark, sf_dir), 3, 2, LEVELS, 1.0, 1e-9).select("point_id", F.coalesce("simplex_id", F.lit(-1)).alias("simplex_id"))


_TILES = (
    ", box AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1, max(node_id) + 1 AS stride FROM nodes),"
    " every AS (SELECT copy AS sector, node_id AS explicit_id, copy * stride + node_id AS copied, px - x0 + (copy // 2) * (x1 - x0) AS x, py - y0 + (copy % 2) * (y1 - y0) AS y FROM nodes, box, range(6) AS r(copy)),"
    " named AS (SELECT sector, explicit_id, min(copied) OVER w AS node_id, count(*) OVER w AS shared FROM every WINDOW w AS (PARTITION BY x, y))"
)


@query(_TILES + " SELECT sector, explicit_id, node_id, shared, node_id // stride AS own_sector, node_id % stride AS own_id FROM named, box")
def tiled_node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = mesh(spark, sf_dir)
    stride = nodes.agg((F.max("node_id") + 1).alias("stride"))
    names = meshes.tile_names(nodes, [3, 2], [0.0, 0.0]).crossJoin(F.broadcast(stride))
    sector, own = meshes.owner(F.col("node_id"), F.col("stride"))
    return names.select("sector", "explicit_id", "node_id", "shared", sector.alias("own_sector"), own.alias("own_id"))


@query(_TILES + " SELECT a.explicit_id, a.sector, (a.sector + 2) AS to_sector, coalesce(b.explicit_id, -1) AS to_id FROM named a LEFT JOIN named b ON b.node_id = a.node_id AND b.sector = a.sector + 2")
def tiled_names_next_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node is called one sector further along the first axis; -1 where that does not have it."""
    names = meshes.tile_names(mesh(spark, sf_dir)[0], [3, 2], [0.0, 0.0])
    return meshes.renamed(names, names.select("explicit_id", "sector", (F.col("sector") + 2).alias("to_sector"))).select("explicit_id", "sector", "to_sector", F.coalesce("to_id", F.lit(-1)).alias("to_id"))


@query(_TILES + " SELECT sector, count(*) FILTER (WHERE shared = 1) AS interior FROM named GROUP BY sector")
def tiled_interior_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = meshes.tile_names(mesh(spark, sf_dir)[0], [3, 2], [0.0, 0.0])
    return names.groupBy("sector").agg(F.count(F.when(F.col("shared") == 1, 1)).alias("interior"))


@query(" SELECT node_id, row_number() OVER (PARTITION BY node_id // 16 ORDER BY (px - 0.3) ** 2 + (py - 4.7) ** 2, node_id) AS rank FROM nodes")
def nodes_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each node by distance from (0.3, 4.7) within its column of the mesh."""
    nodes, _ = mesh(spark, sf_dir)
    d2 = locate.squared_distance(F.col("x"), F.array(F.lit(0.3), F.lit(4.7)), 2)
    return nodes.select("node_id", F.row_number().over(Window.partitionBy(F.floor(F.col("node_id") / 16)).orderBy(d2, "node_id")).cast("long").alias("rank"))


@query(
    "WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),"
    " t AS (SELECT event_type, value, ln(k / n::DOUBLE) AS y FROM n WHERE 20 * k <= n), b AS (SELECT event_type, min(value) AS x0, max(y) AS y0 FROM t GROUP BY event_type)"
    " SELECT event_type, count(*) AS n, round(sum((value - x0) * (y - y0)) / sum((value - x0) ** 2), 9) AS slope FROM t JOIN b USING (event_type) GROUP BY event_type"
)
def event_tail_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the log share of larger values over the largest twentieth of each event type's values, through its first point."""
    t = tail_slopes(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 0.05)
    return t.select("event_type", "n", r("slope", 9).alias("slope"))


@query("SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 2654435761 + 7) % 4294967296, o_orderkey LIMIT 100")
def order_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred orders in the order of a hash of their keys."""
    return subset(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


def _parameters(simplices: DataFrame) -> DataFrame:
    """Ranges and direction that vary along the mesh, and a flow, by simplex."""
    at = (F.get("v", 0) / 16).cast("long")
    return simplices.select("simplex_id", (2.0 + at % 5).alias("r1"), (1.0 + at % 3 / 2).alias("r2"), (at % 7 / 5.0).alias("angle"), (at % 4 / 10.0).alias("b"))


def _model_columns():
    return [F.col("r1"), F.col("r2")], frame_from_angle(F.col("angle"))


@query(
    ", c AS (SELECT *, (v[1] // 16) AS col FROM elements), d AS (SELECT v, area, g, 2.0::DOUBLE + col % 5 AS r1, 1.0::DOUBLE + (col % 3) / 2.0::DOUBLE AS r2, (col % 7) / 5.0::DOUBLE AS t, (col % 4) / 10.0::DOUBLE AS b FROM c),"
    " s AS (SELECT v, area, g, b, r1 / sqrt(8.0::DOUBLE) AS q1, r2 / sqrt(8.0::DOUBLE) AS q2, t FROM d),"
    " h AS (SELECT v, area, g, b, 1 / sqrt(q1 * q2) AS m, q1 ** 2 * cos(t) ** 2 + q2 ** 2 * sin(t) ** 2 AS h00, (q1 ** 2 - q2 ** 2) * cos(t) * sin(t) AS h01, q1 ** 2 * sin(t) ** 2 + q2 ** 2 * cos(t) ** 2 AS h11 FROM s)"
    " SELECT v[a] AS i, v[b_] AS j, round(sum(area * (m * CASE WHEN a = b_ THEN 2 ELSE 1 END / 12 + m * (g[a][1] * h00 * g[b_][1] + g[a][1] * h01 * g[b_][2] + g[a][2] * h01 * g[b_][1] + g[a][2] * h11 * g[b_][2]) + b * g[a][1] / 3)), 8) + 0.0 AS v"
    " FROM h, (VALUES (1), (2), (3)) AS p(a), (VALUES (1), (2), (3)) AS q(b_) GROUP BY 1, 2"
)
def fem_system_varying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system of a non-stationary, anisotropic model with a flow along x."""
    nodes, simplices = mesh(spark, sf_dir)
    c, tensor = varying_coefficients(*_model_columns(), 1.0)
    k = fem.system(nodes, simplices, 3, 2, c, tensor=tensor, flow_coefficients=[F.col("b"), None], parameters=_parameters(simplices))
    return k.select("i", "j", r("v", 8).alias("v"))


@query()
def field_implicit_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean that lineitems' discounts as a source give a field that is 1 on the lowest row of nodes."""
    nodes, simplices = mesh(spark, sf_dir)
    at = locate.located(points(spark, sf_dir).withColumn("sd", F.lit(1.0)), nodes, simplices, 3, 2, 1.0, 1e-9, keep=("value", "sd"))
    load = folded(at, 3).aty
    fixed = nodes.where(F.get("x", 1) == 0).select(F.col("node_id").alias("i"), F.lit(1.0).alias("v"))
    return models.implicit_mean(fem.system(nodes, simplices, 3, 2, 1.0, 1.0), load, fixed, 1e-6)


def _varying(spark: SparkSession, sf_dir: str) -> tuple[models.Field, DataFrame, DataFrame]:
    nodes, simplices = mesh(spark, sf_dir)
    f = models.varying_field(nodes, simplices, 3, 2, _parameters(simplices), lambda: _model_columns()[0], lambda: _model_columns()[1], 1.0, 1.0)
    return f, nodes, simplices


@query()
def field_realisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of the non-stationary field for each return flag."""
    f, _, _ = _varying(spark, sf_dir)
    reps = table(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").cast("long").alias("rep")).distinct()
    return models.realisations(f, reps, seed=5, tolerance=1e-6)


@query()
def field_posterior_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the non-stationary field given lineitems' discounts, one replicate for each return flag."""
    f, nodes, simplices = _varying(spark, sf_dir)
    y = points(spark, sf_dir, F.ascii("l_returnflag").cast("long").alias("rep")).withColumn("value", F.col("value") - 0.05)
    at = locate.located(y, nodes, simplices, 3, 2, 1.0, 1e-9, keep=("rep", "value", "sd"))
    return models.means_given(f, folded(at, 3, every=True), 1e-5)


@query()
def field_covariance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of a Matern field of order 1/2 (by the rational operators) with its first and last node."""
    nodes, simplices = mesh(spark, sf_dir)
    f = models.matern_field(nodes, simplices, 3, 2, Matern(0.5, 4.0, 1.0, 2))
    ends = nodes.agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    columns = ends.select(F.posexplode(F.array("a", "b")).alias("rep", "i")).select(F.col("rep").cast("long").alias("rep"), "i", F.lit(1.0).alias("v"))
    return models.covariance_times(f, columns, 1e-5)


@query(
    ", box AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM nodes)"
    ", ss AS (SELECT max(simplex_id) + 1 AS ss FROM simplices), spots AS (SELECT DISTINCT ((l_orderkey * 8 + l_linenumber) * 67108864 + l_partkey * 1024 + l_suppkey % 1024) * 64 + l_quantity::BIGINT AS point_id, l_partkey * 3 / 20.0::DOUBLE AS x, l_quantity * 2 / 5.0::DOUBLE AS y FROM lineitem),"
    " tiles AS (SELECT s AS sector, ix - x0 + (s // 2) * (x1 - x0) AS gx, iy - y0 + (s % 2) * (y1 - y0) AS gy, ix, iy FROM cells, box, range(6) AS r(s)),"
    " near_ AS (SELECT DISTINCT point_id, (floor(x) - dx)::BIGINT AS gx, (floor(y) - dy)::BIGINT AS gy, x, y FROM spots, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dx, dy)),"
    " hit AS (SELECT point_id, sector, CASE WHEN x - gx >= y - gy - 1e-9 THEN (ix * 16 + iy) * 2 ELSE (ix * 16 + iy) * 2 + 1 END AS simplex_id FROM near_ JOIN tiles USING (gx, gy) WHERE x - gx <= 1 + 1e-9 AND y - gy <= 1 + 1e-9),"
    " first AS (SELECT point_id, min(sector * ss + simplex_id) AS id FROM hit, ss GROUP BY point_id)"
    " SELECT DISTINCT point_id, coalesce(id // ss, -1) AS sector, coalesce(id % ss, -1) AS simplex_id FROM (SELECT DISTINCT point_id FROM spots) LEFT JOIN first USING (point_id), ss"
)
def tiled_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy and simplex of each lineitem, whose places reach over 3 x 2 copies of the mesh; -1 outside."""
    at = table(spark, sf_dir, "lineitem").select(point_id().alias("point_id"), F.array(F.col("l_partkey") * 3 / 20, F.col("l_quantity") * 2 / 5).alias("x")).distinct()
    found = tiled.tiled_located(at, *mesh(spark, sf_dir), 3, 2, [3, 2], [0.0, 0.0], 1.0, 1e-9)
    return found.select("point_id", F.coalesce("sector", F.lit(-1)).cast("long").alias("sector"), F.coalesce("simplex_id", F.lit(-1)).alias("simplex_id"))


@query(
    _TILES
    + ", c AS (SELECT n.sector, c.simplex_id, c.place, n.node_id FROM corners c JOIN named n ON n.explicit_id = c.node_id),"
    " e AS (SELECT p.sector, p.simplex_id, least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b FROM c p JOIN c q USING (sector, simplex_id) WHERE p.place < q.place)"
    " SELECT DISTINCT p.sector, p.simplex_id, q.sector AS neighbor_sector, q.simplex_id AS neighbor_id FROM e p JOIN e q USING (a, b) WHERE p.sector <> q.sector OR p.simplex_id <> q.simplex_id"
)
def tiled_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every simplex of every copy."""
    nodes, simplices = mesh(spark, sf_dir)
    wanted = simplices.select("simplex_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("sector"))
    return tiled.tiled_neighbors(nodes, simplices, 3, 2, [3, 2], wanted)
