"""Queries on meshes, location, finite elements and sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import fem, locate, sparse, topology
from gridloom.operators.paths import shortest_paths
from gridloom.plans.data import MESH_SQL, POINTS_SQL, mesh, points, table
from gridloom.sources import meshes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_mesh: bool = True, with_points: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [p for p, on in ((MESH_SQL, with_mesh), (POINTS_SQL, with_points)) if on]
            ORACLES[f.__name__] = ("WITH " + ",".join(parts) + ("," if sql.startswith("+") else "") + sql.removeprefix("+")) if parts else sql
        return f

    return register


def r(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + 0.0


@query("SELECT node_id, px AS x, py AS y FROM nodes")
def mesh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh(spark, sf_dir)[0].select("node_id", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))


@query("SELECT simplex_id, v[1] AS a, v[2] AS b, v[3] AS c FROM simplices")
def mesh_simplices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh(spark, sf_dir)[1].select("simplex_id", *[F.get("v", i).alias(n) for i, n in enumerate("abc")])


@query("+ pairs AS (SELECT least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b FROM corners p JOIN corners q USING (simplex_id) WHERE p.place < q.place) SELECT DISTINCT a, b FROM pairs")
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.edges(mesh(spark, sf_dir)[1], 3)


_FACETS = "+ facets AS (SELECT least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b, simplex_id FROM corners p JOIN corners q USING (simplex_id) WHERE p.place < q.place)"


@query(_FACETS + " SELECT a, b, count(*) AS n, min(simplex_id) AS first, max(simplex_id) AS last FROM facets GROUP BY a, b")
def mesh_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = topology.facets(mesh(spark, sf_dir)[1], 3, 2)
    return f.select(F.get("facet", 0).alias("a"), F.get("facet", 1).alias("b"), F.size("simplices").cast("long").alias("n"), F.array_min("simplices").alias("first"), F.array_max("simplices").alias("last"))


@query(_FACETS + " SELECT a, b, min(simplex_id) AS simplex_id FROM facets GROUP BY a, b HAVING count(*) = 1")
def mesh_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.boundary(mesh(spark, sf_dir)[1], 3).select(F.get("facet", 0).alias("a"), F.get("facet", 1).alias("b"), "simplex_id")


@query(_FACETS + " SELECT DISTINCT p.simplex_id, q.simplex_id AS neighbor_id FROM facets p JOIN facets q USING (a, b) WHERE p.simplex_id <> q.simplex_id")
def mesh_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.neighbors(mesh(spark, sf_dir)[1], 3)


@query("SELECT min(px) AS low0, max(px) AS high0, min(py) AS low1, max(py) AS high1 FROM nodes")
def mesh_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.bounding_box(mesh(spark, sf_dir)[0], 2)


@query(
    "+ pairs AS (SELECT DISTINCT least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b FROM corners p JOIN corners q USING (simplex_id) WHERE p.place < q.place)"
    " SELECT count(*) AS n, round(min(l), 9) AS shortest, round(max(l), 9) AS longest FROM (SELECT sqrt((s.px - t.px) ** 2 + (s.py - t.py) ** 2) AS l FROM pairs JOIN nodes s ON s.node_id = a JOIN nodes t ON t.node_id = b)"
)
def mesh_edge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, simplices = mesh(spark, sf_dir)
    return topology.edge_lengths(nodes, topology.edges(simplices, 3), 2).agg(F.count("*").alias("n"), r(F.min("length"), 9).alias("shortest"), r(F.max("length"), 9).alias("longest"))


@query(_FACETS + " SELECT a, b, s.px AS ax, s.py AS ay, t.px AS bx, t.py AS by_ FROM (SELECT a, b FROM facets GROUP BY a, b HAVING count(*) = 1) JOIN nodes s ON s.node_id = a JOIN nodes t ON t.node_id = b")
def mesh_boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, simplices = mesh(spark, sf_dir)
    edge = topology.boundary(simplices, 3).select(F.get("facet", 0).alias("a"), F.get("facet", 1).alias("b"))
    at = topology.lines(nodes, edge)
    return at.select("a", "b", *[F.get(c, i).alias(n) for c, i, n in (("start", 0, "ax"), ("start", 1, "ay"), ("end", 0, "bx"), ("end", 1, "by_"))])


@query("SELECT node_id, count(DISTINCT simplex_id) AS n, min(simplex_id) AS first FROM corners GROUP BY node_id")
def simplices_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.simplices_of_nodes(mesh(spark, sf_dir)[1]).select("node_id", F.size("simplices").cast("long").alias("n"), "first")


@query("+ sets AS (SELECT s_suppkey AS set_id, (s_suppkey % 100) * 16 + s_suppkey % 10 AS p FROM supplier) SELECT set_id, simplex_id FROM sets JOIN simplices ON list_contains(v, p) AND list_contains(v, p + 17)")
def simplices_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("s_suppkey") % 100) * 16 + F.col("s_suppkey") % 10
    sets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("set_id"), F.array(p, p + 17).alias("nodes"))
    return topology.simplices_of_sets(sets, mesh(spark, sf_dir)[1])


@query("SELECT simplex_id, area, " + ", ".join(f"round(g[{a + 1}][{k + 1}], 9) + 0.0 AS g{a}{k}" for a in range(3) for k in range(2)) + " FROM elements")
def simplex_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fem.elements(*mesh(spark, sf_dir), 3, 2)
    return e.select("simplex_id", "area", *[r(F.get(F.get("gradients", a), k), 9).alias(f"g{a}{k}") for a in range(3) for k in range(2)])


@query("SELECT node_id, simplex_id, round(area / sum(area) OVER (PARTITION BY node_id), 9) AS w FROM corners JOIN elements USING (simplex_id)")
def node_area_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, simplices = mesh(spark, sf_dir)
    shares = locate.area_shares(simplices, fem.elements(nodes, simplices, 3, 2).select("simplex_id", "area"))
    return shares.select("node_id", "simplex_id", r("w", 9).alias("w"))


@query(
    "+ active AS (SELECT (s_suppkey % 400)::DOUBLE AS x, ((s_suppkey * 7) % 11)::DOUBLE AS y FROM supplier),"
    " outside AS (SELECT node_id FROM nodes, active GROUP BY node_id HAVING min((px - x) ** 2 + (py - y) ** 2) > 2.25)"
    " SELECT simplex_id, v[1] AS a, v[2] AS b, v[3] AS c FROM simplices WHERE NOT EXISTS (SELECT 1 FROM corners q JOIN outside o USING (node_id) WHERE q.simplex_id = simplices.simplex_id)"
)
def mesh_cut_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, simplices = mesh(spark, sf_dir)
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.array((F.col("s_suppkey") % 400).cast("double"), (F.col("s_suppkey") * 7 % 11).cast("double")).alias("x"))
    far = locate.nearest(nodes.withColumnRenamed("node_id", "point_id"), sites, 2, 2.0).where("distance > 1.5").select(F.col("point_id").alias("node_id"))
    return topology.cut(nodes, simplices, far)[1].select("simplex_id", *[F.get("v", i).alias(n) for i, n in enumerate("abc")])


@query(
    "+ t AS (SELECT (count(*) FILTER (WHERE px > 5) > 0) AS any_, max(node_id) AS top FROM nodes),"
    " n AS (SELECT *, CASE WHEN px <= 5 THEN 0.8 ELSE 9 END AS lim FROM nodes),"
    " e AS (SELECT DISTINCT least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b FROM corners p JOIN corners q USING (simplex_id) WHERE p.place < q.place),"
    " long AS (SELECT a, b, (s.px + u.px) / 2 AS x, (s.py + u.py) / 2 AS y, (s.lim + u.lim) / 2 AS lim FROM e JOIN n s ON s.node_id = a JOIN n u ON u.node_id = b WHERE sqrt((s.px - u.px) ** 2 + (s.py - u.py) ** 2) > least(s.lim, u.lim))"
    " SELECT top + row_number() OVER (ORDER BY a, b) AS node_id, x, y, round(lim, 9) AS node_limit FROM long, t"
    " UNION ALL SELECT node_id, px, py, lim FROM n"
)
def mesh_refine_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, simplices = mesh(spark, sf_dir)
    limited = nodes.withColumn("limit", F.when(F.get("x", 0) <= 5, 0.8).otherwise(9.0))
    more = topology.refine_once(limited, simplices, 3, 2)[0]
    return more.select("node_id", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"), r("limit", 9).alias("node_limit"))


@query(
    "+ t AS (SELECT max(node_id) AS top FROM nodes),"
    " n AS (SELECT *, CASE WHEN (node_id // 16) % 2 = 0 THEN 0.8 ELSE 1.2 END AS lim FROM nodes),"
    " e AS (SELECT DISTINCT least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b FROM corners p JOIN corners q USING (simplex_id) WHERE p.place < q.place),"
    " long AS (SELECT a, b, (s.px + u.px) / 2 AS x, (s.py + u.py) / 2 AS y, (s.lim + u.lim) / 2 AS lim FROM e JOIN n s ON s.node_id = a JOIN n u ON u.node_id = b WHERE sqrt((s.px - u.px) ** 2 + (s.py - u.py) ** 2) > least(s.lim, u.lim))"
    " SELECT top + row_number() OVER (ORDER BY a, b) AS node_id, x, y, round(lim, 9) AS node_limit FROM long, t"
    " UNION ALL SELECT node_id, px, py, lim FROM n"
)
def mesh_refine_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``mesh_refine_once``, by limits that bind in every column of the mesh."""
    nodes, simplices = mesh(spark, sf_dir)
    limited = nodes.withColumn("limit", F.when(F.get("x", 0) % 2 == 0, 0.8).otherwise(1.2))
    more = topology.refine_once(limited, simplices, 3, 2)[0]
    return more.select("node_id", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"), r("limit", 9).alias("node_limit"))


_CAPPED = (
    "+ t AS (SELECT max(node_id) AS top FROM nodes),"
    " e AS (SELECT DISTINCT least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b FROM corners p JOIN corners q USING (simplex_id) WHERE p.place < q.place),"
    " l AS (SELECT a, b, (s.px + u.px) / 2 AS x, (s.py + u.py) / 2 AS y, sqrt((s.px - u.px) ** 2 + (s.py - u.py) ** 2) AS length FROM e JOIN nodes s ON s.node_id = a JOIN nodes u ON u.node_id = b),"
    " long AS (SELECT * FROM l WHERE length > 0.8 QUALIFY row_number() OVER (ORDER BY round(length * 1e9) DESC, a, b) <= (SELECT count(*) // 2 FROM nodes))"
)


def _capped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One pass that may add half as many nodes as there are."""
    nodes, simplices = mesh(spark, sf_dir)
    return topology.refine_once(nodes.withColumn("limit", F.lit(0.8)), simplices, 3, 2, most=nodes.count() // 2)[:2]


@query(_CAPPED + " SELECT top + row_number() OVER (ORDER BY a, b) AS node_id, x, y FROM long, t UNION ALL SELECT node_id, px, py FROM nodes")
def mesh_refine_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a pass whose room runs out among edges of one length."""
    return _capped(spark, sf_dir)[0].select("node_id", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))


@query(
    _CAPPED
    + ", s AS (SELECT p.simplex_id, least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b FROM corners p JOIN corners q USING (simplex_id) WHERE p.place < q.place),"
    " m AS (SELECT a, b, top + row_number() OVER (ORDER BY a, b) AS mid FROM long, t)"
    " SELECT simplex_id, count(mid) + 1 AS n, coalesce(sum(mid), 0)::BIGINT AS mids FROM s LEFT JOIN m USING (a, b) GROUP BY simplex_id"
)
def mesh_refine_capped_simplices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each simplex: into how many it was split, and the sum of its new nodes' ids."""
    nodes, split = _capped(spark, sf_dir)
    old = mesh(spark, sf_dir)[0].agg(F.max("node_id").alias("top"))
    parts = split.select(F.floor(F.col("simplex_id") / 8).alias("simplex_id"), F.col("simplex_id").alias("part"), F.explode("v").alias("node_id")).crossJoin(F.broadcast(old))  # one row
    new = F.collect_set(F.when(F.col("node_id") > F.col("top"), F.col("node_id")))
    out = parts.groupBy("simplex_id").agg(F.count_distinct("part").alias("n"), new.alias("new"))
    return out.select("simplex_id", "n", F.aggregate("new", F.lit(0).cast("long"), lambda a, b: a + b).alias("mids"))


@query(
    "+ c AS (SELECT max(node_id) + 1 AS stride FROM nodes), s AS (SELECT simplex_id, list_sort(v) AS v, layer FROM simplices, (VALUES (0), (1)) AS l(layer)),"
    " t AS (SELECT (simplex_id * 2 + layer) * 3 + step AS simplex_id, list_concat([i + layer * stride FOR i IN v[1:step + 1]], [i + (layer + 1) * stride FOR i IN v[step + 1:3]]) AS w FROM s, c, (VALUES (0), (1), (2)) AS k(step))"
    " SELECT simplex_id, w[1] AS a, w[2] AS b, w[3] AS c, w[4] AS d FROM t"
)
def mesh_extrude(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = meshes.extrude(*mesh(spark, sf_dir), [0.0, 1.0, 3.0])
    return s.select("simplex_id", *[F.get("v", i).alias(n) for i, n in enumerate("abcd")])


@query(
    "+ box AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1, max(node_id) + 1 AS stride FROM nodes),"
    " every AS (SELECT copy * stride + node_id AS node_id, px - x0 - 8 + (copy // 2) * (x1 - x0) AS x, py - y0 + 17 + (copy % 2) * (y1 - y0) AS y FROM nodes, box, range(6) AS r(copy))"
    " SELECT min(node_id) AS node_id, x, y FROM every GROUP BY x, y"
)
def mesh_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = meshes.tile(*mesh(spark, sf_dir), [3, 2], [-8.0, 17.0])
    return nodes.select("node_id", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))


@query("SELECT point_id, simplex_id FROM located", with_points=True)
def locate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.located(points(spark, sf_dir), *mesh(spark, sf_dir), 3, 2, 1.0, 1e-9).select("point_id", "simplex_id")


@query("SELECT point_id, node_id, round(wt, 6) + 0.0 AS w FROM weights WHERE abs(wt) > 1e-9", with_points=True)
def observation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = locate.observation_weights(points(spark, sf_dir), *mesh(spark, sf_dir), 3, 2, 1.0, 1e-9)
    return w.where(F.abs("w") > 1e-9).select("point_id", "node_id", r("w").alias("w"))


@query("SELECT node_id, round(sum(wt), 5) AS weight, round(sum(wt * value) / sum(wt), 6) AS mean FROM weights GROUP BY node_id HAVING sum(wt) > 1e-6", with_points=True)
def observation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: points to nodes, weighted mean of a value at each node."""
    w = locate.observation_weights(points(spark, sf_dir), *mesh(spark, sf_dir), 3, 2, 1.0, 1e-9)
    at = w.join(points(spark, sf_dir).select("point_id", "value"), "point_id").groupBy("node_id")
    out = at.agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("value")).alias("m")).where("s > 1e-6")
    return out.select("node_id", r("s", 5).alias("weight"), r(F.col("m") / F.col("s")).alias("mean"))


@query(
    "+ moved AS (SELECT ((l_orderkey * 8 + l_linenumber) * 67108864 + l_partkey * 1024 + l_suppkey % 1024) * 64 + l_quantity::BIGINT AS point_id, l_partkey / 20.0::DOUBLE AS x, l_quantity / 5.0::DOUBLE + 2.5 AS y FROM lineitem),"
    " near AS (SELECT point_id, (floor(x) - dx)::BIGINT AS ix, (floor(y) - dy)::BIGINT AS iy, x - (floor(x) - dx) AS u, y - (floor(y) - dy) AS w FROM moved, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dx, dy))"
    " SELECT point_id FROM moved WHERE point_id NOT IN (SELECT point_id FROM near JOIN cells USING (ix, iy) WHERE u <= 1 + 1e-9 AND w <= 1 + 1e-9)"
)
def unlocated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems moved half a mesh cell and two more up, so that some are beyond the mesh."""
    moved = points(spark, sf_dir).withColumn("x", F.array(F.get("x", 0), F.get("x", 1) + 2.5))
    return locate.located(moved, *mesh(spark, sf_dir), 3, 2, 1.0, 1e-9).where("simplex_id IS NULL").select("point_id")


_PAIRS = "FROM elements, (VALUES (1), (2), (3)) AS p(a), (VALUES (1), (2), (3)) AS q(b)"
_MASS = f"SELECT v[a] AS i, v[b] AS j, sum(area * CASE WHEN a = b THEN 2 ELSE 1 END / 12) AS v {_PAIRS} GROUP BY 1, 2"
_STIFF = f"SELECT v[a] AS i, v[b] AS j, sum(area * (g[a][1] * g[b][1] + g[a][2] * g[b][2])) AS v {_PAIRS} GROUP BY 1, 2"


def _out(m: DataFrame, digits: int = 9) -> DataFrame:
    return m.select("i", "j", r("v", digits).alias("v"))


@query(f"SELECT i, j, round(v, 9) + 0.0 AS v FROM ({_MASS})")
def fem_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fem.assembled(fem.mass(fem.elements(*mesh(spark, sf_dir), 3, 2), 3)))


@query(f"SELECT i, j, round(v, 9) + 0.0 AS v FROM ({_STIFF})")
def fem_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fem.assembled(fem.stiffness(fem.elements(*mesh(spark, sf_dir), 3, 2), 3, 2)))


@query(f"SELECT v[a] AS i, v[b] AS j, round(sum(area * g[a][1] / 3), 9) + 0.0 AS v {_PAIRS} GROUP BY 1, 2")
def fem_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fem.assembled(fem.flow(fem.elements(*mesh(spark, sf_dir), 3, 2), 3, 0)))


@query(f"SELECT v[a] AS i, v[b] AS j, round(sum(area * g[a][1] * g[b][2]), 9) + 0.0 AS v {_PAIRS} GROUP BY 1, 2")
def fem_stiffness_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fem.assembled(fem.stiffness_part(fem.elements(*mesh(spark, sf_dir), 3, 2), 3, 2, 0, 1)))


@query("SELECT v[a] AS i, round(sum(area / 3), 9) AS v FROM elements, (VALUES (1), (2), (3)) AS p(a) GROUP BY 1")
def fem_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fem.assembled_load(fem.load(fem.elements(*mesh(spark, sf_dir), 3, 2), 3)).select("i", r("v", 9).alias("v"))


@query(
    _FACETS + f", m AS ({_MASS}), g AS ({_STIFF}), edge AS (SELECT a, b, 1.0 AS l FROM facets GROUP BY a, b HAVING count(*) = 1), len_ AS (SELECT a, b, sqrt((s.px - t.px) ** 2 + (s.py - t.py) ** 2) AS l FROM edge JOIN nodes s ON s.node_id = a JOIN nodes t ON t.node_id = b),"
    " rob AS (SELECT a AS i, a AS j, l / 3 AS v FROM len_ UNION ALL SELECT b, b, l / 3 FROM len_ UNION ALL SELECT a, b, l / 6 FROM len_ UNION ALL SELECT b, a, l / 6 FROM len_)"
    " SELECT i, j, round(sum(v), 8) + 0.0 AS v FROM (SELECT i, j, 1.5 * v AS v FROM m UNION ALL SELECT i, j, 0.25 * v FROM g UNION ALL SELECT i, j, 0.5 * v FROM rob) GROUP BY i, j"
)
def fem_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fem.system(*mesh(spark, sf_dir), 3, 2, 1.5, 0.25, robin=-0.5), 8)


@query("+ f AS (SELECT node_id, sin(px) + py * py AS f FROM nodes), c AS (SELECT simplex_id, f, g[place + 1] AS g FROM corners JOIN f USING (node_id) JOIN elements USING (simplex_id)) SELECT simplex_id, round(sum(f * g[1]), 7) + 0.0 AS gx, round(sum(f * g[2]), 7) + 0.0 AS gy FROM c GROUP BY simplex_id")
def simplex_gradient_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, simplices = mesh(spark, sf_dir)
    values = nodes.select("node_id", (F.sin(F.get("x", 0)) + F.get("x", 1) * F.get("x", 1)).alias("value"))
    g = fem.gradient_of(values, fem.elements(nodes, simplices, 3, 2))
    return g.select("simplex_id", r(F.get("gradient", 0), 7).alias("gx"), r(F.get("gradient", 1), 7).alias("gy"))


@query(f"+ m AS ({_MASS}), g AS ({_STIFF}) SELECT m.i, g.j, round(sum(m.v * g.v), 8) + 0.0 AS v FROM m JOIN g ON m.j = g.i GROUP BY 1, 2")
def sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fem.elements(*mesh(spark, sf_dir), 3, 2)
    return _out(sparse.product(fem.assembled(fem.mass(e, 3)), fem.assembled(fem.stiffness(e, 3, 2))), 8)


@query(f"+ g AS ({_STIFF}) SELECT i, round(sum(v * px * px), 7) + 0.0 AS v FROM g JOIN nodes ON node_id = j GROUP BY 1")
def sparse_times_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, simplices = mesh(spark, sf_dir)
    g = fem.assembled(fem.stiffness(fem.elements(nodes, simplices, 3, 2), 3, 2))
    x = nodes.select(F.col("node_id").alias("i"), (F.get("x", 0) * F.get("x", 0)).alias("v"))
    return sparse.times_vector(g, x).select("i", r("v", 7).alias("v"))


@query(f"SELECT i, round(sum(v), 9) AS v FROM ({_MASS}) GROUP BY i")
def lumped_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.row_sums(fem.assembled(fem.mass(fem.elements(*mesh(spark, sf_dir), 3, 2), 3))).select("i", r("v", 9).alias("v"))


@query(f"+ g AS ({_STIFF}) SELECT i, j, round(v, 9) + 0.0 AS v FROM g WHERE i % 16 > 0 AND j % 16 > 0")
def sparse_without_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, simplices = mesh(spark, sf_dir)
    g = fem.assembled(fem.stiffness(fem.elements(nodes, simplices, 3, 2), 3, 2))
    return _out(sparse.without(g, nodes.where(F.get("x", 1) == 0).select(F.col("node_id").alias("i"))))


@query("SELECT a.node_id AS i, b.node_id AS j, round(sum(a.wt * b.wt * 4), 5) + 0.0 AS v FROM weights a JOIN weights b USING (point_id) WHERE abs(a.wt) > 1e-9 AND abs(b.wt) > 1e-9 GROUP BY 1, 2", with_points=True)
def normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.operators.fields import folded

    at = locate.located(points(spark, sf_dir), *mesh(spark, sf_dir), 3, 2, 1.0, 1e-9, keep=("value", "sd"))
    return _out(folded(at, 3, 1e-9).ata, 5)


@query(
    "WITH s AS (SELECT min(s_suppkey) AS id, (s_suppkey % 400)::DOUBLE AS x, ((s_suppkey * 7) % 11)::DOUBLE AS y FROM supplier GROUP BY 2, 3),"
    " d AS (SELECT ((l_orderkey * 8 + l_linenumber) * 67108864 + l_partkey * 1024 + l_suppkey % 1024) * 64 + l_quantity::BIGINT AS point_id, min(struct_pack(d := (l_partkey / 20.0::DOUBLE - x) ** 2 + (l_quantity / 5.0::DOUBLE - y) ** 2, id := id)) AS b FROM lineitem, s GROUP BY 1)"
    " SELECT point_id, b.id AS site_id, round(sqrt(b.d), 6) AS distance FROM d",
    with_mesh=False,
)
def nearest_active_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each lineitem's nearest supplier and its distance, by grid bins; the least supplier on ties."""
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.array((F.col("s_suppkey") % 400).cast("double"), (F.col("s_suppkey") * 7 % 11).cast("double")).alias("x"))
    return locate.nearest(points(spark, sf_dir).select("point_id", "x"), sites, 2, 2.0).select("point_id", "site_id", r("distance").alias("distance"))


@query()
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first node to all nodes of the mesh."""
    nodes, simplices = mesh(spark, sf_dir)
    pairs = topology.edge_lengths(nodes, topology.edges(simplices, 3), 2)
    origins = nodes.agg(F.min("node_id").alias("origin"))
    return shortest_paths(pairs, origins).select("origin", "node_id", r("distance").alias("distance"))


ORACLES["shortest_path"] = (
    "WITH RECURSIVE " + MESH_SQL + ","
    " e AS (SELECT DISTINCT p.node_id AS a, q.node_id AS b FROM corners p JOIN corners q USING (simplex_id) WHERE p.node_id <> q.node_id),"
    " l AS (SELECT a, b, sqrt((s.px - t.px) ** 2 + (s.py - t.py) ** 2) AS d FROM e JOIN nodes s ON s.node_id = a JOIN nodes t ON t.node_id = b),"
    " o AS (SELECT min(node_id) AS origin, 2 * max(px) + 64 AS most FROM nodes),"
    " walk(node_id, distance, k) AS (SELECT origin, 0.0::DOUBLE, 0 FROM o UNION ALL"
    " SELECT b, distance, k + 1 FROM (SELECT b, min(distance + d) AS distance, any_value(k) AS k FROM walk JOIN l ON a = node_id GROUP BY b) WHERE k < (SELECT most FROM o))"
    " SELECT origin, node_id, round(min(distance), 6) AS distance FROM walk, o GROUP BY 1, 2"
)
