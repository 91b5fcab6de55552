"""Queries on scattered places, their triangles and values between them, and on distances under a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import marching, triangulate
from gridloom.operators.cut_lineage import checkpointed
from gridloom.plans.data import MESH_SQL, PLACE_SQL, mesh, place, points, table
from gridloom.plans.mesh_queries import r

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: For each edge the first circle at its left. A triangle that is first for all three of its edges has none of the places in its circle.
_TRIANGLES = f"""
s AS (SELECT s_suppkey::BIGINT AS id, {PLACE_SQL.format(k='s_suppkey * 31')}, s_acctbal AS z FROM supplier),
met AS (
  SELECT p.id AS a, q.id AS b, w.id AS c, q.lon - p.lon AS dx, q.lat - p.lat AS dy, w.lon - (p.lon + q.lon) / 2 AS ex, w.lat - (p.lat + q.lat) / 2 AS ey
  FROM s p, s q, s w WHERE p.id <> q.id AND w.id <> p.id AND w.id <> q.id),
after AS (
  SELECT a, b, arg_min(c, (ex * ex + ey * ey - (dx * dx + dy * dy) / 4) / (dx * ey - dy * ex)) AS c FROM met
  WHERE dx * ey - dy * ex > 1e-5 * sqrt(dx * dx + dy * dy) GROUP BY a, b),
t AS (
  SELECT n.a, n.b, n.c FROM after n JOIN after m ON m.a = n.b AND m.b = n.c AND m.c = n.a JOIN after o ON o.a = n.c AND o.b = n.a AND o.c = n.b
  WHERE n.a < n.b AND n.a < n.c)
"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = place(F.col("s_suppkey") * 31)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("point_id"), lon.alias("px"), lat.alias("py"), F.col("s_acctbal").alias("value"))


@query(f"WITH {_TRIANGLES} SELECT a, b, c FROM t")
def delaunay_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of the suppliers' places."""
    return triangulate.delaunay(_suppliers(spark, sf_dir))


@query(f"""
WITH {_TRIANGLES},
g AS (SELECT i::INTEGER AS x, j::INTEGER AS y, i * 5 - 180.0::DOUBLE AS gx, j * 5 - 80.0::DOUBLE AS gy FROM range(73) AS a(i), range(33) AS b(j)),
k AS (
  SELECT t.a, t.b, t.c, p.lon AS ax, p.lat AS ay, q.lon AS bx, q.lat AS by_, w.lon AS cx, w.lat AS cy, p.z AS az, q.z AS bz, w.z AS cz,
         (q.lon - p.lon) * (w.lat - p.lat) - (w.lon - p.lon) * (q.lat - p.lat) AS area
  FROM t JOIN s p ON p.id = t.a JOIN s q ON q.id = t.b JOIN s w ON w.id = t.c),
h AS (
  SELECT x, y, a, b, c, az, bz, cz, ((cx - bx) * (gy - by_) - (gx - bx) * (cy - by_)) / area AS wa, ((ax - cx) * (gy - cy) - (gx - cx) * (ay - cy)) / area AS wb,
         ((bx - ax) * (gy - ay) - (gx - ax) * (by_ - ay)) / area AS wc
  FROM g, k),
v AS (SELECT x, y, arg_min(wa * az + wb * bz + wc * cz, (a, b, c)) AS value FROM h WHERE least(wa, wb, wc) >= -1e-9 GROUP BY x, y)
SELECT x, y, round(value, 6) + 0.0 AS value FROM g LEFT JOIN v USING (x, y)
""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' balances between their places, every five degrees."""
    out = triangulate.resampled_linear(_suppliers(spark, sf_dir), (-180.0, -80.0), (180.0, 80.0), (73, 33))
    return out.select("x", "y", r("value").alias("value"))


@query()
def resample_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' balances between their places, every degree. No SQL: it would compare all triples of customers."""
    lon, lat = place(F.col("c_custkey"))
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("point_id"), lon.alias("px"), lat.alias("py"), F.col("c_acctbal").alias("value"))
    return triangulate.resampled_linear(points, (-180.0, -80.0), (180.0, 80.0), (361, 161)).select("x", "y", r("value").alias("value"))


def _stretched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The mesh of occupied cells under one metric."""
    nodes, simplices = mesh(spark, sf_dir)
    return nodes, simplices.withColumn("tensor", F.array(*[F.array(*[F.lit(c) for c in row]) for row in ((1.0, 0.3), (0.3, 2.0))]))


def _near(dx, dy, distance, more: float = 1e-9):
    """Whether a distance is at least the straight one under that metric and at most a tenth and ``more`` longer, as in a mesh without gaps."""
    straight = F.sqrt(dx * dx + 0.6 * dx * dy + 2 * dy * dy)
    return (distance >= straight * (1 - 1e-9)) & (distance <= straight * 1.1 + more)


@query(f"WITH {MESH_SQL} SELECT node_id, 0.0::DOUBLE AS left_over, TRUE AS near FROM nodes")
def metric_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first node to all: what the triangles around a node would still take off its distance (nothing), and whether it is near the straight one."""
    nodes, simplices = _stretched(spark, sf_dir)
    whole = marching.sides(nodes, simplices, 2)
    first = nodes.agg(F.min("node_id").alias("node_id")).select(F.col("node_id").alias("origin"), "node_id", F.lit(0.0).alias("distance"))
    t = checkpointed(marching.marched(whole, first))
    turns = F.array(*[F.struct(*[F.get("v", (i + n) % 3).alias(f"n{n}") for n in range(3)], *[F.get("sides", (i + n) % 3).alias(f"s{n}") for n in range(3)]) for i in range(3)])
    each = whole.select(F.inline(turns))
    for n in (0, 1):
        each = each.join(t.select(F.col("node_id").alias(f"n{n}"), F.col("distance").alias(f"t{n}")), f"n{n}")
    least = each.groupBy(F.col("n2").alias("node_id")).agg(F.min(marching.across(*[F.col(c) for c in ("t0", "t1", "s0", "s1", "s2")])).alias("least"))
    start = nodes.agg(F.min(F.struct("node_id", "x")).alias("o"))
    both = t.join(least, "node_id").join(nodes, "node_id").crossJoin(F.broadcast(start))  # one row
    near = _near(F.get("x", 0) - F.get("o.x", 0), F.get("x", 1) - F.get("o.x", 1), F.col("distance"))
    return both.select("node_id", r(F.greatest(F.col("distance") - F.col("least"), F.lit(0.0))).alias("left_over"), near.alias("near"))


@query("SELECT ((l_orderkey * 8 + l_linenumber) * 67108864 + l_partkey * 1024 + l_suppkey % 1024) * 64 + l_quantity::BIGINT AS point_id, TRUE AS near FROM lineitem")
def point_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first lineitem's place to all lineitems' under that metric: whether each is near the straight one, up to half of a
    triangle's longest side (1.9), as values are linear along sides."""
    nodes, simplices = _stretched(spark, sf_dir)
    ends = points(spark, sf_dir).select("point_id", "x")
    start = checkpointed(ends.agg(F.min(F.struct("point_id", "x")).alias("s")).select("s.*"))
    found = marching.distances_between(nodes, simplices, start, ends, 2, 1.0)
    # Files say less than rows in memory: the places are not to be broadcast.
    both = found.join(ends.hint("merge"), found["end"] == ends["point_id"]).crossJoin(F.broadcast(start.select(F.col("x").alias("o"))))  # one row
    near = _near(F.get("x", 0) - F.get("o", 0), F.get("x", 1) - F.get("o", 1), F.col("distance"), 1.0)
    return both.select("point_id", near.alias("near"))
