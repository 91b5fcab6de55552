"""Inputs of the registered queries, derived from the tables: a mesh of occupied cells, its points, images and hashed places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.meshes import split_cells

#: The mesh has a cell for each occupied pair (partkey div 20, quantity div 5); a node's id is 16 * ix + iy, its place (ix, iy).
MESH_SQL = """
cells AS (SELECT DISTINCT l_partkey // 20 AS ix, CAST(floor(l_quantity / 5) AS BIGINT) AS iy FROM lineitem),
simplices AS (
  SELECT (ix * 16 + iy) * 2 AS simplex_id, [ix * 16 + iy, (ix + 1) * 16 + iy, (ix + 1) * 16 + iy + 1] AS v FROM cells
  UNION ALL SELECT (ix * 16 + iy) * 2 + 1, [ix * 16 + iy, ix * 16 + iy + 1, (ix + 1) * 16 + iy + 1] FROM cells),
corners AS (SELECT simplex_id, unnest(v) AS node_id, generate_subscripts(v, 1) - 1 AS place FROM simplices),
nodes AS (SELECT DISTINCT node_id, (node_id // 16)::DOUBLE AS px, (node_id % 16)::DOUBLE AS py FROM corners),
triangles AS (
  SELECT simplex_id, v, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_, c.px AS cx, c.py AS cy
  FROM simplices s JOIN nodes a ON a.node_id = v[1] JOIN nodes b ON b.node_id = v[2] JOIN nodes c ON c.node_id = v[3]),
elements AS (
  SELECT simplex_id, v, abs(det) / 2 AS area,
         [[(by_ - cy) / det, (cx - bx) / det], [(cy - ay) / det, (ax - cx) / det], [(ay - by_) / det, (bx - ax) / det]] AS g
  FROM (SELECT *, (bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay) AS det FROM triangles))
"""
#: Points are the lineitems, in the mesh's coordinates; each lies in the least simplex that holds it, faces included.
POINTS_SQL = """
points AS (SELECT ((l_orderkey * 8 + l_linenumber) * 67108864 + l_partkey * 1024 + l_suppkey % 1024) * 64 + l_quantity::BIGINT AS point_id, l_partkey / 20.0::DOUBLE AS x, l_quantity / 5.0::DOUBLE AS y, l_discount AS value, l_tax FROM lineitem),
near AS (
  SELECT point_id, value, (floor(x) - dx)::BIGINT AS ix, (floor(y) - dy)::BIGINT AS iy, x - (floor(x) - dx) AS u, y - (floor(y) - dy) AS w
  FROM points, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dx, dy)),
held AS (
  SELECT point_id, value, n.ix, n.iy, u, w, CASE WHEN u >= w - 1e-9 THEN (n.ix * 16 + n.iy) * 2 ELSE (n.ix * 16 + n.iy) * 2 + 1 END AS simplex_id
  FROM near n JOIN cells c ON c.ix = n.ix AND c.iy = n.iy WHERE u <= 1 + 1e-9 AND w <= 1 + 1e-9),
located AS (SELECT point_id, min(simplex_id) AS simplex_id, arg_min(u, simplex_id) AS u, arg_min(w, simplex_id) AS w, any_value(value) AS value FROM held GROUP BY point_id),
weights AS (
  SELECT point_id, value, unnest(CASE WHEN simplex_id % 2 = 0 THEN [simplex_id // 2, simplex_id // 2 + 16, simplex_id // 2 + 17] ELSE [simplex_id // 2, simplex_id // 2 + 1, simplex_id // 2 + 17] END) AS node_id,
         unnest(CASE WHEN simplex_id % 2 = 0 THEN [1 - u, u - w, w] ELSE [1 - w, w - u, u] END) AS wt
  FROM located)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and triangles of the occupied cells."""
    cells = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_partkey") / 20).alias("ix"), F.floor(F.col("l_quantity") / 5).alias("iy")).distinct()
    simplices = split_cells(cells, [F.col("ix"), F.col("iy")], F.col("ix") * 16 + F.col("iy"), lambda at: at[0] * 16 + at[1])
    ids = simplices.select(F.explode("v").alias("node_id")).distinct()
    nodes = ids.select("node_id", F.array(F.floor(F.col("node_id") / 16).cast("double"), F.pmod("node_id", F.lit(16)).cast("double")).alias("x"))
    return nodes, simplices


def point_id() -> Column:
    """Of a lineitem: order, line, part, supplier and quantity in one number."""
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 67108864 + F.col("l_partkey") * 1024 + F.col("l_suppkey") % 1024
    return line * 64 + F.col("l_quantity").cast("long")


def points(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """``point_id, x, value, sd``, and more columns: lineitems."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(point_id().alias("point_id"), F.array(F.col("l_partkey") / 20, F.col("l_quantity") / 5).alias("x"), F.col("l_discount").alias("value"), F.lit(0.5).alias("sd"), *more)


def place(key: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a key, spread by multiplication."""
    return F.pmod(key * 7919, F.lit(36000)) / 100.0 - 180.0, F.pmod(key * 104729, F.lit(16001)) / 100.0 - 80.0


#: The same in SQL, for a key column.
PLACE_SQL = "((({k})::BIGINT * 7919) % 36000) / 100.0::DOUBLE - 180.0::DOUBLE AS lon, ((({k})::BIGINT * 104729) % 16001) / 100.0::DOUBLE - 80.0::DOUBLE AS lat"


def image(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """Mean value of events by user (mod 24) and event id (mod 20 of its fifths): of odd or even users."""
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == part)
    return e.groupBy((F.col("user_id") % 24).cast("int").alias("x"), (F.floor(F.col("event_id") / 2) % 20).cast("int").alias("y")).agg(F.round(F.avg("value"), 6).alias("value"))


IMAGE_SQL = "SELECT (user_id % 24)::INTEGER AS x, ((event_id // 2) % 20)::INTEGER AS y, round(avg(value), 6) AS value FROM events WHERE event_id % 2 = {part} GROUP BY 1, 2"
