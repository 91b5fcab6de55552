"""Location and neighbours in a mesh that is repeated side by side, from the base mesh alone: no copy is written out.

A copy's number (sector) counts row by row, as in ``sources.meshes.tile``; a simplex is named by its sector and its id in the base mesh.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.locate import containing
from gridloom.operators.topology import facets, neighbors


def _box(nodes: DataFrame, d: int) -> DataFrame:
    """One row: ``low0, long0, low1, ...``, the base mesh's least places and lengths."""
    at = [F.get("x", i) for i in range(d)]
    return nodes.agg(*[c for i, a in enumerate(at) for c in (F.min(a).alias(f"low{i}"), (F.max(a) - F.min(a)).alias(f"long{i}"))])


def _strides(copies: list[int]) -> list[int]:
    return [math.prod(copies[i + 1 :]) for i in range(len(copies))]


def tiled_containing(points: DataFrame, nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, copies: list[int], offset: list[float], width: float, slack: float = 1e-12) -> DataFrame:
    """``point_id, sector, simplex_id, v, w``: every simplex of every copy that holds a point (``point_id, x``), with v by the base nodes' ids; see ``locate.containing``.

    The sectors that a point touches follow from its place (on common faces more than one); moved back, it meets the base mesh by the one join of ``containing``.
    The first copy's corner of least coordinates lies at ``offset``. Points outside, or with null coordinates, are in none.
    """
    own = points.crossJoin(F.broadcast(_box(nodes, d)))  # one row
    near = width * 1e-9 + slack
    for i, stride in enumerate(_strides(copies)):
        x, long = F.get("x", i) - offset[i], F.col(f"long{i}")
        own = own.withColumn(f"k{i}", F.explode(F.sequence(F.floor((x - near) / long), F.floor((x + near) / long)))).where(F.col(f"k{i}").between(-1, copies[i]))
        own = own.withColumn(f"k{i}", F.least(F.greatest(f"k{i}", F.lit(0)), F.lit(copies[i] - 1)))  # a point within rounding of the outer faces
    own = own.distinct()
    sector = sum(F.col(f"k{i}") * stride for i, stride in enumerate(_strides(copies)))
    back = [F.get("x", i) - offset[i] - F.col(f"k{i}") * F.col(f"long{i}") + F.col(f"low{i}") for i in range(d)]
    moved = own.select(F.struct("point_id", sector.alias("sector")).alias("point_id"), F.array(*back).alias("x"))
    met = containing(moved, nodes, simplices, vertices, d, width, slack)
    return met.select("point_id.point_id", "point_id.sector", "simplex_id", "v", "w")


def tiled_located(points: DataFrame, *args, **kwargs) -> DataFrame:
    """``point_id, sector, simplex_id, v, w``: of the simplices that hold a point the one with the least (sector, id); nulls for points in none."""
    first = tiled_containing(points, *args, **kwargs).groupBy("point_id").agg(F.min(F.struct("sector", "simplex_id", "v", "w")).alias("s"))
    return points.select("point_id").join(first, "point_id", "left").select("point_id", "s.*")


def _on_faces(nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, digits: int) -> DataFrame:
    """``simplex_id, axis, side, key``: outer facets on the box's faces (side 1: the high face); facets that meet when copies do have one key."""
    single = facets(simplices, vertices, vertices - 1).where(F.size("simplices") == 1).select(F.get("simplices", 0).alias("simplex_id"), "facet")
    corner = single.select("simplex_id", "facet", F.explode("facet").alias("node_id")).join(nodes.select("node_id", "x"), "node_id")
    place = F.transform("x", lambda c: F.round(c, digits) + 0.0)
    corner = corner.crossJoin(F.broadcast(_box(nodes, d)))  # one row
    whole = corner.groupBy("simplex_id", "facet").agg(
        F.array_sort(F.collect_list(place)).alias("places"), *[c for i in range(d) for c in _sides(i, digits)]
    )
    rows = [
        whole.where(f"{side}{i}").select("simplex_id", F.lit(i).alias("axis"), F.lit(n).alias("side"), F.array_sort(F.transform("places", lambda p: F.array(*[F.get(p, k) for k in range(d) if k != i]))).alias("key"))  # noqa: B023 - built at once
        for i in range(d)
        for n, side in enumerate(("low_side", "high_side"))
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _sides(i: int, digits: int) -> list[Column]:
    x = F.get("x", i)
    return [F.bool_and(F.round(x, digits) == F.round(at, digits)).alias(f"{side}{i}") for side, at in (("low_side", F.col(f"low{i}")), ("high_side", F.col(f"low{i}") + F.col(f"long{i}")))]


def tiled_neighbors(nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, copies: list[int], wanted: DataFrame, digits: int = 9) -> DataFrame:
    """``sector, simplex_id, neighbor_sector, neighbor_id``: for simplices ``wanted`` (``sector, simplex_id``), those that share a facet, in their own sector or the next.

    Within a sector they are the base mesh's neighbours; across, outer facets on opposite faces of the base mesh's box meet where they agree but for that axis. Both tables
    have the base mesh's size. Places are compared to ``digits``. Sectors beyond ``copies`` have none.
    """
    wanted = wanted.where(F.col("sector").between(0, math.prod(copies) - 1)).select("sector", "simplex_id")
    inside = wanted.join(neighbors(simplices, vertices), "simplex_id").select("sector", "simplex_id", F.col("sector").alias("neighbor_sector"), "neighbor_id")
    faces = _on_faces(nodes, simplices, vertices, d, digits)
    high, low = (faces.where(f"side = {n}").select("axis", "key", F.col("simplex_id").alias(name)) for n, name in ((1, "h"), (0, "l")))
    met = high.join(low, ["axis", "key"])
    across = met.select("axis", F.lit(1).alias("step"), F.col("h").alias("simplex_id"), F.col("l").alias("neighbor_id")).unionByName(
        met.select("axis", F.lit(-1).alias("step"), F.col("l").alias("simplex_id"), F.col("h").alias("neighbor_id")))
    stride, copies_ = (F.element_at(F.array(*[F.lit(n).cast("long") for n in values]), F.col("axis") + 1) for values in (_strides(copies), copies))
    to = F.floor(F.col("sector") / stride) % copies_ + F.col("step")
    beyond = wanted.join(across, "simplex_id").where((to >= 0) & (to < copies_))
    return inside.unionByName(beyond.select("sector", "simplex_id", (F.col("sector") + F.col("step") * stride).alias("neighbor_sector"), "neighbor_id")).distinct()
