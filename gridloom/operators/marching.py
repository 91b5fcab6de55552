"""Distances over a mesh of triangles under a metric, through the triangles' insides, by rounds over blocks of nodes."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.vectors import parts
from gridloom.operators.cut_lineage import checkpointed
from gridloom.operators.locate import containing
from gridloom.operators.paths import BLOCK, by_blocks
from gridloom.operators.topology import with_vertices


def _length(a: list[Column], b: list[Column], tensor: Column | None) -> Column:
    """Length of b - a: the root of its square under ``tensor`` (rows of a symmetric positive matrix; null: the plain one)."""
    step = [y - x for x, y in zip(a, b, strict=True)]
    plain = sum((s * s for s in step), F.lit(0.0))
    if tensor is None:
        return F.sqrt(plain)
    d = len(step)
    return F.sqrt(F.when(tensor.isNull(), plain).otherwise(sum((F.get(F.get(tensor, i), j) * step[i] * step[j] for i in range(d) for j in range(d)), F.lit(0.0))))


def _cornered(nodes: DataFrame, simplices: DataFrame, d: int) -> tuple[DataFrame, list[list[Column]], Column | None]:
    """``simplex_id, v, p`` with the corners' coordinates, and the triangles' ``tensor`` where they have one."""
    s, p = with_vertices(simplices, nodes, 3, d)
    if "tensor" not in simplices.columns:
        return s, p, None
    return s.join(simplices.select("simplex_id", "tensor"), "simplex_id"), p, F.col("tensor")


def sides(nodes: DataFrame, simplices: DataFrame, d: int) -> DataFrame:
    """``simplex_id, v, sides``: lengths of each triangle's sides v0 v1, v1 v2, v2 v0 under its own ``tensor``, where simplices have that column."""
    s, p, tensor = _cornered(nodes, simplices, d)
    return s.select("simplex_id", "v", F.array(*[_length(p[i], p[(i + 1) % 3], tensor) for i in range(3)]).alias("sides"))


def across(ta: Column, tb: Column, ab: Column, bc: Column, ca: Column) -> Column:
    """Least of t + length over the points of side ab, for corner c: t runs linearly from ``ta`` to ``tb``; null values are unknown."""
    x = (ca * ca - bc * bc + ab * ab) / (2 * ab)
    height = F.sqrt(F.greatest(ca * ca - x * x, F.lit(0.0)))
    slope = (tb - ta) / ab
    s = F.greatest(F.least(x - slope * height / F.sqrt(1 - slope * slope), ab), F.lit(0.0))
    inside = F.when(F.abs(slope) < 1, ta + slope * s + F.sqrt((x - s) * (x - s) + height * height))
    return F.least(ta + ca, tb + bc, inside)


def _across(ta: float, tb: float, ab: float, bc: float, ca: float) -> float:
    """``across`` for one triangle in a task; infinite values are unknown."""
    best = min(ta + ca, tb + bc)
    if abs(tb - ta) < ab:  # false where both are infinite
        x, slope = (ca * ca - bc * bc + ab * ab) / (2 * ab), (tb - ta) / ab
        height2 = max(ca * ca - x * x, 0.0)
        s = min(max(x - slope * math.sqrt(height2 / (1 - slope * slope)), 0.0), ab)
        best = min(best, ta + slope * s + math.sqrt((x - s) ** 2 + height2))
    return best


MARCH = "origin long, block long, node_id long, distance double, own boolean, turn int"


def _march(known: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """One origin's distances in one block, from those around it: nodes are settled from the nearest on, and again where a later one improves them. They go to all blocks beside them."""
    if known.empty or near.empty:
        return pd.DataFrame({c.split()[0]: [] for c in MARCH.split(", ")})
    origin, block = int(known["origin"].iloc[0]), int(known["block"].iloc[0])
    t: dict[int, float] = {}
    entered = set()
    for n, d, own in known.sort_values("own", ascending=False)[["node_id", "distance", "own"]].itertuples(index=False):
        if d < t.get(n, math.inf):
            t[n] = d
            if not own:
                entered.add(n)
    found = {n for n in entered if n // BLOCK == block}  # starts
    at: dict[int, list[tuple[int, int, float, float, float]]] = {}
    others: dict[int, set[int]] = {}
    for v, side in zip(near["v"], near["sides"], strict=True):
        v, side = v.tolist(), side.tolist()
        beside = {n // BLOCK for n in v}
        for i in range(3):
            # For the corner opposite of side i: the side's ends, its length, and the ways from them to the corner.
            a, b, c = v[i], v[(i + 1) % 3], v[(i + 2) % 3]
            if c // BLOCK == block:
                rest = (c, a, b, side[i], side[(i + 1) % 3], side[(i + 2) % 3])
                at.setdefault(a, []).append(rest)
                at.setdefault(b, []).append(rest)
                if len(beside) > 1:
                    others.setdefault(c, set()).update(beside - {block})
    heap = [(t[n], n) for n in entered]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if d > t[n]:
            continue
        for c, a, b, ab, bc, ca in at.get(n, []):
            new = _across(t.get(a, math.inf), t.get(b, math.inf), ab, bc, ca)
            if new < t.get(c, math.inf) * (1 - 1e-13) - 1e-300:
                t[c] = new
                found.add(c)
                heapq.heappush(heap, (new, c))
    rows = [(origin, block, n, t[n], True, 0) for n in found] + [(origin, o, n, t[n], False, 0) for n in found for o in others.get(n, ())]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MARCH.split(", ")])


def marched(triangles: DataFrame, starts: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """``origin, node_id, distance``: the largest values that no triangle of ``triangles`` (``simplex_id, v, sides``) lowers by ``across``, from ``starts`` (``origin, node_id, distance``).

    They are distances through the triangles' insides, of first order in the triangles' size (obtuse corners see less), and never above those along
    edges. Nodes that nothing reaches have no row. A node's block alone changes its value, so a round's tasks don't meet; a task holds one block's
    triangles and one origin's values. A round takes the blocks beside nodes that changed in other blocks, until none did.
    """
    whole = triangles.where("v IS NOT NULL AND forall(sides, s -> s > 0)").select("v", "sides")
    mine = whole.withColumn("block", F.explode(F.array_distinct(F.transform("v", lambda n: F.floor(n / BLOCK)))))
    least = starts.where("distance IS NOT NULL AND NOT isnan(distance)").groupBy(F.col("origin").cast("long").alias("origin"), F.col("node_id").cast("long").alias("node_id")).agg(F.min("distance").alias("distance"))
    first = least.select("origin", F.floor(F.col("node_id") / BLOCK).alias("block"), "node_id", "distance", F.lit(False).alias("own"), F.lit(0).alias("turn"))
    found = by_blocks(mine, first, _march, MARCH, most_rounds, "distances").where(F.col("block") == F.floor(F.col("node_id") / BLOCK))
    # Starts that no triangle holds have their own distances.
    every = found.select("origin", "node_id", "distance").unionByName(least.select("origin", "node_id", "distance"))
    return every.groupBy("origin", "node_id").agg(F.min("distance").alias("distance"))


def _placed(points: DataFrame, nodes: DataFrame, simplices: DataFrame, d: int, width: float) -> DataFrame:
    """``point_id, x, simplex_id``: each point once, with the least triangle that holds it; points outside are left out. Points are not joined with themselves."""
    held = containing(points, nodes, simplices, 3, d, width, keep=("x",)).select("point_id", "simplex_id", *[F.get("x", i).alias(f"x{i}") for i in range(d)])
    first = held.groupBy("point_id", *[f"x{i}" for i in range(d)]).agg(F.min("simplex_id").alias("simplex_id"))
    return first.select("point_id", F.array(*[f"x{i}" for i in range(d)]).alias("x"), "simplex_id")


def distances_between(nodes: DataFrame, simplices: DataFrame, starts: DataFrame, ends: DataFrame, d: int, width: float) -> DataFrame:
    """``origin, end, distance``: from points ``starts`` (``point_id, x``) to points ``ends``, anywhere in the mesh; see ``marched``. Simplices may have a ``tensor`` each.

    A start gives its triangle's corners their plain distances; an end takes the least that its triangle's sides allow, or the
    straight way to a start in the same triangle. Pairs with a point outside the mesh, or in parts that don't hang together, have no row.
    Corners' distances meet in triangles, before any point: an end is joined once, with its triangle.
    """
    s, p, tensor = _cornered(nodes, simplices, d)
    whole = checkpointed(s.select("simplex_id", "v", "p", F.array(*[_length(p[i], p[(i + 1) % 3], tensor) for i in range(3)]).alias("sides"), *([tensor.alias("tensor")] if tensor is not None else [])))
    tensor = F.col("tensor") if tensor is not None else None
    corner = [parts(F.get("p", i), d) for i in range(3)]
    to = [_length(parts(F.col("x"), d), q, tensor) for q in corner]
    a = checkpointed(_placed(starts, nodes, simplices, d, width).select(F.col("point_id").alias("origin"), "simplex_id", "x"))
    first = a.join(whole, "simplex_id").select("origin", F.explode(F.arrays_zip(F.col("v").alias("node_id"), F.array(*to).alias("distance"))).alias("e")).select("origin", "e.node_id", "e.distance")
    t = marched(whole, first)
    each = whole.select("simplex_id", F.posexplode("v").alias("i", "node_id")).join(t, "node_id")
    values = each.groupBy("simplex_id", "origin").agg(*[F.max(F.when(F.col("i") == i, F.col("distance"))).alias(f"t{i}") for i in range(3)])
    known = checkpointed(values.join(a.withColumnRenamed("x", "y"), ["origin", "simplex_id"], "left").join(whole, "simplex_id"))
    side = [across(F.col(f"t{i}"), F.col(f"t{(i + 1) % 3}"), F.get("sides", i), F.col(f"to{(i + 1) % 3}"), F.col(f"to{i}")) for i in range(3)]
    straight = _length(parts(F.col("y"), d), parts(F.col("x"), d), tensor)
    b = _placed(ends, nodes, simplices, d, width)
    met = b.join(known, "simplex_id").select("origin", F.col("point_id").alias("end"), "sides", "t0", "t1", "t2", straight.alias("straight"), *[c.alias(f"to{i}") for i, c in enumerate(to)])
    return met.groupBy("origin", "end").agg(F.min(F.least(*side, "straight")).alias("distance"))
