"""Meshes with further regular dimensions, such as time: cells are simplices times intervals, and nothing is stored but tables.

Node and cell ids are copy * (largest base id + 1) + base id, where copies count the levels of the further dimensions, the first one fastest.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.locate import located


@dataclass(frozen=True)
class Levels:
    """For each further dimension: first level, step (any positive number) and number of intervals."""

    offset: tuple[float, ...]
    step: tuple[float, ...]
    count: tuple[int, ...]

    def strides(self, extra: int) -> list[int]:
        """Copies before one step in each dimension; ``extra``: 1 for nodes (levels), 0 for cells (intervals)."""
        return [math.prod(c + extra for c in self.count[:k]) for k in range(len(self.count))]

    def level(self, copy: Column, k: int, extra: int) -> Column:
        return F.floor(copy / self.strides(extra)[k]) % (self.count[k] + extra)

    def copies(self, extra: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(math.prod(c + extra for c in self.count) - 1).cast("long")))

    def corners(self, cell_copy: Column) -> list[Column]:
        """Node copies at the corners of an interval's box, lowest first."""
        at = [self.level(cell_copy, k, 0) for k in range(len(self.count))]
        stride = self.strides(1)
        return [sum(((a + s) * w for a, s, w in zip(at, shift[::-1], stride, strict=True)), F.lit(0).cast("long")) for shift in itertools.product((0, 1), repeat=len(self.count))]


def _shifted(v: str, by: Column) -> Column:
    return F.transform(v, lambda i: i + by)


def _times(v: str, by: Column) -> Column:
    return F.transform(v, lambda i: i * by)


def _stride(df: DataFrame, id_col: str, name: str) -> DataFrame:
    return F.broadcast(df.agg((F.coalesce(F.max(id_col), F.lit(-1)) + 1).alias(name)))


def extended_nodes(nodes: DataFrame, levels: Levels) -> DataFrame:
    """``node_id, x``: a copy of the nodes at every combination of levels, with the levels as further coordinates."""
    every = nodes.select("node_id", "x", levels.copies(1).alias("copy")).crossJoin(_stride(nodes, "node_id", "stride"))
    more = [levels.offset[k] + levels.level(F.col("copy"), k, 1) * levels.step[k] for k in range(len(levels.count))]
    return every.select((F.col("copy") * F.col("stride") + F.col("node_id")).alias("node_id"), F.concat("x", F.array(*more)).alias("x"))


def extended_cells(nodes: DataFrame, simplices: DataFrame, levels: Levels) -> DataFrame:
    """``simplex_id, v``: cells; v has the base simplex's nodes at each corner of the interval, corner by corner."""
    every = simplices.select("simplex_id", "v", levels.copies(0).alias("copy")).crossJoin(_stride(simplices, "simplex_id", "ss")).crossJoin(_stride(nodes, "node_id", "ns"))
    v = F.flatten(F.array(*[_shifted("v", c * F.col("ns")) for c in levels.corners(F.col("copy"))]))
    return every.select((F.col("copy") * F.col("ss") + F.col("simplex_id")).alias("simplex_id"), v.alias("v"))


def extended_neighbors(simplices: DataFrame, base: DataFrame, levels: Levels) -> DataFrame:
    """``simplex_id, neighbor_id``: base neighbours (``base``, of ``topology.neighbors``) in the same copy, and the same simplex one interval below and above."""
    stride = _stride(simplices, "simplex_id", "ss")
    beside = base.select("simplex_id", "neighbor_id", levels.copies(0).alias("copy")).crossJoin(stride)
    beside = beside.select((F.col("copy") * F.col("ss") + F.col("simplex_id")).alias("simplex_id"), (F.col("copy") * F.col("ss") + F.col("neighbor_id")).alias("neighbor_id"))
    every = simplices.select("simplex_id", levels.copies(0).alias("copy")).crossJoin(stride)
    steps = [F.when((levels.level(F.col("copy"), k, 0) + s >= 0) & (levels.level(F.col("copy"), k, 0) + s < n), F.lit(s * w).cast("long")) for k, (n, w) in enumerate(zip(levels.count, levels.strides(0), strict=True)) for s in (-1, 1)]
    along = every.select("simplex_id", "copy", "ss", F.explode(F.array_compact(F.array(*steps))).alias("step"))
    own = F.col("copy") * F.col("ss") + F.col("simplex_id")
    return beside.unionByName(along.select(own.alias("simplex_id"), (own + F.col("step") * F.col("ss")).alias("neighbor_id")))


def extended_located(points: DataFrame, nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, levels: Levels, width: float, slack: float = 1e-12) -> DataFrame:
    """``point_id, simplex_id, v, w``: the cell of each point (the first ``d`` coordinates lie in the base mesh), least base simplex first, with weights in the order of
    ``v``: barycentric times linear. An upper face belongs to the next interval, but for the last. Null for points in none."""
    base = located(points, nodes, simplices, vertices, d, width, slack, keep=("x",)).withColumnRenamed("simplex_id", "base")
    at = base.crossJoin(_stride(simplices, "simplex_id", "ss")).crossJoin(_stride(nodes, "node_id", "ns"))
    inside, copy, low_weights = F.col("base").isNotNull(), F.lit(0).cast("long"), []
    for k, (o, s, n, w) in enumerate(zip(levels.offset, levels.step, levels.count, levels.strides(0), strict=True)):
        t = (F.get("x", d + k) - o) / s
        level = F.when((t >= n) & (t <= n + slack), n - 1).when((t < 0) & (t >= -slack), 0).otherwise(F.floor(t))
        inside = inside & F.coalesce((level >= 0) & (level < n), F.lit(False))
        copy = copy + level * w
        low_weights.append((1 - (t - level), t - level))
    corners = levels.corners(F.col("copy"))
    weights = []
    for shift in itertools.product((0, 1), repeat=len(levels.count)):
        c = F.lit(1.0)
        for k, s in enumerate(shift[::-1]):
            c = c * low_weights[k][s]
        weights.append(c)
    at = at.withColumn("copy", F.when(inside, copy))
    v = F.flatten(F.array(*[_shifted("v", c * F.col("ns")) for c in corners]))
    w = F.flatten(F.array(*[_times("w", c) for c in weights]))
    found = F.col("copy").isNotNull()
    return at.select("point_id", F.when(found, F.col("copy") * F.col("ss") + F.col("base")).alias("simplex_id"), F.when(found, v).alias("v"), F.when(found, w).alias("w"))
