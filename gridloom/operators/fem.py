"""Finite elements on simplicial meshes: matrix entries by simplex, assembly by grouped sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import SimplexMap
from gridloom.functions.vectors import dot, parts
from gridloom.operators.topology import boundary, with_vertices


def elements(nodes: DataFrame, simplices: DataFrame, vertices: int, d: int) -> DataFrame:
    """``simplex_id, v, area, gradients``: size of each simplex and the gradients of its nodes' basis functions (an array for each vertex)."""
    s, p = with_vertices(simplices, nodes, vertices, d)
    simplex = SimplexMap(p)
    gradients = F.array(*[F.array(*g) for g in simplex.gradients()]) if vertices > 1 else F.array(F.array(F.lit(0.0)))
    return s.select("simplex_id", "v", simplex.volume().alias("area"), gradients.alias("gradients"))


def _pairs(e: DataFrame, vertices: int, value) -> DataFrame:
    """Rows ``simplex_id, i, j, w`` for all ordered pairs of vertices; value(a, b) is the entry."""
    rows = F.array(*[F.struct(F.get("v", a).alias("i"), F.get("v", b).alias("j"), value(a, b).alias("w")) for a in range(vertices) for b in range(vertices)])
    return e.select("simplex_id", F.inline(rows))


def mass(e: DataFrame, vertices: int) -> DataFrame:
    """<phi_i, phi_j>: area * (1 + [i = j]) / ((t + 1)(t + 2)) in t dimensions."""
    t = vertices - 1
    return _pairs(e, vertices, lambda a, b: F.col("area") * ((2.0 if a == b else 1.0) / ((t + 1) * (t + 2))))


def stiffness(e: DataFrame, vertices: int, d: int, tensor: list[list[Column]] | None = None) -> DataFrame:
    """<grad phi_i, H grad phi_j>; H is the identity or columns of ``e``."""
    g = [parts(F.get("gradients", a), d) for a in range(vertices)]

    def value(a: int, b: int) -> Column:
        if tensor is None:
            return F.col("area") * dot(g[a], g[b])
        return F.col("area") * sum((g[a][k] * tensor[k][m] * g[b][m] for k in range(d) for m in range(d)), F.lit(0.0))

    return _pairs(e, vertices, value)


def stiffness_part(e: DataFrame, vertices: int, d: int, k: int, m: int) -> DataFrame:
    """<d_k phi_i, d_m phi_j>."""
    return _pairs(e, vertices, lambda a, b: F.col("area") * F.get(F.get("gradients", a), k) * F.get(F.get("gradients", b), m))


def flow(e: DataFrame, vertices: int, k: int) -> DataFrame:
    """<d_k phi_i, phi_j>."""
    return _pairs(e, vertices, lambda a, b: F.col("area") * F.get(F.get("gradients", a), k) / vertices)


def load(e: DataFrame, vertices: int) -> DataFrame:
    """``simplex_id, i, w``: <1, phi_i>."""
    return e.select("simplex_id", F.explode("v").alias("i"), (F.col("area") / vertices).alias("w"))


def assembled(entries: DataFrame, coefficient: DataFrame | float = 1.0) -> DataFrame:
    """``i, j, v``: entries times a coefficient (a number, or ``simplex_id, c``), added up by place."""
    if isinstance(coefficient, DataFrame):
        entries = entries.join(coefficient, "simplex_id").withColumn("w", F.col("w") * F.col("c"))
        factor = 1.0
    else:
        factor = float(coefficient)
    return entries.groupBy("i", "j").agg((F.sum("w") * factor).alias("v"))


def assembled_load(entries: DataFrame, coefficient: DataFrame | float = 1.0) -> DataFrame:
    """``i, v``."""
    rows = entries.withColumn("j", F.lit(0).cast("long"))
    return assembled(rows, coefficient).select("i", "v")


def robin_mass(nodes: DataFrame, simplices: DataFrame, vertices: int, d: int) -> DataFrame:
    """Mass entries of the boundary's facets; ``simplex_id`` is that of the facet's simplex."""
    edge = boundary(simplices, vertices)
    if vertices == 2:
        return edge.select("simplex_id", F.get("facet", 0).alias("i"), F.get("facet", 0).alias("j"), F.lit(1.0).alias("w"))
    named = edge.select(F.xxhash64("facet").alias("simplex_id"), F.col("facet").alias("v"))
    return mass(elements(nodes, named, vertices - 1, d), vertices - 1)


def system(
    nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, mass_coefficient, stiffness_coefficient=None, robin: float = 0.0, tensor: list[list[Column]] | None = None, flow_coefficients: list | None = None, parameters: DataFrame | None = None, e: DataFrame | None = None
) -> DataFrame:
    """K = M(c) + B(b) + G(g) - M_boundary(robin), ``i, j, v``.

    A coefficient is a number, a table ``simplex_id, c``, or a column of ``parameters`` (one row for each ``simplex_id``); so are the entries of ``tensor`` (d by d),
    which takes the place of the stiffness coefficient, and of ``flow_coefficients`` (for each dimension one or None). Terms without a coefficient are not built.
    All terms of a simplex are added before anything is shuffled: one grouping by place makes the matrix. ``e``: the elements, if there are already.
    """
    wide, columns = elements(nodes, simplices, vertices, d) if e is None else e, {}

    def of(c, name: str) -> Column:
        """The coefficient as a column of the elements."""
        nonlocal wide
        if isinstance(c, DataFrame):
            wide = wide.join(c.select("simplex_id", F.col("c").alias(name)), "simplex_id")
        elif isinstance(c, Column):
            columns[name] = c
        else:
            return F.lit(float(c))
        return F.col(name)

    c = of(mass_coefficient, "_c")
    h = [[of(tensor[k][m], f"_h{k}_{m}") for m in range(d)] for k in range(d)] if tensor is not None else None
    g = of(stiffness_coefficient, "_g") if tensor is None and stiffness_coefficient is not None else None
    b = {k: of(x, f"_b{k}") for k, x in enumerate(flow_coefficients or []) if isinstance(x, (Column, DataFrame)) or x}
    if columns:
        wide = wide.join(parameters.select("simplex_id", *[x.alias(name) for name, x in columns.items()]), "simplex_id")
    t = vertices - 1
    slopes = [parts(F.get("gradients", k), d) for k in range(vertices)]

    def value(i: int, j: int) -> Column:
        out = c * ((2.0 if i == j else 1.0) / ((t + 1) * (t + 2)))
        if h is not None:
            out = out + sum((slopes[i][k] * h[k][m] * slopes[j][m] for k in range(d) for m in range(d)), F.lit(0.0))
        elif g is not None:
            out = out + g * dot(slopes[i], slopes[j])
        for k, x in b.items():
            out = out + x * slopes[i][k] / vertices
        return F.col("area") * out

    entries = _pairs(wide, vertices, value)
    if robin:
        entries = entries.unionByName(robin_mass(nodes, simplices, vertices, d).withColumn("w", F.col("w") * -robin))
    return assembled(entries)


def robin_load(nodes: DataFrame, simplices: DataFrame, vertices: int, d: int) -> DataFrame:
    """``simplex_id, i, w``: <1, phi_i> over the boundary's facets, ``simplex_id`` as in ``robin_mass``."""
    edge = boundary(simplices, vertices)
    if vertices == 2:
        return edge.select("simplex_id", F.get("facet", 0).alias("i"), F.lit(1.0).alias("w"))
    return load(elements(nodes, edge.select(F.xxhash64("facet").alias("simplex_id"), F.col("facet").alias("v")), vertices - 1, d), vertices - 1)


def diameters(nodes: DataFrame, simplices: DataFrame, vertices: int, d: int) -> DataFrame:
    """``simplex_id, diameter``: the longest edge of each simplex."""
    s, p = with_vertices(simplices, nodes, vertices, d)
    longest = F.greatest(*[sum(((a - b) * (a - b) for a, b in zip(p[i], p[j], strict=True)), F.lit(0.0)) for i in range(vertices) for j in range(i)], F.lit(0.0))
    return s.select("simplex_id", F.sqrt(longest).alias("diameter"))


def reference_integrals(t: int) -> dict[str, float]:
    """On the standard simplex of t dimensions: its size, <1, phi>, <phi, phi> and <phi, phi'>."""
    size = 1 / math.factorial(t)
    return {"volume": size, "one": size / (t + 1), "diagonal": 2 * size / ((t + 1) * (t + 2)), "off_diagonal": size / ((t + 1) * (t + 2))}


def gradient_of(values: DataFrame, e: DataFrame) -> DataFrame:
    """``simplex_id, gradient`` of node values (``node_id, value``)."""
    each = e.select("simplex_id", F.explode(F.arrays_zip(F.col("v").alias("node_id"), F.col("gradients").alias("g"))).alias("z")).select("simplex_id", "z.node_id", "z.g")
    met = each.join(values, "node_id").select("simplex_id", F.posexplode("g").alias("k", "g"), "value")
    summed = met.groupBy("simplex_id", "k").agg(F.sum(F.col("g") * F.col("value")).alias("s"))
    return summed.groupBy("simplex_id").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("s")).select("simplex_id", F.col("s.s").alias("gradient"))
