"""Meshes as tables: generators and text files.

nodes: ``node_id long, x array<double>``; simplices: ``simplex_id long, v array<long>`` (node ids, one more than dimensions).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_id long, x array<double>"
SIMPLICES = "simplex_id long, v array<long>"


def _permutations(d: int) -> list[tuple[int, ...]]:
    return list(itertools.permutations(range(d)))


def split_cells(cells: DataFrame, corner: list[Column], cell_id: Column, node_id) -> DataFrame:
    """Simplices of grid cells: each cell of d dimensions becomes d! simplices along the paths from its lowest to its highest corner.

    ``corner``: the cell's integer coordinates; ``node_id(coordinates)``: a column for a corner's id. The split depends on the
    coordinates alone, so neighbouring cells agree on their common faces. Simplex ids are cell_id * d! + the path's number.
    """
    d = len(corner)
    paths = []
    for order in _permutations(d):
        at = list(corner)
        v = [node_id(at)]
        for axis in order:
            at = [c + 1 if k == axis else c for k, c in enumerate(at)]
            v.append(node_id(at))
        paths.append(F.array(*v))
    split = cells.select(cell_id.alias("_cell"), F.posexplode(F.array(*paths)).alias("_path", "v"))
    return split.select((F.col("_cell") * math.factorial(d) + F.col("_path")).alias("simplex_id"), "v")


def grid(spark: SparkSession, low: list[float], high: list[float], largest: float) -> tuple[DataFrame, DataFrame]:
    """Regular mesh of a box: ceil(extent / largest) intervals along each axis, cells split into simplices; any number of dimensions."""
    n = [max(1, math.ceil(round((b - a) / largest, 12))) for a, b in zip(low, high, strict=True)]
    stride = [math.prod(k + 1 for k in n[i + 1 :]) for i in range(len(n))]
    cell_stride = [math.prod(n[i + 1 :]) for i in range(len(n))]

    def axis(k: Column, i: int, counts: list[int], strides: list[int]) -> Column:
        return F.floor(k / strides[i]) % counts[i]

    ids = spark.range(math.prod(k + 1 for k in n))
    x = [low[i] + axis(F.col("id"), i, [k + 1 for k in n], stride) * ((high[i] - low[i]) / n[i]) for i in range(len(n))]
    nodes = ids.select(F.col("id").alias("node_id"), F.array(*x).alias("x"))
    cells = spark.range(math.prod(n))
    corner = [axis(F.col("id"), i, n, cell_stride) for i in range(len(n))]
    simplices = split_cells(cells, corner, F.col("id"), lambda at: sum(a * s for a, s in zip(at, stride, strict=True)))
    return nodes, simplices


def circle(spark: SparkSession, largest: float, most: int, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Closed chain on a circle: as many nodes as chords of ``largest`` need, ``most`` at most."""
    n = min(most, math.ceil(math.pi / math.asin(min(largest / (2 * radius), 1.0))))
    ids = spark.range(n)
    angle = F.col("id") * (2 * math.pi / n)
    nodes = ids.select(F.col("id").alias("node_id"), F.array(radius * F.cos(angle), radius * F.sin(angle)).alias("x"))
    return nodes, ids.select(F.col("id").alias("simplex_id"), F.array(F.col("id"), (F.col("id") + 1) % n).alias("v"))


def square(spark: SparkSession, scale: tuple[float, float] = (1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Two triangles."""
    a, b = scale
    return _table(spark, [(0.0, 0.0), (a, 0.0), (a, b), (0.0, b)], [(0, 1, 2), (0, 2, 3)])


def _table(spark: SparkSession, x: list[tuple], v: list[tuple]) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(x)], NODES)
    return nodes, spark.createDataFrame([(i, list(s)) for i, s in enumerate(v)], SIMPLICES)


def cube_surface(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The unit cube's surface: 8 nodes, 12 triangles."""
    x = list(itertools.product((0.0, 1.0), repeat=3))
    v = []
    for axis in range(3):
        for side in (0, 1):
            face = [i for i, p in enumerate(x) if p[axis] == side]
            v += [(face[0], face[1], face[3]), (face[0], face[2], face[3])]
    return _table(spark, x, v)


def icosahedron(spark: SparkSession, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """12 nodes (cyclic turns of (0, +-1, +-golden ratio), scaled to the radius) and the 20 faces between nearest nodes."""
    golden = (1 + math.sqrt(5)) / 2
    x = [p[-k:] + p[:-k] for a in (-1, 1) for b in (-1, 1) for k in range(3) for p in [(0.0, float(a), b * golden)]]
    scale = radius / math.sqrt(1 + golden * golden)
    near = {(i, j) for i, j in itertools.combinations(range(12), 2) if abs(math.dist(x[i], x[j]) - 2) < 1e-9}
    v = [t for t in itertools.combinations(range(12), 3) if all(e in near for e in itertools.combinations(t, 2))]
    return _table(spark, [tuple(c * scale for c in p) for p in x], v)


def extrude(nodes: DataFrame, simplices: DataFrame, heights: list[float]) -> tuple[DataFrame, DataFrame]:
    """A mesh of one dimension more: a copy of the nodes at each height, and each prism between layers split by staircase.

    A simplex's vertices are taken in the order of their ids, which gives prisms that share a face the same diagonal. Nodes are numbered
    layer * (largest id + 1) + id, simplices (simplex_id * layers + layer) * vertices + step.
    """
    stride = nodes.agg((F.coalesce(F.max("node_id"), F.lit(-1)) + 1).alias("stride"))
    layers = F.posexplode(F.array(*[F.lit(float(h)) for h in heights])).alias("layer", "height")
    up = nodes.select("node_id", "x", layers).crossJoin(F.broadcast(stride))
    out = up.select((F.col("layer") * F.col("stride") + F.col("node_id")).alias("node_id"), F.concat("x", F.array("height")).alias("x"))
    k = len(heights) - 1
    prism = simplices.select("simplex_id", F.array_sort("v").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("layer")).crossJoin(F.broadcast(stride))
    prism = prism.select("*", F.explode(F.sequence(F.lit(0), F.size("v") - 1)).alias("step"))
    low = F.transform(F.slice("v", 1, F.col("step") + 1), lambda i: i + F.col("layer") * F.col("stride"))
    high = F.transform(F.expr("slice(v, step + 1, size(v))"), lambda i: i + (F.col("layer") + 1) * F.col("stride"))
    number = (F.col("simplex_id") * k + F.col("layer")) * F.size("v") + F.col("step")
    return out, prism.select(number.alias("simplex_id"), F.concat(low, high).alias("v"))


def _tiled(nodes: DataFrame, copies: list[int], offset: list[float], digits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``sector, explicit_id, copied, x, place`` of every copy of every node, ``place, node_id, x`` of those that are kept, the box)."""
    d = len(copies)
    box = nodes.agg(*[F.min(F.get("x", i)).alias(f"low{i}") for i in range(d)], *[F.max(F.get("x", i)).alias(f"high{i}") for i in range(d)], (F.max("node_id") + 1).alias("node_stride"))
    sectors = nodes.sparkSession.range(math.prod(copies)).withColumnRenamed("id", "sector")
    stride = [math.prod(copies[i + 1 :]) for i in range(d)]
    moved = [F.get("x", i) - F.col(f"low{i}") + offset[i] + F.floor(F.col("sector") / stride[i]) % copies[i] * (F.col(f"high{i}") - F.col(f"low{i}")) for i in range(d)]
    every = nodes.crossJoin(F.broadcast(box)).crossJoin(F.broadcast(sectors))
    every = every.select("sector", F.col("node_id").alias("explicit_id"), (F.col("sector") * F.col("node_stride") + F.col("node_id")).alias("copied"), F.array(*moved).alias("x"))
    every = every.withColumn("place", F.transform("x", lambda c: F.round(c, digits) + 0.0))
    kept = every.groupBy("place").agg(F.min("copied").alias("node_id"), F.min_by("x", "copied").alias("x"))
    return every, kept, box


def tile(nodes: DataFrame, simplices: DataFrame, copies: list[int], offset: list[float], digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """Copies of a mesh side by side along its axes, with nodes on common faces merged.

    Copy numbers (sectors) count row by row; a node is known by its place rounded to ``digits``, and the copy with the least number keeps it. Node and
    simplex ids are copy * (largest id + 1) + id.
    """
    every_node, kept, box = _tiled(nodes, copies, offset, digits)
    named = every_node.join(kept.select("place", "node_id"), "place").select("copied", "node_id")
    most = simplices.agg((F.max("simplex_id") + 1).alias("simplex_stride"))
    sectors = nodes.sparkSession.range(math.prod(copies)).withColumnRenamed("id", "copy")
    every = simplices.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(sectors)).crossJoin(F.broadcast(box.select("node_stride")))
    every = every.select((F.col("copy") * F.col("simplex_stride") + F.col("simplex_id")).alias("simplex_id"), F.posexplode(F.transform("v", lambda i: i + F.col("copy") * F.col("node_stride"))).alias("place", "copied"))
    joined = every.join(named, "copied").groupBy("simplex_id").agg(F.array_sort(F.collect_list(F.struct("place", "node_id"))).alias("v"))
    return kept.select("node_id", "x"), joined.select("simplex_id", F.col("v.node_id").alias("v"))


def tile_names(nodes: DataFrame, copies: list[int], offset: list[float], digits: int = 9) -> DataFrame:
    """``sector, explicit_id, node_id, shared``: what each base node is called in the tiled mesh, in every sector; shared: by how many sectors. A node's own sector and
    base id are its ``owner``; from a sector's name to another's, join on node_id; a sector's interior nodes are those with shared = 1."""
    every, kept, _ = _tiled(nodes, copies, offset, digits)
    named = every.join(kept.select("place", "node_id"), "place")
    count = named.groupBy("node_id").agg(F.count("*").alias("shared"))
    return named.select("sector", "explicit_id", "node_id").join(count, "node_id").select("sector", "explicit_id", "node_id", "shared")


def owner(node_id: Column, stride: Column | int) -> tuple[Column, Column]:
    """(sector, base id) of a tiled mesh's node or simplex; ``stride``: largest base id + 1."""
    return F.floor(node_id / stride), F.pmod(node_id, stride if isinstance(stride, Column) else F.lit(stride))


def renamed(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``to_id`` to ``wanted`` (``explicit_id, sector, to_sector``): the base id of the same node in another sector, null where that sector does not have it."""
    here = names.select("sector", "explicit_id", "node_id")
    there = names.select(F.col("sector").alias("to_sector"), F.col("explicit_id").alias("to_id"), "node_id")
    return wanted.join(here, ["sector", "explicit_id"], "left").join(there, ["to_sector", "node_id"], "left")


def tile_of_point(x: list[Column], low: list[Column], length: list[Column], copies: list[int]) -> Column:
    """Number of the copy that a point lies in; null outside. Upper faces belong to the next copy, but for the last."""
    at = [F.floor((a - b) / c) for a, b, c in zip(x, low, length, strict=True)]
    at = [F.when((a - b) == c * n, n - 1).otherwise(k) for k, a, b, c, n in zip(at, x, low, length, copies, strict=True)]
    inside = [(k >= 0) & (k < n) for k, n in zip(at, copies, strict=True)]
    number = sum(k * math.prod(copies[i + 1 :]) for i, k in enumerate(at))
    ok = inside[0]
    for i in inside[1:]:
        ok = ok & i
    return F.when(ok, number)


def read_msh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and triangles (or, without any, lines) of a text mesh file of format version 2, read line by line in Spark.

    A node's line has an id and three coordinates, an element's an id, a kind (1 line, 2 triangle, 4 tetrahedron), a number of tags, the tags
    and the node ids. Sections begin with ``$Nodes`` and ``$Elements``.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    marks = lines.where(F.col("value").isin("$Nodes", "$EndNodes", "$Elements", "$EndElements")).groupBy("file").pivot("value", ["$Nodes", "$EndNodes", "$Elements", "$EndElements"]).agg(F.min("at"))
    part = lines.join(F.broadcast(marks), "file").withColumn("f", F.split("value", r"\s+"))
    nodes = part.where((F.col("at") > F.col("`$Nodes`") + 1) & (F.col("at") < F.col("`$EndNodes`")))
    nodes = nodes.select(F.get("f", 0).try_cast("long").alias("node_id"), F.transform(F.slice("f", 2, 3), lambda c: c.try_cast("double")).alias("x"))
    elements = part.where((F.col("at") > F.col("`$Elements`") + 1) & (F.col("at") < F.col("`$EndElements`")))
    elements = elements.select(F.get("f", 0).try_cast("long").alias("simplex_id"), F.get("f", 1).try_cast("int").alias("kind"), F.expr("transform(slice(f, 4 + coalesce(try_cast(get(f, 2) AS int), 0), size(f)), c -> try_cast(c AS bigint))").alias("v"))
    kinds = [r["kind"] for r in elements.where("kind IN (1, 2, 4)").select("kind").distinct().collect()]
    kind = 2 if 2 in kinds or not kinds else min(kinds)
    return nodes, elements.where(F.col("kind") == kind).select("simplex_id", "v")


def msh_lines(nodes: DataFrame, simplices: DataFrame) -> DataFrame:
    """``part, line``: the text of a mesh file of format version 2, in the order of (part, number); missing coordinates are 0."""
    kind = F.element_at(F.create_map(*[F.lit(k) for k in (2, 1, 3, 2, 4, 4)]), F.size("v"))
    x = [F.coalesce(F.get("x", i), F.lit(0.0)).cast("string") for i in range(3)]
    node = nodes.select(F.lit(2).alias("part"), F.col("node_id").alias("number"), F.concat_ws(" ", F.col("node_id").cast("string"), *x).alias("line"))
    element = simplices.select(F.lit(5).alias("part"), F.col("simplex_id").alias("number"), F.concat_ws(" ", F.col("simplex_id").cast("string"), kind.cast("string"), F.lit("2 0 0"), F.array_join(F.col("v").cast("array<string>"), " ")).alias("line"))
    count = {1: (nodes, "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n"), 4: (simplices, "$EndNodes\n$Elements\n")}
    heads = [df.agg(F.lit(part).alias("part"), F.lit(0).cast("long").alias("number"), F.concat(F.lit(text), F.count("*").cast("string")).alias("line")) for part, (df, text) in count.items()]
    last = nodes.sparkSession.range(1).select(F.lit(6).alias("part"), F.col("id").alias("number"), F.lit("$EndElements").alias("line"))
    return heads[0].unionByName(node).unionByName(heads[1]).unionByName(element).unionByName(last)


def write_msh(nodes: DataFrame, simplices: DataFrame, path: str) -> None:
    """One text file. The format is a single ordered file, so one task writes it; use Parquet for meshes of any size."""
    msh_lines(nodes, simplices).repartition(1).sortWithinPartitions("part", "number").select("line").write.mode("overwrite").text(path)


#: Cell types of the format, by number of vertices.
VTK_TYPES = {1: 1, 2: 3, 3: 5, 4: 10}


def vtk_lines(nodes: DataFrame, simplices: DataFrame) -> DataFrame:
    """``part, number, line``: the text of a legacy VTK file (an unstructured grid), in the order of (part, number). Node and simplex ids are made dense first, as the format
    has none; missing coordinates are 0."""
    from gridloom.operators.topology import renumber

    nodes, simplices = renumber(nodes, simplices)
    x = [F.coalesce(F.get("x", i), F.lit(0.0)).cast("string") for i in range(3)]
    size = F.size("v")
    kind = F.element_at(F.create_map(*[F.lit(k) for pair in VTK_TYPES.items() for k in pair]), size)

    def head(df: DataFrame, part: int, line: Column) -> DataFrame:
        return df.agg(F.lit(part).alias("part"), F.lit(-1).cast("long").alias("number"), line.alias("line"))

    def body(df: DataFrame, part: int, number: str, line: Column) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.col(number).alias("number"), line.alias("line"))

    count = F.count("*").cast("string")
    return (
        head(nodes, 0, F.concat(F.lit("# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS "), count, F.lit(" double")))
        .unionByName(body(nodes, 1, "node_id", F.concat_ws(" ", *x)))
        .unionByName(head(simplices, 2, F.concat(F.lit("CELLS "), count, F.lit(" "), F.coalesce(F.sum(size + 1), F.lit(0)).cast("string"))))
        .unionByName(body(simplices, 3, "simplex_id", F.concat_ws(" ", size.cast("string"), F.array_join(F.col("v").cast("array<string>"), " "))))
        .unionByName(head(simplices, 4, F.concat(F.lit("CELL_TYPES "), count)))
        .unionByName(body(simplices, 5, "simplex_id", kind.cast("string")))
    )


def write_vtk(nodes: DataFrame, simplices: DataFrame, path: str) -> None:
    """One text file, written by one task as ``write_msh``'s is."""
    vtk_lines(nodes, simplices).repartition(1).sortWithinPartitions("part", "number").select("line").write.mode("overwrite").text(path)


def read_vtk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and cells of a legacy VTK text file with one point or cell a line, as ``write_vtk`` writes it; ids count from 0 in the file's order."""
    from gridloom.operators.topology import ranked

    lines = spark.read.option("lineSep", "\n").text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("at"))
    lines = ranked(lines.where("value != ''"), "row", ["at"]).select("row", "value", F.split("value", r"\s+").alias("f"))
    marks = {r["name"]: (r["row"], r["n"]) for r in lines.where(F.get("f", 0).isin("POINTS", "CELLS")).select(F.get("f", 0).alias("name"), "row", F.get("f", 1).cast("long").alias("n")).limit(2).collect()}

    def section(name: str) -> DataFrame:
        at, n = marks.get(name, (0, 0))
        return lines.where((F.col("row") > at) & (F.col("row") <= at + n)).withColumn("k", F.col("row") - at - 1)

    nodes = section("POINTS").select(F.col("k").alias("node_id"), F.transform("f", lambda c: c.cast("double")).alias("x"))
    return nodes, section("CELLS").select(F.col("k").alias("simplex_id"), F.transform(F.expr("slice(f, 2, size(f))"), lambda c: c.cast("long")).alias("v"))


def geo_point(number: Column, x: list[Column], size: Column | None = None) -> Column:
    """Geometry-script line of a point, with a characteristic length if there is one."""
    fields = [c.cast("string") for c in (x if size is None else [*x, size])]
    return F.concat(F.lit("Point("), number.cast("string"), F.lit(") = {"), F.concat_ws(", ", *fields), F.lit("};"))


def geo_line(number: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("Line("), number.cast("string"), F.lit(") = {"), F.concat_ws(", ", start.cast("string"), end.cast("string")), F.lit("};"))


def geo_circle(number: Column, start: Column, centre: Column, end: Column) -> Column:
    return F.concat(F.lit("Circle("), number.cast("string"), F.lit(") = {"), F.concat_ws(", ", *[c.cast("string") for c in (start, centre, end)]), F.lit("};"))


def geo_line_loop(number: Column, lines: Column) -> Column:
    """``lines``: an array of line numbers."""
    return F.concat(F.lit("Line Loop("), number.cast("string"), F.lit(") = {"), F.array_join(lines.cast("array<string>"), ", "), F.lit("};"))
