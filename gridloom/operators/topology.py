"""Mesh topology: facets, boundary, neighbours, statistics, cutting and refinement, as explodes, groupings and joins."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.cut_lineage import checkpointed


def facets(simplices: DataFrame, vertices: int, size: int) -> DataFrame:
    """``facet array<long>, simplices array<long>``: distinct node sets of ``size`` and the simplices that have them, both in order.

    ``vertices``: of a simplex. The group is what shares a facet: two simplices at most on a proper mesh.
    """
    v = F.array_sort("v")
    subsets = F.array(*[F.array(*[F.get(v, i) for i in c]) for c in itertools.combinations(range(vertices), size)])
    each = simplices.select("simplex_id", F.explode(subsets).alias("facet"))
    return each.groupBy("facet").agg(F.array_sort(F.collect_set("simplex_id")).alias("simplices"))


def edges(simplices: DataFrame, vertices: int) -> DataFrame:
    """``a, b``: distinct pairs of nodes of a simplex, a < b."""
    pairs = F.array(*[F.struct(F.least(F.get("v", i), F.get("v", j)).alias("a"), F.greatest(F.get("v", i), F.get("v", j)).alias("b")) for i, j in itertools.combinations(range(vertices), 2)])
    return simplices.select(F.inline(pairs)).distinct()


def edge_lengths(nodes: DataFrame, pairs: DataFrame, d: int) -> DataFrame:
    """``a, b, length`` of edges."""
    a, b = nodes.select(F.col("node_id").alias("a"), F.col("x").alias("xa")), nodes.select(F.col("node_id").alias("b"), F.col("x").alias("xb"))
    squares = sum((F.pow(F.get("xa", i) - F.get("xb", i), F.lit(2.0)) for i in range(d)), F.lit(0.0))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.sqrt(squares).alias("length"))


def lines(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, start, end``: segments of edges."""
    a, b = nodes.select(F.col("node_id").alias("a"), F.col("x").alias("start")), nodes.select(F.col("node_id").alias("b"), F.col("x").alias("end"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "start", "end")


def boundary(simplices: DataFrame, vertices: int) -> DataFrame:
    """``facet, simplex_id``: facets of one simplex only. Its nodes are the distinct ones of ``facet``."""
    return facets(simplices, vertices, vertices - 1).where(F.size("simplices") == 1).select("facet", F.get("simplices", 0).alias("simplex_id"))


def neighbors(simplices: DataFrame, vertices: int) -> DataFrame:
    """``simplex_id, neighbor_id``: simplices that share a facet, in both directions. One grouping by facet, no self-join."""
    shared = facets(simplices, vertices, vertices - 1).where(F.size("simplices") > 1)
    pairs = shared.select(F.explode("simplices").alias("simplex_id"), "simplices").select("simplex_id", F.explode("simplices").alias("neighbor_id"))
    return pairs.where("simplex_id != neighbor_id").distinct()


def incidence(simplices: DataFrame) -> DataFrame:
    """``simplex_id, place, node_id``."""
    return simplices.select("simplex_id", F.posexplode("v").alias("place", "node_id"))


def simplices_of_nodes(simplices: DataFrame) -> DataFrame:
    """``node_id, simplices, first``: simplices at each node, and the least one."""
    return incidence(simplices).groupBy("node_id").agg(F.array_sort(F.collect_set("simplex_id")).alias("simplices"), F.min("simplex_id").alias("first"))


def simplices_of_sets(sets: DataFrame, simplices: DataFrame) -> DataFrame:
    """``set_id, simplex_id``: simplices that have all nodes of a set (``set_id, nodes array<long>``). A join by node, counted."""
    wanted = sets.select("set_id", F.size(F.array_distinct("nodes")).alias("n"), F.explode(F.array_distinct("nodes")).alias("node_id"))
    met = wanted.join(incidence(simplices).select("simplex_id", "node_id").distinct(), "node_id").groupBy("set_id", "simplex_id").agg(F.count("*").alias("found"), F.first("n").alias("n"))
    return met.where("found = n").select("set_id", "simplex_id")


def bounding_box(nodes: DataFrame, d: int) -> DataFrame:
    """One row: ``low0, high0, low1, ...``."""
    return nodes.agg(*[f(F.get("x", i)).alias(f"{n}{i}") for i in range(d) for n, f in (("low", F.min), ("high", F.max))])


def with_vertices(simplices: DataFrame, nodes: DataFrame, vertices: int, d: int) -> tuple[DataFrame, list[list[Column]]]:
    """Simplices with the column ``p`` (vertices' coordinates in order) and column expressions for them."""
    at = incidence(simplices).join(nodes, "node_id").groupBy("simplex_id").agg(F.array_sort(F.collect_list(F.struct("place", "node_id", "x"))).alias("p"))
    at = at.select("simplex_id", F.col("p.node_id").alias("v"), F.col("p.x").alias("p"))
    return at, [[F.get(F.get("p", k), i) for i in range(d)] for k in range(vertices)]


def cut(nodes: DataFrame, simplices: DataFrame, outside: DataFrame, keep_border: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mesh without the nodes of ``outside`` (``node_id``). A simplex goes if it has such a node, or with ``keep_border`` only if all its
    nodes are; nodes without a simplex go. Ids stay as they are."""
    flagged = incidence(simplices).join(outside.select("node_id", F.lit(1).alias("out")).distinct(), "node_id", "left")
    gone = flagged.groupBy("simplex_id").agg(F.count("out").alias("n"), F.count("*").alias("all"))
    gone = gone.where("n = all" if keep_border else "n > 0").select("simplex_id")
    left = simplices.join(gone, "simplex_id", "left_anti")
    used = incidence(left).select("node_id").distinct()
    return nodes.join(used, "node_id", "left_semi"), left


def ranked(df: DataFrame, name: str, order: list[str], cells: int = 1000) -> DataFrame:
    """Adds ``rank``: 0, 1, ... in the order of ``order``, whose first column is a long. Rows are ranked within ranges of it, ranges within ranges of ranges, and
    a running count over the latter (a millionth of the rows, where ids are dense) places these, so that no task has all rows."""
    cell = df.withColumn("_cell", F.floor(F.col(order[0]) / cells))
    counts = cell.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_cell") / cells))

    def ahead(over) -> Column:
        return F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_n")).select("_block", ahead(Window.orderBy("_block")).alias("_blocks_before"))
    within = counts.select("_cell", "_block", ahead(Window.partitionBy("_block").orderBy("_cell")).alias("_cells_before"))
    before = within.join(blocks, "_block").select("_cell", (F.col("_cells_before") + F.col("_blocks_before")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
    return cell.join(before, "_cell").withColumn(name, (F.col("_before") + rank).cast("long")).drop("_cell", "_before")


def renumber(nodes: DataFrame, simplices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and simplex ids without gaps, in their order."""
    n = ranked(nodes, "_new", ["node_id"])
    v = incidence(simplices).join(n.select("node_id", "_new"), "node_id").groupBy("simplex_id").agg(F.array_sort(F.collect_list(F.struct("place", "_new"))).alias("v"))
    s = ranked(v.select("simplex_id", F.col("v._new").alias("v")), "_new", ["simplex_id"])
    return n.select(F.col("_new").alias("node_id"), "x"), s.select(F.col("_new").alias("simplex_id"), "v")


def longest(lengths: DataFrame, most: int, bins: int = 1024) -> DataFrame:
    """The ``most`` longest of edges ``a, b, length``, to 1e-9; of equally long ones those with the least (a, b).

    The length at the cut is found by counts in ever narrower bins, of which the driver has ``bins`` a round; edges at the cut are ranked by ``ranked``. Nothing is sorted as a whole.
    """
    keyed = checkpointed(lengths.withColumn("_key", F.round(F.col("length") * 1e9).cast("long")))
    ends = keyed.agg(F.min("_key").alias("low"), F.max("_key").alias("high"), F.count("*").alias("n")).first()
    low, high, left = ends["low"], ends["high"], most
    if ends["n"] <= most:
        return keyed.drop("_key")
    while low < high:
        width = -(-(high - low + 1) // bins)
        counts = keyed.where(F.col("_key").between(low, high)).groupBy(F.floor((F.col("_key") - low) / width).alias("bin")).agg(F.count("*").alias("n"))
        for r in sorted(counts.collect(), key=lambda r: -r["bin"]):
            if r["n"] > left:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            left -= r["n"]
    level = ranked(keyed.where(F.col("_key") == low), "_rank", ["a", "b"]).where(F.col("_rank") < left).drop("_rank")
    return keyed.where(F.col("_key") > low).unionByName(level).drop("_key")


def refine_once(
    nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, transform: Callable[[Column], Column] | None = None, every: bool = False, most: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass over edges longer than their limit (nodes have ``limit double``), or all with ``every``: (nodes, simplices, edges split). With ``most``, only so many edges are split,
    the longest; any choice of edges leaves a proper mesh, as every simplex splits those that it has.

    An edge's limit is the smaller one of its ends, a midpoint's limit the mean. A triangle with three long edges becomes four; otherwise a
    simplex is bisected at its longest long edge (ties: larger node ids last), and its parts at theirs. The choice depends on the edge
    alone, so simplices that share an edge split it alike. Ids: midpoints follow the largest node id in the order of their edges;
    children count from parent * 2**(vertices choose 2).
    """
    pairs = edges(simplices, vertices)
    limit = nodes.select("node_id", "limit")
    long = (
        edge_lengths(nodes, pairs, d)
        .join(limit.select(F.col("node_id").alias("a"), F.col("limit").alias("la")), "a")
        .join(limit.select(F.col("node_id").alias("b"), F.col("limit").alias("lb")), "b")
        .where(F.lit(every) | (F.col("length") > F.least("la", "lb") * (1 + 1e-12)))
    )
    if most is not None:
        long = longest(long, most)
    top = nodes.agg(F.max("node_id").alias("top"))
    long = ranked(long, "rank", ["a", "b"]).crossJoin(F.broadcast(top)).withColumn("mid", F.col("top") + 1 + F.col("rank")).select("a", "b", "length", "la", "lb", "mid")
    ends = nodes.select("node_id", "x")
    middle = [(F.get("xa", i) + F.get("xb", i)) / 2 for i in range(d)]
    new = long.join(ends.select(F.col("node_id").alias("a"), F.col("x").alias("xa")), "a").join(ends.select(F.col("node_id").alias("b"), F.col("x").alias("xb")), "b")
    x = F.array(*middle)
    new = new.select(F.col("mid").alias("node_id"), (transform(x) if transform else x).alias("x"), ((F.col("la") + F.col("lb")) / 2).alias("limit"))
    count = vertices * (vertices - 1) // 2
    parts = simplices.select((F.col("simplex_id") * 2**count).alias("simplex_id"), "v")
    if vertices == 3:
        e = edges_of(parts, 3).join(long, ["a", "b"]).groupBy("simplex_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("a", "b", "mid"))).alias("e"))
        whole = parts.join(e.where("n = 3"), "simplex_id")
        s = F.array_sort("v")
        a, b, c = (F.get(s, i) for i in range(3))
        ab, ac, bc = (F.get(F.col("e.mid"), i) for i in range(3))
        four = F.array(F.array(a, ab, ac), F.array(ab, b, bc), F.array(ac, bc, c), F.array(ab, bc, ac))
        quartered = whole.select("simplex_id", F.posexplode(four).alias("k", "v")).select((F.col("simplex_id") + F.col("k")).alias("simplex_id"), "v")
        parts = parts.join(e.where("n = 3").select("simplex_id"), "simplex_id", "left_anti")
    else:
        quartered = None
    for step in range(count):
        e = edges_of(parts, vertices).join(long, ["a", "b"]).groupBy("simplex_id").agg(F.max(F.struct(F.round("length", 9).alias("length"), "a", "b", "mid")).alias("e"))
        at = parts.join(e, "simplex_id", "left")

        def child(drop: str) -> Column:
            return F.transform("v", lambda i: F.when(i == F.col(f"e.{drop}"), F.col("e.mid")).otherwise(i))

        both = F.when(F.col("e").isNull(), F.array("v")).otherwise(F.array(child("b"), child("a")))
        parts = at.select("simplex_id", F.posexplode(both).alias("k", "v")).select((F.col("simplex_id") + F.col("k") * 2 ** (count - 1 - step)).alias("simplex_id"), "v")
    out = parts if quartered is None else parts.unionByName(quartered)
    return nodes.select("node_id", "x", "limit").unionByName(new), out, long


def subset(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of a multiplicative hash of a whole number, then of the number: the same ones whatever the partitions."""
    return df.orderBy(F.pmod(F.col(key) * 2654435761 + seed, F.lit(4294967296)), key).limit(n)


def edges_of(simplices: DataFrame, vertices: int) -> DataFrame:
    """``simplex_id, a, b``."""
    pairs = F.array(*[F.struct(F.least(F.get("v", i), F.get("v", j)).alias("a"), F.greatest(F.get("v", i), F.get("v", j)).alias("b")) for i, j in itertools.combinations(range(vertices), 2)])
    return simplices.select("simplex_id", F.inline(pairs))


def refine(nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, most_nodes: int | None = None, levels: int | None = None, transform: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Passes of ``refine_once`` until one splits no edge longer than twice its limit (or ``levels`` passes over all edges), or there are ``most_nodes``: the last pass splits the longest edges
    as far as these go.

    Each pass is checkpointed and its simplices are numbered anew. ``nodes`` has ``limit``.
    """
    done = 0
    while levels is None or done < levels:
        room = None if most_nodes is None else most_nodes - nodes.count()
        if room is not None and room <= 0:
            break
        more, split, long = refine_once(nodes, simplices, vertices, d, transform, levels is not None, room)
        long = checkpointed(long)
        more = checkpointed(more)
        if long.isEmpty():
            break
        nodes = more
        simplices = checkpointed(ranked(split, "rank", ["simplex_id"]).select(F.col("rank").alias("simplex_id"), "v"))
        done += 1
        if levels is None and long.where(F.col("length") > 2 * F.least("la", "lb")).isEmpty():
            break
    return nodes.select("node_id", "x"), simplices
