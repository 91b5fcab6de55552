"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import Rounds


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the edges: one row."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (long): the smallest node reachable from each node that has a link, itself included.

    ``links``: two columns of longs; direction, repeats and loops don't matter, rows with a null are left out.
    Nodes without a link to another node are not returned. Each round is one aggregation and one join by node in both
    directions; minima are combined before the shuffle, and links stay distributed throughout. Every round's links are
    written to the shared folder, so that a lost executor costs one round at most, and take the place of those before.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    rounds = Rounds(links.sparkSession, "links")
    edges = rounds.put(edges)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = rounds.put(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    ends = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.unionByName(roots)
