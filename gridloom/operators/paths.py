"""Shortest paths along a mesh's edges, by rounds of relaxation over tables."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.cut_lineage import Log, checkpointed

#: Nodes are dealt by id into blocks of so many; a round finishes the paths within a block. What crosses a long mesh takes a round a block: a task of a few seconds.
BLOCK = 1 << 16


def _block(node: str) -> Column:
    return F.floor(F.col(node) / BLOCK)


def by_blocks(parts: DataFrame, first: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, most_rounds: int, what: str) -> DataFrame:
    """All own rows (``schema``) that ``run`` makes of blocks, from the rows ``first`` on.

    Rows are ``origin, block, node_id, own, turn`` and values: one that is not ``own`` comes from another block and has its block entered in the next round.
    ``run`` has all rows of an origin in a block that was entered, and the block's ``parts``. A round reads and writes entered blocks alone, so that all
    rounds together read a block's parts as often as it is entered. The driver sees the numbers of the entered blocks.
    """
    session, kinds = parts.sparkSession, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    whole, known = Log(session, "parts", kinds, ("block",)), Log(session, "found", schema, ("block",))
    whole.add(parts)
    names = [c.split()[0] for c in schema.split(", ")]
    new = checkpointed(first.select(*names))
    for turn in range(most_rounds):
        known.add(new)
        entered = checkpointed(new.where("NOT own").select("origin", "block").distinct())
        blocks = [r["block"] for r in entered.select("block").distinct().collect()]  # a number for each block
        if not blocks:
            whole.drop()
            return known.every().where("own")
        rows = known.among(blocks).join(entered, ["origin", "block"], "left_semi").groupBy("origin", "block")
        near = whole.among(blocks).join(entered, "block").withColumnsRenamed({"origin": "from", "block": "of"}).groupBy("from", "of")
        new = checkpointed(rows.cogroup(near).applyInPandas(run, schema).withColumn("turn", F.lit(turn + 1)))
    raise RuntimeError(f"{what} are not finished after {most_rounds} rounds")


def _better(new: tuple[float, int], old: tuple[float, int | None] | None) -> bool:
    return old is None or new[0] < old[0] - 1e-12 or (new[0] <= old[0] + 1e-12 and old[1] is not None and new[1] is not None and new[1] < old[1])


PATH = "origin long, block long, node_id long, distance double, prior long, own boolean, turn int"


def _within(known: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """What one origin's paths reach from those that enter a block: nodes in it, with all that follows there, and nodes one link outside, for their blocks too."""
    if known.empty:
        return pd.DataFrame({c.split()[0]: [] for c in PATH.split(", ")})
    origin, block = int(known["origin"].iloc[0]), int(known["block"].iloc[0])
    best: dict[int, tuple[float, int | None]] = {}
    heap, found = [], set()
    # What the block has found itself comes first, the last at last; then what enters.
    for n, d, p, own in known.sort_values(["own", "turn"], ascending=[False, True])[["node_id", "distance", "prior", "own"]].itertuples(index=False):
        new = float(d), None if pd.isna(p) else int(p)
        if own:
            best[n] = new
        elif _better(new, best.get(n)):
            best[n] = new
            found.add(n)
            heap.append((new[0], n))
    links: dict[int, list[tuple[int, float]]] = {}
    for a, b, length in zip(near["a"].tolist(), near["b"].tolist(), near["length"].tolist(), strict=True):
        links.setdefault(a, []).append((b, length))
    heapq.heapify(heap)
    while heap:
        d, a = heapq.heappop(heap)
        if d > best[a][0]:
            continue
        for b, length in links.get(a, []):
            if _better((d + length, a), best.get(b)):
                best[b] = d + length, a
                found.add(b)
                if b // BLOCK == block:
                    heapq.heappush(heap, (d + length, b))
    rows = [(origin, block, n, *best[n], True, 0) for n in found] + [(origin, n // BLOCK, n, *best[n], False, 0) for n in found if n // BLOCK != block]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PATH.split(", ")]).astype({"prior": "Int64"})


def shortest_paths(links: DataFrame, origins: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """``origin, node_id, distance, prior``: least sum of ``length`` over undirected links ``a, b, length`` from each origin (``origin``, a node id), and the node
    before on such a path (the least one of equals; null at the origin).

    A round takes the blocks that paths came into in the round before, finishes the paths within each (a task has one block's links) and
    hands on what leaves it. It ends when nothing enters a block: after as many rounds as a path crosses blocks, not nodes.
    """
    both = links.select("a", "b", "length").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "length"))
    both = both.groupBy("a", "b").agg(F.min("length").alias("length")).withColumn("block", _block("a"))
    origin = F.col("origin").cast("long")
    first = origins.select(origin.alias("origin"), _block("origin").alias("block"), origin.alias("node_id"), F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("prior"), F.lit(False).alias("own"), F.lit(0).alias("turn")).distinct()
    found = by_blocks(both, first, _within, PATH, most_rounds, "shortest paths").where(F.col("block") == _block("node_id"))
    last = found.groupBy("origin", "node_id").agg(F.max_by(F.struct("distance", "prior"), "turn").alias("last"))
    return last.select("origin", "node_id", "last.distance", "last.prior")


def path_nodes(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """``origin, end, step, node_id``: nodes of the paths to ``ends`` (``origin, end``), the end first (step 0)."""
    at = ends.select("origin", "end", F.lit(0).alias("step"), F.col("end").alias("node_id"))
    out = at
    prior = paths.where("prior IS NOT NULL").select("origin", "node_id", "prior")
    while True:
        at = checkpointed(at.join(prior, ["origin", "node_id"]).select("origin", "end", (F.col("step") + 1).alias("step"), F.col("prior").alias("node_id")))
        if at.isEmpty():
            return out
        out = out.unionByName(at)
