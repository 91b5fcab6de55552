"""Conjugate gradients with a multilevel preconditioner on tables, for systems too large to factor.

Nodes are gathered into boxes of a few by place, boxes into boxes of eight, and so on down to a few hundred: one halving (``factor.boxes``) names them all, as an outer box's
code is the start of an inner one's. A value on a level's boxes is a value on the level below by a smoothed step function P; the coarse matrix is P^T A P.

A cycle from the finest level to the coarsest and back, with one damped Jacobi step W = w D^-1 on either side, is B = S + R^T B' R with S = 2 W - W A W, R = P^T (I - A W) and B' the
coarser level's. S and R are tables made once, so a cycle is three products a level and nothing else. Steps stay about the same however many nodes there are.

From the first level of ``WITHIN`` rows at most on, a cycle is one task's work on a table of all levels below, so that a step's plan has joins for the few larger levels alone.
Nothing is broadcast: a cycle's many joins would each send a level through the driver, at every step. A step's files and what the driver holds of it go with the step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import sparse
from gridloom.operators.cut_lineage import checkpointed, released
from gridloom.operators.factor import DEPTH, boxes

#: Nodes of the coarsest level at most, whose inverse is one task's work; bits of a box's code between levels.
COARSEST, BITS, FEW = 256, 3, 8
#: Rows of a level that is one task's work, with all coarser ones.
WITHIN = 1 << 14


@dataclass(frozen=True)
class Hierarchy:
    """smooth, restrict: S and R of each level; inverse: of the coarsest matrix; all ``i, j, v``. wide: levels of more than ``WITHIN`` rows; narrow: ``level, kind, i, j, v`` of the others."""

    smooth: list[DataFrame]
    restrict: list[DataFrame]
    inverse: DataFrame
    wide: int
    narrow: DataFrame


def _inverted(t: pa.Table) -> pa.Table:
    i, j = t["i"].to_numpy(), t["j"].to_numpy()
    ids = np.unique(i)
    m = np.zeros((len(ids), len(ids)))
    np.add.at(m, (np.searchsorted(ids, i), np.searchsorted(ids, j)), t["v"].to_numpy())
    m = np.linalg.inv((m + m.T) / 2)
    return pa.table({"i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids)), "v": ((m + m.T) / 2).ravel()})


def _times(m: DataFrame, x: DataFrame) -> DataFrame:
    return sparse.times_vectors(m.hint("merge"), x)


def _scaled(m: DataFrame, w: DataFrame, side: str) -> DataFrame:
    """W m or m W for a diagonal W (``i, w``)."""
    return m.join((w if side == "i" else w.withColumnRenamed("i", "j")).hint("merge"), side).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def hierarchy(m: DataFrame, nodes: DataFrame, dims: int) -> Hierarchy:
    """Of m (``i, j, v``, symmetric positive definite, each row with an entry on its diagonal), whose rows have the places ``nodes`` (``i, x array``)."""
    a = checkpointed(m)
    at = checkpointed(boxes(nodes.join(a.select("i").distinct(), "i", "left_semi"), dims, FEW))
    bits = at.agg(F.max("depth").alias("d")).first()["d"] or 0
    place = at.select("i", F.col("code"))
    smooth, restrict, wide = [], [], 0
    while (rows := place.count()) > COARSEST:
        wide += rows > WITHIN
        d = sparse.diagonal(a)
        most = a.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).join(d, "i").agg(F.max(F.col("s") / F.col("v")).alias("m")).first()["m"]
        w = checkpointed(d.select("i", (F.lit(4 / 3 / most) / F.col("v")).alias("w")))
        box = F.col("code") - F.pmod("code", F.lit(1 << (DEPTH - bits)))
        step = place.select("i", box.alias("j"), F.lit(1.0).alias("v"))
        up = checkpointed(sparse.add((1.0, step), (-1.0, sparse.product(_scaled(a, w, "i").hint("merge"), step))))  # P
        down = sparse.transposed(up)
        restrict.append(checkpointed(sparse.add((1.0, down), (-1.0, sparse.product(down.hint("merge"), _scaled(a, w, "j"))))))
        both = w.select("i", F.col("i").alias("j"), F.col("w").alias("v"))
        smooth.append(checkpointed(sparse.add((2.0, both), (-1.0, _scaled(_scaled(a, w, "i"), w, "j")))))
        half = checkpointed(sparse.product(a.hint("merge"), up))
        fine, a = a, checkpointed(sparse.product(down.hint("merge"), half))
        released(fine, half, w, up)
        place = checkpointed(place.select(box.alias("i")).distinct().withColumn("code", F.col("i")))
        if bits == 0:
            break
        bits = max(bits - BITS, 0)
    inverse = checkpointed(a.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(_inverted, "i long, j long, v double"))
    named = lambda m, level, kind: m.select(F.lit(level).alias("level"), F.lit(kind).alias("kind"), "i", "j", "v")
    narrow = named(inverse, len(smooth), 0)
    for level in range(wide, len(smooth)):
        narrow = narrow.unionByName(named(smooth[level], level, 0)).unionByName(named(restrict[level], level, 1))
    return Hierarchy(smooth, restrict, inverse, wide, checkpointed(narrow))


def _cycled(narrow: pa.Table, r: pa.Table) -> pa.Table:
    """The cycle on the narrow levels: B r; ``kind`` 0 is S (of the coarsest level the inverse), 1 is R."""
    level, kind, i, j, v = (narrow[c].to_numpy() for c in ("level", "kind", "i", "j", "v"))
    rep, at, value = (r[c].to_numpy() for c in ("rep", "i", "v"))
    smooth, restrict = ([(i[on], j[on], v[on]) for k in np.unique(level) if (on := (level == k) & (kind == what)).any()] for what in (0, 1))
    ids, reps = [np.unique(m[0]) for m in smooth], np.unique(rep)

    def times(m, rows: np.ndarray, columns: np.ndarray, x: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(rows, m[0]), np.searchsorted(columns, m[1])
        return np.stack([np.bincount(a, m[2] * x[b, c], len(rows)) for c in range(len(reps))], axis=1)

    held, x = np.isin(at, ids[0]), np.zeros((len(ids[0]), len(reps)))
    np.add.at(x, (np.searchsorted(ids[0], at[held]), np.searchsorted(reps, rep[held])), value[held])
    if not len(reps):
        return pa.table({"rep": rep, "i": at, "v": value})
    down = [x]
    for k, m in enumerate(restrict):
        down.append(times(m, ids[k + 1], ids[k], down[-1]))
    z = times(smooth[-1], ids[-1], ids[-1], down.pop())
    for k in reversed(range(len(restrict))):
        rows, columns, w = restrict[k]
        z = times(smooth[k], ids[k], ids[k], down.pop()) + times((columns, rows, w), ids[k], ids[k + 1], z)
    return pa.table({"rep": np.tile(reps, len(z)), "i": np.repeat(ids[0], len(reps)), "v": z.ravel()})


def cycle(h: Hierarchy, r: DataFrame) -> DataFrame:
    """``rep, i, v``: B r for vectors ``rep, i, v``."""
    down = [r]
    for m in h.restrict[: h.wide]:
        down.append(_times(m, down[-1]))
    narrow, last = (t.withColumn("all", F.lit(True)).groupBy("all") for t in (h.narrow, down.pop().select("rep", "i", "v")))
    z = narrow.cogroup(last).applyInArrow(_cycled, "rep long, i long, v double")
    for smooth, restrict in zip(reversed(h.smooth[: h.wide]), reversed(h.restrict[: h.wide]), strict=True):
        z = _times(smooth, down.pop()).unionByName(_times(sparse.transposed(restrict), z)).groupBy("rep", "i").agg(F.sum("v").alias("v"))
    return z


def solve(m: DataFrame, b: DataFrame, h: Hierarchy, tolerance: float = 1e-8, most: int = 200) -> tuple[DataFrame, int]:
    """(``rep, i, v`` with m @ x = b for each right side ``rep, i, v``, steps): until each residual's size, as the preconditioner weighs it, is ``tolerance`` of the first.

    Vectors are checkpointed once a step; the driver sees one row for each right side. Raises if ``most`` steps do not do. Right sides that are zero have none.
    """
    m = checkpointed(m)
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    r = checkpointed(b.select("rep", "i", F.col("v").alias("r")))
    z = cycle(h, r.withColumnRenamed("r", "v")).withColumnRenamed("v", "z")
    state = both = checkpointed(z.join(r.hint("merge"), ["rep", "i"], "left").select("rep", "i", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"), F.col("z").alias("p"), "z"))
    released(r)
    rho = {k["rep"]: k["s"] for k in state.groupBy("rep").agg(dot("r", "z").alias("s")).collect()}
    first, steps = dict(rho), 0
    while any(rho[k] > tolerance**2 * first[k] for k in rho):
        if steps == most:
            raise RuntimeError(f"conjugate gradients: {most} steps do not reach {tolerance:g} for every right side")
        steps += 1
        q = _times(m, state.select("rep", "i", F.col("p").alias("v"))).withColumnRenamed("v", "q")
        met = checkpointed(state.drop("z").join(q.hint("merge"), ["rep", "i"], "left").withColumn("q", F.coalesce("q", F.lit(0.0))))
        released(both)
        by = {k["rep"]: rho[k["rep"]] / k["s"] if k["s"] > 0 else 0.0 for k in met.groupBy("rep").agg(dot("p", "q").alias("s")).collect()}
        by = F.element_at(F.create_map(*[F.lit(x) for item in by.items() for x in item]), F.col("rep"))
        moved = met.select("rep", "i", (F.col("x") + by * F.col("p")).alias("x"), (F.col("r") - by * F.col("q")).alias("r"), "p")
        z = cycle(h, moved.select("rep", "i", F.col("r").alias("v"))).withColumnRenamed("v", "z")
        both = checkpointed(moved.join(z.hint("merge"), ["rep", "i"], "left").withColumn("z", F.coalesce("z", F.lit(0.0))))
        released(met)
        new = {k["rep"]: k["s"] for k in both.groupBy("rep").agg(dot("r", "z").alias("s")).collect()}
        turn = {k: new[k] / rho[k] if rho[k] > 0 else 0.0 for k in new}
        turn = F.element_at(F.create_map(*[F.lit(x) for item in turn.items() for x in item]), F.col("rep"))
        state, rho = both.withColumn("p", F.col("z") + turn * F.col("p")), new
    released(m)
    return state.select("rep", "i", F.col("x").alias("v")), steps
