"""Conjugate gradients on tables for many right sides, by blocks of rows.

Rows are dealt to blocks by ranges of ids that hold about ``ROWS`` each. A block's part of the matrix is one row of the table of blocks, which is made once and kept with
its partitions; a step sends the vectors, an array for each block, to it and writes them anew. Of other blocks' values a step sends those at ends of
entries that lie in two blocks, and nothing for each entry. The method is that of Chronopoulos and Gear with Jacobi's preconditioner: both sums of a step are made at once,
so a step is one shuffle, and neighbours keep the residuals at such ends up to date themselves. The driver sees two sums for each block and right side, and the ranges' ends.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.cut_lineage import checkpointed, deleted, shared_folder

#: Rows of a block on average; right sides that are one group's work.
ROWS, SLOT = 1 << 14, 4
ENTRY = "block long, i long, j long, v double"
SIDE = "block long, slot int, k int, i long, v double"
MATRIX = "block long, ids binary, starts binary, columns binary, entries binary, others binary, counts binary, sends binary, sizes binary"
#: kind: state (vectors of a block), edge (values for another block), sum.
STATE = "block long, slot int, source long, data binary, kind string"
_NAMES = ["block", "slot", "source", "data", "kind"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]


def _cuts(m: DataFrame) -> np.ndarray:
    """Where blocks but the first begin."""
    rows = m.where("i = j").select("i").distinct()
    n = rows.count()
    blocks = math.ceil(n / ROWS)
    if blocks < 2:
        return np.zeros(0, np.int64)
    shares = [k / blocks for k in range(1, blocks)]
    return np.unique(np.array(rows.agg(F.percentile_approx("i", shares, 10_000 + 20 * blocks).alias("c")).first()["c"], np.int64))


def _packed(cuts: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        """One block's rows: starts of each row, columns (own ones, then others' by block and id), and which own values other blocks need."""
        i, j, v = (t[c].to_numpy() for c in ("i", "j", "v"))
        ids = np.unique(i[i == j])
        block = t["block"][0].as_py()
        of = np.searchsorted(cuts, j, side="right")
        held = np.isin(i, ids) & ((of != block) | np.isin(j, ids))
        i, j, v, of = i[held], j[held], v[held], of[held]
        order = np.lexsort((j, i))
        i, j, v, of = i[order], j[order], v[order], of[order]
        far = of != block
        outside = np.unique(j[far])
        columns = np.where(far, len(ids) + np.searchsorted(outside, j), np.searchsorted(ids, j))
        owner = np.searchsorted(cuts, outside, side="right")
        others, counts = np.unique(owner, return_counts=True)
        sends = [np.unique(np.searchsorted(ids, i[of == b])) for b in others]  # the matrix is symmetric
        cells = (ids, np.searchsorted(i, ids), columns.astype(np.int32), v, others, counts, np.concatenate([*sends, np.zeros(0, np.int64)]), np.array([len(s) for s in sends], np.int64))
        kinds = (np.int64, np.int64, np.int32, float, np.int64, np.int64, np.int64, np.int64)
        return pa.table([pa.array([block], pa.int64()), *[pa.array([np.ascontiguousarray(c, k).tobytes()], pa.binary()) for c, k in zip(cells, kinds, strict=True)]], names=[c.split()[0] for c in MATRIX.split(", ")])

    return run


class _Block:
    """A block's rows, read."""

    def __init__(self, t: pa.Table):
        r = t.to_pylist()[0]
        whole = lambda c: np.frombuffer(r[c], np.int64)
        self.block, self.slot, self.ids, self.starts, self.others, self.counts = r["block"], r["slot"], whole("ids"), whole("starts"), whole("others"), whole("counts")
        self.columns, self.entries = np.frombuffer(r["columns"], np.int32), np.frombuffer(r["entries"])
        self.sends = np.split(whole("sends"), np.cumsum(whole("sizes"))[:-1]) if len(self.others) else []
        self.n, self.outside = len(self.ids), int(self.counts.sum())

    def diagonal(self) -> np.ndarray:
        out, rows = np.zeros(self.n), np.repeat(np.arange(self.n), np.diff([*self.starts, len(self.columns)]))
        on = rows == self.columns
        np.add.at(out, rows[on], self.entries[on])
        return out

    def times(self, u: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.entries[:, None] * u[self.columns], self.starts, axis=0)

    def edges(self, values: np.ndarray) -> list[tuple]:
        """Rows for other blocks: this one's values that their entries meet, by id."""
        return [(int(to), self.slot, self.block, values[at].tobytes(), "edge") for to, at in zip(self.others, self.sends, strict=True)]

    def met(self, t: pa.Table, width: int) -> np.ndarray:
        """Others' values, in the order of the columns."""
        sent = {s: np.frombuffer(d) for s, d, kind in zip(t["source"].to_pylist(), t["data"].to_pylist(), t["kind"].to_pylist(), strict=True) if kind == "edge"}
        parts = [sent.get(int(b), np.zeros(0)) for b in self.others]
        if any(len(p) != c * width for p, c in zip(parts, self.counts, strict=True)):
            raise ValueError("the matrix is not symmetric")
        return np.concatenate([p.reshape(-1, width) for p in parts]) if parts else np.zeros((0, width))


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(_NAMES), _KINDS, strict=True)], names=_NAMES)


def _first(width: list[int]):
    def run(matrix: pa.Table, b: pa.Table) -> pa.Table:
        """A block's right sides and diagonal, for it and for its neighbours."""
        if not matrix.num_rows:
            return _rows([])  # right sides of rows that the matrix does not have
        a = _Block(matrix)
        r = np.zeros((a.n, width[a.slot]))
        if b.num_rows:
            i, k = b["i"].to_numpy(), b["k"].to_numpy()
            at = np.minimum(np.searchsorted(a.ids, i), a.n - 1)
            held = a.ids[at] == i
            np.add.at(r, (at[held], k[held]), b["v"].to_numpy()[held])
        both = np.column_stack([a.diagonal(), r])
        return _rows([(a.block, a.slot, a.block, both.tobytes(), "state"), *a.edges(both)])

    return run


def _stepped(width: list[int], by: list[np.ndarray] | None, turn: list[np.ndarray] | None):
    def run(matrix: pa.Table, rows: pa.Table) -> pa.Table:
        """Vectors moved by the last step's sums (none yet: begun), their product with the matrix, its values for the neighbours, and the new sums."""
        if not matrix.num_rows:
            return _rows([])
        a = _Block(matrix)
        n, m, all_ = a.n, width[a.slot], a.n + a.outside
        own = np.frombuffer(next(d for d, kind in zip(rows["data"].to_pylist(), rows["kind"].to_pylist(), strict=True) if kind == "state"))
        if by is None:
            both = np.concatenate([own.reshape(n, m + 1), a.met(rows, m + 1)])
            d, r = both[:, 0].copy(), both[:, 1:].copy()
            x, p, s = np.zeros((n, m)), np.zeros((n, m)), np.zeros((all_, m))
        else:
            d, x, p, w, r, s = np.split(own, np.cumsum([all_, n * m, n * m, n * m, all_ * m]))
            x, p, w, r, s = (c.reshape(-1, m) for c in (x, p, w, r, s))
            w, step, keep = np.concatenate([w, a.met(rows, m)]), by[a.slot], turn[a.slot]
            p, s = r[:n] / d[:n, None] + keep * p, w + keep * s
            x, r = x + step * p, r - step * s
        u = r / d[:, None]
        w = a.times(u)
        sums = np.concatenate([(r[:n] * u[:n]).sum(axis=0), (w * u[:n]).sum(axis=0)])
        state = np.concatenate([c.ravel() for c in (d, x, p, w, r, s)])
        return _rows([(a.block, a.slot, a.block, state.tobytes(), "state"), *a.edges(w), (a.block, a.slot, a.block, sums.tobytes(), "sum")])

    return run


def _solution(width: list[int], reps: np.ndarray):
    def run(matrix: pa.Table, rows: pa.Table) -> pa.Table:
        a = _Block(matrix)
        m, first = width[a.slot], a.slot * SLOT
        at = a.n + a.outside
        x = np.frombuffer(rows["data"][0].as_py())[at : at + a.n * m].reshape(-1, m)
        return pa.table({"rep": np.tile(reps[first : first + m], a.n), "i": np.repeat(a.ids, m), "v": x.ravel()})

    return run


def solve_many(m: DataFrame, b: DataFrame, tolerance: float, most: int) -> DataFrame:
    """``rep, i, v`` with m @ x = b for each right side ``rep, i, v``; see ``sparse.solve_many``."""
    session = m.sparkSession
    m, b = checkpointed(m), checkpointed(b.where("rep IS NOT NULL"))
    reps = np.array(sorted(r["rep"] for r in b.select("rep").distinct().collect()), np.int64)
    if not len(reps):
        return b.select("rep", "i", "v")
    cuts = _cuts(m)
    width = [len(reps[k : k + SLOT]) for k in range(0, len(reps), SLOT)]

    def dealt(batches):
        for t in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, t["i"].to_numpy(), side="right"), pa.int64()), t["i"], t["j"], t["v"]], names=["block", "i", "j", "v"])

    def named(batches):
        for t in batches:
            block, k = np.searchsorted(cuts, t["i"].to_numpy(), side="right"), np.searchsorted(reps, t["rep"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(k // SLOT, pa.int32()), pa.array(k % SLOT, pa.int32()), t["i"], t["v"]], names=["block", "slot", "k", "i", "v"])

    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))  # with fewer Spark would deal the blocks anew in each step
    matrix = m.select("i", "j", F.col("v").cast("double").alias("v")).mapInArrow(dealt, ENTRY).groupBy("block").applyInArrow(_packed(cuts), MATRIX)
    matrix = matrix.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(width) - 1)))).repartition(tasks, "block", "slot").persist(StorageLevel.MEMORY_AND_DISK)
    key, folder = ["block", "slot"], f"{shared_folder(session)}/gradients-{uuid.uuid4().hex}"

    def written(rows: DataFrame, run, step: int) -> DataFrame:
        """What a step makes of the rows of the one before, which are deleted."""
        matrix.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(run, STATE).write.partitionBy("kind").parquet(f"{folder}/{step}")
        if step:
            deleted(session, f"{folder}/{step - 1}")
        return session.read.schema(STATE).parquet(f"{folder}/{step}")

    try:
        matrix.count()
        sides = b.where("v IS NOT NULL").select("rep", "i", F.col("v").cast("double").alias("v")).mapInArrow(named, SIDE)
        rows = written(sides, _first(width), 0)
        by = turn = before = first = None
        for step in range(most + 1):
            rows = written(rows.where("kind <> 'sum'"), _stepped(width, by, turn), step + 1)
            sums = [np.zeros(2 * k) for k in width]
            for r in sorted(rows.where("kind = 'sum'").collect(), key=lambda r: r["block"]):
                sums[r["slot"]] = sums[r["slot"]] + np.frombuffer(r["data"])
            rho, form = (np.concatenate([s.reshape(2, -1)[k] for s in sums]) for k in (0, 1))
            first = rho if first is None else first
            open_ = ~(rho <= tolerance**2 * first)
            if not open_.any():
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                beta = np.zeros(len(reps)) if before is None else np.where(before[1] > 0, rho / before[0], 0.0)
                under = form if before is None else form - beta * rho / before[1]
                beta, under = np.where(under > 0, beta, 0.0), np.where(under > 0, under, form)  # begun anew where rounding has the better of it
                alpha = np.where(open_ & (under > 0), rho / under, 0.0)
            before = (rho, alpha)
            by, turn = ([np.where(open_, c, 0.0)[k : k + SLOT] for k in range(0, len(reps), SLOT)] for c in (alpha, beta))
        else:
            raise RuntimeError(f"conjugate gradients: residual {math.sqrt((rho[open_] / first[open_]).max()):.3g} of the first after {most} steps, not {tolerance:g}")
        last = rows.where("kind = 'state'").select(*_NAMES)
        matrix.groupBy(*key).cogroup(last.groupBy(*key)).applyInArrow(_solution(width, reps), "rep long, i long, v double").write.parquet(f"{folder}/solution")
        deleted(session, f"{folder}/{step + 1}")
    finally:
        matrix.unpersist()
    return session.read.schema("rep long, i long, v double").parquet(f"{folder}/solution")
