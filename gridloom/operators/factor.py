"""Exact factor of a sparse symmetric positive definite matrix on tables: A = L L^T in an order by nested dissection, tile by tile.

Order. Nodes are halved by place, box within box. The end of an edge that lies on the lower side of the cut where the edge's ends part belongs to that cut's
separator; an edge then joins nodes of which one's box holds the other's. Boxes are eliminated from the innermost out, all of one depth at once; a
separator of many nodes is cut into blocks, one step each. So the number of steps follows the depth and the largest separators, not the nodes.

Factor. The matrix is a table of tiles: for a block row and a block column, the rows and columns that hold something, and their values. A step adds up the tiles of
its columns, takes the diagonal tiles' factors, solves the tiles below them, and writes the products of these as further tiles for later steps. Matrix,
factor and inverse are logs by step in the shared folder: a row is written once and read by its own step. No group holds a front: tiles of a column are dealt in parts of ``PART``.
The driver sees the number of blocks at each depth.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.cut_lineage import Log, checkpointed, released

#: Nodes of a block, of the boxes that are not halved further, of a box that is halved within one task, and tiles of a part. A box's tile is full however
#: sparse its matrix is: small boxes keep the factor near its own size, and large blocks the steps of long separators few.
BLOCK, BOX, WITHIN, PART = 512, 64, 1 << 16, 16
#: Levels of halving.
DEPTH = 48
TILE = "step int, i long, j long, part int, p binary, q binary, v binary"
_NAMES = ["step", "i", "j", "part", "p", "q", "v"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


@dataclass(frozen=True)
class Factored:
    """order: ``i, block, place``; tiles: the factor's, by step; steps: their number."""

    order: DataFrame
    tiles: Log
    steps: int


def _halved(nodes: pd.DataFrame, leaf: int) -> pd.DataFrame:
    """Codes of one box's nodes, halved along their longest side until few or at one place."""
    x, code, depth = np.stack(nodes["x"].to_numpy()).astype(float), nodes["code"].to_numpy().copy(), nodes["depth"].to_numpy().copy()
    todo = [np.arange(len(x))]
    while todo:
        some = todo.pop()
        spread = np.ptp(x[some], axis=0)
        axis, level = int(spread.argmax()), int(depth[some[0]])
        if len(some) <= leaf or spread[axis] == 0 or level >= DEPTH:
            continue
        middle = np.median(x[some, axis])
        upper = x[some, axis] > middle
        if not upper.any():
            upper = x[some, axis] >= middle
        code[some[upper]] |= 1 << (DEPTH - 1 - level)
        depth[some] = level + 1
        todo += [some[upper], some[~upper]]
    return pd.DataFrame({"i": nodes["i"], "code": code, "depth": depth})


def boxes(nodes: DataFrame, dims: int, leaf: int = BLOCK) -> DataFrame:
    """``i, code, depth``: the box of each node (``i, x array``); a code's first ``depth`` of ``DEPTH`` bits say on which side of each cut it lies.

    Boxes of more than ``WITHIN`` nodes are halved by a round over all, at approximate medians; a smaller box's inner cuts are one group's work.
    """
    state = nodes.select("i", "x", F.lit(0).cast("long").alias("code"), F.lit(0).alias("depth"))
    for level in range(DEPTH):
        at = [F.get("x", d) for d in range(dims)]
        state = checkpointed(state)
        each = [F.struct((F.max(a) - F.min(a)).alias("spread"), F.lit(d).alias("axis"), F.percentile_approx(a, 0.5, 1000).alias("middle"), F.max(a).alias("most")) for d, a in enumerate(at)]
        cuts = state.where(F.col("depth") == level).groupBy("code").agg(F.count("*").alias("n"), F.greatest(*each).alias("cut") if dims > 1 else each[0].alias("cut"))
        cuts = checkpointed(cuts.where((F.col("n") > WITHIN) & (F.col("cut.spread") > 0)).select("code", F.lit(level).alias("depth"), "cut"))
        if cuts.isEmpty():
            break
        here = F.get("x", F.col("cut.axis"))
        upper = F.when(F.col("cut.middle") < F.col("cut.most"), here > F.col("cut.middle")).otherwise(here >= F.col("cut.middle"))
        bit = F.when(upper, 1 << (DEPTH - 1 - level)).otherwise(0)
        state = state.join(cuts, ["code", "depth"], "left").select("i", "x", F.when(F.col("cut").isNull(), F.col("code")).otherwise(F.col("code") + bit).alias("code"), (F.col("depth") + F.col("cut").isNotNull().cast("int")).alias("depth"))
    return state.groupBy("code", "depth").applyInPandas(lambda g: _halved(g, leaf), "i long, code long, depth int")


def nested_order(m: DataFrame, nodes: DataFrame, dims: int, leaf: int = BLOCK) -> tuple[DataFrame, int]:
    """(``i, block, place``, steps): an elimination order of m (``i, j, v``) whose rows have the places ``nodes`` (``i, x array``). A block's id starts with its step."""
    at = checkpointed(boxes(nodes, dims, min(leaf, BOX)))
    edges = m.select("i", "j").where("i <> j").join(at.select("i", F.col("code").alias("a")), "i").join(at.select(F.col("i").alias("j"), F.col("code").alias("b")), "j")
    level = DEPTH - F.length(F.bin(F.col("a").bitwiseXOR(F.col("b"))))
    cut = edges.where("a < b").groupBy("i").agg(F.min(level).alias("level"))
    placed = at.join(cut, "i", "left").select("i", "code", F.coalesce("level", "depth").cast("int").alias("level"))
    box = F.col("code") - F.pmod("code", F.expr(f"shiftleft(1L, {DEPTH} - level)"))
    k = F.row_number().over(Window.partitionBy("level", "box").orderBy("code", "i")) - 1
    placed = checkpointed(placed.withColumn("box", box).select("i", "level", "box", F.floor(k / leaf).cast("int").alias("chunk"), (k % leaf).cast("int").alias("place")))
    first, step = {}, 0
    for r in placed.groupBy("level").agg(F.max("chunk").alias("chunk")).orderBy(F.desc("level")).collect():  # one row a level, DEPTH at most
        first[r["level"]] = step
        step += r["chunk"] + 1
    starts = F.create_map(*[F.lit(x) for item in first.items() for x in item]) if first else F.create_map(F.lit(0), F.lit(0))
    block = (F.element_at(starts, F.col("level")) + F.col("chunk")).cast("long") * (1 << DEPTH) + F.col("box")
    return checkpointed(placed.select("i", block.alias("block"), "place")), step


def _tiles(t: pa.Table) -> list[tuple]:
    """(i, j, part, p, q, values) of each row."""
    rows = zip(*(t[c].to_pylist() for c in ("i", "j", "part", "p", "q", "v")), strict=True)
    return [(i, j, part, np.frombuffer(p, np.int32), np.frombuffer(q, np.int32), np.frombuffer(v).reshape(len(p) // 4, len(q) // 4)) for i, j, part, p, q, v in rows]


def _table(rows: list[tuple]) -> pa.Table:
    """Of (i, j, part, p, q, values); a tile's step is its column's."""
    packed = [(j >> DEPTH, i, j, part, p.astype(np.int32).tobytes(), q.astype(np.int32).tobytes(), np.ascontiguousarray(v, float).tobytes()) for i, j, part, p, q, v in rows]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*packed, strict=True) if packed else [[]] * 7, _KINDS, strict=True)], names=_NAMES)


def _added(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tiles of one place added up: (rows, columns, values)."""
    p, q = np.unique(np.concatenate([r[3] for r in rows])), np.unique(np.concatenate([r[4] for r in rows]))
    out = np.zeros((len(p), len(q)))
    for r in rows:
        out[np.ix_(np.searchsorted(p, r[3]), np.searchsorted(q, r[4]))] += r[5]
    return p, q, out


def _summed(t: pa.Table) -> pa.Table:
    """A tile from its terms; a diagonal one is factored."""
    rows = _tiles(t)
    p, q, v = _added(rows)
    if rows[0][0] == rows[0][1]:
        try:
            v = np.linalg.cholesky(v)
        except np.linalg.LinAlgError as e:
            raise ValueError("the matrix is not positive definite") from e
    return _table([(rows[0][0], rows[0][1], rows[0][2], p, q, v)])


def _wide(r: tuple, width: int) -> np.ndarray:
    out = np.zeros((len(r[3]), width))
    out[:, r[4]] = r[5]
    return out


def _below(diagonal: pa.Table, panel: pa.Table) -> pa.Table:
    """Tiles below a diagonal one: X L^T = A."""
    if not panel.num_rows:
        return _table([])
    lower = _tiles(diagonal)[0][5]
    m = len(lower)
    return _table([(r[0], r[1], r[2], r[3], np.arange(m), np.linalg.solve(lower, _wide(r, m).T).T) for r in _tiles(panel)])


def _products(left: pa.Table, right: pa.Table) -> pa.Table:
    """-X_I X_K^T for tiles I of one part and K of another, or the same, where I is not before K."""
    a, b = _tiles(left), _tiles(right)
    return _table([(x[0], y[0], 0, x[3], y[3], -(x[5] @ y[5].T)) for x in a for y in b if x[0] >= y[0]])


def _of_entries(t: pa.Table) -> pa.Table:
    """A tile from single entries ``p, q, v``."""
    p, q = t["p"].to_numpy(), t["q"].to_numpy()
    rows, columns = np.unique(p), np.unique(q)
    out = np.zeros((len(rows), len(columns)))
    np.add.at(out, (np.searchsorted(rows, p), np.searchsorted(columns, q)), t["v"].to_numpy())
    return _table([(t["i"][0].as_py(), t["j"][0].as_py(), 0, rows, columns, out)])


def _met(left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Groups of both tables by the same keys; the tables may come from one (their columns are named anew)."""
    left, right = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _in_parts(tiles: DataFrame) -> DataFrame:
    """Tiles below the diagonal, ``PART`` of each column to a part."""
    k = F.row_number().over(Window.partitionBy("j").orderBy("i")) - 1
    return tiles.withColumn("part", F.floor(k / PART).cast("int"))


def _to_parts(tiles: DataFrame, panel: DataFrame) -> DataFrame:
    """A copy of each column's diagonal tile for each of its parts."""
    return tiles.drop("part").join(panel.select("j", "part").distinct(), "j").select(*_NAMES)


def _pairs(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles keyed by pairs of parts (a, b), a not before b: once as those of a, once as those of b."""
    parts = tiles.groupBy("j").agg(F.max("part").alias("parts"))
    left = tiles.withColumn("a", F.col("part")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("part"))))
    return left, tiles.join(parts, "j").withColumn("b", F.col("part")).withColumn("a", F.explode(F.sequence(F.col("part"), F.col("parts")))).drop("parts")


def factored(m: DataFrame, nodes: DataFrame, dims: int, leaf: int = BLOCK) -> Factored:
    """The factor of m (``i, j, v``, symmetric positive definite, both triangles), whose rows have the places ``nodes`` (``i, x``). Raises where it is not positive definite."""
    m = checkpointed(m)
    order, steps = nested_order(m, nodes.join(m.select("i").distinct(), "i", "left_semi"), dims, leaf)
    session = m.sparkSession
    terms, tiles = Log(session, "terms", TILE), Log(session, "factor", TILE)
    a = order.select("i", F.col("block").alias("bi"), F.col("place").alias("p"))
    entries = m.join(a, "i").join(a.select(F.col("i").alias("j"), F.col("bi").alias("bj"), F.col("p").alias("q")), "j").where("bi >= bj")
    entries = entries.select(F.col("bi").alias("i"), F.col("bj").alias("j"), "p", "q", "v")
    terms.add(entries.groupBy("i", "j").applyInArrow(_of_entries, TILE))
    released(m)
    for step in range(steps):
        mine = checkpointed(terms.of(step).groupBy("i", "j").applyInArrow(_summed, TILE))
        panel = _in_parts(mine.where("i <> j"))
        below = _met(_to_parts(mine.where("i = j"), panel), panel, ["j", "part"], _below, TILE)
        tiles.add(mine.where("i = j").unionByName(below))
        left, right = _pairs(tiles.of(step).where("i <> j"))
        terms.add(_met(left, right, ["j", "a", "b"], _products, TILE))
        terms.drop_step(step)
        released(mine)
    terms.drop()
    return Factored(order, tiles, steps)


def _entries_of(mirrored: bool):
    def run(t: pa.Table) -> pa.Table:
        """Entries of one place's tiles beside the ids of their rows and columns; zeros are left out."""
        out = []
        for (i, j, _, p, q, v), rows, columns in zip(_tiles(t), t["rows"].to_pylist(), t["columns"].to_pylist(), strict=True):
            a, b = np.nonzero(v)
            at = np.frombuffer(rows, np.int64)[p[a]], np.frombuffer(columns, np.int64)[q[b]]
            out += [(*at, v[a, b]), *([(at[1], at[0], v[a, b])] if mirrored and i != j else [])]
        return pa.table([np.concatenate([r[c] for r in out]) for c in range(3)], names=["i", "j", "v"])

    return run


def _ids_of(t: pa.Table) -> pa.Table:
    ids = np.empty(t.num_rows, np.int64)
    ids[t["place"].to_numpy()] = t["i"].to_numpy()
    return pa.table({"block": t["block"].slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary())})


def _named(tiles: DataFrame, order: DataFrame, mirrored: bool = False) -> DataFrame:
    """``i, j, v`` of tiles, by the nodes' own ids; zeros are left out. mirrored: what lies off the diagonal stands for both triangles.

    Tiles meet their blocks' ids, not entries their nodes'. Neither side is broadcast: files of tiles say far less than the tiles are in memory.
    """
    ids = order.groupBy("block").applyInArrow(_ids_of, "block long, ids binary")
    rows, columns = ids.select(F.col("block").alias("i"), F.col("ids").alias("rows")), ids.select(F.col("block").alias("j"), F.col("ids").alias("columns"))
    met = tiles.join(rows.hint("merge"), "i").join(columns.hint("merge"), "j")
    return met.groupBy("i", "j").applyInArrow(_entries_of(mirrored), "i long, j long, v double")


def _added_up(t: pa.Table) -> pa.Table:
    rows = _tiles(t)
    return _table([(*rows[0][:3], *_added(rows))])


def squared(f: Factored) -> DataFrame:
    """``i, j, v`` of L L^T, tile by tile: a column's tiles meet each other, and what they give for one place is added up before it is named."""
    left, right = _pairs(f.tiles.every())
    less = _met(left, right, ["j", "a", "b"], _products, TILE).groupBy("i", "j").applyInArrow(_added_up, TILE)
    return _named(less, f.order, mirrored=True).withColumn("v", -F.col("v"))


def lower(f: Factored) -> DataFrame:
    """``i, j, v`` of L, by the nodes' own ids; in the order (block, place) of ``f.order`` it is lower triangular."""
    return _named(f.tiles.every(), f.order)


def _log_diagonal(t: pa.Table) -> pa.Table:
    return pa.table({"v": [float(np.log(np.diagonal(r[5])).sum()) for r in _tiles(t)]})


def log_determinant(f: Factored) -> float:
    """Of the matrix, exact to rounding: one number for each block is added up."""
    logs = f.tiles.every().where("i = j").groupBy("j").applyInArrow(_log_diagonal, "v double")
    return 2 * float(logs.agg(F.sum("v").alias("s")).first()["s"] or 0.0)


def _of_values(t: pa.Table) -> pa.Table:
    """Right sides of a block, ``rep, place, v``, as a tile of places by replicates. Replicates are 64-bit: their names go before the tile's values."""
    p, r = t["place"].to_numpy(), t["rep"].to_numpy()
    rows, reps = np.unique(p), np.unique(r)
    out = np.zeros((len(rows), len(reps)))
    np.add.at(out, (np.searchsorted(rows, p), np.searchsorted(reps, r)), t["v"].to_numpy())
    return _vectors([(t["block"][0].as_py(), t["slot"][0].as_py(), rows, reps, out)])


VECTOR = "step int, j long, slot long, p binary, r binary, v binary"


def _vectors(rows: list[tuple]) -> pa.Table:
    packed = [(j >> DEPTH, j, slot, p.astype(np.int32).tobytes(), r.astype(np.int64).tobytes(), np.ascontiguousarray(v, float).tobytes()) for j, slot, p, r, v in rows]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*packed, strict=True) if packed else [[]] * 6, kinds, strict=True)], names=["step", "j", "slot", "p", "r", "v"])


def _read_vectors(t: pa.Table) -> list[tuple]:
    rows = zip(*(t[c].to_pylist() for c in ("j", "slot", "p", "r", "v")), strict=True)
    return [(j, slot, np.frombuffer(p, np.int32), np.frombuffer(r, np.int64), np.frombuffer(v).reshape(len(p) // 4, len(r) // 8)) for j, slot, p, r, v in rows]


def _together(rows: list[tuple], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(replicates, values of all m places) of a block's terms."""
    reps = np.unique(np.concatenate([r[3] for r in rows]))
    out = np.zeros((m, len(reps)))
    for r in rows:
        out[np.ix_(r[2], np.searchsorted(reps, r[3]))] += r[4]
    return reps, out


def _solved(transpose: bool):
    def run(diagonal: pa.Table, terms: pa.Table) -> pa.Table:
        if not terms.num_rows:
            return _vectors([])
        rows, low = _read_vectors(terms), _tiles(diagonal)[0][5]
        reps, right = _together(rows, len(low))
        return _vectors([(rows[0][0], rows[0][1], np.arange(len(low)), reps, np.linalg.solve(low.T if transpose else low, right))])

    return run


def _sent(tiles: pa.Table, solved: pa.Table) -> pa.Table:
    """-X y of each tile X, for the block of its rows."""
    if not solved.num_rows:
        return _vectors([])
    _, slot, _, reps, y = _read_vectors(solved)[0]
    return _vectors([(x[0], slot, x[3], reps, -(x[5] @ y)) for x in _tiles(tiles)])


def _returned(t: pa.Table) -> pa.Table:
    """-X^T x for a part's tiles, each beside the solution of its rows' block, added up."""
    out = None
    kept = t.select(["i", "j", "part", "p", "q", "v"])
    for tile, r, w, slot in zip(_tiles(kept), t["r"].to_pylist(), t["w"].to_pylist(), t["slot"].to_pylist(), strict=True):
        reps = np.frombuffer(r, np.int64)
        x = np.frombuffer(w).reshape(-1, len(reps))
        term = (tile[1], slot, tile[4], reps, -(tile[5].T @ x[tile[3]]))
        out = [term] if out is None else [*out, term]
    reps, total = _together(out, len(out[0][2]))
    return _vectors([(out[0][0], out[0][1], out[0][2], reps, total)])


def solve_factored(f: Factored, b: DataFrame, half: bool = False, slot: int = 64) -> DataFrame:
    """``rep, i, v`` with A x = b, for right sides ``rep, i, v``; half: L y = b only (y by the nodes' own ids). ``slot`` replicates are solved in one group.

    Down the steps, a block's solution sends its products with the tiles below it to their blocks; up again, a block gathers them. Nodes that A doesn't have are left out.
    """
    session = b.sparkSession
    right = b.join(f.order, "i").select("block", F.floor(F.col("rep") / slot).alias("slot"), "rep", "place", "v")
    terms, down, up = Log(session, "right", VECTOR), Log(session, "down", VECTOR), Log(session, "up", VECTOR)
    terms.add(right.groupBy("block", "slot").applyInArrow(_of_values, VECTOR))
    key = ["j", "slot"]
    for step in range(f.steps):
        mine, tiles = terms.of(step), f.tiles.of(step)
        here = tiles.where("i = j").join(mine.select(*key).distinct(), "j")
        down.add(_met(here, mine, key, _solved(False), VECTOR))
        below, solved = tiles.where("i <> j"), down.of(step)
        panel = below.join(solved.select(*key), "j")
        copies = solved.join(below.select("j", "part").distinct(), "j")
        terms.add(_met(panel, copies, [*key, "part"], _sent, VECTOR))
        terms.drop_step(step)
    if not half:
        for step in reversed(range(f.steps)):
            tiles = f.tiles.of(step)
            x = up.every().select(F.col("j").alias("i"), "slot", "r", F.col("v").alias("w"))
            back = tiles.where("i <> j").join(x, "i").groupBy("j", "slot", "part").applyInArrow(_returned, VECTOR)
            mine = checkpointed(down.of(step).unionByName(back))
            here = tiles.where("i = j").join(mine.select(*key).distinct(), "j")
            up.add(_met(here, mine, key, _solved(True), VECTOR))
            released(mine)
        down.drop()
    terms.drop()
    values = (down if half else up).every().groupBy("j", "slot").applyInArrow(_values_of, "block long, place int, rep long, v double")
    return values.join(f.order, ["block", "place"]).select("rep", "i", "v")


def _values_of(t: pa.Table) -> pa.Table:
    out = [(np.full(v.size, j), np.repeat(p, len(r)), np.tile(r, len(p)), v.ravel()) for j, _, p, r, v in _read_vectors(t)]
    return pa.table([np.concatenate([r[c] for r in out]) for c in range(4)], names=["block", "place", "rep", "v"])


ASKED = "j long, i long, k long, a int, b int, p binary, q binary"
TAKEN = ASKED + ", v binary"


def _scaled(diagonal: pa.Table, panel: pa.Table) -> pa.Table:
    """Y = X L^-1 for the tiles X below a diagonal one."""
    if not panel.num_rows:
        return _table([])
    low = _tiles(diagonal)[0][5]
    return _table([(*r[:5], np.linalg.solve(low.T, r[5].T).T) for r in _tiles(panel)])


def _taken(inverse: pa.Table, asked: pa.Table) -> pa.Table:
    """The parts of one tile of the inverse that columns ask for."""
    out = []
    if asked.num_rows:
        _, _, _, p, q, z = _tiles(inverse)[0]
        for r in asked.select(["p", "q"]).to_pylist():
            at = np.ix_(np.searchsorted(p, np.frombuffer(r["p"], np.int32)), np.searchsorted(q, np.frombuffer(r["q"], np.int32)))
            out.append(np.ascontiguousarray(z[at]).tobytes())
    names = [c.split()[0] for c in ASKED.split(", ")]
    return asked.select(names).append_column("v", pa.array(out, pa.binary()))


def _applied(taken: pa.Table, scaled: pa.Table) -> pa.Table:
    """Z_IK Y_K for the rows I of one part and K of another, added up over K."""
    if not taken.num_rows:
        return _table([])
    y = {r[0]: r for r in _tiles(scaled)}
    out: dict = {}
    for r in taken.to_pylist():
        p, q = np.frombuffer(r["p"], np.int32), np.frombuffer(r["q"], np.int32)
        z = np.frombuffer(r["v"]).reshape(len(p), len(q))
        if r["turned"]:
            p, z = q, z.T
        row, other = (r["k"], r["i"]) if r["turned"] else (r["i"], r["k"])
        term = z @ y[other][5]
        out[row] = (p, out[row][1] + term) if row in out else (p, term)
    j, part, q = taken["j"][0].as_py(), taken["to"][0].as_py(), next(iter(y.values()))[4]
    return _table([(row, j, part, p, q, v) for row, (p, v) in out.items()])


def _off_diagonal(terms: pa.Table, scaled: pa.Table) -> pa.Table:
    """A part's tiles of the inverse, and what they add to the diagonal one."""
    out, total = [], 0.0
    by: dict = {}
    for r in _tiles(terms):
        by.setdefault(r[0], []).append(r)
    for i, j, part, p, q, y in _tiles(scaled):
        t = sum(r[5] for r in by[i])
        out.append((i, j, part, p, q, -t))
        total = total + y.T @ t
    if out:
        out.append((out[0][1], out[0][1], out[0][2], out[0][4], out[0][4], total))
    return _table(out)


def _diagonal(t: pa.Table) -> pa.Table:
    """The diagonal tile of the inverse: (L L^T)^-1 and the terms of its column."""
    z, some = 0.0, None
    for i, j, part, p, q, v in _tiles(t):
        if part < 0:
            half = np.linalg.solve(v, np.eye(len(v)))
            v = half.T @ half
        z, some = z + v, (i, j, 0, p, q)
    return _table([(*some, z)])


def selected_inverse(f: Factored, diagonal: bool = False) -> DataFrame:
    """``i, j, v``: the inverse at the places where L or L^T holds something (all of the matrix's own among them), exact to rounding. The diagonal has the variances;
    ``diagonal``: it alone, so that no other tile is sent to be named.

    Up from the last step, a column of the inverse follows from later ones at the places of its own rows: each column asks the tiles it needs for those rows alone.
    """
    z = Log(f.order.sparkSession, "inverse", TILE)
    for step in reversed(range(f.steps)):
        tiles = f.tiles.of(step)
        own, below = tiles.where("i = j"), tiles.where("i <> j")
        y = checkpointed(_met(_to_parts(own, below), below, ["j", "part"], _scaled, TILE))
        rows = y.select("j", "i", F.col("part").alias("a"), "p").join(y.select("j", F.col("i").alias("k"), F.col("part").alias("b"), F.col("p").alias("q")), "j").where("i >= k")
        known = z.every().where(f"step > {step}").withColumn("k", F.col("j")).join(rows.select("i", "k").distinct(), ["i", "k"], "left_semi")
        taken = checkpointed(_met(known, rows.select("j", "i", "k", "a", "b", "p", "q"), ["i", "k"], _taken, TAKEN))
        straight = taken.select("*", F.lit(False).alias("turned"), F.col("a").alias("to"), F.col("b").alias("of"))
        turned = taken.where("i <> k").select("*", F.lit(True).alias("turned"), F.col("b").alias("to"), F.col("a").alias("of"))
        parts = y.groupBy("j").agg(F.max("part").alias("parts"))
        copies = y.join(parts, "j").withColumn("of", F.col("part")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts")))).drop("parts")
        terms = _met(straight.unionByName(turned), copies, ["j", "to", "of"], _applied, TILE)
        found = checkpointed(_met(terms, y, ["j", "part"], _off_diagonal, TILE))
        ends = found.where("i = j").unionByName(own.withColumn("part", F.lit(-1))).groupBy("j").applyInArrow(_diagonal, TILE)
        z.add(found.where("i <> j").unionByName(ends))
        released(y, taken, found)
    if diagonal:
        out = checkpointed(_named(z.every().where("i = j"), f.order).where("i = j"))
        z.drop()
        return out
    return _named(z.every(), f.order, mirrored=True)
