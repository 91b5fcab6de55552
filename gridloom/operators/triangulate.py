"""Delaunay triangulation of scattered points in the plane, and linear resampling on it, as joins over cells of a hierarchy.

Triangles inside a cell's surroundings are found there and kept where their circles stay in what the cell knows. The rest, along
the hull and across empty regions, lie between ends of open edges and places without a triangle, the front: a small part of all places. Where it has
``FRONT`` places at most, one task closes all edges; a larger one is closed edge by edge from its cells' boxes, coarse to fine, in rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.cut_lineage import checkpointed

#: A cell has FAN x FAN parts on the next level; cells with at most MOST places are not split. DEPTH levels tell places 1e-8 of the extent apart.
FAN, MOST, DEPTH = 4, 64, 12
#: Places that one task closes the edges of, places of one of its boxes, and pairs of an edge and a box or place that it compares at once.
FRONT, BOX, PAIRS = 1 << 16, 32, 1 << 18
#: As parts of the extent: places nearer than this are one; a triangle is at least so high above its longest side, whichever of its edges it is seen from (else places
#: along a straight hull would get slivers behind slivers without end); places are moved by a tenth of it, by their hash, so that of four corners on a circle all see the same diagonal.
SAME = 1e-8


def _places(points: DataFrame) -> DataFrame:
    """``id, x, y, u, v, value``: places, each with its least point_id and mean value; u and v are in the unit square."""
    whole = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('Infinity')" for c in ("px", "py"))
    points = points.where(whole).select("point_id", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), F.col("value").cast("double").alias("value"))
    box = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("long"))
    scale = F.when(F.col("long") > 0, F.col("long")).otherwise(1.0)
    own = points.crossJoin(F.broadcast(box)).select("point_id", "x", "y", "value", ((F.col("x") - F.col("x0")) / scale).alias("u"), ((F.col("y") - F.col("y0")) / scale).alias("v"))  # one row
    key = [F.round(F.col(c) / SAME).cast("long") for c in ("u", "v")]
    first = F.min(F.struct("point_id", "x", "y", "u", "v")).alias("p")
    known = F.when(~F.isnan("value"), F.col("value"))
    merged = own.groupBy(key[0].alias("ku"), key[1].alias("kv")).agg(first, F.avg(known).alias("value"))
    moved = [(F.col(f"p.{c}") + F.pmod(F.xxhash64("ku", "kv", F.lit(n)), F.lit(1 << 30)) / float(1 << 30) * (SAME / 10)).alias(c) for n, c in enumerate(("u", "v"))]
    return merged.select(F.col("p.point_id").alias("id"), "p.x", "p.y", *moved, "value")


def _cell(c: str, level: Column) -> Column:
    return F.least(F.floor(F.col(c) * F.pow(F.lit(float(FAN)), level)), F.pow(F.lit(float(FAN)), level) - 1).cast("long")


def _cells(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places by the cell they lie in on each level, and the cells: count, tight box, one place of each, whether it is split."""
    at = places.select("id", "u", "v", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("k"))
    at = at.select("id", "u", "v", "k", _cell("u", F.col("k")).alias("cx"), _cell("v", F.col("k")).alias("cy"))
    cells = at.groupBy("k", "cx", "cy").agg(
        F.count("*").alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min(F.struct("u", "v")).alias("one")
    )
    cells = cells.withColumn("split", (F.col("n") > MOST) & (F.col("k") < DEPTH))
    up = [F.floor(F.col(c) / FAN).alias(c) for c in ("cx", "cy")]
    above = cells.where("split").select((F.col("k") + 1).alias("k"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    below = cells.withColumns({"ax": up[0], "ay": up[1]})
    # A cell counts only under a split one; others are parts of a leaf.
    return at, checkpointed(below.join(above, ["k", "ax", "ay"], "left_semi").unionByName(below.where("k = 0")))


def _next(p, q, all_, alive, turn):
    """For each edge p -> q the index of the place at its left (turn 1) or right (-1) with the first circle; -1 without one. Also centre and squared radius."""
    d = q - p
    n = turn * np.stack([-d[:, 1], d[:, 0]], axis=1)
    e = all_[None] - ((p + q) / 2)[:, None]
    side = np.einsum("ij,ikj->ik", n, e)
    quarter, away = (d * d).sum(axis=1) / 4, (e * e).sum(axis=2)
    left = side > SAME * np.sqrt(np.maximum(4 * quarter[:, None], away + quarter[:, None] + np.abs(np.einsum("ij,ikj->ik", d, e))))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(left, (away - quarter[:, None]) / (2 * side), np.inf)
    best = t.argmin(axis=1)
    t = t[np.arange(len(p)), best]
    found = alive & np.isfinite(t)
    t = np.where(found, t, 0)
    return np.where(found, best, -1), (p + q) / 2 + t[:, None] * n, quarter * (1 + 4 * t * t)


def _inside(centre, r2, level: int, cx: int, cy: int, unknown) -> np.ndarray:
    """Which circles stay within a cell's surroundings of three by three cells, those that it doesn't know left out; beyond the unit square nothing lies."""
    width, r = float(FAN) ** -level, np.sqrt(r2) * (1 + 1e-9) + 1e-12
    good = np.ones(len(r), dtype=bool)
    for axis, c in enumerate((cx, cy)):
        if c > 1:
            good &= centre[:, axis] - r >= (c - 1) * width
        if c + 2 < FAN**level:
            good &= centre[:, axis] + r <= (c + 2) * width
    for ux, uy in unknown:
        low = np.array([ux, uy]) * width
        away = np.maximum(np.maximum(low - centre, centre - low - width), 0)
        # The last cell of a row also holds what lies on the square's far side.
        good &= (away**2).sum(axis=1) > r * r
    return good


def _star(rows: pd.DataFrame) -> pd.DataFrame:
    """Triangles around a leaf's own places whose circles hold no place: each place's neighbours in turn, from its nearest one both ways round."""
    level, cx, cy = (int(rows[c].iloc[0]) for c in ("k", "lx", "ly"))
    unknown = [(int(a), int(b)) for a, b in rows.loc[rows["id"].isna(), ["cx", "cy"]].to_numpy()]
    rows = rows[rows["id"].notna()].sort_values("id")
    ids, all_ = rows["id"].to_numpy("int64"), rows[["u", "v"]].to_numpy("float64")
    own = np.flatnonzero((rows["cx"] == cx) & (rows["cy"] == cy))
    out: list[np.ndarray] = []
    if len(ids) >= 3:
        p = all_[own]
        d2 = ((p[:, None] - all_[None]) ** 2).sum(axis=2)
        d2[np.arange(len(own)), own] = np.inf
        start = d2.argmin(axis=1)
        closed = np.zeros(len(own), dtype=bool)
        for turn in (1, -1):
            q, alive = start.copy(), ~closed
            for _ in range(len(ids)):
                if not alive.any():
                    break
                go = np.flatnonzero(alive)
                r, centre, r2 = _next(p[go], all_[q[go]], all_, np.ones(len(go), dtype=bool), turn)
                good = (r >= 0) & _inside(centre, r2, level, cx, cy, unknown)
                tri = np.stack([own[go], q[go], r] if turn == 1 else [own[go], r, q[go]], axis=1)[good]
                out.append(ids[tri])
                alive[go] = r >= 0
                q[go] = np.where(r >= 0, r, q[go])
                back = go[(r >= 0) & (r == start[go])]
                alive[back], closed[back] = False, True
    tri = np.concatenate(out) if out else np.empty((0, 3), dtype="int64")
    return pd.DataFrame(tri, columns=["a", "b", "c"])


def _turned(t: DataFrame) -> DataFrame:
    """``a, b, c`` counter-clockwise from the least id, each triangle once."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    s = F.when((a < b) & (a < c), F.struct(a, b, c)).when((b < a) & (b < c), F.struct(b.alias("a"), c.alias("b"), a.alias("c"))).otherwise(F.struct(c.alias("a"), a.alias("b"), b.alias("c")))
    return t.select(s.alias("s")).select("s.*").distinct()


def _edges(t: DataFrame) -> DataFrame:
    return t.select(F.inline(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])))


def _corners(t: DataFrame) -> DataFrame:
    """``id`` of the corners of triangles, or the ends of edges."""
    return t.select(F.explode(F.array(*t.columns)).alias("id")).distinct()


def _circle(u: Column, v: Column) -> Column:
    """Of a place at the left of an edge (``au, av, bu, bv``): how far along its normal the centre of the circle lies."""
    du, dv = F.col("bu") - F.col("au"), F.col("bv") - F.col("av")
    eu, ev = u - (F.col("au") + F.col("bu")) / 2, v - (F.col("av") + F.col("bv")) / 2
    side, long2, away = du * ev - dv * eu, du * du + dv * dv, eu * eu + ev * ev
    return F.when(side > SAME * F.sqrt(F.greatest(long2, away + long2 / 4 + F.abs(du * eu + dv * ev))), (away - long2 / 4) / (2 * side))


def _reaches(t: Column) -> Column:
    """Whether a box (``u0, u1, v0, v1``) has places at the left of the edge within its circle ``t`` (any circle where that is null)."""
    du, dv = F.col("bu") - F.col("au"), F.col("bv") - F.col("av")
    long2 = du * du + dv * dv
    furthest, least = F.lit(0.0), -long2 / 4
    for n, low, high, m in ((-dv, "u0", "u1", (F.col("au") + F.col("bu")) / 2), (du, "v0", "v1", (F.col("av") + F.col("bv")) / 2)):
        a, b = F.col(low) - m, F.col(high) - m
        furthest = furthest + F.greatest(n * a, n * b)
        x = F.least(F.greatest(t * n, a), b)
        least = least + x * x - 2 * t * n * x
    return (furthest > SAME * F.sqrt(long2)) & (t.isNull() | (least <= 1e-9 * (long2 + F.abs(t) * furthest)))


def _third(open_: DataFrame, cells: DataFrame, leaves: DataFrame, places: DataFrame, deepest: int) -> DataFrame:
    """``a, b, c``: for edges ``a, b`` (a counter-clockwise triangle's) the place that closes the triangle at their left; null along the hull.

    Cells that the best circle so far reaches are followed from the coarsest level down; a cell's one known place bounds the circle.
    """
    end = lambda n: places.select(F.col("id").alias(n), F.col("u").alias(f"{n}u"), F.col("v").alias(f"{n}v"))
    edges = open_.join(end("a"), "a").join(end("b"), "b")
    names = ["a", "b", "au", "av", "bu", "bv"]
    pairs, held = edges.withColumns({"ax": F.lit(0).cast("long"), "ay": F.lit(0).cast("long"), "best": F.lit(None).cast("double")}), None
    for k in range(deepest + 1):
        level = cells.where(F.col("k") == k).select("ax", "ay", "cx", "cy", "u0", "u1", "v0", "v1", "one", "split")
        met = pairs.join(level, ["ax", "ay"])
        met = met.withColumn("t", _circle(F.col("one.u"), F.col("one.v"))).where(_reaches(F.col("best")))
        bound = F.min(F.least("best", "t")).over(Window.partitionBy("a", "b"))
        met = checkpointed(met.withColumn("best", bound).where(_reaches(F.col("best"))))
        leaf = met.where("NOT split").select(*names, F.lit(k).alias("k"), F.col("cx").alias("lx"), F.col("cy").alias("ly"))
        held = leaf if held is None else held.unionByName(leaf)
        pairs = met.where("split").select(*names, F.col("cx").alias("ax"), F.col("cy").alias("ay"), "best")
    t = _circle(F.col("u"), F.col("v"))
    near = held.join(leaves, ["k", "lx", "ly"]).where("id != a AND id != b").select("a", "b", "id", t.alias("t")).where("t IS NOT NULL")
    return open_.join(near.groupBy("a", "b").agg(F.min(F.struct("t", "id")).alias("s")), ["a", "b"], "left").select("a", "b", F.col("s.id").alias("c"))


def _boxed(xy: np.ndarray) -> list[np.ndarray]:
    """Places halved along their longest side until ``BOX`` are left."""
    out, todo = [], [np.arange(len(xy))]
    while todo:
        some = todo.pop()
        if len(some) <= BOX:
            out.append(some)
            continue
        axis, half = int(np.ptp(xy[some], axis=0).argmax()), len(some) // 2
        some = some[np.argpartition(xy[some, axis], half)]
        todo += [some[half:], some[:half]]
    return out


class _Front:
    """Places of a front in boxes, in the order of their ids."""

    def __init__(self, xy: np.ndarray):
        self.xy, boxes = xy, _boxed(xy)
        self.members = np.stack([np.resize(b, BOX) for b in boxes])  # a box's places, some twice
        at = xy[self.members]
        self.low, self.high, self.one = at.min(axis=1), at.max(axis=1), self.members[:, 0]

    def _met(self, p: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How far along the normals of edges p -> q the circles' centres lie for places c (broadcast against the edges); infinite where they are not at the left."""
        d = self.xy[q] - self.xy[p]
        e = self.xy[c] - (self.xy[p] + self.xy[q]) / 2
        side, long2, away = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0], (d * d).sum(axis=-1), (e * e).sum(axis=-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(side > SAME * np.sqrt(np.maximum(long2, away + long2 / 4 + np.abs((d * e).sum(axis=-1)))), (away - long2 / 4) / (2 * side), np.inf)

    def third(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each edge the place at its left with the first circle, -1 without one."""
        step = max(PAIRS // len(self.one), 1)
        return np.concatenate([self._third(p[k : k + step], q[k : k + step]) for k in range(0, len(p), step)])

    def _third(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        t = self._met(p[:, None], q[:, None], self.one[None]).min(axis=1)  # bounds the circle; see ``_reaches``
        d, middle = self.xy[q] - self.xy[p], (self.xy[p] + self.xy[q]) / 2
        n, long2, some = np.stack([-d[:, 1], d[:, 0]], axis=1), (d * d).sum(axis=1), np.isfinite(t)
        centre, furthest, least = np.where(some, t, 0.0)[:, None] * n, 0.0, -long2[:, None] / 4
        for axis in (0, 1):
            a, b = self.low[None, :, axis] - middle[:, None, axis], self.high[None, :, axis] - middle[:, None, axis]
            furthest = furthest + np.maximum(n[:, None, axis] * a, n[:, None, axis] * b)
            x = np.minimum(np.maximum(centre[:, None, axis], a), b)
            least = least + x * x - 2 * centre[:, None, axis] * x
        far = np.where(some, np.abs(t), 0.0)[:, None]
        edge, box = np.nonzero((furthest > SAME * np.sqrt(long2)[:, None]) & (~some[:, None] | (least <= 1e-9 * (long2[:, None] + far * furthest))))
        best, out = np.full(len(p), np.inf), np.full(len(p), len(self.xy))
        for k in range(0, len(edge), max(PAIRS // BOX, 1)):
            e, c = edge[k : k + PAIRS // BOX], self.members[box[k : k + PAIRS // BOX]]
            t = self._met(p[e][:, None], q[e][:, None], c)
            t[(c == p[e][:, None]) | (c == q[e][:, None])] = np.inf
            least = t.min(axis=1)
            c = np.where(t == least[:, None], c, len(self.xy)).min(axis=1)  # of equal circles the least id
            order = np.lexsort((c, least, e))
            e, least, c = e[order], least[order], c[order]
            first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            e, least, c = e[first], least[first], c[first]
            better = (least < best[e]) | ((least == best[e]) & np.isfinite(least) & (c < out[e]))
            best[e[better]], out[e[better]] = least[better], c[better]
        return np.where(np.isfinite(best), out, -1)


def _closed(most_rounds: int):
    def run(front: pd.DataFrame, open_: pd.DataFrame) -> pd.DataFrame:
        """All triangles behind the open edges ``a, b`` of a front (``id, u, v``), round by round."""
        front = front.sort_values("id")
        ids, out = front["id"].to_numpy("int64"), [np.empty((0, 3), dtype="int64")]
        n, f = len(ids), _Front(front[["u", "v"]].to_numpy("float64")) if len(ids) else None
        a, b = (np.searchsorted(ids, open_[c].to_numpy("int64")) for c in "ab")
        for _ in range(most_rounds):
            if not len(a):
                tri = ids[np.concatenate(out)]
                return pd.DataFrame(tri, columns=["a", "b", "c"])
            c = f.third(a, b)
            tri = np.stack([a, b, c], axis=1)[c >= 0]
            turn = tri.argmin(axis=1)[:, None]
            tri = np.unique(np.take_along_axis(tri, (turn + np.arange(3)) % 3, axis=1), axis=0)
            out.append(tri)
            # As between rounds over tables: an edge of a new triangle is open on its other side unless it was open itself or that side is new too.
            edges = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
            key = edges[:, 0] * n + edges[:, 1]
            edges = edges[~np.isin(key, a * n + b)]
            edges = edges[~np.isin(edges[:, 1] * n + edges[:, 0], key)]
            a, b = edges[:, 1], edges[:, 0]
        raise RuntimeError(f"open edges are left after {most_rounds} rounds")

    return run


def delaunay(points: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``a, b, c``: Delaunay triangles of ``points`` (``point_id, px, py, value``) by point_id, counter-clockwise, the least first.

    Points at one place (within 1e-8 of the extent) are one, under the least point_id; null, NaN and infinite coordinates are left out; fewer than three
    places, or all on a line, have no triangles. Of corners on one circle every choice of diagonals is right; one is made, the same
    in every run. Corners within 1e-8 of the extent of a line make no triangle.

    A leaf of the hierarchy holds 64 places at most and sees 3 x 3 cells of its size with 64 at most each, so a task's group is bounded however uneven
    the places are. A place whose triangles are all found has no part in others, so only the front is looked at from then on. One task closes the edges of
    a front of ``FRONT`` places; those of a larger one meet boxes of cells, level by level, a round closes all of them at once, and rounds
    go as deep as triangles lie behind one another from the first ones, until the front is small.
    """
    places = checkpointed(_places(points))
    at, cells = _cells(places)
    leaf = cells.where("NOT split").select("k", F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    deepest = cells.agg(F.max("k")).first()[0] or 0
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    seen = leaf.select("k", "lx", "ly", F.inline(around)).select("k", "lx", "ly", (F.col("lx") + F.col("i")).alias("cx"), (F.col("ly") + F.col("j")).alias("cy"))
    full = cells.where("split").select("k", "cx", "cy")
    unknown = seen.join(full, ["k", "cx", "cy"]).select("k", "lx", "ly", "cx", "cy", F.lit(None).cast("long").alias("id"), *[F.lit(None).cast("double").alias(c) for c in ("u", "v")])
    member = seen.join(full, ["k", "cx", "cy"], "left_anti").join(at.where(F.col("k") <= deepest), ["k", "cx", "cy"]).select("k", "lx", "ly", "cx", "cy", "id", "u", "v")
    found = checkpointed(_turned(member.unionByName(unknown).groupBy("k", "lx", "ly").applyInPandas(_star, "a long, b long, c long")))
    if found.isEmpty():
        first = places.agg(F.min(F.struct("id", "u", "v")).alias("s")).select("s.*")
        away = F.pow(F.col("u") - F.col("fu"), F.lit(2.0)) + F.pow(F.col("v") - F.col("fv"), F.lit(2.0))
        both = places.crossJoin(F.broadcast(first.select(F.col("id").alias("f"), F.col("u").alias("fu"), F.col("v").alias("fv"))))  # one row
        pair = both.where("id != f").agg(F.min(F.struct(away.alias("d"), "f", "id")).alias("s")).where("s IS NOT NULL").select(F.col("s.f").alias("a"), F.col("s.id").alias("b"))
        open_ = checkpointed(pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    else:
        edges = _edges(found)
        open_ = checkpointed(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(edges, ["a", "b"], "left_anti"))
    lone = checkpointed(places.join(_corners(found), "id", "left_anti").select("id", "u", "v"))
    front = places.select("id", "u", "v")
    for turn in range(most_rounds):
        if open_.isEmpty():
            return found
        front = checkpointed(front.join(_corners(open_), "id", "left_semi").unionByName(lone).distinct())
        if front.count() <= FRONT:
            both = [t.withColumn("all", F.lit(0)).groupBy("all") for t in (front, open_)]
            return checkpointed(found.unionByName(both[0].cogroup(both[1]).applyInPandas(_closed(most_rounds), "a long, b long, c long")))
        at, cells = _cells(front)
        leaf = cells.where("NOT split").select("k", F.col("cx").alias("lx"), F.col("cy").alias("ly"))
        leaves = checkpointed(at.withColumnsRenamed({"cx": "lx", "cy": "ly"}).join(leaf, ["k", "lx", "ly"]).select("k", "lx", "ly", "id", "u", "v"))
        new = checkpointed(_turned(_third(open_, cells, leaves, front, cells.agg(F.max("k")).first()[0]).where("c IS NOT NULL")))
        # A new triangle has an open edge, so none before is the same; and an edge whose other side was found before is open itself. All triangles
        # so far are therefore not looked at again: a round's work is that of its open edges.
        found = found.unionByName(new) if turn % 50 < 49 else checkpointed(found.unionByName(new))
        lone = checkpointed(lone.join(_corners(new), "id", "left_anti"))
        edges = _edges(new)
        back = edges.join(open_, ["a", "b"], "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b"))
        open_ = checkpointed(back.join(edges, ["a", "b"], "left_anti"))
    raise RuntimeError(f"open edges are left after {most_rounds} rounds")


def resampled_linear(points: DataFrame, low: tuple[float, float], high: tuple[float, float], shape: tuple[int, int]) -> DataFrame:
    """``x, y, value``: ``points`` (``point_id, px, py, value``) interpolated linearly over their Delaunay triangles at ``shape`` places from ``low`` to
    ``high``, ends included; null outside their hull and where a corner's value is null. Points at one place count with their mean.

    A triangle gives the pixels that it covers, row by row: rows from its height, pixels from where its sides meet the row. So no triangle, however long, is
    compared with a pixel outside it. On common sides the triangle with the least ids counts.
    """
    spark = points.sparkSession
    places = checkpointed(_places(points))
    t = delaunay(places.select(F.col("id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"), "value"))
    for n in "abc":
        t = t.join(places.select(F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"), F.col("value").alias(f"{n}z")), n)
    cell = [(h - a) / max(m - 1, 1) for a, h, m in zip(low, high, shape, strict=True)]
    if min(cell) <= 0:
        raise ValueError("high must lie above low")
    area = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    t = t.withColumn("area", area).where("area > 0")

    def steps(least: Column, most: Column, axis: int) -> Column:
        first = F.greatest(F.ceil((least - low[axis]) / cell[axis] - 1e-9), F.lit(0))
        last = F.least(F.floor((most - low[axis]) / cell[axis] + 1e-9), F.lit(shape[axis] - 1))
        return F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))))

    rows = t.withColumn("y", steps(F.least("ay", "by", "cy"), F.greatest("ay", "by", "cy"), 1)).withColumn("gy", low[1] + F.col("y") * cell[1])
    least, most = [], []
    for p, q in ("ab", "bc", "ca"):
        rise = F.col(f"{q}y") - F.col(f"{p}y")
        at = F.col(f"{p}x") + (F.col("gy") - F.col(f"{p}y")) / F.nullif(rise, F.lit(0.0)) * (F.col(f"{q}x") - F.col(f"{p}x"))
        on = F.when((F.col("gy") >= F.least(f"{p}y", f"{q}y") - 1e-9 * cell[1]) & (F.col("gy") <= F.greatest(f"{p}y", f"{q}y") + 1e-9 * cell[1]), True)
        level = rise == 0
        least.append(F.when(on, F.when(level, F.least(f"{p}x", f"{q}x")).otherwise(at)))
        most.append(F.when(on, F.when(level, F.greatest(f"{p}x", f"{q}x")).otherwise(at)))
    pixels = rows.withColumn("x", steps(F.least(*least), F.greatest(*most), 0)).withColumn("gx", low[0] + F.col("x") * cell[0])

    def share(p: str, q: str) -> Column:
        return ((F.col(f"{q}x") - F.col(f"{p}x")) * (F.col("gy") - F.col(f"{p}y")) - (F.col("gx") - F.col(f"{p}x")) * (F.col(f"{q}y") - F.col(f"{p}y"))) / F.col("area")

    value = share("b", "c") * F.col("az") + share("c", "a") * F.col("bz") + share("a", "b") * F.col("cz")
    best = pixels.groupBy("x", "y").agg(F.min_by(value, F.struct("a", "b", "c")).alias("value"))
    every = spark.range(shape[0] * shape[1]).select((F.col("id") % shape[0]).cast("int").alias("x"), F.floor(F.col("id") / shape[0]).cast("int").alias("y"))
    return every.join(best, ["x", "y"], "left")
