"""Point location, observation weights and nearest neighbours as joins on grid bins."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import SimplexMap
from gridloom.functions.vectors import parts, total
from gridloom.operators.cut_lineage import checkpointed
from gridloom.operators.topology import with_vertices


def _bins(low: list[Column], high: list[Column], width: float) -> Column:
    """Arrays of bin numbers of a box: every bin that it touches."""
    out = F.array(F.array().cast("array<long>"))
    for a, b in zip(low, high, strict=True):
        out = _appended(out, F.sequence(F.floor(a / width), F.floor(b / width)))
    return out


def _appended(heads: Column, steps: Column) -> Column:
    """Every head with every step at its end."""
    return F.flatten(F.transform(heads, lambda head: F.transform(steps, lambda k: F.concat(head, F.array(k)))))


def _listed(nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, width: float, plain: bool) -> DataFrame:
    """``simplex_id, v``, what weights are made of, and ``bins``: all that a simplex's bounding box touches."""
    s, p = with_vertices(simplices, nodes, vertices, d)
    margin = width * 1e-9 if plain else width / 2
    low = [F.least(*[q[i] for q in p]) - margin for i in range(d)]
    high = [F.greatest(*[q[i] for q in p]) + margin for i in range(d)]
    if not plain:
        return s.select("simplex_id", "v", "p", _bins(low, high, width).alias("bins"))
    # The weights are affine in the point: their gradients are computed once for each simplex, before the join.
    gradients = F.array(*[F.array(*g) for g in SimplexMap(p).gradients()])
    return s.select("simplex_id", "v", "p", F.get("p", 0).alias("o"), gradients.alias("g"), _bins(low, high, width).alias("bins"))


def _weights(x: list[Column], of: Callable[[str], Column], vertices: int, d: int, off: float | None, centre: list[float] | None) -> tuple[list[Column], Column | None]:
    """(barycentric weights of a point, its distance from the plane where that is tested) for the simplex whose columns ``of`` gives."""
    if off is None and centre is None:
        step = [a - b for a, b in zip(x, parts(of("o"), d), strict=True)]
        return [sum((F.get(F.get(of("g"), k), i) * step[i] for i in range(d)), F.lit(1.0 if k == 0 else 0.0)) for k in range(vertices)], None
    simplex = SimplexMap([[F.get(F.get(of("p"), k), i) for i in range(d)] for k in range(vertices)])
    at = simplex.on_line_from([F.lit(c) for c in centre], x) if centre else x
    return simplex.barycentric(at), simplex.off(x) if off is not None and not centre else None


def _held(w: list[Column], away: Column | None, slack: float, off: float | None) -> Column:
    out = w[0] >= -slack
    for c in w[1:]:
        out = out & (c >= -slack)
    return out if away is None else out & (away <= off)


def _whole(d: int) -> Column:
    return F.expr(" AND ".join(f"get(x, {i}) IS NOT NULL" for i in range(d)))


def containing(points: DataFrame, nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, width: float, slack: float = 1e-12, off: float | None = None, centre: list[float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``point_id, simplex_id, v, w``, and columns ``keep`` of the points: every simplex that holds a point (``point_id, x``), with barycentric weights in the order of ``v``.

    A simplex is listed in all bins of ``width`` that its bounding box touches, a point in its own, so the join is an equi-join; weights of
    -``slack`` or more count as inside. On a surface (fewer dimensions than the space) a point may be ``off`` the plane; with
    ``centre`` (the centre of curvature) it is first moved along the line to the centre onto the plane, and off is not tested. Bins should
    be about as wide as a simplex. Points with null coordinates are in none.
    """
    s = _listed(nodes, simplices, vertices, d, width, off is None and centre is None)
    s = s.select(*[c for c in s.columns if c not in ("bins", "p") or (c == "p" and "g" not in s.columns)], F.explode("bins").alias("bin"))
    x = parts(F.col("x"), d)
    own = points.where(_whole(d)).select("point_id", "x", F.array(*[F.floor(c / width) for c in x]).alias("bin"), *[c for c in keep if c != "x"])
    w, away = _weights(x, F.col, vertices, d, off, centre)
    named = [F.col(f"w{k}") for k in range(vertices)]
    met = own.join(s, "bin").select("point_id", "simplex_id", "v", *keep, *[c.alias(f"w{k}") for k, c in enumerate(w)], (F.lit(0.0) if away is None else away).alias("away"))
    return met.where(_held(named, None if away is None else F.col("away"), slack, off)).select("point_id", "simplex_id", "v", F.array(*named).alias("w"), *keep)


#: Simplices of a mesh whose bins are broadcast.
SMALL = 4096


def located(points: DataFrame, nodes: DataFrame, simplices: DataFrame, vertices: int, d: int, width: float, slack: float = 1e-12, off: float | None = None, centre: list[float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``point_id, simplex_id, v, w`` with the least simplex that holds each point, and columns ``keep`` of the points; null for points in none (see ``containing``).

    All simplices that can hold a point are in the list of its bin, least first, so that a point is sent once at most, to its bin, and not
    at all where the mesh is small. Bins are named by a hash: where two have one name, their list is that of both.
    """
    plain = off is None and centre is None
    s = checkpointed(_listed(nodes, simplices, vertices, d, width, plain))
    g = [[f"g{k}_{i}" for i in range(d)] for k in range(vertices)]
    if plain:  # single numbers, and the bounding box first: what is done for each simplex of a list is not compiled
        ends = [(F.least(*c), F.greatest(*c)) for c in ([F.get(F.get("p", k), i) for k in range(vertices)] for i in range(d))]
        margin = [width * 1e-9 + slack * vertices * (high - low) for low, high in ends]  # as far out as weights of -slack reach
        flat = {f"o{i}": F.get("o", i) for i in range(d)} | {g[k][i]: F.get(F.get("g", k), i) for k in range(vertices) for i in range(d)}
        flat |= {f"low{i}": ends[i][0] - margin[i] for i in range(d)} | {f"high{i}": ends[i][1] + margin[i] for i in range(d)}
        s = s.select("simplex_id", "v", *[c.alias(n) for n, c in flat.items()], "bins")
    entry = F.struct(*[c for c in s.columns if c != "bins"])
    lists = s.select(entry.alias("s"), F.explode("bins").alias("bin")).groupBy(F.xxhash64("bin").alias("bin")).agg(F.array_sort(F.collect_list("s")).alias("list"))
    lists = F.broadcast(lists) if s.count() <= SMALL else lists
    x = parts(F.col("x"), d)
    bin_ = F.when(_whole(d), F.xxhash64(F.array(*[F.floor(c / width) for c in x])))
    at = [f"x{i}" for i in range(d)]
    own = points.select("point_id", "x", bin_.alias("bin"), *[c.alias(n) for c, n in zip(x, at, strict=True)], *[c for c in keep if c != "x"])

    def weights(of: Callable[[str], Column]) -> tuple[list[Column], Column | None]:
        if not plain:
            return _weights([F.col(n) for n in at], of, vertices, d, off, centre)
        step = [F.col(n) - of(f"o{i}") for i, n in enumerate(at)]
        return [sum((of(g[k][i]) * step[i] for i in range(1, d)), of(g[k][0]) * step[0] + F.lit(1.0 if k == 0 else 0.0)) for k in range(vertices)], None

    first = F.col("list")
    if plain:
        first = F.filter(first, lambda t: reduce(operator.and_, [(F.col(n) >= t[f"low{i}"]) & (F.col(n) <= t[f"high{i}"]) for i, n in enumerate(at)]))
    first = F.get(F.filter(first, lambda t: _held(*weights(lambda c: t[c]), slack, off)), F.lit(0))
    met = own.join(lists, "bin", "left").select("point_id", "x", *at, *[c for c in keep if c != "x"], first.alias("s"))
    w = F.when(F.col("s").isNotNull(), F.array(*weights(lambda c: F.col(f"s.{c}"))[0]))
    return met.select("point_id", "s.simplex_id", "s.v", w.alias("w"), *keep)


def observation_weights(points: DataFrame, *args, **kwargs) -> DataFrame:
    """``point_id, node_id, w``: barycentric weights of each point's simplex, without zeros; one row with nulls for points in none."""
    at = located(points, *args, **kwargs)
    each = at.select("point_id", F.explode_outer(F.arrays_zip(F.col("v").alias("node_id"), F.col("w").alias("w"))).alias("e")).select("point_id", F.col("e.node_id").alias("node_id"), F.col("e.w").alias("w"))
    return each.where("w IS NULL OR w != 0")


def squared_distance(a: Column, b: Column, d: int) -> Column:
    return sum((F.pow(x - y, F.lit(2.0)) for x, y in zip(parts(a, d), parts(b, d), strict=True)), F.lit(0.0))


#: Bins of a level make one of the next; sites of a list that one point is compared with in a row; sites of a bin on average, and how often bins are halved for that;
#: sites that are few enough for a bin of points not to be parted; sites in all lists together that are broadcast; pairs of bins of the level to begin with.
FAN, LIST, FULL, HALVINGS, FEW, SENT, BEGIN = 4, 256, 8, 16, 32, 2**18, 2**16

#: Least and largest coordinates.
Box = tuple[list[Column], list[Column]]


def _ends(name: str, d: int) -> list[str]:
    """Columns of a box, the low ends first."""
    return [f"{name}_{end}{i}" for end in ("low", "high") for i in range(d)]


def _box(name: str, d: int, of: Callable[[str], Column] = F.col) -> Box:
    names = _ends(name, d)
    return [of(n) for n in names[:d]], [of(n) for n in names[d:]]


def _up(k: int) -> Column:
    """The bin of level ``k`` that holds a bin."""
    return F.transform("bin", lambda b: F.floor(b / float(FAN**k)))


def _farthest(p: Box, s: Box) -> Column:
    """Largest squared distance between points of two boxes."""
    return total([F.pow(F.greatest(p1 - s0, s1 - p0), F.lit(2.0)) for p0, p1, s0, s1 in zip(*p, *s, strict=True)])


def _farther(p: Box, a: Box, b: Box) -> Column:
    """Whether every point of ``p`` has all of ``b`` farther away than all of ``a``, by more than rounding can change.

    The squared distances' difference is a sum of one term for each coordinate, so that its largest value over ``p`` is the sum of the terms'; a term is convex
    between the ends of ``b`` (everywhere, where ``b`` is one point), and so is largest at those or at the ends of ``p``.
    """

    def most(p0: Column, p1: Column, a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
        far = lambda x: F.pow(F.greatest(x - a0, a1 - x), F.lit(2.0))
        if b[0] is b[1]:
            return F.greatest(*[far(x) - F.pow(x - b0, F.lit(2.0)) for x in (p0, p1)])
        ends = [far(x) - F.pow(F.greatest(b0 - x, x - b1, F.lit(0.0)), F.lit(2.0)) for x in (p0, p1)]
        return F.greatest(*ends, *[F.when((x >= p0) & (x <= p1), far(x)) for x in (b0, b1)])

    return total([most(*ends) for ends in zip(*p, *a, *b, strict=True)]) < -1e-12 * _farthest(p, a)


def _boxed(t: DataFrame, x: list[Column], width: float) -> DataFrame:
    """``bin``, its ends (``own_low0``, ...) and ``n`` of each occupied bin: the ends and the number of what it holds."""
    b, ends = [f"b{i}" for i in range(len(x))], _ends("own", len(x))
    found = [f(c) for f in (F.min, F.max) for c in x]
    out = t.groupBy(*[F.floor(c / width).alias(n) for c, n in zip(x, b, strict=True)]).agg(*[c.alias(n) for c, n in zip(found, ends, strict=True)], F.count("*").alias("n"))
    return out.select(F.array(*b).alias("bin"), *ends, "n")


def _levels(p0: DataFrame, s0: DataFrame, d: int) -> int:
    """The finest level whose bins make ``BEGIN`` pairs at most, or the first one with two bins at most in each direction."""
    bins = p0.select("bin", F.lit(0).alias("of")).unionByName(s0.select("bin", F.lit(1).alias("of")))
    ends = bins.agg(*[(F.max(F.get("bin", i)) - F.min(F.get("bin", i))).alias(f"e{i}") for i in range(d)]).first()
    extent, most = max([e or 0 for e in ends]), 0
    while FAN**most <= extent:
        most += 1
    n = [r[1:] for r in bins.groupBy("of").agg(*[F.approx_count_distinct(_up(k)).alias(f"k{k}") for k in range(most)]).collect()]
    return next((k for k in range(most) if prod(c[k] for c in n) <= BEGIN), most)


def _in_reach(p0: DataFrame, s0: DataFrame, d: int, levels: int) -> DataFrame:
    """``at, p``, its ends (``p_low0``, ...) and ``s``: bins ``p`` of level ``at`` that part the points' bins ``p0``, and for each the bins of ``s0`` that can hold the nearest site of a point in it.

    From level ``levels``, where all bins meet, down: bins of sites are parted, then bins of points, and a pair is left out where the bin's sites are all
    farther from each of the points than those of the bin with the smallest largest distance. A bin of points that has ``FEW`` sites left is not parted any more,
    so that points far from all sites don't have lists of their own.
    """

    def level(bins: DataFrame, k: int, name: str, above: str) -> DataFrame:
        ends = [f(c).alias(n) for f, c, n in zip([F.min] * d + [F.max] * d, _ends("own", d), _ends(name, d), strict=True)]
        return bins.groupBy(_up(k).alias(name), _up(k + 1).alias(above)).agg(*ends, F.sum("n").alias(f"{name}_n"))

    own, p_ends, s_ends = Window.partitionBy("at", "p"), _ends("p", d), _ends("s", d)

    def kept(pairs: DataFrame) -> DataFrame:
        p, s = _box("p", d), _box("s", d)
        pairs = pairs.withColumn("a", F.min(F.struct(_farthest(p, s).alias("d2"), *s_ends)).over(own))
        return pairs.where(~_farther(p, _box("s", d, lambda n: F.col(f"a.{n}")), s)).drop("a")

    top = level(p0, levels, "p", "_").select(F.lit(levels).alias("at"), "p", *p_ends)
    pairs = kept(top.crossJoin(F.broadcast(level(s0, levels, "s", "_")))).select("at", "p", *p_ends, "s")
    for k in range(levels - 1, -1, -1):
        pairs = kept(pairs.withColumnRenamed("s", "sa").join(level(s0, k, "s", "sa"), "sa").drop("sa"))
        parted = level(p0, k, "child", "pa").select(F.lit(k + 1).alias("of"), "pa", "child", *_ends("child", d))
        met = pairs.withColumn("few", F.sum("s_n").over(own) <= FEW).join(parted, (F.col("at") == F.col("of")) & (F.col("p") == F.col("pa")) & ~F.col("few"), "left")
        child = [F.coalesce(c, n).alias(n) for c, n in zip(["child", *_ends("child", d)], ["p", *p_ends], strict=True)]
        pairs = kept(met.select(F.when(F.col("child").isNull(), F.col("at")).otherwise(F.lit(k)).alias("at"), *child, "s", *s_ends)).select("at", "p", *p_ends, "s")
    return pairs


def nearest(points: DataFrame, sites: DataFrame, d: int, width: float) -> DataFrame:
    """``point_id, site_id, distance``: each point's nearest site (least site_id on ties); without sites no rows.

    Work on pairs is done for occupied bins of ``width``, not for points: which bins of sites can hold the nearest one of some point in a bin is found level by
    level (see ``_in_reach``), then which of their sites can be it. Points then meet their bin's sites, a handful as a rule, by one equi-join, in lists of about ``LIST`` sites at most
    (bins are named by a hash: where two have one name, their points meet the lists of both), and
    only best ones are combined. Sites at one place are one site. ``width`` should be about the distance between sites; it is halved until bins that hold
    sites have ``FULL`` on average, so that what a point is compared with doesn't grow with the sites. Points and sites with a null or NaN coordinate are left out.
    """
    x = parts(F.col("x"), d)
    whole = " AND ".join(f"get(x, {i}) IS NOT NULL AND NOT isnan(get(x, {i}))" for i in range(d))
    points, sites = points.where(whole), sites.where(whole)
    places = sites.select("x").distinct()
    held = [F.approx_count_distinct(F.array(*[F.floor(c / (width / 2**k)) for c in x])).alias(f"k{k}") for k in range(HALVINGS + 1)]
    n, *occupied = places.agg(F.count("*"), *held).first()
    width = width / 2 ** next((k for k, bins in enumerate(occupied) if n <= FULL * bins), HALVINGS)
    bins = [F.floor(c / width) for c in x]
    ys = [f"y{i}" for i in range(d)]
    merged = sites.groupBy("x").agg(F.min("site_id").alias("site_id")).select("site_id", *[c.alias(n) for c, n in zip(x, ys, strict=True)], F.array(*bins).alias("s"))
    p0, s0 = checkpointed(_boxed(points, x, width)), checkpointed(_boxed(places, x, width))
    reach = checkpointed(_in_reach(p0, s0, d, _levels(p0, s0, d)))

    def site(of: Callable[[str], Column]) -> Box:
        y = [of(n) for n in ys]
        return y, y

    own, p = Window.partitionBy("at", "p"), _box("p", d)
    found = reach.join(merged, "s").withColumn("a", F.min(F.struct(_farthest(p, site(F.col)).alias("d2"), *ys)).over(own)).where(~_farther(p, site(lambda n: F.col(f"a.{n}")), site(F.col)))
    lists = found.withColumn("list", F.pmod(F.xxhash64("site_id"), F.ceil(F.count("*").over(own) / LIST))).groupBy("at", "p", "list").agg(F.collect_list(F.struct("site_id", *ys)).alias("sites"))
    # Bins below the one that has the list: what none of their own points can have as its nearest goes.
    ats = [r["at"] for r in reach.select("at").distinct().collect()]
    levels_of = F.explode(F.array(*[F.struct(F.lit(k).alias("at"), _up(k).alias("p")) for k in ats or [0]])).alias("of")
    p = _box("own", d)
    each = p0.select("bin", *_ends("own", d), levels_of).select("bin", *_ends("own", d), "of.at", "of.p").join(lists, ["at", "p"])
    each = each.withColumn("a", F.array_min(F.transform("sites", lambda s: F.struct(_farthest(p, site(lambda n: s[n])).alias("d2"), *[s[n].alias(n) for n in ys]))))
    left = F.filter("sites", lambda s: ~_farther(p, site(lambda n: F.col(f"a.{n}")), site(lambda n: s[n])))
    near = checkpointed(each.select(F.xxhash64(*parts(F.col("bin"), d)).alias("bin"), "list", F.when(F.col("at") == 0, F.col("sites")).otherwise(left).alias("sites")))
    entries, most = near.agg(F.sum(F.size("sites")), F.max("list")).first()
    at = [f"x{i}" for i in range(d)]
    best = F.array_min(F.transform("sites", lambda s: F.struct(total([F.pow(F.col(n) - s[m], F.lit(2.0)) for n, m in zip(at, ys, strict=True)]).alias("d2"), s["site_id"].alias("site_id"))))
    met = points.select("point_id", *[c.alias(n) for c, n in zip(x, at, strict=True)], F.xxhash64(*bins).alias("bin"))
    met = met.join(near.hint("broadcast" if (entries or 0) <= SENT else "shuffle_hash"), "bin").select("point_id", best.alias("best"))
    met = met if most else met.repartition("point_id")  # with one list for each point nothing is gained by combining before rows are sent
    return met.groupBy("point_id").agg(F.min("best").alias("best")).select("point_id", F.col("best.site_id").alias("site_id"), F.sqrt(F.col("best.d2")).alias("distance"))


def nearest_of_few(points: DataFrame, sites: DataFrame, distance, most: int = 10_000) -> DataFrame:
    """``point_id, site_id, distance`` for a bounded set of sites, by any distance of two columns ``x`` and ``y``: the sites are gathered into one
    array, whose size is checked, and each point takes its least over it. No row is made for a pair."""
    n = sites.count()
    if n > most:
        raise ValueError(f"{n} sites; at most {most}. Use nearest() instead")
    gathered = sites.agg(F.array_sort(F.collect_list(F.struct("site_id", F.col("x").alias("y")))).alias("sites"))
    best = F.array_min(F.transform("sites", lambda s: F.struct(distance(F.col("x"), s["y"]).alias("distance"), s["site_id"].alias("site_id"))))
    out = points.crossJoin(F.broadcast(gathered)).select("point_id", best.alias("best"))
    return out.select("point_id", "best.site_id", "best.distance")


def distances(a: DataFrame, b: DataFrame, distance, most: int = 10_000) -> DataFrame:
    """``a_id, b_id, distance``: the full matrix, asked for as such; the right side (``b_id, y``) must be a bounded set, which is checked."""
    n = b.count()
    if n > most:
        raise ValueError(f"{n} columns; at most {most}")
    return a.crossJoin(F.broadcast(b)).select("a_id", "b_id", distance(F.col("x"), F.col("y")).alias("distance"))


def area_shares(simplices: DataFrame, areas: DataFrame) -> DataFrame:
    """``node_id, simplex_id, w``: each simplex's part of the area at a node, for averages of simplex values at nodes."""
    each = simplices.select("simplex_id", F.explode("v").alias("node_id")).join(areas, "simplex_id")
    return each.select("node_id", "simplex_id", (F.col("area") / F.sum("area").over(Window.partitionBy("node_id"))).alias("w"))
