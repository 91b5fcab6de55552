"""Near-duplicate embeddings by product quantisation.

Unit vectors go to the inverted list of their nearest coarse centroid, and their residuals are coded by subspace. A query
visits the lists that can hold a neighbour. With radius r = sqrt(2 - 2 c) for cosine c, a neighbour y of x that is nearer to centroid b than to
x's own a satisfies |x - b|^2 - |x - a|^2 <= 2 (y - x)(a - b): at most 2 r |a - b|, and with y - x spread as the data are, below
``SIGMAS`` standard deviations of that, r |a - b| / sqrt(stable rank). The smaller of the two is the bound (for data of few dimensions
the first, which loses nothing).

Queries are moved once, to the region of their list (lists near each other make a region). A region's queries ask for the codes of the lists that they probe; distances from a query to the codes
come from one table for each subspace, and members within r of some query, give or take the code's own error, which is stored, are
survivors. Only their vectors are fetched, and compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.store import in_batches, saved

#: Vectors that an index is fitted on at most; queries in a part of a region, and members that a part meets at once; most lists of an index.
SAMPLE, PART, MEMBERS, LISTS = 20_000, 8192, 1 << 16, 1024
SUBSPACES, CODES, ROUNDS, SIGMAS = 16, 256, 8, 3.0


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean, rows of x by rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spread rows; empty clusters stay where they are."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([_distances(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and subspace codebooks of one dimension; fitted on unit vectors."""

    def __init__(self, x: np.ndarray, lists: int):
        self.coarse = _means(x, lists)
        self.between = np.sqrt(_distances(self.coarse, self.coarse))
        self.region = _distances(self.coarse, _means(self.coarse, int(np.ceil(np.sqrt(len(self.coarse)))))).argmin(1)
        rest = x - self.coarse[np.concatenate([_distances(x[i : i + 2048], self.coarse).argmin(1) for i in range(0, len(x), 2048)])]
        self.cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        self.books = [_means(np.ascontiguousarray(rest[:, a:b]), CODES) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        spread = np.linalg.eigvalsh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
        #: What part of the largest possible step towards another list a neighbour takes.
        self.reach = float(min(1.0, SIGMAS * np.sqrt(max(spread[-1], 0) / spread.sum()))) if spread.sum() > 1e-12 else 1.0

    def _subspaces(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False):
            yield x[:, a:b], book

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error) of each row."""
        near = _distances(x, self.coarse).argmin(1)
        rest = x - self.coarse[near]
        codes = np.stack([_distances(part, book).argmin(1) for part, book in self._subspaces(rest)], axis=1).astype(np.uint8)
        decoded = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return near, codes, np.sqrt(((rest - decoded) ** 2).sum(1))

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Rows by lists: can the list hold a neighbour."""
        d = _distances(x, self.coarse)
        near = d.argmin(1)
        return d - d[np.arange(len(x)), near][:, None] <= 2 * self.reach * radius * self.between[near] + 1e-9

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """For each subspace, products of its codes with the queries (codes by queries): the same for every list."""
        return [np.ascontiguousarray(book @ part.T, np.float32) for part, book in self._subspaces(x)]

    def lengths(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared lengths of what the codes stand for."""
        decoded = self.coarse[lists] + np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return (decoded * decoded).sum(axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(b.as_buffer(), np.float64) for b in column]) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles."""
    for batch in batches:
        packed = [np.array(v, float).tobytes() for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("dim"), batch.column("n"), pa.array(packed, pa.binary())], ["node", "label", "dim", "n", "vector"])


def _assign(indexes: dict[int, Index], radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                index, x = indexes[int(dim)], _unit(_vectors(part.column("vector")))
                near, codes, error = index.encode(x)
                probes = [np.flatnonzero(p).astype(np.int32) for p in index.probes(x, radius)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near.astype(np.int32)), pa.array(index.region[near].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))],
                    ["node", "label", "dim", "n", "vector", "print", "list", "home", "codes", "error", "probes"],
                )

    return run


def _survivors(indexes: dict[int, Index], radius: float):
    """Of one part of a region's queries and the codes of members of lists that they probe: members that may be within the radius of a query."""

    def run(ask: pa.Table, member: pa.Table) -> pa.Table:
        if not ask.num_rows or not member.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("label", pa.string()), ("dim", pa.int32()), ("home", pa.int32()), ("q_part", pa.int64()), ("node", pa.int64()), ("print", pa.int64()))})
        first = {c: ask.column(c)[0].as_py() for c in ("label", "dim", "home", "q_part")}
        index, x = indexes[first["dim"]], _unit(_vectors(ask.column("vector")))
        probes = index.probes(x, radius)
        order = np.argsort(member.column("list").to_numpy(), kind="stable")
        lists = member.column("list").to_numpy()[order]
        codes = np.frombuffer(b"".join(member.column("codes").to_pylist()), np.uint8).reshape(len(order), -1)[order]
        within, found = (radius + member.column("error").to_numpy()[order] + 1e-4) ** 2, []
        for i in range(0, len(x), 512):
            tables, asked = index.tables(x[i : i + 512]), probes[i : i + 512].T
            centres = (index.coarse @ x[i : i + 512].T).astype(np.float32)
            for j in range(0, len(lists), 2048):
                at, code = lists[j : j + 2048], codes[j : j + 2048]
                q = np.flatnonzero(asked[np.unique(at)].any(axis=0))  # of a long list, the queries that probe it; of short ones, any of them
                if len(q):
                    every = len(q) == asked.shape[1]
                    dots = centres[at] if every else centres[at][:, q]
                    for s, table in enumerate(tables):
                        dots += (table if every else table[:, q])[code[:, s]]
                    # |x - y|^2 of a unit query and what the code stands for.
                    near = (1 + index.lengths(at, code) - within[j : j + 2048]).astype(np.float32)[:, None] <= 2 * dots
                    found.append(order[j + np.flatnonzero((near & (asked[at] if every else asked[at][:, q])).any(axis=1))])
        rows = pa.array(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))
        fill = lambda v, t: pa.array([v] * len(rows), t)
        return pa.table({"label": fill(first["label"], pa.string()), "dim": fill(first["dim"], pa.int32()), "home": fill(first["home"], pa.int32()), "q_part": fill(first["q_part"], pa.int64()), "node": member.column("node").take(rows), "print": member.column("print").take(rows)})

    return run


def _compare(least: float):
    """One part of a region's queries against some survivors: links of each query, and edges that keep what is connected so."""

    def run(ask: pa.Table, member: pa.Table) -> pa.Table:
        if not ask.num_rows or not member.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        q, m = (_unit(_vectors(t.column("vector"))) for t in (ask, member))
        weight, qn, mn = member.column("n").to_numpy(), ask.column("node").to_numpy(), member.column("node").to_numpy()
        nodes, of = np.unique(np.concatenate((qn, mn)), return_inverse=True)
        links, root = np.zeros(len(q), np.int64), np.arange(len(nodes))
        for i in range(0, len(q), 256):
            # The product names pairs within rounding of the threshold, which sums of each pair's own products then decide.
            a, b = np.nonzero(q[i : i + 256] @ m.T >= least - 1e-9)
            a += i
            for lo in range(0, len(a), 1 << 16):
                x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                good = ((q[x] * m[y]).sum(axis=1) >= least) & (qn[x] != mn[y])
                x, y = x[good], y[good]
                np.add.at(links, x, weight[y])
                # Least labels, passed along the links until nothing changes.
                u, v = of[x], of[len(q) + y]
                while True:
                    low = np.minimum(root[u], root[v])
                    before = root.copy()
                    np.minimum.at(root, root[u], low)
                    np.minimum.at(root, root[v], low)
                    root = root[root]
                    if (root == before).all():
                        break
        joined = np.flatnonzero(root != np.arange(len(nodes)))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "node": pa.array(np.concatenate((qn[some], nodes[joined])), pa.int64()),
                "links": pa.array(np.concatenate((links[some], np.zeros(len(joined), np.int64))), pa.int64()),
                "to": pa.array([None] * len(some) + nodes[root[joined]].tolist(), pa.int64()),
            }
        )

    return run


def _sampled(packed: DataFrame, count: int, sample: int) -> pa.Table:
    """About ``sample`` vectors, at most: those whose id hash is below a bound, then the least of them. Only these leave their partitions."""
    share = min(1.0, 1.1 * sample / max(count, 1))
    spot = F.shiftrightunsigned(F.xxhash64("node"), 1)
    some = packed.where(spot < int(share * 2**63)) if share < 1 else packed
    return some.select("dim", "vector", spot.alias("spot"), "node", "label").orderBy("spot", "node", "label").limit(sample).select("dim", "vector").toArrow()


def _met(asks: DataFrame, members: DataFrame, deals: DataFrame, whose: list[str]):
    """Parts of queries with what they ask for, in the number of parts ``m`` that ``deals`` has for each: cogroups."""
    members = members.join(deals, whose).withColumn("m_part", F.pmod(F.xxhash64("node"), "m")).drop("m")
    asks = asks.join(deals, whose).withColumn("m_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).drop("m")
    keys = [*whose, "m_part"]
    members = members.select(*[F.col(c).alias(f"of_{c}" if c in keys else c) for c in members.columns])
    return asks.groupBy(*whose, "m_part").cogroup(members.groupBy(*[f"of_{c}" for c in [*whose, "m_part"]]))


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``vectors``.

    Vectors of equal labels with cosine (in doubles) of ``least`` or more are linked; n_links counts the other rows linked
    directly, component_id is the smallest vec_id reachable, kept says that it is the row's own. Equal vectors of a label
    form one class and are compared once. The index is fitted on ``sample`` vectors at most, those of least id hash; every vector is
    indexed. Links are exact cosines; a link is missed if neither end's probes reach the other's list (see the module). Cosines that differ from
    ``least`` by rounding alone may fall on either side.

    Null label; null, empty or zero vector; null, infinite or NaN component: linked with nothing. Vectors of different
    lengths are not compared. Null vec_id: linked with nothing, component_id null, kept true. Rows with one vec_id count each; they are one node of the links. Other columns are
    ignored. An empty table gives an empty result. Large lists are dealt into parts of about ``PART`` queries, members into parts of ``MEMBERS``.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    fine = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    of = ["label", "vector"]
    classes = saved(rows.where("fine").groupBy(of).agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    packed = saved(in_batches(classes.withColumn("dim", F.size("vector")), _pack, "node long, label string, dim int, n long, vector binary"), "vectors")
    radius = float(np.sqrt(2 - 2 * least))
    indexes: dict[int, Index] = {}
    sizes = {r["dim"]: r["count"] for r in packed.groupBy("dim").count().limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1000 lengths of vectors")
    taken = _sampled(packed, sum(sizes.values()), sample) if sizes else None
    for dim, size in sizes.items():
        own = taken.filter(pa.array(np.array(taken.column("dim")) == dim))
        x = _unit(_vectors(own.column("vector"))) if own.num_rows else np.eye(1, dim)
        indexes[dim] = Index(x, int(np.clip(2 * np.sqrt(size), 1, LISTS)))
    coded = in_batches(packed.withColumn("print", F.xxhash64("vector")), _assign(indexes, radius), "node long, label string, dim int, n long, vector binary, print long, list int, home int, codes binary, error double, probes array<int>")
    coded = saved(coded, "coded")
    home = ["label", "dim", "home"]
    own = coded.join(coded.groupBy(*home).agg(F.ceil(F.count("*") / PART).alias("q")), home).withColumn("q_part", F.pmod(F.xxhash64("node"), "q"))
    whose = [*home, "q_part"]
    asks = own.select(*whose, "node", "vector")
    probed = saved(own.select(*whose, F.explode("probes").alias("list")).distinct(), "probed")
    # A part of queries meets the codes of all lists that it asks for, in parts of members; each part of members gets the queries once.
    sizes = coded.groupBy("label", "dim", "list").agg(F.count("*").alias("size"))
    deals = saved(probed.join(sizes, ["label", "dim", "list"]).groupBy(*whose).agg(F.ceil(F.sum("size") / MEMBERS).alias("m")), "deals")
    codes = probed.join(coded.select("label", "dim", "list", "node", "print", "codes", "error"), ["label", "dim", "list"])
    kind = "label string, dim int, home int, q_part long, node long, print long"
    left = saved(_met(asks, codes, deals, whose).applyInArrow(_survivors(indexes, radius), kind), "survivors")
    deals = saved(left.groupBy(*whose).agg(F.ceil(F.count("*") / PART).alias("m")), "deals")
    fetched = left.join(coded.select("label", "node", "print", "n", "vector"), ["label", "node", "print"])
    found = _met(asks, fetched, deals, whose).applyInArrow(_compare(least), "node long, links long, to long")
    found = saved(found, "links")
    joined = components(found.where("to IS NOT NULL"), "node", "to")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(totals, "node", "left").join(joined, "node", "left")
    named = named.select(*of, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.where("fine").join(named, of).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
