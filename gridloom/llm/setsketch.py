"""Near-duplicate documents by SetSketch registers over word shingles.

Each document's set of shingles becomes ``m`` registers: per register the least of exponentially distributed hashes,
rounded to powers of ``BASE`` and truncated to 16 bits. Registers of a union are the maxima of the registers, and two
sets agree in a register with a probability that rises with their Jaccard similarity. Bands of registers name
candidates, a maximum-likelihood estimate from the joint registers of two sets thins them out, and exact comparison
of the full sets confirms every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.store import in_batches, saved
from gridloom.llm.words import U, mix, pieces, run_hashes, signed

BASE = 1.001
RATE = 20.0
TOP = 2**16 - 1
#: Nodes in a part of a group; two parts meet in one task.
GROUP = 1024


def band_rows(m: int, similarity: float, miss: float = 1e-6) -> int:
    """The most registers a band can have while a pair at ``similarity`` shares no band with probability ``miss`` at most."""
    return max([1, *(r for r in range(1, m + 1) if (1 - similarity**r) ** (m // r) <= miss)])


def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; A-Z count as a-z; fewer than k words: the whole sequence is one shingle."""
    for lo, hi, w in pieces(text):
        h, counts = w.hashes(lower=True), w.counts()
        n = np.maximum(counts - k + 1, np.minimum(counts, 1))
        cut = np.concatenate(([0], np.cumsum(n)))
        starts = np.repeat(w.first[:-1] - cut[:-1], n) + np.arange(cut[-1])
        g = run_hashes(h, starts, np.minimum(starts + k, np.repeat(w.first[1:], n)))
        for i in range(hi - lo):
            yield lo + i, np.unique(g[cut[i] : cut[i + 1]])


class Sketcher:
    """Registers and bands of sets of 64-bit hashes."""

    def __init__(self, m: int, rows: int):
        rng = np.random.Generator(np.random.PCG64(11))
        self.m, self.rows, self.bands = m, rows, m // rows
        self.a = rng.integers(0, 2**64, m, dtype=U) | U(1)
        self.c = rng.integers(0, 2**64, m, dtype=U)
        self.weights = rng.integers(0, 2**64, rows, dtype=U) | U(1)
        self.salts = rng.integers(0, 2**64, self.bands, dtype=U)

    def registers(self, s: np.ndarray) -> np.ndarray:
        least = np.full(self.m, 2**64 - 1, U)
        for i in range(0, len(s), 512):
            np.minimum(least, (s[i : i + 512, None] * self.a + self.c).min(axis=0), out=least)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)

    def band_hashes(self, registers: np.ndarray) -> np.ndarray:
        r = registers[..., : self.bands * self.rows].astype(U).reshape(*registers.shape[:-1], self.bands, self.rows)
        return mix((r * self.weights).sum(axis=-1, dtype=U) + self.salts)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets from their registers (pairs x m) and sizes.

    With u = na/(na+nb), v = 1-u and p(x) = -log_b(1 - x(b-1)/b), a register of the first set exceeds the second's with
    probability p(u - vJ), the other way with p(v - uJ). The log-likelihood is concave in J; its maximum on
    [0, min(u/v, v/u)] is found by ternary search for all pairs at once.
    """
    up, down = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        x, y = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return up * np.log(np.maximum(x, tiny)) + down * np.log(np.maximum(y, tiny)) + same * np.log(np.maximum(1 - x - y, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(25):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        better = likelihood(a) < likelihood(b)
        lo, hi = np.where(better, a, lo), np.where(better, hi, b)
    return (lo + hi) / 2


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _sketches(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(m, 1)
        for batch in batches:
            n, one, two, regs = [], [], [], []
            for _, s in shingle_sets(batch.column(2), k):
                n.append(len(s))
                total = s.sum(dtype=U), np.bitwise_xor.reduce(mix(s)) if len(s) else U(0)
                one.append(int(signed(mix(np.array([total[0] + U(len(s))], U)))[0]))
                two.append(int(signed(np.array([total[1]], U))[0]))
                regs.append(sketch.registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.binary())],
                ["doc_id", "print", "n_shingles", "f1", "f2", "registers"],
            )

    return run


def _buckets(m: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(m, rows)
        for batch in batches:
            if batch.num_rows:
                r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, m)
                bands = signed(sketch.band_hashes(r))
                nodes = np.repeat(batch.column(0).to_numpy(), bands.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(nodes)], ["bucket", "node"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary([s for _, s in shingle_sets(batch.column(1), k)])], ["node", "shingles"])

    return run


def _likely(least: float):
    """Keeps pairs whose estimate is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                keep = pa.array(estimate(ra, rb, na, nb) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _confirmed(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), U) for z in (x, y))
                keep.append(_alike(x, y, percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, m: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, print``: one row for each row of ``docs``; print is xxhash64 of the text.

    Links join documents whose sets of ``k``-word shingles (A-Z as a-z) have 100 * intersection >= ``percent`` * union;
    component_id is the smallest doc_id reachable, kept marks the row that stays (doc_id = component_id).

    Rows with equal sets form one class, represented by its smallest doc_id, and only representatives are compared. In
    a band's bucket all representatives are first compared with the smallest one (a star, not all pairs). When the
    components of these links are known, buckets that still hold several of them are gathered into groups, and a task
    compares two parts of a group, of ``GROUP`` nodes about, and gives at most a spanning tree of what it joins. So no pair
    within a component is compared or made a row, and no link is lost that a band shows; bands are cut so that a
    pair at the threshold shares none with probability 1e-6 at most.

    Null, empty or word-free text: n_shingles 0, linked with nothing. Null doc_id: component_id null, kept true, linked
    with nothing. Rows that share a doc_id are judged by their own texts; classes with one smallest doc_id are one node. Columns other than id and text are
    ignored, whatever their names. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "doc_id long, print long, n_shingles long, f1 long, f2 long, registers binary"
    sketches = saved(in_batches(docs.select("doc_id", F.xxhash64("text").alias("print"), "text"), _sketches(k, m), kind), "sketches")
    of = ["n_shingles", "f1", "f2"]
    classes = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(of).agg(F.min(F.struct("doc_id", "registers")).alias("first"))
    classes = saved(classes.select(*of, F.col("first.doc_id").alias("node"), "first.registers"), "classes")
    found = components(_links(docs, classes, k, percent, m))
    member = (
        sketches.select("doc_id", "print", *of)
        .join(classes.select(*of, "node"), of, "left")
        .join(found, "node", "left")
        .select("doc_id", "print", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
    )
    return member.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "print")


def _links(docs: DataFrame, classes: DataFrame, k: int, percent: int, m: int) -> DataFrame:
    """Confirmed links ``a, b`` between representatives: enough of them for the components of all links."""
    rows = band_rows(m, percent / 100)
    buckets = saved(in_batches(classes.select("node", "registers"), _buckets(m, rows), "bucket long, node long"), "buckets")
    lead = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("bucket", "lead")
    shared = saved(buckets.join(lead, "bucket").select("bucket", "node", "lead").distinct(), "buckets")
    wanted = shared.select("node").distinct()
    sets = saved(in_batches(docs.join(wanted, docs["doc_id"] == wanted["node"], "left_semi"), _sets(k), "node long, shingles binary").where("length(shingles) > 0"), "sets")
    stars = saved(shared.where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    links = saved(_confirm(stars, classes, sets, percent, m), "confirmed")
    # What is left: buckets whose nodes are in several components. Nodes that such buckets join make up a group.
    found = components(links)
    state = shared.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    state = saved(state, "buckets")
    open_ = state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("lead")).where("low < high").select("bucket", "lead")
    rest = saved(state.join(open_, "bucket"), "rest")
    groups = saved(components(rest.select("node", "lead"), "node", "lead").withColumnRenamed("component", "group"), "groups")
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / GROUP).alias("n"))
    member = rest.select("node", "component").distinct().join(groups, "node").join(sizes, "group")
    member = member.withColumn("part", F.pmod(F.xxhash64("node"), "n"))
    # Parts i <= j of a group meet in one task; a group of one part is dealt once.
    to = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda x: F.struct(F.least(x, "part").alias("i"), F.greatest(x, "part").alias("j")))
    member = member.select("group", "node", "component", "part", F.explode(to).alias("task")).join(classes.select("node", "n_shingles", "registers"), "node").join(sets, "node")
    member = member.select("group", "task.i", "task.j", "node", "component", "part", "n_shingles", "registers", "shingles")
    more = member.groupBy("group", "i", "j").applyInArrow(_across(percent, m, rows), "a long, b long")
    return links.unionByName(saved(more, "confirmed"))


def _across(percent: int, m: int, rows: int):
    """Links between two parts of a group (or within one) that join different components; a pair must share a band."""
    least = percent / 100

    def run(table: pa.Table) -> pa.Table:
        sketch, a, b = Sketcher(m, rows), [], []
        n = table.num_rows
        node, component, part, size = (table.column(c).to_numpy() for c in ("node", "component", "part", "n_shingles"))
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(n, m)
        sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("shingles")]
        bands = sketch.band_hashes(registers)
        names, of = np.unique(component, return_inverse=True)
        inside = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        for x in range(n):
            other = (of != of[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])) & (bands == bands[x]).any(axis=1)
            other[: x + 1] = False
            if not inside:
                other &= part != part[x]
            y = np.flatnonzero(other)
            if not len(y):
                continue
            likely = estimate(np.repeat(registers[x : x + 1], len(y), axis=0), registers[y], np.full(len(y), float(size[x])), size[y].astype(float))
            for z in y[np.argsort(-likely, kind="stable")][: int((likely >= least - margin(least, m)).sum())]:
                if of[z] != of[x] and _alike(sets[x], sets[z], percent):
                    a.append(node[x])
                    b.append(node[z])
                    of[of == of[z]] = of[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def margin(similarity: float, m: int) -> float:
    """Five standard errors of the estimate."""
    return 5 * float(np.sqrt(similarity * (1 - similarity) / m))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= percent * (x.size + y.size - both)


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, m: int) -> DataFrame:
    """The pairs that the registers' estimate leaves (threshold less five standard errors) and the full sets confirm."""
    a = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    b = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    least = percent / 100
    near = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = in_batches(near, _likely(least - margin(least, m)), "a long, b long").distinct()
    near = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    near = near.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return in_batches(near, _confirmed(percent), "a long, b long").distinct()
