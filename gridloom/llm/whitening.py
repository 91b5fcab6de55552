"""Whitening of embeddings by a bit-sliced scatter.

Vectors are integers, so the scatter can be exact. A batch's values are shifted by their least in each dimension, and each bit plane of each dimension is packed
across rows, 64 rows a word. The cross-product of two dimensions is then the sum over their planes a, b of 2^(a + b) times the rows in which both bits are
set: an AND and a count of ones for 64 rows at a time. Tasks add up these counts as integers, give one row for each pair of dimensions, and Spark adds those as decimals
of 38 digits. n times the cross-products less the products of the sums centres them before anything is rounded; only then come eigenvalues and vectors.

What reaches the driver is the scatter of the dimensions, whatever the number of rows; what tasks are given is the fit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import in_batches, saved

#: Integers beyond this are not taken.
MOST = 1 << 44
#: Rows whose planes are packed at once.
SLICE = 8192
#: Eigenvalues below this share of the largest are rounding, not spread.
FLAT = 1e-12
SUMS = "dims int, i int, j int, v decimal(38,0)"
EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Fit:
    """n: distinct vectors; sums: of each dimension; values, vectors (dims x components), trace of the covariance; error: of the whitened covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes (dims, bits, words) of non-negative integers (rows, dims), 64 rows a word."""
    bits = max(int(x.max(initial=0)).bit_length(), 1)
    rows = -(-len(x) // 64) * 64
    each = np.zeros((x.shape[1], bits, rows), np.uint8)
    for b in range(bits):
        each[:, b, : len(x)] = ((x >> b) & 1).T
    return np.packbits(each, axis=2).view(np.uint64)


def counts(p: np.ndarray) -> np.ndarray:
    """For each two planes, the rows where both bits are set: (dims * bits, dims * bits), the upper triangle."""
    flat = p.reshape(-1, p.shape[2])
    out = np.zeros((len(flat), len(flat)), np.int64)
    for k in range(len(flat)):
        out[k, k:] = np.bitwise_count(flat[k:] & flat[k]).sum(axis=1, dtype=np.int64)
    return out


def scatter(x: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    """(rows, sums, cross-products as Python integers) of integers (rows, dims), exact."""
    dims = x.shape[1]
    total, sums, cross = 0, [0] * dims, np.zeros((dims, dims), object)
    for at in range(0, len(x), SLICE):
        some = x[at : at + SLICE]
        least = some.min(axis=0)
        p = planes(some - least)
        upper = counts(p)
        both = (upper + np.triu(upper, 1).T).reshape(dims, p.shape[1], dims, p.shape[1])
        weight = np.array([1 << b for b in range(p.shape[1])], object)
        if 2 * p.shape[1] + len(some).bit_length() < 62:
            high = np.einsum("aibj,i,j->ab", both, weight.astype(np.int64), weight.astype(np.int64)).astype(object)
        else:
            high = np.stack([((line.astype(object) * weight).sum(axis=2) * weight[:, None]).sum(axis=0) for line in both])
        ones = np.bitwise_count(p).sum(axis=2, dtype=np.int64).astype(object)  # rows with the bit set
        shifted, shift = (ones * weight).sum(axis=1), least.astype(object)
        cross = cross + high + np.outer(shift, shifted) + np.outer(shifted, shift) + len(some) * np.outer(shift, shift)
        sums = [s + int(a) + len(some) * int(b) for s, a, b in zip(sums, shifted, shift, strict=True)]
        total += len(some)
    return total, sums, cross


def _by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, integers (rows, dims)) for each length of vector."""
    column = batch.column(name)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), int(n))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows (i = j = -1), sums (j = -1) and cross-products."""
    held: dict = defaultdict(int)
    for batch in batches:
        for _, x in _by_length(batch, "x"):
            d = x.shape[1]
            n, sums, cross = scatter(x)
            held[d, -1, -1] += n
            for i in range(d):
                held[d, i, -1] += sums[i]
                for j in range(i, d):
                    held[d, i, j] += cross[i, j]
    keys = list(held)
    columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)] + [pa.array([Decimal(int(held[k])) for k in keys], EXACT)]
    yield pa.RecordBatch.from_arrays(columns, ["dims", "i", "j", "v"])


def _solved(rows: list, components: int) -> dict[int, Fit]:
    by: dict = defaultdict(dict)
    for r in rows:
        by[r["dims"]][r["i"], r["j"]] = int(r["v"])
    out = {}
    for d, v in by.items():
        n, sums = v[-1, -1], [v[i, -1] for i in range(d)]
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = (n * v[i, j] - sums[i] * sums[j]) / (n * n)  # integers until here
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        keep = values > FLAT * max(values[0], 0.0) if d else np.zeros(0, bool)
        out[d] = Fit(n, sums, values[keep], vectors[:, keep], float(np.trace(cov)))
    return out


def _centred(x: np.ndarray, f: Fit) -> tuple[np.ndarray, np.ndarray, int]:
    """x - S/n as doubles, and as n*x - S = n*(x - m) - r: (x - m, r) with m the nearest integers to the means."""
    m = [(2 * s + f.n) // (2 * f.n) for s in f.sums]
    r = [s - f.n * k for s, k in zip(f.sums, m, strict=True)]
    near = x - np.array(m, np.int64)
    return near - np.array([k / f.n for k in r]), near, r


def _whitened(x: np.ndarray, f: Fit) -> np.ndarray:
    return _centred(x, f)[0] @ (f.vectors / np.sqrt(f.values))


def _deviations(x: np.ndarray, f: Fit) -> list[int]:
    """Sum over dimensions of (n*x - S)^2, exact."""
    _, near, r = _centred(x, f)
    most = int(np.abs(near).max(initial=0))
    if x.shape[1] * (f.n * (most + 1)) ** 2 < 2**62:
        d = f.n * near - np.array(r, np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((f.n * int(v) - k) ** 2 for v, k in zip(row, r, strict=True)) for row in near.tolist()]


def _moments(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    """A task's sums of products of whitened values; they are centred already."""
    held: dict = {}
    for batch in batches:
        for _, x in _by_length(batch, "x"):
            w = _whitened(x, fits[x.shape[1]])
            held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
    rows = [(d, i, j, m[i, j]) for d, m in held.items() for i in range(len(m)) for j in range(len(m))]
    columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
    yield pa.RecordBatch.from_arrays(columns, ["dims", "i", "j", "v"])


def fit(distinct: DataFrame, components: int) -> dict[int, Fit]:
    """The fit of each length of vector in ``distinct`` (``x array<long>``, each once)."""
    sums = in_batches(distinct.select("x"), _sums, SUMS).groupBy("dims", "i", "j").agg(F.sum("v").alias("v"))
    fits = _solved(sums.collect(), components)
    moments = in_batches(distinct.select("x"), lambda b: _moments(b, fits), "dims int, i int, j int, v double").groupBy("dims", "i", "j").agg(F.sum("v").alias("v"))
    error = {d: 0.0 for d in fits}
    for r in moments.collect():
        error[r["dims"]] = max(error[r["dims"]], abs(r["v"] / fits[r["dims"]].n - (r["i"] == r["j"])))
    return {d: Fit(f.n, f.sums, f.values, f.vectors, f.trace, error[d]) for d, f in fits.items()}


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """``id, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double``: one row for each of ``vectors`` (``id, x array<long>``).

    The fit takes each distinct x once. deviation: sum over dimensions of (n*x - S)^2, exact; whitened: x - S/n on the unit eigenvectors of the covariance, over the roots of the
    eigenvalues, by falling eigenvalue, ``components`` at most; explained: their eigenvalues' shares of the trace; identity_error: the largest absolute entry of the whitened
    covariance less the identity, measured over the fit's vectors. Rows with a null x, a null in it, or a component beyond 2**44 are left out; a null id stays; repeated rows are each
    returned and count once in the fit. Vectors of different lengths are whitened apart. Directions without spread (eigenvalues below 1e-12 of the largest: few or equal
    vectors) have no component, so that lists can be shorter or empty. An empty table gives none. Other columns are left out.
    """
    fits_in = F.forall("x", lambda v: v.isNotNull() & v.between(-MOST, MOST))
    rows = saved(vectors.select("id", "x").where(F.col("x").isNotNull() & fits_in), "vectors")
    fits = fit(saved(rows.select("x").distinct(), "fit"), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch, "x"):
                f, n = fits[x.shape[1]], len(at)
                white = _whitened(x, f)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1)))
                shares = np.tile(f.values / f.trace if len(f.values) else f.values, (n, 1))
                columns = [batch.column("id").take(pa.array(at)), pa.array([f.n] * n, pa.int64()), pa.array([Decimal(d) for d in _deviations(x, f)], EXACT), lists(white), lists(shares), pa.array([f.error] * n)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = f"id {rows.schema['id'].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    return in_batches(rows, run, kind)
