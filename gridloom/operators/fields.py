"""Gaussian random fields: Matern models on meshes, sampling, conditioning, likelihood and covariance; spectral fields on grids.

Assembly, projection of observations and everything that has a row for each point or replicate are Spark jobs. The dense kernel works on a
mesh's own system, whose size is checked (``MOST`` nodes); larger systems are for ``sparse.solve``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.rational import Rational, clenshaw_lord
from gridloom.operators import sparse
from gridloom.operators.cut_lineage import checkpointed

MOST = 4096


@dataclass(frozen=True)
class Matern:
    """Coefficients of a stationary isotropic model in ``d`` dimensions: smoothness ``order``, correlation range, standard deviation.

    kappa = sqrt(8 order) / range, alpha = order + d / 2; K = c_mass M + c_stiff G makes X = (C^-1 K)^(-alpha / 2) W / tau.
    """

    order: float
    range: float
    sigma: float
    d: int

    @property
    def alpha(self) -> float:
        return self.order + self.d / 2

    @property
    def kappa(self) -> float:
        return math.sqrt(8 * self.order) / self.range

    @property
    def mass(self) -> float:
        return self.kappa ** (self.d / self.alpha)

    @property
    def stiffness(self) -> float:
        return self.mass / self.kappa**2

    @property
    def tau(self) -> float:
        return math.sqrt(math.gamma(self.order) / (math.gamma(self.alpha) * (4 * math.pi) ** (self.d / 2))) / self.sigma


def varying_coefficients(ranges: list[Column], frame: list[list[Column]], order: float) -> tuple[Column, list[list[Column]]]:
    """(mass coefficient, stiffness tensor) of a model whose ranges and frame vary by simplex, as columns."""
    from gridloom.functions.geometry import metric_from_ranges

    d = len(frame[0])
    alpha = order + d / 2
    scaled = [r / math.sqrt(8 * order) for r in ranges]
    log_root, inverse = metric_from_ranges(frame, scaled)
    c = F.exp(log_root / alpha)
    return c, [[c * x for x in row] for row in inverse]


def rational_split(alpha: float, degree: int = 20) -> Rational:
    """Approximation of x^(alpha/2 - whole part) used for fractional powers of the operator: degrees (2, 1) if alpha / 2 is 1 or more, else
    (1, 2), on (10^-2.5, 1)."""
    beta = min(alpha / 2, 3.25)
    m, n = (2, 1) if beta >= 1 else (1, 2)
    return clenshaw_lord(lambda x: x**beta, degree, (10**-2.5, 1.0), m, n)


@dataclass(frozen=True)
class Factor:
    """Spectral factor of a field on a mesh's nodes: covariance = basis diag(values^(-alpha)) basis^T / tau^2."""

    ids: np.ndarray
    basis: np.ndarray
    inverse: np.ndarray
    values: np.ndarray
    alpha: float
    tau: float

    @property
    def scales(self) -> np.ndarray:
        return self.values ** (-self.alpha / 2) / self.tau

    def covariance(self, columns: np.ndarray) -> np.ndarray:
        return self.basis @ (self.scales[:, None] ** 2 * (self.basis.T @ columns))

    def log_determinant(self) -> float:
        """Of the covariance at the nodes."""
        return float(2 * np.log(self.scales).sum() + 2 * np.linalg.slogdet(self.basis)[1])


def _dense(m: DataFrame, ids: np.ndarray) -> np.ndarray:
    rows = m.toPandas()
    out = np.zeros((len(ids), len(ids)))
    np.add.at(out, (np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])), rows["v"])
    return out


def factor(k: DataFrame, lumped: DataFrame, model: Matern, fixed: DataFrame | None = None) -> Factor:
    """Of K (``i, j, v``) and the lumped mass (``i, v``); nodes in ``fixed`` (``i``) are held at zero and left out."""
    if fixed is not None:
        k, lumped = sparse.without(k, fixed), lumped.join(fixed.select("i"), "i", "left_anti")
    n = lumped.count()
    if n > MOST:
        raise ValueError(f"{n} nodes; the dense kernel takes {MOST} at most. Use sparse.solve()")
    c = lumped.toPandas().sort_values("i")
    ids, root = c["i"].to_numpy(), np.sqrt(c["v"].to_numpy())
    values, vectors = np.linalg.eigh(_dense(k, ids) / root / root[:, None])
    if values[0] <= 0:
        raise ValueError("the system is not positive definite")
    return Factor(ids, vectors / root[:, None], vectors.T * root, values, model.alpha, model.tau)


def sample(spark: SparkSession, f: Factor, n: int, seed: int = 0, mean: float = 0.0) -> DataFrame:
    """``rep, node_id, value``: n realisations, each with its own generator, spread over the cluster."""
    shared = spark.sparkContext.broadcast((f.ids, f.basis * f.scales))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, root = shared.value
        for batch in batches:
            for rep in batch["id"]:
                z = np.random.Generator(np.random.PCG64([seed, int(rep)])).standard_normal(root.shape[1])
                yield pd.DataFrame({"rep": rep, "node_id": ids, "value": mean + root @ z})

    return spark.range(n).mapInPandas(run, "rep long, node_id long, value double")


@dataclass(frozen=True)
class Normal:
    """Observations folded onto the nodes: A^T Q A, A^T Q y, y^T Q y, their number and log |Q|; Q = 1 / sd^2. Numbers are counted when they are asked for."""

    ata: DataFrame
    aty: DataFrame
    sums: DataFrame

    @cached_property
    def _totals(self):
        return self.sums.first()

    @property
    def yty(self) -> float:
        return self._totals["yty"] or 0.0

    @property
    def count(self) -> int:
        return self._totals["n"] or 0

    @property
    def seen(self) -> int:
        """Observations with a value (of ``folded``)."""
        return self._totals["seen"] or 0

    @property
    def log_q(self) -> float:
        return self._totals["log_q"] or 0.0


def normal_equations(weights: DataFrame, y: DataFrame) -> Normal:
    """From ``point_id, node_id, w`` and ``point_id, value, sd``. Points without a node are left out; pairs of a point's nodes (a few) are made by
    one grouping by point, never between points."""
    each = weights.where("node_id IS NOT NULL").groupBy("point_id").agg(F.collect_list(F.struct("node_id", "w")).alias("e")).join(y.where("value IS NOT NULL"), "point_id")
    q = 1 / (F.col("sd") * F.col("sd"))
    rows = each.select("e", F.explode("e").alias("a"), q.alias("q"), "value")
    aty = rows.groupBy(F.col("a.node_id").alias("i")).agg(F.sum(F.col("a.w") * F.col("q") * F.col("value")).alias("v"))
    pairs = rows.select("a", "q", F.explode("e").alias("b"))
    ata = pairs.groupBy(F.col("a.node_id").alias("i"), F.col("b.node_id").alias("j")).agg(F.sum(F.col("a.w") * F.col("b.w") * F.col("q")).alias("v"))
    return Normal(ata, aty, each.agg(F.sum(q * F.col("value") * F.col("value")).alias("yty"), F.count("*").alias("n"), F.sum(F.log(q)).alias("log_q")))


def folded(at: DataFrame, vertices: int, least: float = 0.0, every: bool = False) -> Normal:
    """The same of observations that carry their simplex: ``v, w`` (see ``locate.located``), ``value, sd`` and, for several right sides, ``rep`` in one row each.

    Sums are made by simplex first, as all its observations have the same nodes: no pair of nodes is made, and nothing is sent, for an observation. Weights of the size ``least`` or less are
    left out. ``every``: observations without a value count too, as 0, in all but A^T Q y and y^T Q y."""
    names = ["rep"] if "rep" in at.columns else []
    w, q = [F.col(f"w{a}") for a in range(vertices)], F.col("q")
    rows = at.where("v IS NOT NULL" if every else "v IS NOT NULL AND value IS NOT NULL").select(
        *names, *[F.get("v", a).alias(f"v{a}") for a in range(vertices)], *[F.when(F.abs(F.get("w", a)) > least, F.get("w", a)).alias(f"w{a}") for a in range(vertices)], "value", (1 / (F.col("sd") * F.col("sd"))).alias("q")
    )
    pairs = [(a, b) for a in range(vertices) for b in range(a, vertices)]
    sums = rows.groupBy(*names, *[f"v{a}" for a in range(vertices)]).agg(
        *[F.sum(w[a] * w[b] * q).alias(f"a{a}{b}") for a, b in pairs], *[F.sum(w[a] * q * F.col("value")).alias(f"y{a}") for a in range(vertices)],
        F.sum(q * F.col("value") * F.col("value")).alias("yty"), F.count("*").alias("n"), F.count("value").alias("seen"), F.sum(F.log(q)).alias("log_q"),
    )
    sums = checkpointed(sums)
    both = F.array(*[F.struct(F.col(f"v{a}").alias("i"), F.col(f"v{b}").alias("j"), F.col(f"a{min(a, b)}{max(a, b)}").alias("v")) for a in range(vertices) for b in range(vertices)])
    ata = sums.select(F.inline(both)).where("v IS NOT NULL").groupBy("i", "j").agg(F.sum("v").alias("v"))
    each = F.array(*[F.struct(F.col(f"v{a}").alias("i"), F.col(f"y{a}").alias("v")) for a in range(vertices)])
    aty = sums.select(*names, F.inline(each)).where("v IS NOT NULL").groupBy(*names, "i").agg(F.sum("v").alias("v"))
    return Normal(ata, aty, sums.agg(*[F.sum(c).alias(c) for c in ("yty", "n", "seen", "log_q")]))


def _posterior(f: Factor, normal: Normal) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(precision of the spectral weights, right side, mean weights)."""
    b = f.basis * f.scales
    rows = normal.aty.toPandas()
    t = np.zeros(len(f.ids))
    np.add.at(t, np.searchsorted(f.ids, rows["i"]), rows["v"])
    precision = np.eye(len(f.ids)) + b.T @ _dense(normal.ata, f.ids) @ b
    right = b.T @ t
    return precision, right, np.linalg.solve(precision, right)


def condition(spark: SparkSession, f: Factor, normal: Normal) -> DataFrame:
    """``node_id, mean, variance`` of the field given the observations (mean zero before)."""
    precision, _, w = _posterior(f, normal)
    b = f.basis * f.scales
    half = np.linalg.solve(np.linalg.cholesky(precision), b.T)
    return spark.createDataFrame(pd.DataFrame({"node_id": f.ids, "mean": b @ w, "variance": (half**2).sum(axis=0)}))


def log_likelihood(f: Factor, normal: Normal) -> float:
    """Of the observations, the field integrated out."""
    precision, right, w = _posterior(f, normal)
    return float(0.5) * float(normal.log_q - np.linalg.slogdet(precision)[1] - normal.count * math.log(2 * math.pi) - normal.yty + float(right @ w))


def covariance_columns(spark: SparkSession, f: Factor, columns: DataFrame) -> DataFrame:
    """``rep, node_id, value`` of the covariance times columns given as ``rep, node_id, value``: one group for each column."""
    shared = spark.sparkContext.broadcast((f.ids, f.basis, f.scales**2))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, basis, weights = shared.value
        x = np.zeros(len(ids))
        np.add.at(x, np.searchsorted(ids, group["node_id"]), group["value"])
        return pd.DataFrame({"rep": group["rep"].iloc[0], "node_id": ids, "value": basis @ (weights * (basis.T @ x))})

    return columns.groupBy("rep").applyInPandas(run, "rep long, node_id long, value double")


def polynomial(m: DataFrame, coefficients: list[float], ids: DataFrame) -> DataFrame:
    """c_0 I + c_1 m + c_2 m^2 + ... by Horner's rule; ``ids``: ``i`` of all rows."""
    one = ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    out = sparse.add((coefficients[-1], one))
    for c in reversed(coefficients[:-1]):
        out = sparse.add((1.0, sparse.product(out, m)), (c, one))
    return out


# Fields on periodic grids: ``k0, k1, ...`` are indices, the density has a row for each frequency.


def frequency(k: Column, n: int) -> Column:
    """Angular frequency of index ``k`` of ``n``, in the order of the Fourier transform."""
    return 2 * math.pi * F.when(k <= n // 2, k).otherwise(k - n)


def spectral_density(indices: DataFrame, shape: list[int], lengths: list[float], order: float, metric: list[list[float]] | None = None, sigma: float = 1.0) -> DataFrame:
    """Adds ``density``: anisotropic Matern, (1 + w^T G w)^-(order + d/2) with w by the box's lengths, scaled to mean sigma^2."""
    d = len(shape)
    g = metric or [[1.0 if i == j else 0.0 for j in range(d)] for i in range(d)]
    w = [frequency(F.col(f"k{i}"), shape[i]) / lengths[i] for i in range(d)]
    form = sum((w[i] * w[j] * g[i][j] for i in range(d) for j in range(d) if g[i][j]), F.lit(0.0))
    raw = indices.withColumn("density", F.pow(1 + form, F.lit(-(order + d / 2))))
    mean = raw.agg(F.avg("density").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("density", sigma**2 * F.col("density") / F.col("mean")).drop("mean")


def spectral_log_determinant(density: DataFrame, power: float = 1.0) -> DataFrame:
    return density.agg((power * F.sum(F.log("density"))).alias("log_determinant"))


def _line(axis: str, n: int, inverse: bool):
    """One line of a grid along ``axis``: its (inverse) Fourier transform; cells left out are zero."""

    def run(line: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(n, complex)
        np.add.at(z, line[axis].to_numpy(), line["re"].to_numpy() + 1j * line["im"].to_numpy())
        z = np.fft.ifft(z) if inverse else np.fft.fft(z)
        out = {c: line[c].iloc[0] for c in line.columns if c not in (axis, "re", "im")}
        return pd.DataFrame(out | {axis: np.arange(n), "re": z.real, "im": z.imag})[list(line.columns)]

    return run


def fourier(data: DataFrame, shape: list[int], inverse: bool = False) -> DataFrame:
    """``rep, k0, k1, ..., re, im``: the discrete Fourier transform of each replicate, axis by axis: a group is a line of the grid, never the grid."""
    axes = [f"k{i}" for i in range(len(shape))]
    kind = ", ".join(["rep long", *(f"{k} int" for k in axes), "re double", "im double"])
    data = data.select("rep", *[F.col(k).cast("int").alias(k) for k in axes], "re", "im")
    for axis, n in zip(axes, shape, strict=True):
        data = data.groupBy("rep", *[k for k in axes if k != axis]).applyInPandas(_line(axis, n, inverse), kind)
    return data


def _cells(shape: list[int]) -> tuple[Column, list[Column]]:
    """(number of a cell from k0, k1, ..., its indices from ``cell``); cells count row by row."""
    stride = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
    return sum((F.col(f"k{i}").cast("long") * w for i, w in enumerate(stride)), F.lit(0).cast("long")), [(F.floor(F.col("cell") / w) % n).cast("int").alias(f"k{i}") for i, (w, n) in enumerate(zip(stride, shape, strict=True))]


def spectral_sample(density: DataFrame, shape: list[int], reps: DataFrame, seed: int = 0, mean: float = 0.0) -> DataFrame:
    """``rep, cell, value``: a realisation on the grid (cells row by row) for each row of ``reps`` (``rep long``); the same whatever the partitions."""
    from gridloom.operators.models import normal_noise

    keys = [f"k{i}" for i in range(len(shape))]
    z = reps.select("rep").distinct().crossJoin(density.select(*keys, F.sqrt("density").alias("root")))  # asked for as such: every frequency of every draw
    z = z.select("rep", *keys, (F.col("root") * normal_noise(seed, "rep", *keys)).alias("re"), (F.col("root") * normal_noise(seed + 1, "rep", *keys)).alias("im"))
    x = fourier(z, shape, inverse=True)
    return x.select("rep", _cells(shape)[0].alias("cell"), (mean + F.col("re") * math.sqrt(math.prod(shape))).alias("value"))


def spectral_covariance(density: DataFrame, shape: list[int], data: DataFrame, power: float = 1.0) -> DataFrame:
    """``rep, cell, value`` of the covariance's power times data (``rep, cell, value``; cells and frequencies left out are zero)."""
    number, indices = _cells(shape)
    keys = [f"k{i}" for i in range(len(shape))]
    x = fourier(data.select(F.col("rep").cast("long").alias("rep"), *indices, F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im")), shape)
    g = F.pow(F.col("density"), F.lit(float(power)))
    y = x.join(density.select(*keys, "density"), keys).select("rep", *keys, (F.col("re") * g).alias("re"), (F.col("im") * g).alias("im"))
    return fourier(y, shape, inverse=True).select("rep", number.alias("cell"), F.col("re").alias("value"))


def spectral_log_likelihood(density: DataFrame, shape: list[int], data: DataFrame, mean: float = 0.0) -> DataFrame:
    """``log_likelihood`` by ``rep``: -(log det + cells * log 2 pi + x^T S^-1 x) / 2."""
    centred = data.select(F.col("rep").cast("long").alias("rep"), F.col("cell").cast("long").alias("cell"), (F.col("value") - mean).alias("value"))
    solved = spectral_covariance(density, shape, centred, -1.0).withColumnRenamed("value", "solved")
    form = centred.join(solved, ["rep", "cell"]).groupBy("rep").agg(F.sum(F.col("value") * F.col("solved")).alias("form"))
    return form.crossJoin(F.broadcast(spectral_log_determinant(density))).select("rep", (-0.5 * (F.col("log_determinant") + math.prod(shape) * math.log(2 * math.pi) + F.col("form"))).alias("log_likelihood"))


def variogram(points: DataFrame, d: int, width: float, bins: int) -> DataFrame:
    """``bin, n, gamma``: half the mean squared difference of ``value`` by distance, up to ``bins * width``; pairs meet through grid bins of that size.

    An addition of this library.
    """
    from gridloom.operators.locate import _bins, squared_distance

    reach = width * bins
    x = [F.get("x", i) for i in range(d)]
    a = points.select(F.col("point_id").alias("pa"), F.col("x").alias("xa"), F.col("value").alias("va"), F.array(*[F.floor(c / reach) for c in x]).alias("bin"))
    b = points.select(F.col("point_id").alias("pb"), F.col("x").alias("xb"), F.col("value").alias("vb"), F.explode(_bins([c - reach for c in x], [c + reach for c in x], reach)).alias("bin"))
    r = F.sqrt(squared_distance(F.col("xa"), F.col("xb"), d))
    pairs = a.join(b, "bin").where("pa < pb").withColumn("bin", F.floor(r / width).cast("int")).where(F.col("bin") < bins)
    return pairs.groupBy("bin").agg(F.count("*").alias("n"), (F.sum(F.pow(F.col("va") - F.col("vb"), F.lit(2.0))) / (2 * F.count("*"))).alias("gamma"))


def lagged(df: DataFrame, value: str, order: str, by: str) -> DataFrame:
    """Adds ``step``: the difference to the row before, within ``by``."""
    return df.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order)))
