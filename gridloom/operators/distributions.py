"""Fitting and transforming marginal laws: NIG moments, EM, lookup tables and Gaussian scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.marginals import CAP, nig_by_moments, nig_gauss, nig_log_pdf
from gridloom.operators.cut_lineage import checkpointed

def bessel_ratio_terms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(x) K_0(x), exp(x) K_1(x), exp(x) K_2(x) for all x > 0 at once: trapezoids of exp(-x (cosh t - 1)) cosh(order t), up to
    where that is below exp(-40)."""
    out = np.zeros((3, len(x)))
    for near, points in ((x < 1, 96), (x >= 1, 24)):
        at = np.flatnonzero(near)
        if len(at):
            y = x[at, None]
            step = np.arccosh(1 + (40 + 2 * np.log1p(40 / y) * (y < 1) + 8) / y) / points
            t = step * np.arange(points + 1)
            decay = np.exp(-y * (np.cosh(t) - 1)) * step
            decay[:, 0] /= 2
            cosh = np.cosh(t)
            out[:, at] = decay.sum(1), (decay * cosh).sum(1), (decay * (2 * cosh * cosh - 1)).sum(1)
    return out[0], out[1], out[2]


def log_density(y: np.ndarray, alpha: float, beta: float, mu: float, delta: float) -> np.ndarray:
    if math.isinf(alpha):
        return -0.5 * ((y - mu) / delta) ** 2 - math.log(delta) - 0.5 * math.log(2 * math.pi)
    a, b, x = alpha * delta, beta * delta, (y - mu) / delta
    q = np.sqrt(1 + x * x)
    _, k1, _ = bessel_ratio_terms(a * q)
    return math.log(a / math.pi) + math.sqrt(a * a - b * b) + b * x - np.log(q) + np.log(k1) - a * q - math.log(delta)


def moments(data: DataFrame, by: str, value: str) -> DataFrame:
    """``by, n, mean, variance, skewness, kurtosis`` (population forms, kurtosis in excess)."""
    x = F.col(value)
    kept = data.where(x.isNotNull() & ~F.isnan(x.cast("double")))
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))


def fit_by_moments(data: DataFrame, by: str, value: str) -> DataFrame:
    """``by, n, alpha, beta, mu, delta``."""
    p = nig_by_moments(F.col("mean"), F.col("variance"), F.col("skewness"), F.col("kurtosis"))
    return moments(data, by, value).select(by, "n", *[p[c].alias(c) for c in ("alpha", "beta", "mu", "delta")])


def fit_gauss(data: DataFrame, by: str, value: str) -> DataFrame:
    p = nig_gauss(F.col("mean"), F.col("variance"))
    return moments(data, by, value).select(by, "n", *[p[c].alias(c) for c in ("alpha", "beta", "mu", "delta")])


def log_likelihood(data: DataFrame, params: DataFrame, by: str, value: str) -> DataFrame:
    """``by, log_likelihood``; ``params``: one row for each group."""
    y = F.col(value)
    joined = data.where(y.isNotNull()).join(params.select(by, "alpha", "beta", "mu", "delta"), by)
    return joined.groupBy(by).agg(F.sum(nig_log_pdf(y, F.col("alpha"), F.col("beta"), F.col("mu"), F.col("delta"))).alias("log_likelihood"))


def _expectation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of an E step for each group in each batch."""
    for batch in batches:
        rows = batch.to_pandas()
        out = []
        for name, g in rows.groupby("g", dropna=False):
            alpha, beta, mu, delta = (float(g[c].iloc[0]) for c in ("alpha", "beta", "mu", "delta"))
            y = g["y"].to_numpy(float)
            s = w = sw = ll = sy = 0.0
            for i in range(0, len(y), 4096):
                part = y[i : i + 4096]
                phi = np.sqrt(1 + ((part - mu) / delta) ** 2)
                a = alpha * delta
                k0, k1, k2 = bessel_ratio_terms(a * phi)
                s += float((delta * delta * phi * k0 / (a * k1)).sum())
                each = a * k2 / (delta * delta * phi * k1)
                w += float(each.sum())
                sw += float((part * each).sum())
                sy += float(part.sum())
                x = (part - mu) / delta
                ll += float((math.log(a / math.pi) + math.sqrt(a * a - (beta * delta) ** 2) + beta * delta * x - np.log(phi) + np.log(k1) - a * phi - math.log(delta)).sum())
            out.append((name, len(y), s, w, sw, sy, ll))
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["g", "n", "s", "w", "yw", "y", "ll"]), preserve_index=False)


def fit_em(data: DataFrame, by: str, value: str, rounds: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """``by, n, alpha, beta, mu, delta, log_likelihood, settled``: maximum likelihood by EM from the moment fit and from the Gaussian, the better one.

    A round is one pass over the data: Arrow batches give a row of sums for each group, which Spark adds up. One row for each group reaches
    the driver (groups are taken to be few: series, not observations); a group whose likelihood gains less than ``tolerance`` of its
    size is settled and leaves the next rounds; settled is false where ``rounds`` ran out from either start. Null and NaN values are left out; groups without spread keep the moment fit.
    """
    spark = data.sparkSession
    y = F.col(value).cast("double")
    rows = checkpointed(data.where(y.isNotNull() & ~F.isnan(y)).select(F.col(by).alias("g"), y.alias("y")))  # every pass reads it again
    best: dict = {}
    late: set = set()
    kind = f"g {rows.schema['g'].dataType.simpleString()}, n long, s double, w double, yw double, y double, ll double"
    for start in (fit_by_moments, fit_gauss):
        first = start(rows, "g", "y").where("alpha > 0 AND delta > 0").toPandas()
        now = {r.g: (r.alpha, r.beta, r.mu, r.delta) for r in first.itertuples()}
        last: dict = {}
        for _ in range(rounds):
            if not now:
                break
            params = spark.createDataFrame(pd.DataFrame([(g, *p) for g, p in now.items()], columns=["g", "alpha", "beta", "mu", "delta"]))
            sums = rows.join(F.broadcast(params), "g").mapInArrow(_expectation, kind).groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", "s", "w", "yw", "y", "ll")]).collect()
            following = {}
            for r in sums:
                g, n = r["g"], r["n"]
                if g not in best or r["ll"] > best[g][5]:
                    best[g] = (n, *now[g], r["ll"])
                if g in last and 0 <= r["ll"] - last[g] < tolerance * n:
                    continue
                last[g] = r["ll"]
                s, w, ybar = r["s"] / n, r["w"] / n, r["y"] / n
                if w - 1 / s <= 0:
                    continue
                delta = math.sqrt(1 / (w - 1 / s))
                gamma = delta / s
                beta = (r["yw"] - ybar * w * n) / (n - s * w * n)
                alpha = math.sqrt(gamma * gamma + beta * beta)
                if alpha * delta > CAP:
                    alpha, beta = alpha * CAP / (alpha * delta), beta * CAP / (alpha * delta)
                    gamma = math.sqrt(alpha * alpha - beta * beta)
                following[g] = (alpha, beta, ybar - beta * delta / gamma, delta)
            now = following
        late |= set(now)
    names = [by, "n", "alpha", "beta", "mu", "delta", "log_likelihood", "settled"]
    kind = f"`{by}` {rows.schema['g'].dataType.simpleString()}, n long, alpha double, beta double, mu double, delta double, log_likelihood double, settled boolean"
    return spark.createDataFrame(pd.DataFrame([(g, *p, g not in late) for g, p in best.items()], columns=names), kind) if best else spark.createDataFrame([], kind)


@lru_cache
def _bessel_table() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over logs of x from 1e-5 to 1e4: log(exp(x) K_1(x)), K_0(x) / K_1(x) and their slopes; made once in a task's process."""
    at = np.linspace(math.log(1e-5), math.log(1e4), 10_001)
    x = np.exp(at)
    k0, k1, _ = (np.concatenate(c) for c in zip(*(bessel_ratio_terms(x[i : i + 1024]) for i in range(0, len(x), 1024)), strict=True))
    ratio = k0 / k1
    return at, np.log(k1), x * (1 - ratio) - 1, ratio, x * (ratio * ratio - 1) + ratio


def log_and_ratio(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log(exp(x) K_1(x)) and K_0(x) / K_1(x): cubic Hermite pieces in log x (to about 1e-12), and ``bessel_ratio_terms`` beyond the table."""
    at, log_k1, log_slope, ratio, ratio_slope = _bessel_table()
    h, u = at[1] - at[0], np.log(x)
    i = np.clip(((u - at[0]) / h).astype(np.int64), 0, len(at) - 2)
    t = (u - at[i]) / h
    out = []
    for c, d in ((log_k1, log_slope), (ratio, ratio_slope)):
        c0, c1, e0, e1 = c[i], c[i + 1], d[i] * h, d[i + 1] * h
        out.append(c0 + t * (e0 + t * (3 * (c1 - c0) - 2 * e0 - e1 + t * (2 * (c0 - c1) + e0 + e1))))
    far = np.flatnonzero((u < at[0]) | (u > at[-1]))
    for k in range(0, len(far), 4096):
        some = far[k : k + 4096]
        k0, k1, _ = bessel_ratio_terms(x[some])
        out[0][some], out[1][some] = np.log(k1), k0 / k1
    return out[0], out[1]


#: Sums of a pass: the log density, its slopes and its second slopes (the upper triangle, by rows).
_SUMS = 15


def _derivatives(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Those sums at t: log(alpha delta), artanh(beta / alpha), mu, log delta."""
    a, sech, tanh, mu, delta = math.exp(t[0]), 1 / math.cosh(t[1]), math.tanh(t[1]), t[2], math.exp(t[3])
    x = (z - mu) / delta
    q2 = 1 + x * x
    q = np.sqrt(q2)
    log_k1, ratio = log_and_ratio(a * q)
    turn = ratio * ratio + ratio / (a * q) - 1  # the ratio's slope
    f = t[0] - math.log(math.pi) + a * sech + a * tanh * x - np.log(q) + log_k1 - a * q - t[3]
    u, w = a * (sech + tanh * x - q * ratio), a * (sech * sech * x - sech * tanh)
    fx = a * tanh - 2 * x / q2 - a * x * ratio / q
    ux, wx = a * (tanh - x * ratio / q - a * x * turn), a * sech * sech
    xx = -2 * (1 - x * x) / (q2 * q2) - a * (ratio / (q2 * q) + a * x * x * turn / q2)
    each = (
        f, u, w, -fx / delta, -1 - x * fx,
        u - a * a * q2 * turn, w, -ux / delta, -x * ux, a * sech * (tanh * tanh - sech * sech - 2 * sech * tanh * x), np.full(len(x), -wx / delta), -x * wx, xx / delta**2, (xx * x + fx) / delta, x * x * xx + x * fx,
    )
    return np.array([c.sum() for c in each])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each group's log density and its slopes at its parameters."""
    for batch in batches:
        rows, out = batch.to_pandas(), []
        for name, g in rows.groupby("g", dropna=False):
            z, t = (g["y"].to_numpy(float) - g["mean"].iloc[0]) / g["sd"].iloc[0], np.array([g[f"t{k}"].iloc[0] for k in range(4)], float)
            out.append((name, len(z), *sum(_derivatives(z[i : i + 4096], t) for i in range(0, len(z), 4096))))
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["g", "n", *(f"s{k}" for k in range(_SUMS))]), preserve_index=False)


def _step(s: dict) -> np.ndarray:
    """A Newton step, damped so that the second slopes bend down; where alpha * delta is at ``CAP`` and would grow, it stays."""
    free = np.array([not (s["t"][0] >= math.log(CAP) - 1e-12 and s["g"][0] > 0), True, True, True])
    out = np.zeros(4)
    for _ in range(2):
        bend, turned = np.linalg.eigh(-s["h"][np.ix_(free, free)])
        bend = np.maximum(np.abs(bend), 1e-8) + s["damp"]
        out[:] = 0
        out[free] = turned @ ((turned.T @ s["g"][free]) / bend)
        if not (free[0] and s["t"][0] >= math.log(CAP) - 1e-12 and out[0] > 0):
            break
        free[0] = False
    out *= min(1.0, 2.0 / max(np.abs(out).max(), 1e-300))
    if s["t"][0] + out[0] > math.log(CAP):  # to the bound, and no further along any of them
        out *= (math.log(CAP) - s["t"][0]) / out[0]
    return out


def fit_gradient(data: DataFrame, by: str, value: str, rounds: int = 200, tolerance: float = 1e-7) -> DataFrame:
    """``by, n, alpha, beta, mu, delta, log_likelihood, settled``: maximum likelihood by damped Newton steps from the moment fit.

    A pass over the data gives every group's likelihood at a trial point, its slope and second slopes, all from one Bessel ratio a value; the driver has one row
    for each group and takes all groups' steps at once (groups are series, not observations). A step that does not gain is damped more. settled: the mean slope is below ``tolerance``
    (but for alpha * delta at its bound) or steps have become too small to matter, within ``rounds`` passes. alpha * delta is held at ``CAP`` at most. Null and NaN values are left out; groups without spread have no row.
    """
    spark, y = data.sparkSession, F.col(value).cast("double")
    rows = checkpointed(data.where(y.isNotNull() & ~F.isnan(y)).select(F.col(by).alias("g"), y.alias("y")))  # every pass reads it again
    start = fit_by_moments(rows, "g", "y").join(moments(rows, "g", "y").select("g", "mean", F.sqrt("variance").alias("sd")), "g").where("alpha > 0 AND delta > 0 AND sd > 0").toPandas()
    kind = f"g {rows.schema['g'].dataType.simpleString()}, n long, " + ", ".join(f"s{k} double" for k in range(_SUMS))
    state: dict = {}
    for r in start.itertuples():
        t = np.array([min(math.log(r.alpha * r.delta), math.log(CAP)), math.atanh(max(-0.999, min(0.999, r.beta / r.alpha))), (r.mu - r.mean) / r.sd, math.log(r.delta / r.sd)])
        state[r.g] = {"t": t, "f": -math.inf, "p": np.zeros(4), "damp": 1e-3, "mean": r.mean, "sd": r.sd, "n": 0, "done": False}
    for _ in range(rounds):
        open_ = {g: s for g, s in state.items() if not s["done"]}
        if not open_:
            break
        params = spark.createDataFrame(pd.DataFrame([(g, s["mean"], s["sd"], *(s["t"] + s["p"])) for g, s in open_.items()], columns=["g", "mean", "sd", "t0", "t1", "t2", "t3"]))
        sums = rows.join(F.broadcast(params), "g").mapInArrow(_around, kind).groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", *(f"s{k}" for k in range(_SUMS)))]).collect()
        for r in sums:
            s, v = state[r["g"]], np.array([r[f"s{k}"] for k in range(_SUMS)]) / r["n"]
            s["n"] = r["n"]
            gain = v[0] - s["f"]
            if not gain > 0:
                # Not better: from the point before again, or done where steps no longer matter.
                s["done"] = bool(np.abs(s["p"]).max() < 1e-7)
                s["damp"] *= 10
            else:
                s["t"], s["f"], s["g"], s["h"] = s["t"] + s["p"], v[0], v[1:5], np.zeros((4, 4))
                s["h"][np.triu_indices(4)] = v[5:]
                s["h"] = s["h"] + np.triu(s["h"], 1).T
                s["damp"] = max(s["damp"] / 10, 1e-12)
                held = np.where([s["t"][0] >= math.log(CAP) - 1e-12 and s["g"][0] > 0, False, False, False], 0.0, s["g"])
                s["done"] = bool(np.abs(held).max() < tolerance)
            s["p"] = np.zeros(4) if s["done"] else _step(s)
    out = []
    for g, s in state.items():
        alpha = math.exp(s["t"][0] - s["t"][3])
        out.append((g, s["n"], *map(float, (alpha / s["sd"], alpha * math.tanh(s["t"][1]) / s["sd"], s["mean"] + s["sd"] * s["t"][2], math.exp(s["t"][3]) * s["sd"], s["n"] * (s["f"] - math.log(s["sd"])))), s["done"]))
    kind = f"`{by}` {rows.schema['g'].dataType.simpleString()}, n long, alpha double, beta double, mu double, delta double, log_likelihood double, settled boolean"
    return spark.createDataFrame(out, kind)


class Lookup:
    """Distribution function and quantiles of a NIG law from a table: Simpson sums of the density on a grid of sinh spacing, cubic Hermite
    interpolation with the density as slope. Beyond the table (a probability of about 1e-14 on either side) tails are density over slope of its
    logarithm, kept as logarithms, so that no score is infinite."""

    def __init__(self, alpha: float, beta: float, mu: float, delta: float, knots: int = 2001):
        self.params = alpha, beta, mu, delta
        if math.isinf(alpha):
            mean, sd = mu, delta
        else:
            gamma = math.sqrt(alpha * alpha - beta * beta)
            mean, sd = mu + delta * beta / gamma, math.sqrt(delta * alpha * alpha / gamma**3)
        self.sd = sd
        reach = 10.0
        while max(log_density(np.array([mean - reach * sd, mean + reach * sd]), *self.params)) + math.log(sd) > -34 and reach < 1e5:
            reach *= 1.5
        u = np.linspace(-1, 1, 2 * knots - 1)
        stretch = math.asinh(reach)
        fine = mean + sd * np.sinh(u * stretch)
        self.x = fine[::2]
        pdf = np.exp(log_density(fine, *self.params))
        g = pdf * sd * np.cosh(u * stretch) * stretch
        steps = (2 / (knots - 1)) / 6 * (g[:-2:2] + 4 * g[1:-1:2] + g[2::2])
        ends = np.exp(self._log_tail(self.x[[0, -1]], np.array([-1, 1])))
        self.scale = ends.sum() + steps.sum()
        self.density = pdf[::2] / self.scale
        #: At the knots: probability below, and above.
        self.below = (ends[0] + np.concatenate(([0.0], np.cumsum(steps)))) / self.scale
        self.above = (ends[1] + np.concatenate((np.cumsum(steps[::-1])[::-1], [0.0]))) / self.scale

    def _log_tail(self, y: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Log of the probability beyond ``y`` (below for side -1, above for 1), far out."""
        e = 1e-3 * self.sd
        slope = (log_density(y - e, *self.params) - log_density(y + e, *self.params)) / (2 * e)
        return log_density(y, *self.params) - np.log(np.maximum(side * slope, 1e-12 / self.sd))

    def log_tails(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the probabilities below and above."""
        i = np.clip(np.searchsorted(self.x, y) - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        t = np.clip((y - self.x[i]) / h, 0, 1)
        d0, d1 = self.density[i] * h, self.density[i + 1] * h

        def between(c: np.ndarray, sign: int) -> np.ndarray:
            c0, c1, e0, e1 = c[i], c[i + 1], sign * d0, sign * d1
            v = c0 + t * (e0 + t * (3 * (c1 - c0) - 2 * e0 - e1 + t * (2 * (c0 - c1) + e0 + e1)))
            return np.log(np.clip(v, np.minimum(c0, c1), np.maximum(c0, c1)))

        low, high = between(self.below, 1), between(self.above, -1)
        out = y < self.x[0]
        if out.any():
            low[out] = self._log_tail(y[out], np.full(out.sum(), -1)) - math.log(self.scale)
        out = y > self.x[-1]
        if out.any():
            high[out] = self._log_tail(y[out], np.full(out.sum(), 1)) - math.log(self.scale)
        return low, high

    def cdf(self, y: np.ndarray) -> np.ndarray:
        low, high = self.log_tails(y)
        return np.where(low <= high, np.exp(low), -np.expm1(high))

    def from_tails(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The values whose probabilities below and above have these logs; bisection, to the last bit of the knots' interval or of the tail."""
        left = low <= high
        wanted = np.where(left, low, high)
        a, b = np.full(len(low), self.x[0]), np.full(len(low), self.x[-1])
        finite = np.isfinite(wanted)
        for _ in range(80):  # tails end where the wanted logarithm is passed
            la, hb = self.log_tails(a)[0], self.log_tails(b)[1]
            more_a, more_b = left & finite & (la > wanted), ~left & finite & (hb > wanted)
            if not (more_a | more_b).any():
                break
            a, b = np.where(more_a, a - 2 * (self.x[-1] - a), a), np.where(more_b, b + 2 * (b - self.x[0]), b)
        for _ in range(70):
            mid = (a + b) / 2
            la, hb = self.log_tails(mid)
            under = np.where(left, la < wanted, hb > wanted)
            a, b = np.where(under, mid, a), np.where(under, b, mid)
        return np.where(finite, (a + b) / 2, np.where(np.isnan(wanted), np.nan, np.where(left, -np.inf, np.inf)))

    def quantile(self, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.from_tails(np.log(p), np.log1p(-p))


def _normal_log_below(z: np.ndarray) -> np.ndarray:
    """Log of the standard normal's distribution function; the asymptotic series from -30 down."""
    square = np.maximum(z * z, 1.0)
    far = -square / 2 - np.log(np.maximum(-z, 1.0)) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / square + 3 / square**2)
    near = np.array([math.log(0.5 * math.erfc(-max(v, -30.0) / math.sqrt(2))) if v == v else math.nan for v in z])
    return np.where(z < -30, far, near)


def _normal_score(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The standard normal's value whose probabilities below and above have these logs: by bisection on the smaller one."""
    least = np.minimum(low, high)
    a, b = -np.sqrt(np.maximum(-2 * least, 0)) - 1, np.zeros(len(least))
    for _ in range(60):
        mid = (a + b) / 2
        under = _normal_log_below(mid) < least
        a, b = np.where(under, mid, a), np.where(under, b, mid)
    return np.where(low <= high, 1, -1) * (a + b) / 2


def _transform(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[tuple, Lookup] = {}
        for batch in batches:
            out = np.full(len(batch), np.nan)
            keys = batch[["alpha", "beta", "mu", "delta"]]
            for key, rows in batch.groupby([keys[c] for c in keys], sort=False).indices.items():
                if key not in tables:
                    tables[key] = Lookup(*key)
                table, y = tables[key], batch["y"].to_numpy(float)[rows]
                if kind == "to_gauss":
                    out[rows] = _normal_score(*table.log_tails(y))
                elif kind == "from_gauss":
                    out[rows] = table.from_tails(_normal_log_below(y), _normal_log_below(-y))
                else:
                    out[rows] = table.cdf(y) if kind == "cdf" else table.quantile(y)
            yield batch.assign(out=out)[["id", "out"]]

    return run


def transformed(data: DataFrame, params: DataFrame, by: str, id_col: str, value: str, kind: str) -> DataFrame:
    """``id_col, out``: ``cdf``, ``quantile``, ``to_gauss`` (value to normal score) or ``from_gauss`` of each value under its group's law.

    A law's table is built once in each task. Null values give null.
    """
    rows = data.where(F.col(value).isNotNull()).join(params.select(by, "alpha", "beta", "mu", "delta"), by)
    rows = rows.select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("y"), "alpha", "beta", "mu", "delta")
    out = rows.mapInPandas(_transform(kind), f"id {rows.schema['id'].dataType.simpleString()}, out double").withColumnRenamed("id", id_col)
    return data.select(id_col).join(out, id_col, "left")


def tail_slopes(data: DataFrame, by: str, id_col: str, value: str, share: float) -> DataFrame:
    """``by, n, slope``: least squares through the first point of log(share of values at least as large) over the largest ``share`` of each group's values: the rate of an
    exponential tail, negated. Ties in the order of ``id_col``; null slope where the tail has no spread. The window sorts one group in a task."""
    rows = data.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("x"), F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc(), id_col)).alias("k"))
    count = data.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("all"))
    tail = rows.join(count, by).where(F.col("k") <= share * F.col("all")).select(by, "x", F.log(F.col("k") / F.col("all")).alias("y"))
    first = tail.groupBy(by).agg(F.min("x").alias("x0"), F.max("y").alias("y0"))
    x, y = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    out = tail.join(first, by).groupBy(by).agg(F.count("*").alias("n"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"))
    return out.select(by, "n", F.when(F.col("xx") > 0, F.col("xy") / F.col("xx")).alias("slope"))


def nig_draws(ids: DataFrame, alpha: float, beta: float, mu: float, delta: float, seed: int = 0, of_log: bool = False) -> DataFrame:
    """Adds ``value``: NIG draws as a normal with inverse-Gaussian variance (by the two-root method), from Spark's generators; a Gaussian for infinite alpha."""
    if math.isinf(alpha):
        y = mu + delta * F.randn(seed)
    else:
        mean, shape = delta / math.sqrt(alpha**2 - beta**2), delta**2
        z = F.pow(F.randn(seed), F.lit(2.0))
        root = mean + mean * mean * z / (2 * shape) - mean / (2 * shape) * F.sqrt(4 * mean * shape * z + mean * mean * z * z)
        ids = ids.withColumn("_root", root).withColumn("_u", F.rand(seed + 1))
        v = F.when(F.col("_u") <= mean / (mean + F.col("_root")), F.col("_root")).otherwise(mean * mean / F.col("_root"))
        ids = ids.withColumn("_v", v)
        y = mu + beta * F.col("_v") + F.sqrt("_v") * F.randn(seed + 2)
    return ids.withColumn("value", F.exp(y) if of_log else y).drop("_root", "_u", "_v")
