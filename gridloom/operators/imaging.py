"""Template matching between images and filters on them; images are ``x int, y int, value double`` with null for missing pixels."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def disc(radius: int, skip: int = 0, start: int = 0) -> list[tuple[int, int]]:
    """Offsets on the lattice of step skip + 1 whose distance is between ``start`` and ``radius``."""
    axis = range(-(radius // (skip + 1)) * (skip + 1), radius + 1, skip + 1)
    return [(a, b) for a, b in itertools.product(axis, axis) if start**2 <= a * a + b * b <= radius**2]


def _offsets(found: list[tuple[int, int]], a: str, b: str) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(p).alias(a), F.lit(q).alias(b)) for p, q in found]))


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """From six sums: the covariance divides by n, the variances by n - 1; null without spread."""
    mx, my = sx / n, sy / n
    vx, vy = (sxx - n * mx * mx) / (n - 1), (syy - n * my * my) / (n - 1)
    return F.when((n > 1) & (vx > 1e-12) & (vy > 1e-12), (sxy / n - mx * my) / F.sqrt(vx * vy))


def match(first: DataFrame, second: DataFrame, template: int, search: int, template_skip: int = 0, search_skip: int = 0, template_start: int = 0, search_start: int = 0, chosen: DataFrame | None = None) -> DataFrame:
    """``x, y, mx, my, score``: the pixel of ``second`` whose surroundings correlate best with those of each pixel of ``first``.

    Pixels of the first image are paired with those of the second by shift (one equi-join); sums over a template are then sums of those products
    over its offsets (one explode and grouping), so an offset is a row, not a join. Ties: least (my, mx). Pixels without a match have nulls. ``chosen``: ``x, y`` of the
    pixels wanted.
    """
    a = first.where("value IS NOT NULL AND NOT isnan(value)").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("value").alias("u"))
    b = second.where("value IS NOT NULL AND NOT isnan(value)").select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("value").alias("w"))
    shifted = a.select("px", "py", "u", _offsets(disc(search, search_skip, search_start), "sx", "sy"))
    met = shifted.join(b, (F.col("px") + F.col("sx") == F.col("qx")) & (F.col("py") + F.col("sy") == F.col("qy"))).select("px", "py", "sx", "sy", "u", "w")
    spread = met.select("sx", "sy", "u", "w", "px", "py", _offsets(disc(template, template_skip, template_start), "ox", "oy"))
    x, y = (F.col("px") - F.col("ox")).alias("x"), (F.col("py") - F.col("oy")).alias("y")
    sums = spread.groupBy(x, y, "sx", "sy").agg(
        F.count("*").alias("n"), F.sum("u").alias("su"), F.sum("w").alias("sw"), F.sum(F.col("u") * F.col("u")).alias("suu"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("u") * F.col("w")).alias("suw")
    )
    c = correlation(*[F.col(k) for k in ("n", "su", "sw", "suu", "sww", "suw")])
    targets = second.select(F.col("x").alias("mx"), F.col("y").alias("my"))
    scored = sums.select("x", "y", (F.col("x") + F.col("sx")).alias("mx"), (F.col("y") + F.col("sy")).alias("my"), F.round(c, 12).alias("score")).where("score IS NOT NULL").join(targets, ["mx", "my"], "left_semi")
    best = scored.groupBy("x", "y").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("my"), F.col("mx"))).alias("best"))
    pixels = first.select("x", "y") if chosen is None else first.select("x", "y").join(chosen.select("x", "y").distinct(), ["x", "y"], "left_semi")
    return pixels.join(best, ["x", "y"], "left").select("x", "y", F.col("best.mx").alias("mx"), F.col("best.my").alias("my"), (-F.col("best.s")).alias("score"))


def vector_field(matches: DataFrame, least: float) -> DataFrame:
    """``x, y, dx, dy``: displacements, null where there is no match or its score is below ``least``."""
    good = F.col("score") >= least
    return matches.select("x", "y", F.when(good, F.col("mx") - F.col("x")).alias("dx"), F.when(good, F.col("my") - F.col("y")).alias("dy"))


def filtered(image: DataFrame, size: int, how: str, width: int, height: int) -> DataFrame:
    """``x, y, value``: mean or median over windows of ``size`` by ``size`` without missing pixels. Beyond the border the nearest pixel counts again.

    Each pixel is sent to the windows it belongs to, as often as it counts there; one grouping gathers them.
    """
    half = size // 2
    span = [k - half for k in range(size)]

    def targets(c: Column, n: int) -> Column:
        """Centres whose window has the pixel, one for each time it counts."""
        own = F.filter(F.array(*[c - k for k in span]), lambda t: (t >= 0) & (t < n))
        # Offsets that lead beyond the border from a centre count for the border pixel.
        low = F.when(c == 0, F.filter(F.array(*[F.lit(-k - e) for k in span for e in range(1, half + 1)]), lambda t: (t >= 0) & (t < n)))
        high = F.when(c == n - 1, F.filter(F.array(*[F.lit(n - 1 + e - k) for k in span for e in range(1, half + 1)]), lambda t: (t >= 0) & (t < n)))
        empty = F.array().cast("array<int>")
        return F.concat(own.cast("array<int>"), F.coalesce(low.cast("array<int>"), empty), F.coalesce(high.cast("array<int>"), empty))

    known = image.where("value IS NOT NULL AND NOT isnan(value)")
    sent = known.select("value", "y", F.explode(targets(F.col("x"), width)).alias("x")).select("value", "x", F.explode(targets(F.col("y"), height)).alias("y"))
    f = {"mean": F.avg("value"), "median": F.percentile("value", 0.5)}[how]
    return image.select("x", "y").join(sent.groupBy("x", "y").agg(f.alias("value")), ["x", "y"], "left")


def resampled(points: DataFrame, low: tuple[float, float], cell: tuple[float, float], shape: tuple[int, int]) -> DataFrame:
    """``x, y, value``: mean of the points in each pixel, null where there are none (``points``: ``px, py, value``). A bin average; linear
    interpolation is ``triangulate.resampled_linear``."""
    spark = points.sparkSession
    x, y = (F.floor((F.col(c) - a) / s).cast("int") for c, a, s in (("px", low[0], cell[0]), ("py", low[1], cell[1])))
    mean = points.groupBy(x.alias("x"), y.alias("y")).agg(F.avg("value").alias("value"))
    every = spark.range(shape[0] * shape[1]).select((F.col("id") % shape[0]).cast("int").alias("x"), F.floor(F.col("id") / shape[0]).cast("int").alias("y"))
    return every.join(mean, ["x", "y"], "left")


def cosine_basis(x: list[Column], harmonics: list[int], low: list[float], high: list[float]) -> Column:
    """Product of cos(h pi (x - low) / (high - low)) over the axes."""
    out = F.lit(1.0)
    for c, h, a, b in zip(x, harmonics, low, high, strict=True):
        if h >= 1:
            out = out * F.cos(h * 3.141592653589793 * (c - a) / (b - a))
    return out


def cosine_sum(x: list[Column], coefficients: dict[tuple[int, ...], float], low: list[float], high: list[float]) -> Column:
    """Sum of coefficient times basis function, by harmonics."""
    return sum((c * cosine_basis(x, list(h), low, high) for h, c in sorted(coefficients.items())), F.lit(0.0))
