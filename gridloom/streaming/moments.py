"""Streaming form of the moment fit: an addition of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.marginals import nig_by_moments


def windowed_nig(stream: DataFrame, time: str, by: str, value: str, window: str, late: str) -> DataFrame:
    """``start, by, n, alpha, beta, mu, delta`` for each event-time window; rows later than ``late`` are dropped by the watermark."""
    x = F.col(value)
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by)
    m = grouped.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    p = nig_by_moments(F.col("mean"), F.col("variance"), F.col("skewness"), F.col("kurtosis"))
    return m.select(F.col("w.start").alias("start"), by, "n", *[p[c].alias(c) for c in ("alpha", "beta", "mu", "delta")])
