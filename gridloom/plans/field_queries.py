"""Queries on scalars, marginal laws, fields and images."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry, marginals, special
from gridloom.functions.vectors import parts
from gridloom.operators import distributions, exact, fem, fields, imaging, locate, models, sparse
from gridloom.plans.data import IMAGE_SQL, PLACE_SQL, image, place, point_id, points, table
from gridloom.plans.mesh_queries import r
from gridloom.sources import meshes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_CUSTOMERS = f"c AS (SELECT c_custkey AS id, {PLACE_SQL.format(k='c_custkey')} FROM customer), p AS (SELECT id, lon, lat, cos(radians(lon)) * cos(radians(lat)) AS x, sin(radians(lon)) * cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM c)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = place(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lon.alias("lon"), lat.alias("lat"))


@query(f"WITH {_CUSTOMERS} SELECT id, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, round(z, 9) + 0.0 AS z FROM p")
def lonlat_to_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = geometry.lonlat_to_xyz(F.col("lon"), F.col("lat"))
    return _customers(spark, sf_dir).select("id", *[r(c, 9).alias(n) for c, n in zip(v, "xyz", strict=True)])


@query("SELECT vec_id AS id, round(degrees(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE)), 6) + 0.0 AS lon, round(degrees(asin(embedding[3]::DOUBLE / sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2))), 6) + 0.0 AS lat FROM embeddings")
def xyz_to_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geometry.xyz_to_lonlat(parts(F.col("embedding").cast("array<double>"), 3))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), r(lon).alias("lon"), r(lat).alias("lat"))


@query(f"WITH {_CUSTOMERS} SELECT id, round(acos(greatest(-1, least(1, x * 0.6 + z * 0.8))), 7) AS angle FROM p")
def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = geometry.lonlat_to_xyz(F.col("lon"), F.col("lat"))
    return _customers(spark, sf_dir).select("id", r(geometry.great_circle(v, [F.lit(0.6), F.lit(0.0), F.lit(0.8)]), 7).alias("angle"))


@query(f"WITH {_CUSTOMERS}, e AS (SELECT *, sqrt(x * x + y * y) AS h FROM p) SELECT id, " + ", ".join(f"round(cos(0.1) * {c} + sin(0.1) * (cos(0.5) * {n} + sin(0.5) * {e}), 7) + 0.0 AS {c}" for c, n, e in (("x", "(-x * z / h)", "(-y / h)"), ("y", "(-y * z / h)", "(x / h)"), ("z", "h", "0"))) + " FROM e")
def geodesic_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = geometry.lonlat_to_xyz(F.col("lon"), F.col("lat"))
    to = geometry.geodesic_step(v, F.lit(0.1), F.lit(0.5), [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    return _customers(spark, sf_dir).select("id", *[r(c, 7).alias(n) for c, n in zip(to, "xyz", strict=True)])


_E = "e AS (SELECT vec_id AS id, [embedding[i]::DOUBLE FOR i IN range(1, 9)] AS x FROM embeddings)"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


@query(f"WITH {_E}, u AS (SELECT id, x[1] / n AS a, x[2] / n AS b, x[3] / n AS c, sqrt(x[1] ** 2 + x[2] ** 2) / n AS h FROM (SELECT *, sqrt(x[1] ** 2 + x[2] ** 2 + x[3] ** 2) AS n FROM e)) SELECT id, round(-b / h, 7) + 0.0 AS ex, round(a / h, 7) + 0.0 AS ey, round(-c * a / h, 7) + 0.0 AS nx, round(-c * b / h, 7) + 0.0 AS ny, round(h, 7) AS nz FROM u")
def tangent_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north, _ = geometry.tangent_frame(parts(F.col("x"), 3), [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    return _embeddings(spark, sf_dir).select("id", r(east[0], 7).alias("ex"), r(east[1], 7).alias("ey"), *[r(c, 7).alias(n) for c, n in zip(north, ("nx", "ny", "nz"), strict=True)])


@query(f"WITH {_E}, m AS (SELECT id, x[1] AS t, 0.5 + abs(x[2]) AS r1, 0.2 + abs(x[3]) AS r2 FROM e) SELECT id, round(-ln(r1) - ln(r2), 7) + 0.0 AS log_root, round(r1 ** 2 * cos(t) ** 2 + r2 ** 2 * sin(t) ** 2, 7) AS g00, round((r1 ** 2 - r2 ** 2) * cos(t) * sin(t), 7) + 0.0 AS g01, round(r1 ** 2 * sin(t) ** 2 + r2 ** 2 * cos(t) ** 2, 7) AS g11 FROM m")
def metric_from_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = parts(F.col("x"), 3)
    log_root, g = geometry.metric_from_ranges(geometry.frame_from_angle(x[0]), [0.5 + F.abs(x[1]), 0.2 + F.abs(x[2])])
    return _embeddings(spark, sf_dir).select("id", r(log_root, 7).alias("log_root"), r(g[0][0], 7).alias("g00"), r(g[0][1], 7).alias("g01"), r(g[1][1], 7).alias("g11"))


@query(f"WITH {_E}, c AS (SELECT id, ((x[3] - x[1]) ** 2 + (x[4] - x[2]) ** 2) AS q, 1 + abs(x[5]) AS s, 2 + abs(x[6]) AS t FROM e) SELECT id, round(CASE WHEN abs(q * t - q * s) <= 1e-12 * greatest(q * s, q * t) THEN sqrt((q * s + q * t) / 2) ELSE 2.0::DOUBLE / 3 * ((q * t) ** 1.5::DOUBLE - (q * s) ** 1.5::DOUBLE) / (q * t - q * s) END, 6) AS distance FROM c")
def metric_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = parts(F.col("x"), 6)
    s, t, zero = 1 + F.abs(x[4]), 2 + F.abs(x[5]), F.lit(0.0)
    d = geometry.metric_distance(x[:2], x[2:4], [[s, zero], [zero, s]], [[t, zero], [zero, t]])
    return _embeddings(spark, sf_dir).select("id", r(d).alias("distance"))


_SUPPLIERS = f"s AS (SELECT s_suppkey AS b_id, {PLACE_SQL.format(k='s_suppkey * 31')} FROM supplier), sp AS (SELECT b_id, cos(radians(lon)) * cos(radians(lat)) AS x, sin(radians(lon)) * cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM s)"


def _supplier_places(spark: SparkSession, sf_dir: str, id_name: str) -> DataFrame:
    lon, lat = place(F.col("s_suppkey") * 31)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(id_name), F.array(*geometry.lonlat_to_xyz(lon, lat)).alias("x"))


def _angle(a, b):
    return geometry.great_circle(parts(a, 3), parts(b, 3), normalise=False)


@query(f"WITH {_CUSTOMERS}, {_SUPPLIERS} , d AS (SELECT id, min(struct_pack(d := round((p.x - sp.x) ** 2 + (p.y - sp.y) ** 2 + (p.z - sp.z) ** 2, 13), b := b_id)) AS m FROM p, sp GROUP BY id) SELECT id, m.b AS site_id, round(2 * asin(least(1, sqrt(m.d) / 2)), 6) + 0.0 AS distance FROM d")
def nearest_on_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest places by bins in space: chords order as angles do."""
    v = geometry.lonlat_to_xyz(F.col("lon"), F.col("lat"))
    left = _customers(spark, sf_dir).select(F.col("id").alias("point_id"), F.array(*v).alias("x"))
    near = locate.nearest(left, _supplier_places(spark, sf_dir, "site_id"), 3, 0.1)
    return near.select(F.col("point_id").alias("id"), "site_id", r(2 * F.asin(F.least(F.lit(1.0), F.col("distance") / 2))).alias("distance"))


@query(f"WITH {_SUPPLIERS}, n AS (SELECT n_nationkey AS n_id, {PLACE_SQL.format(k='n_nationkey::BIGINT * 1009')} FROM nation), np AS (SELECT n_id, cos(radians(lon)) * cos(radians(lat)) AS x, sin(radians(lon)) * cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM n) SELECT b_id AS a_id, n_id AS b_id, round(acos(greatest(-1, least(1, np.x * sp.x + np.y * sp.y + np.z * sp.z))), 6) + 0.0 AS distance FROM sp, np")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = place(F.col("n_nationkey").cast("long") * 1009)
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("b_id"), F.array(*geometry.lonlat_to_xyz(lon, lat)).alias("y"))
    out = locate.distances(_supplier_places(spark, sf_dir, "a_id"), b, _angle)
    return out.select("a_id", "b_id", r("distance").alias("distance"))


_H = "h AS (SELECT o_orderkey AS id, (o_orderkey % 97) / 40.0::DOUBLE AS d, o_totalprice AS v FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97 / 40.0).alias("d"), F.col("o_totalprice").alias("v"))


@query(f"WITH {_H}, k AS (SELECT id, d * sqrt(4.0::DOUBLE) / 0.48 AS a, d * sqrt(12.0::DOUBLE) / 0.48 AS b, d * sqrt(20.0::DOUBLE) / 0.48 AS c FROM h) SELECT id, round(exp(-a), 9) AS half, round((1 + b) * exp(-b), 9) AS three, round((1 + c + c * c / 3) * exp(-c), 9) AS five FROM k")
def matern_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("id", *[r(special.matern_by_range(F.col("d"), v, 0.48), 9).alias(n) for v, n in ((0.5, "half"), (1.5, "three"), (2.5, "five"))])


def _bessel_sql(order: float, x: str) -> str:
    """exp(x) K_order(x) by another integral than the library's: sqrt(pi / 2x) / Gamma(order + 1/2) times that of exp(-s) s^(order - 1/2) (1 + s / 2x)^(order - 1/2),
    over s = exp(u - exp(-u))."""
    each = f"exp(-exp(u - exp(-u)) + (u - exp(-u)) * {order + 0.5}::DOUBLE) * (1 + exp(-u)) * (1 + exp(u - exp(-u)) / (2 * ({x}))) ** {order - 0.5}::DOUBLE"
    return f"(sqrt(pi() / (2 * ({x}))) / gamma({order + 0.5}::DOUBLE) / 16 * list_sum([{each} FOR u IN [k / 16.0::DOUBLE FOR k IN range(-72, 73)]]))"


@query(f"WITH {_H}, k AS (SELECT id, d * sqrt(8 * 1.3::DOUBLE) / 0.48 AS x FROM h) SELECT id, round(CASE WHEN x < 1e-8 THEN 1 ELSE 2 ** (1 - 1.3::DOUBLE) / gamma(1.3::DOUBLE) * x ** 1.3::DOUBLE * {_bessel_sql(1.3, 'x')} * exp(-x) END, 8) AS correlation FROM k")
def matern_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("id", r(special.matern_by_range(F.col("d"), 1.3, 0.48), 8).alias("correlation"))


@query(f"WITH {_H} SELECT id, round(CASE WHEN 2 * d < 1e-8 THEN 0 ELSE -d * 2 ** (1 - 1.5::DOUBLE) / gamma(1.5::DOUBLE) * (2 * d) ** 1.5::DOUBLE * {_bessel_sql(0.5, '2 * d')} * exp(-2 * d) END, 8) + 0.0 AS by_kappa FROM h")
def matern_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("id", r(special.matern_derivatives(F.col("d"), 1.5, F.lit(2.0))[1], 8).alias("by_kappa"))


@query(f"WITH {_E}, k AS (SELECT id, sqrt(((x[1] * cos(0.7) + x[2] * sin(0.7)) / 0.3::DOUBLE) ** 2 + ((-x[1] * sin(0.7) + x[2] * cos(0.7)) / 0.1::DOUBLE) ** 2) * sqrt(12.0::DOUBLE) AS h FROM e) SELECT id, round((1 + h) * exp(-h), 8) AS correlation FROM k")
def matern_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = parts(F.col("x"), 2)
    a, b = geometry.frame_from_angle(F.lit(0.7))
    u = [(v[0] * x[0] + v[1] * x[1]) / s for v, s in ((a, 0.3), (b, 0.1))]
    return _embeddings(spark, sf_dir).select("id", r(special.matern_by_range(F.sqrt(u[0] * u[0] + u[1] * u[1]), 1.5, 1.0), 8).alias("correlation"))


@query(f"WITH {_H} SELECT id, round((v ** 0.3::DOUBLE - 1) / 0.3::DOUBLE, 6) AS forward, round(ln(v), 8) AS logged, round((v ** 0.3::DOUBLE * (0.3::DOUBLE * ln(v) - 1) + 1) / 0.09::DOUBLE, 5) AS slope FROM h")
def box_cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _orders(spark, sf_dir).select("id", r(marginals.box_cox(v, 0.3)).alias("forward"), r(marginals.box_cox(v, 0.0), 8).alias("logged"), r(marginals.box_cox_slope(v, 0.3), 5).alias("slope"))


@query(f"WITH {_H} SELECT id, round((0.5::DOUBLE * d + 1) ** 2.0::DOUBLE, 9) AS squared, round(exp(d), 8) AS raised FROM h")
def box_cox_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("id", r(marginals.box_cox_inverse(F.col("d"), 0.5), 9).alias("squared"), r(marginals.box_cox_inverse(F.col("d"), 0.0), 8).alias("raised"))


@query("SELECT ((l_orderkey * 8 + l_linenumber) * 67108864 + l_partkey * 1024 + l_suppkey % 1024) * 64 + l_quantity::BIGINT AS id, round(1 + 0.5 * cos(2 * pi() * l_quantity / 50) + 0.25 * cos(pi() * l_quantity / 50) * cos(3 * pi() * l_discount / 0.1::DOUBLE), 7) + 0.0 AS value FROM lineitem")
def cosine_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [F.col("l_quantity"), F.col("l_discount")]
    value = imaging.cosine_sum(x, {(0, 0): 1.0, (2, 0): 0.5, (1, 3): 0.25}, [0.0, 0.0], [50.0, 0.1])
    return table(spark, sf_dir, "lineitem").select(point_id().alias("id"), r(value, 7).alias("value"))


def _moments_sql(key: str, source: str) -> str:
    by = key.replace(" ", "")
    return (
        f"m AS (SELECT {key}, count(*) AS n, avg(value) AS mean, var_pop(value) AS variance FROM {source} GROUP BY {key}),"
        f" c AS (SELECT {key}, any_value(n) AS n, any_value(mean) AS mean, any_value(variance) AS variance, avg((value - mean) ** 3) / any_value(variance) ** 1.5::DOUBLE AS skewness,"
        f" avg((value - mean) ** 4) / any_value(variance) ** 2 - 3 AS kurtosis FROM {source} JOIN m USING ({by}) GROUP BY {key})"
    )


def _nig_sql(key: str, source: str) -> str:
    return _moments_sql(key, source) + f"""
, a AS (SELECT *, CASE WHEN kurtosis <= 0 THEN 0.1::DOUBLE ELSE kurtosis END AS k0 FROM c),
b AS (SELECT *, CASE WHEN 3 * k0 < 5 * skewness ** 2 THEN 2 * skewness ** 2 ELSE k0 END AS k, CASE WHEN 3 * k0 < 5 * skewness ** 2 THEN 0.0::DOUBLE ELSE skewness END AS s FROM a),
z AS (SELECT *, 3 / (k - 4.0::DOUBLE / 3 * s * s) AS z FROM b), y AS (SELECT *, s * sqrt(z) / 3 AS chi FROM z),
x AS (SELECT *, 1 / sqrt(1 - chi * chi) AS q, sqrt(variance * z) * sqrt(1 - chi * chi) AS delta FROM y),
w AS (SELECT *, z / delta * q AS alpha0 FROM x), v AS (SELECT *, CASE WHEN alpha0 * delta > 100 THEN 100 / (alpha0 * delta) ELSE 1 END AS f FROM w),
nig AS (SELECT {key}, n, alpha0 * f AS alpha, alpha0 * chi * f AS beta, mean - delta * alpha0 * chi / (z / delta) AS mu, delta FROM v)"""


_MOMENTS, _BY_MOMENTS = _moments_sql("event_type", "events"), _nig_sql("event_type", "events")



@query(f"WITH {_MOMENTS} SELECT event_type, n, round(mean, 6) AS mean, round(variance, 4) AS variance, round(skewness, 6) + 0.0 AS skewness, round(kurtosis, 6) + 0.0 AS kurtosis FROM c")
def nig_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = distributions.moments(table(spark, sf_dir, "events"), "event_type", "value")
    return m.select("event_type", "n", r("mean").alias("mean"), r("variance", 4).alias("variance"), r("skewness").alias("skewness"), r("kurtosis").alias("kurtosis"))


@query(f"WITH {_BY_MOMENTS} SELECT event_type, n, round(alpha, 5) AS alpha, round(beta, 5) + 0.0 AS beta, round(mu, 4) AS mu, round(delta, 4) AS delta FROM nig")
def nig_by_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = distributions.fit_by_moments(table(spark, sf_dir, "events"), "event_type", "value")
    return p.select("event_type", "n", r("alpha", 5).alias("alpha"), r("beta", 5).alias("beta"), r("mu", 4).alias("mu"), r("delta", 4).alias("delta"))


@query(f"WITH {_BY_MOMENTS}, g AS (SELECT *, sqrt(alpha ** 2 - beta ** 2) AS gm FROM nig) SELECT event_type, round(mu + delta * beta / gm, 4) AS mean, round(delta * alpha ** 2 / gm ** 3, 3) AS variance, round(3 * beta / (alpha * sqrt(delta * gm)), 5) + 0.0 AS skewness, round(3 * (1 + 4 * beta ** 2 / alpha ** 2) / (delta * gm), 5) AS kurtosis FROM g")
def nig_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = distributions.fit_by_moments(table(spark, sf_dir, "events"), "event_type", "value")
    s = marginals.nig_statistics(*[F.col(c) for c in ("alpha", "beta", "mu", "delta")])
    return p.select("event_type", r(s["mean"], 4).alias("mean"), r(s["variance"], 3).alias("variance"), r(s["skewness"], 5).alias("skewness"), r(s["kurtosis"], 5).alias("kurtosis"))


_LAW = "2.0::DOUBLE AS alpha, 0.6::DOUBLE AS beta, 4.0::DOUBLE AS mu, 15.0::DOUBLE AS delta"


@query(
    f"WITH s AS (SELECT event_id, (value - 4) / 15 AS x FROM events), q AS (SELECT *, sqrt(1 + x * x) AS q FROM s)"
    f" SELECT event_id, round(ln(30 / pi()) + sqrt(900 - 81.0::DOUBLE) + 9 * x - ln(q) + ln({_bessel_sql(1.0, '30 * q')}) - 30 * q - ln(15.0::DOUBLE), 6) + 0.0 AS log_density,"
    " round(ln(30 / pi()) + sqrt(900 - 81.0::DOUBLE) + 9 * x - ln(q) + 0.5 * ln(pi() / (60 * q)) - 30 * q - ln(15.0::DOUBLE), 6) + 0.0 AS tail FROM q"
)
def nig_log_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = [F.lit(c) for c in (2.0, 0.6, 4.0, 15.0)]
    return table(spark, sf_dir, "events").select("event_id", r(marginals.nig_log_pdf(F.col("value"), *law)).alias("log_density"), r(marginals.nig_tail_log_pdf(F.col("value"), *law)).alias("tail"))


@query()
def nig_fit_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.fit_gradient(table(spark, sf_dir, "events"), "event_type", "value")


@query()
def nig_fit_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty rounds at most; ``settled`` says whether they did. ``nig_fit_gradient`` gets there in fewer passes."""
    return distributions.fit_em(table(spark, sf_dir, "events"), "event_type", "value", rounds=30)


@query()
def nig_to_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return distributions.transformed(events, distributions.fit_by_moments(events, "event_type", "value"), "event_type", "event_id", "value", "to_gauss")


@query()
def nig_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return distributions.transformed(events, distributions.fit_by_moments(events, "event_type", "value"), "event_type", "event_id", "value", "cdf")


@query()
def nig_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw for each order from one law."""
    return distributions.nig_draws(_orders(spark, sf_dir).select("id"), 2.0, 0.6, 4.0, 15.0, seed=7)


_GRID = "i AS (SELECT DISTINCT (l_partkey % 64)::INTEGER AS k0, (l_suppkey % 32)::INTEGER AS k1 FROM lineitem), w AS (SELECT k0, k1, 2 * pi() * (CASE WHEN k0 <= 32 THEN k0 ELSE k0 - 64 END) / 20 AS a, 2 * pi() * (CASE WHEN k1 <= 16 THEN k1 ELSE k1 - 32 END) / 10 AS b FROM i), d AS (SELECT k0, k1, (1 + 0.3::DOUBLE * a * a + 0.1::DOUBLE * b * b) ** (-1.8::DOUBLE) AS g FROM w), s AS (SELECT k0, k1, g / avg(g) OVER () AS density FROM d)"


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).cast("int").alias("k0"), (F.col("l_suppkey") % 32).cast("int").alias("k1")).distinct()
    return fields.spectral_density(k, [64, 32], [20.0, 10.0], 0.8, [[0.3, 0.0], [0.0, 0.1]])


@query(f"WITH {_GRID} SELECT k0, k1, round(density, 8) AS density FROM s")
def spectral_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _density(spark, sf_dir).select("k0", "k1", r("density", 8).alias("density"))


@query(f"WITH {_GRID} SELECT round(sum(ln(density)), 5) AS log_determinant FROM s")
def spectral_log_determinant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.spectral_log_determinant(_density(spark, sf_dir)).select(r("log_determinant", 5).alias("log_determinant"))


@query()
def spectral_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw on the grid for each ship month."""
    reps = table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").cast("long").alias("rep")).distinct()
    return fields.spectral_sample(_density(spark, sf_dir), [64, 32], reps, seed=3)


@query(
    f"WITH {_GRID}, lag AS (SELECT a, b, sum(density * cos(2 * pi() * (k0 * a / 64.0::DOUBLE + k1 * b / 32.0::DOUBLE))) / 2048 AS c FROM s, range(64) p(a), range(32) q(b) GROUP BY a, b),"
    " x AS (SELECT month(l_shipdate)::BIGINT AS rep, (l_partkey % 64) AS u, (l_suppkey % 32) AS w, sum(l_discount) AS value FROM lineitem GROUP BY ALL),"
    " y AS (SELECT rep, p.i AS i, q.j AS j, sum(c * value) AS value FROM x, range(64) p(i), range(32) q(j), lag WHERE a = (p.i - u + 64) % 64 AND b = (q.j - w + 32) % 32 GROUP BY ALL)"
    " SELECT rep, i * 32 + j AS cell, round(value, 6) + 0.0 AS value FROM y"
)
def spectral_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance applied to each ship month's sums of discounts by cell. The SQL adds the covariance function over all pairs of cells."""
    t = table(spark, sf_dir, "lineitem")
    data = t.groupBy(F.month("l_shipdate").alias("rep"), ((F.col("l_partkey") % 64) * 32 + F.col("l_suppkey") % 32).alias("cell")).agg(F.sum("l_discount").alias("value"))
    return fields.spectral_covariance(_density(spark, sf_dir), [64, 32], data).select("rep", "cell", r("value").alias("value"))


def _match_sql(template: int, search: int) -> str:
    box = lambda n: f"(SELECT a, b FROM range(-{n}, {n} + 1) p(a), range(-{n}, {n} + 1) q(b) WHERE a * a + b * b <= {n * n})"
    return (
        f"f AS ({IMAGE_SQL.format(part=0)}), g AS ({IMAGE_SQL.format(part=1)}),"
        f" z AS (SELECT f.x - o.a AS x, f.y - o.b AS y, s.a AS sx, s.b AS sy, f.value AS u, g.value AS w FROM f, {box(search)} s, {box(template)} o, g WHERE g.x = f.x + s.a AND g.y = f.y + s.b),"
        " c AS (SELECT x, y, sx, sy, count(*) AS n, sum(u) AS su, sum(w) AS sw, sum(u * u) AS suu, sum(w * w) AS sww, sum(u * w) AS suw FROM z GROUP BY ALL),"
        " v AS (SELECT *, (suu - su * su / n) / (n - 1) AS vu, (sww - sw * sw / n) / (n - 1) AS vw FROM c WHERE n > 1),"
        " t AS (SELECT x, y, x + sx AS mx, y + sy AS my, round((suw / n - su / n * (sw / n)) / sqrt(vu * vw), 12) AS score FROM v WHERE vu > 1e-12 AND vw > 1e-12),"
        " b AS (SELECT x, y, min(struct_pack(s := -score, my := my, mx := mx)) AS b FROM t WHERE EXISTS (SELECT 1 FROM g WHERE g.x = mx AND g.y = my) GROUP BY x, y)"
    )


@query(f"WITH {_match_sql(2, 2)} SELECT f.x, f.y, b.b.mx AS mx, b.b.my AS my, round(-b.b.s, 6) + 0.0 AS score FROM f JOIN b ON b.x = f.x AND b.y = f.y")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that have a match, with its place."""
    m = imaging.match(image(spark, sf_dir, 0), image(spark, sf_dir, 1), 2, 2).where("score IS NOT NULL")
    return m.select("x", "y", "mx", "my", r("score").alias("score"))


@query(f"WITH {_match_sql(2, 2)} SELECT f.x, f.y, b.b.mx - f.x AS dx, b.b.my - f.y AS dy FROM f JOIN b ON b.x = f.x AND b.y = f.y WHERE -b.b.s >= 0.3")
def vector_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacements of the pixels whose match is good enough."""
    return imaging.vector_field(imaging.match(image(spark, sf_dir, 0), image(spark, sf_dir, 1), 2, 2), 0.3).where("dx IS NOT NULL")


def _filter_sql(f: str) -> str:
    return (
        f"WITH i AS ({IMAGE_SQL.format(part=0)}), o AS (SELECT a, b FROM range(-1, 2) p(a), range(-1, 2) q(b))"
        f" SELECT c.x, c.y, round({f}, 9) AS value FROM i c, o LEFT JOIN i n ON n.x = greatest(0, least(23, c.x + a)) AND n.y = greatest(0, least(19, c.y + b)) GROUP BY 1, 2"
    )


@query(_filter_sql("avg(n.value)"))
def mean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.filtered(image(spark, sf_dir, 0), 3, "mean", 24, 20).select("x", "y", r("value", 9).alias("value"))


@query(_filter_sql("quantile_cont(n.value, 0.5)"))
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.filtered(image(spark, sf_dir, 0), 3, "median", 24, 20).select("x", "y", r("value", 9).alias("value"))


@query("WITH p AS (SELECT s_suppkey AS id, (s_suppkey % 400)::DOUBLE AS x, ((s_suppkey * 7) % 11)::DOUBLE AS y, s_acctbal AS v FROM supplier), q AS (SELECT floor(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 2)::INTEGER AS bin, (a.v - b.v) ** 2 AS d FROM p a JOIN p b ON a.id < b.id) SELECT bin, count(*) AS n, round(sum(d) / (2 * count(*)), 2) AS gamma FROM q WHERE bin < 5 GROUP BY bin")
def empirical_variogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), F.array((F.col("s_suppkey") % 400).cast("double"), (F.col("s_suppkey") * 7 % 11).cast("double")).alias("x"), F.col("s_acctbal").alias("value"))
    return fields.variogram(s, 2, 2.0, 5).select("bin", "n", r("gamma", 2).alias("gamma"))


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) + 0.0 AS step FROM events")
def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.lagged(table(spark, sf_dir, "events"), "value", "event_id", "user_id").select("event_id", r("step").alias("step"))


@query("SELECT s_suppkey AS id, 'Point(' || s_suppkey || ') = {' || (s_suppkey % 400) || ', ' || ((s_suppkey * 7) % 11) || ', 0};' AS point, 'Line(' || s_suppkey || ') = {' || s_suppkey || ', ' || (s_suppkey + 1) || '};' AS line FROM supplier")
def geometry_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), meshes.geo_point(k, [k % 400, k * 7 % 11, F.lit(0)]).alias("point"), meshes.geo_line(k, k, k + 1).alias("line"))


def _window_sql() -> str:
    return "WITH e AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start FROM events), " + _nig_sql("start, event_type", "e")


@query(
    _window_sql() + " SELECT epoch(start)::BIGINT AS start, event_type, n, isfinite(delta) AND isfinite(mu) AND isfinite(alpha) AND isfinite(beta) AS fitted,"
    + ",".join(f" CASE WHEN isfinite(delta) AND isfinite(mu) AND isfinite(alpha) AND isfinite(beta) THEN round({c}, {k}) + 0.0 ELSE -1 END AS {c}" for c, k in (("alpha", 5), ("beta", 5), ("mu", 3), ("delta", 3))) + " FROM nig"
)
def windowed_nig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator on a finite table: every window, also those without spread, which no law fits (``fitted`` is false, parameters -1)."""
    from gridloom.streaming.moments import windowed_nig as fit

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = fit(e, "ts", "event_type", "value", "7 days", "1 day")
    fitted = F.lit(True)
    for c in ("alpha", "beta", "mu", "delta"):
        fitted = fitted & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    out = out.withColumn("fitted", fitted)
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "fitted", *[F.when(F.col("fitted"), r(c, k)).otherwise(-1.0).alias(c) for c, k in (("alpha", 5), ("beta", 5), ("mu", 3), ("delta", 3))])


def _field(spark: SparkSession, sf_dir: str):
    """A Matern field on a coarse grid over the points' box (quantity by discount, scaled to the unit square), its nodes, and observations with their simplices."""
    nodes, simplices = meshes.grid(spark, [-0.3, -0.3], [1.3, 1.3], 0.1)
    f = models.matern_field(nodes, simplices, 3, 2, fields.Matern(1.0, 0.5, 1.0, 2))
    t = table(spark, sf_dir, "lineitem")
    p = t.select(point_id().alias("point_id"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("x"), (F.log("l_extendedprice") - 10).alias("value"), F.lit(0.5).alias("sd"))
    return f, nodes, locate.located(p, nodes, simplices, 3, 2, 0.1, 1e-9, keep=("value", "sd"))


@query()
def grf_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and variances given the observations, each with its own noise, by the sparse factor."""
    f, nodes, at = _field(spark, sf_dir)
    normal = fields.folded(at, 3, every=True)
    q = exact.posterior_given(f, nodes, 2, normal)
    mean = exact.means_given(f, q, normal)
    out = exact.variances(f, q).join(mean.select("i", F.col("v").alias("mean")), "i")
    return out.select(F.col("i").alias("node_id"), "mean", F.col("v").alias("variance"))


@query()
def grf_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, nodes, at = _field(spark, sf_dir)
    normal = fields.folded(at, 3, every=True)
    value = exact.log_likelihood_given(f, nodes, 2, normal)
    return normal.sums.select(F.lit(value).alias("log_likelihood"), F.coalesce("seen", F.lit(0)).alias("n"))


@query()
def grf_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior covariance applied to the observations' load on the nodes."""
    f, nodes, at = _field(spark, sf_dir)
    load = fields.folded(at, 3).aty.select(F.lit(0).cast("long").alias("rep"), "i", "v")
    return exact.covariance_times(f, exact.prior(f, nodes, 2), load).select("rep", F.col("i").alias("node_id"), F.col("v").alias("value"))


@query()
def grf_posterior_mean_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(K + A^T Q A) x = A^T Q y by conjugate gradients on tables, on the mesh of the lineitems' cells."""
    from gridloom.plans.data import mesh

    nodes, simplices = mesh(spark, sf_dir)
    normal = fields.folded(locate.located(points(spark, sf_dir), nodes, simplices, 3, 2, 1.0, 1e-9, keep=("value", "sd")), 3)
    m = sparse.add((1.0, fem.system(nodes, simplices, 3, 2, 1.0, 1.0)), (1.0, normal.ata))
    return sparse.solve(m, normal.aty, tolerance=1e-4)


