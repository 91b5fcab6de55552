"""Every registered query of the library with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from gridloom.plans.registry import FLAGSHIP, ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def values(df):
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if v is None or v != v else v if isinstance(v, str) else float(v) for v in row))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = values(got), values(want)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-6)) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", ["nig_to_gauss", "nig_cdf", "nig_draws", "nig_fit_gradient", "spectral_sample", "field_implicit_mean", "field_realisations", "field_posterior_means"])
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
