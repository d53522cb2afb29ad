"""Every query that SQL can state equals its DuckDB twin; every other one runs and yields rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
MODELS = {
    "kmeans_profiles", "gmm_soft", "kshape_profiles", "silhouette", "pca_loadings", "soft_cluster_prob", "forest_importance",
    "forest_predict_raster", "two_level_residual", "route_hierarchical",
}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    assert compare(got, duck.execute(ORACLES[name]).fetchdf()) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_yields_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and "mean_hour_0" in df.columns
