"""Nearest sites and zonal statistics of crowded places: the same as by all pairs, from few candidates."""

import math

import numpy as np
import pytest

from gridstrata.operators import joins, spatial


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(5)
    xs = [(i, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(rng.random(6000), rng.random(6000), rng.normal(size=6000)))]
    xs += [(6000, None, 0.5, 1.0), (6001, 0.25, 0.25, None), (6002, 0.25, 0.25, 3.0), (6003, 40.0, -3.0, 1.0)]
    return xs, spark.createDataFrame(xs, "id int, x double, y double, v double")


def test_nearest_of_a_crowd(spark, crowd, monkeypatch):
    xs, df = crowd
    sites = spark.createDataFrame([(i % 2500, x, y) for i, x, y, _ in xs[:2500]] + [(9, 0.25, 0.25), (8, 0.25, 0.25)], "sid int, x double, y double")
    levels = []
    monkeypatch.setattr(joins, "checkpoint", lambda d, real=joins.checkpoint: (levels.append(d), real(d))[1])
    got = {r.id: (r.sid, r.d2) for r in joins.nearest(df.select("id", "x", "y"), "id", sites, "sid", "x", "y", 4.0).collect()}
    s = np.array([(i, x, y) for i, x, y, _ in xs[:2500]] + [(9, 0.25, 0.25), (8, 0.25, 0.25)])
    for i, x, y, _ in xs:
        if x is None:
            assert i not in got
            continue
        d2 = (s[:, 1] - x) ** 2 + (s[:, 2] - y) ** 2
        assert got[i][1] == pytest.approx(d2.min(), abs=1e-15) and got[i][0] == s[d2 == d2.min(), 0].min()
    assert len(levels) > 2  # one level of cells of 4 would hold all sites in each cell


def test_zonal_stats_of_a_crowd(spark, crowd, monkeypatch):
    xs, df = crowd
    zones = [(1, 0.5, 0.5), (2, 0.0, 0.0), (3, 0.25, 0.25), (4, 90.0, 0.0), (5, None, 1.0), (6, 1.25, 0.5), (3, 0.9, 0.9)]
    z = spark.createDataFrame(zones, "sid int, x double, y double")
    for halvings in (8, 0):
        monkeypatch.setattr(spatial, "HALVINGS", halvings)
        got = {r.sid: r for r in spatial.zonal_stats(df, z, "sid", "x", "y", 0.25, "v").distinct().collect()}
        for sid in {q[0] for q in zones}:
            near = [v for k, a, b in zones if k == sid and a is not None for _, x, y, v in xs if x is not None and v is not None and (x - a) ** 2 + (y - b) ** 2 <= 0.0625]
            assert got[sid].n == len(near)
            if near:
                assert got[sid].mean == pytest.approx(math.fsum(near) / len(near), abs=1e-9) and (got[sid].low, got[sid].high) == (min(near), max(near))
            else:
                assert got[sid].mean is None and got[sid].low is None


def test_squares_of_zones_pass_by_the_driver(spark, crowd):
    """A few zones become many squares; a broadcast would bring them all to the driver."""
    _, df = crowd
    z = spark.range(2).selectExpr("id AS sid", "id / 2.0D AS x", "0.5D AS y")  # of a size that the engine knows
    plan = spatial.zonal_stats(df, z, "sid", "x", "y", 0.25, "v")._jdf.queryExecution().executedPlan().toString()
    met = [line for line in plan.splitlines() if "Join " in line and "_cx" in line]
    assert len(met) > 2 and all("SortMergeJoin" in line for line in met), met
