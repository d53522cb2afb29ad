"""Operators that must not lose rows or make NaN outside the test tables."""

import math

import pytest
from pyspark.sql import functions as F

from gridstrata.operators import joins, windows


@pytest.mark.parametrize("cell", [0.001, 4.0])
def test_nearest_settles_far_points(spark, cell, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    points = [(1, 0.0, 0.0), (2, 500_000.0, 500_000.0), (3, -70.0, 12.0), (4, 1e-4, 0.0)]
    sites = [(10, 1.0, 1.0), (11, -80.0, 10.0), (12, 1.0, 1.0)]
    p = spark.createDataFrame(points, "pid long, x double, y double")
    s = spark.createDataFrame(sites, "sid long, x double, y double")
    got = {r.pid: r.sid for r in joins.nearest(p, "pid", s, "sid", "x", "y", cell).collect()}
    assert got == {i: min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in sites)[1] for i, x, y in points}


@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.8, 0.95, 1.0])
def test_ewm_equals_a_loop(spark, alpha):
    n = 3000
    df = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), ((F.col("id") * 37) % 101).cast("double").alias("v"))
    got = [r.ewm for r in windows.ewm(df, ["k"], "ts", "v", 3600, alpha).orderBy("ts").collect()]
    up = down = 0.0
    for i, e in enumerate(got):
        up, down = up * (1 - alpha) + (i * 37) % 101, down * (1 - alpha) + 1
        assert math.isclose(e, up / down, rel_tol=1e-9, abs_tol=1e-9)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_short_names_meet_names_that_hold_them(spark):
    known = ["xab", "b", "abc", "zz", "abcdefgh"]
    names = ["ab", "a", "xyz", "abc", "bcd", "z", "abcdefgx"]
    n = spark.createDataFrame([(1, x) for x in names], "block int, name string")
    k = spark.createDataFrame([(1, x) for x in known], "block int, name string")
    got = {r.name: r.matched for r in joins.match_names(n, k, "block", "name").collect()}
    for a in names:
        fits = [(-1 + distance(a, c) / max(len(a), len(c)), c) for c in known]
        fits = [f for f in fits if a in f[1] or f[1] in a or -f[0] > 0.8]
        assert got[a] == (min(fits)[1] if fits else a)
