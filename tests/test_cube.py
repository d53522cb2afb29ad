"""Roll-ups and exact rank facts against plain loops, on odd values."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstrata.operators import cube


def test_bins_never_fall(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1e-320, -1e-320, 5e-324, 1.0, 2.0, math.nextafter(2.0, 0), math.nextafter(4.0, 9), 1e308, -1e308, float("inf"), float("-inf")]
    xs += [math.ldexp(1, e) * s for e in range(-60, 60) for s in (1, -1, 1 + 2**-52, 1 - 2**-53)] + [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", cube.magnitude_bin("x").alias("b")).collect()
    ordered = sorted(rows, key=lambda r: (r.x, r.b))
    assert all(a.b <= b.b for a, b in zip(ordered, ordered[1:]))
    assert spark.sql("SELECT CAST('NaN' AS DOUBLE) AS x").select(cube.magnitude_bin("x")).first()[0] > max(r.b for r in rows)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    groups = {
        1: rng.normal(0, 5, 4000), 2: np.full(500, 3.25), 3: np.array([7.0]), 4: rng.integers(0, 4, 3000) * 1.0, 5: 1 + rng.random(9000) / 1e6,
        6: np.array([-1.0, 2.0]), 7: rng.exponential(3, 501), 8: np.zeros(30), 9: np.concatenate([np.zeros(50), [1e9]])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    return groups, spark.createDataFrame(rows, "g int, x double").groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))


def test_quantiles_equal_numpy(values):
    groups, df = values
    probs = {f"p{i}": i / 100 for i in (0, 1, 10, 25, 50, 75, 90, 99, 100)}
    for r in cube.quantiles(df, ["g"], probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.g], p), rel=1e-12, abs=1e-12), (r.g, name)


def test_sums_below_ranks_and_numbers(values):
    groups, df = values
    n = F.col("n")
    facts = cube.rank_facts(df, ["g"], {"third": F.floor(n / 3), "outside": n + 5}, {"mean": F.col("total") / n, "low": F.lit(-1e12), "high": F.lit(1e12)}).collect()
    assert len(facts) == len(groups)
    for r in facts:
        x = np.sort(groups[r.g])
        k = len(x) // 3
        assert r.n == len(x) and r.third == x[k] and r.outside is None and r.third_under == pytest.approx(x[:k].sum(), abs=1e-6)
        under = x[x < r.total / r.n]
        assert r.mean_count == len(under) and r.mean_under == pytest.approx(under.sum(), abs=1e-6)
        assert (r.low_count, r.low_under, r.high_count) == (0, 0.0, len(x)) and r.high_under == pytest.approx(x.sum())


def test_distribution_equals_a_plain_reading(values):
    groups, df = values
    for r in cube.distribution(df, ["g"], {"p95": 0.95}).collect():
        x = np.sort(groups[r.g])
        k = int(len(x) * 0.1)
        mid = x[k : len(x) - k]
        assert r.p95 == pytest.approx(np.quantile(x, 0.95))
        assert r.trimmed_mean == pytest.approx(mid.mean(), rel=1e-9, abs=1e-9) and r.trimmed_range == pytest.approx(mid.max() - mid.min())
        assert r.mean_abs_dev == pytest.approx(np.abs(x - x.mean()).mean(), rel=1e-6, abs=1e-9)
        assert r.median_abs_dev == pytest.approx(np.median(np.abs(x - np.median(x))), rel=1e-9, abs=1e-12)
        assert (r.geometric_mean is None) == (not (x > 0).any())
        if (x > 0).any():
            assert r.geometric_mean == pytest.approx(np.exp(np.log(x[x > 0]).mean()))


def test_roll_ups_equal_plain_groups(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), f"2020-0{rng.randrange(1, 6)}-{rng.randrange(1, 28):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", rng.choice([None, rng.gauss(50, 20)]), rng.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, t string, a double, b double").withColumn("t", F.to_timestamp("t"))
    groupings = {"month": F.month("day"), "half": F.when(F.hour("day") + F.col("hour") < 12, "am"), "all": F.lit("all")}
    got = cube.roll_up(cube.cells(df, ["k"], "t", ["a", "b"], "a"), ["k"], groupings, ["a", "b"])
    got = {(r.k, r.grouping, r.bucket): r for r in got.withColumns({"std": cube.statistic("a", "std"), "mean": cube.statistic("a", "mean")}).collect()}
    want = defaultdict(list)
    for k, t, a, _ in rows:
        for g, b in (("month", str(int(t[5:7]))), ("half", "am" if int(t[11:13]) < 12 else ""), ("all", "all")):
            want[k, g, b].append(a)
    assert set(got) == set(want)
    for key, xs in want.items():
        known = [x for x in xs if x is not None]
        r = got[key]
        assert r.rows == len(xs) and r.n_a == len(known) and r.lo_a == min(known) and r.hi_a == max(known)
        assert r.mean == pytest.approx(np.mean(known)) and r.std == pytest.approx(np.std(known, ddof=1))


def test_one_read_of_the_input(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("id % 7 AS k", "timestamp_seconds(id * 3000) AS t", "CAST(id % 13 AS double) AS a").write.parquet(path)
    states = cube.written(cube.cells(spark.read.parquet(path), ["k"], "t", ["a"], "a"), "cells")
    groupings = {"month": F.month("day"), "hour": F.col("hour")}
    out = cube.roll_up(states, ["k"], groupings, ["a"]).join(cube.quantiles(cube.by_bucket(states, ["k"], groupings), ["k", "grouping", "bucket"], {"m": 0.5}), ["k", "grouping", "bucket"])
    assert path not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() > 0


def test_groups_as_arrays_equal_bins(spark, values):
    """Both ways through groups give the same, with null values, equal values and groups without a name."""
    groups, df = values
    rows = df.withColumn("x", F.explode(F.array_repeat("x", F.col("c").cast("int")))).select("g", "x", F.lit(1).cast("bigint").alias("c"))
    odd = spark.createDataFrame([(90, 1.0, 1), (90, None, 1), (90, 4.0, 1), (90, 5.0, 1), (91, None, 1), (None, 1.0, 1), (92, None, 1), (92, None, 1), (92, 3.0, 1)], "g int, x double, c long")
    both = rows.unionByName(odd)
    probs = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p100": 1.0}
    rounded = lambda d: {r.g: tuple(None if v is None else float(f"{v:.7g}") if abs(v) > 1e-7 else 0.0 for v in r) for r in d.collect()}
    assert rounded(cube.ordered_distribution(cube.ordered(both, ["g"]), ["g"], probs)) == rounded(cube.distribution(both, ["g"], probs))
    some = both.where("x IS NOT NULL")
    assert rounded(cube.quantiles(some, ["g"], probs, True)) == rounded(cube.quantiles(some, ["g"], probs))
    assert rounded(cube.shapes(some, ["g"], True).select("g", "med", "hi")) == rounded(cube.shapes(some, ["g"]).select("g", "med", "hi"))


def test_rows_are_dealt_out_once(spark, small, monkeypatch):
    """Nothing of the cube of ordinary keys is shuffled after its rows, and crowded keys give the same rows."""
    from gridstrata.plans import cubes

    plan = cubes.agg_distribution_groups(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") > 0
    made = {n: getattr(cubes, n) for n in ("agg_distribution_groups", "agg_bucket_shapes", "agg_profile_products", "agg_calendar_extremes")}
    rows = lambda f: sorted(map(str, f(spark, small).collect()))
    before = {n: rows(f) for n, f in made.items()}
    monkeypatch.setattr(cube, "WHOLE", 600)
    whole = []
    real = cube.spread
    monkeypatch.setattr(cube, "spread", lambda df, *a, **k: (whole.append(df.count()), real(df, *a, **k))[1])
    for n, f in made.items():
        assert rows(f) == before[n], n
    assert 0 < whole[0] < spark.read.parquet(f"{small}/lineitem.parquet").count()
