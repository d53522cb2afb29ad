"""Operators that SQL does not state, against brute force on small fixtures; golden metric values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridstrata.functions import calendar as cal
from gridstrata.operators import cluster, cube, evaluate, graph, joins, peaks, splits


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = graph.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()
    roots = {r["node"]: r["component"] for r in got}
    assert all(roots[i] == 1 for i in range(1, 41))
    assert roots[100] == roots[101] == roots[103] == 100


def test_merge_similar_keeps_the_largest(spark):
    rows = [(1, 10, 0.0, 0.0, 5), (1, 11, 0.1, 0.1, 9), (1, 12, 0.3, 0.2, 2), (1, 13, 5.0, 5.0, 1), (2, 14, 0.1, 0.1, 1)]
    df = spark.createDataFrame(rows, "h int, id int, lat double, lon double, size int")
    out = graph.merge_similar(df, "h", "id", {"lat": 0.25, "lon": 0.25}, "size", F.col("lat"))
    assert sorted(r["id"] for r in out.collect()) == [11, 13, 14]


@pytest.mark.parametrize("seed", range(4))
def test_nearest(spark, seed):
    rng = np.random.default_rng(seed)
    p, s = rng.uniform(0, 100, (40, 2)), rng.uniform(0, 100, (5 + 10 * seed, 2))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "pid int, x double, y double")
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(s)], "sid int, x double, y double")
    got = {r["pid"]: r["sid"] for r in joins.nearest(pts, "pid", sites, "sid", "x", "y", 2.0).collect()}
    assert got == {i: int(np.argmin(((s - q) ** 2).sum(1))) for i, q in enumerate(p)}


def plain_peaks(x, distance, prominence):
    """Position, prominence and distances to the bases, by walking from every peak."""
    change = np.flatnonzero(np.diff(x) != 0)
    starts, stops = np.r_[0, change + 1], np.r_[change, len(x) - 1]
    at = [(a + z) // 2 for a, z in zip(starts, stops) if a > 0 and z < len(x) - 1 and x[a] > x[a - 1] and x[z] > x[z + 1]]
    kept = []
    for p in sorted(at, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        bases = []
        for way in (-1, 1):
            i, low, base = p, x[p], p
            while 0 <= i < len(x) and x[i] <= x[p]:
                if x[i] < low:
                    low, base = x[i], i
                i += way
            bases.append((low, abs(base - p)))
        high = x[p] - max(b[0] for b in bases)
        if high >= prominence:
            out.append((int(p), float(high), int(bases[0][1]), int(bases[1][1])))
    return out


def found_peaks(spark, series, distance, prominence):
    rows = [(k, i * 3600, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, t long, v double").select("k", F.timestamp_seconds("t").alias("ts"), "v")
    out = {k: [] for k in series}
    for r in peaks.peak_detect(df, "k", "ts", "v", distance, prominence).collect():
        out[r.k].append((int(r.ts.timestamp() // 3600), r.prominence, r.start_ago, r.end_in))
    return {k: sorted(v) for k, v in out.items()}


def test_peaks(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    x = np.array([0, 50, 10, 90, 90, 20, 60, 5, 5, 40, 0], float)
    assert plain_peaks(x, 1, 30) == [(1, 40.0, 1, 1), (3, 90.0, 3, 7), (6, 40.0, 1, 4), (9, 35.0, 1, 1)]
    rng = np.random.default_rng(1)
    long = rng.integers(0, 100, 40_000).astype(float)
    long[9_000:31_000] = np.minimum(long[9_000:31_000], 3)  # the next higher sample is groups of blocks away
    long[20_000] = 98.0
    series = {
        1: x, 2: np.zeros(5), 3: rng.integers(0, 6, 700), 4: np.repeat(rng.integers(0, 9, 90), rng.integers(1, 400, 90)), 5: long,
        6: np.ravel(np.column_stack([np.zeros(40), np.arange(40, 0, -1)])), 7: np.array([5.0]), 8: rng.normal(size=900).cumsum()}  # 6: a staircase of peaks
    for distance, prominence in ((1, 30), (4, 30), (6, 0.5)):
        assert found_peaks(spark, series, distance, prominence) == {k: plain_peaks(np.asarray(v, float), distance, prominence) for k, v in series.items()}


def spans(spark, rows):
    df = spark.createDataFrame(rows, "name string, id long, a long, z long")
    return df.select("name", "id", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("z").alias("stop"))


def test_interval_score_goldens(spark):
    true = spans(spark, [("perfect", 1, 10, 20), ("perfect", 2, 30, 45), ("apart", 1, 10, 20), ("late", 1, 0, 100), ("greedy", 1, 0, 10), ("greedy", 2, 8, 20)])
    pred = spans(spark, [("perfect", 1, 10, 20), ("perfect", 2, 30, 45), ("apart", 1, 20, 30), ("late", 1, 10, 110), ("late", 2, 300, 310), ("greedy", 1, 6, 20)])
    got = {r["name"]: r for r in evaluate.interval_score(true, pred, "name").collect()}
    assert got["perfect"]["score"] == pytest.approx(1.0)
    assert got["apart"]["score"] == 0.0
    late = got["late"]
    assert late["iou"] == pytest.approx(90 / 110) and late["near"] == pytest.approx(math.exp(-2)) and late["precision"] == 0.5
    # The first truth takes the only prediction although it fits the second better.
    assert got["greedy"]["iou"] == pytest.approx(4 / 20) and got["greedy"]["recall"] == 0.5


def sequential_distinct(cands, tau, n_max):
    kept = []
    for rank, c in cands:
        far = all(np.mean([np.linalg.norm(np.subtract(a, b)) for a, b in zip(sorted(c), sorted(k))]) > tau for _, k in kept)
        if far:
            kept.append((rank, c))
        if len(kept) >= n_max:
            break
    return [r for r, _ in kept]


def test_distinct_candidates(spark):
    rng = np.random.default_rng(2)
    data = {s: [(i, [tuple(map(float, v)) for v in rng.uniform(0, 1, (2, 3))]) for i in range(9)] for s in range(5)}
    rows = [(s, i, [{"x": a, "y": b, "q": c} for a, b, c in src]) for s, cs in data.items() for i, src in cs]
    df = spark.createDataFrame(rows, "sample int, rank int, sources array<struct<x:double,y:double,q:double>>")
    out = evaluate.distinct_candidates(df, "sample", "rank", "sources", 0.5, 3, (1.0, 1.0, 1.0)).collect()
    for s, cs in data.items():
        assert sorted(r["rank"] for r in out if r["sample"] == s) == sequential_distinct(cs, 0.5, 3)


def test_distinct_candidates_are_walked_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cands = {s: [(i, [tuple(map(float, v)) for v in rng.uniform(0, 1, (2, 3))]) for i in range(3 + 6 * s)] for s in range(5)}
    rows = [(s, i, [{"x": a, "y": b, "q": c} for a, b, c in src], k) for s, cs in cands.items() for i, src in cs for k in range(1 + (i % 3 == 0))]  # some come twice
    at = lambda v: [{"x": v, "y": v, "q": v}]
    # no sample, no rank (takes a round and stays away), one rank twice: both rows go with the one that is kept
    rows += [(None, 1, at(0.0), 0), (7, None, at(0.0), 0), (7, 1, at(0.1), 1), (7, 2, at(9.0), 2), (7, 2, at(0.2), 3), (7, 3, at(9.1), 4), (7, 4, at(20.0), 5), (7, 5, at(30.0), 6)]
    df = spark.createDataFrame(rows, "sample int, rank int, sources array<struct<x:double,y:double,q:double>>, n int")
    written = []
    monkeypatch.setattr(evaluate, "checkpoint", lambda d, real=evaluate.checkpoint: (written.append(d), real(d))[1])
    for whole in (cube.WHOLE, 10, 0):  # all samples in one pass, the larger ones in rounds, all in rounds
        monkeypatch.setattr(cube, "WHOLE", whole)
        out = evaluate.distinct_candidates(df, "sample", "rank", "sources", 0.5, 3, (1.0, 1.0, 1.0))
        assert out.columns == df.columns
        got = out.collect()
        assert (len(written) == 0) == (whole > 10)  # nothing that is left is written
        for s, cs in cands.items():
            keep = sequential_distinct(cs, 0.5, 3)
            assert sorted((r["rank"], r["n"]) for r in got if r["sample"] == s) == sorted((i, k) for i in keep for k in range(1 + (i % 3 == 0)))
        assert sorted((r["rank"], r["n"]) for r in got if r["sample"] == 7) == [(2, 2), (2, 3), (4, 5)] and not [r for r in got if r["sample"] is None]


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(2000).select("id", F.lit("a").alias("g"), (F.col("id") % 10).cast("double").alias("e"))
    r = evaluate.bootstrap(df, ["g"], "id", F.col("e")).first()
    assert r["low"] < 4.5 < r["high"] and r["n_reps"] == 50 and r["high"] - r["low"] < 0.5


def test_folds_are_balanced(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3).alias("c"))
    sizes = splits.kfold(df, "id", 5, ["c"]).groupBy("c", "fold").count().toPandas()
    assert len(sizes) == 15 and sizes.groupby("c")["count"].agg(lambda s: s.max() - s.min()).max() <= 1


def test_ranking_scores_with_ties(spark):
    y = [1, 0, 1, 1, 0, 0, 1]
    p = [0.9, 0.9, 0.8, 0.4, 0.4, 0.1, 0.1]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(y, p)], "k int, y int, p double")
    r = evaluate.ranking_scores(df, ["k"], "y", "p").first()
    pairs = [(a, b) for a, b in itertools.product(range(7), repeat=2) if y[a] == 1 and y[b] == 0]
    want = np.mean([1.0 if p[a] > p[b] else 0.5 if p[a] == p[b] else 0.0 for a, b in pairs])
    assert r["auc_roc"] == pytest.approx(want)
    assert r["brier"] == pytest.approx(np.mean((np.array(p) - np.array(y)) ** 2))


def test_sun_events(spark):
    df = spark.createDataFrame([("2024-03-20 12:00:00",), ("2024-06-21 12:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    rows = df.select("ts", *[c.alias(n) for n, c in cal.minutes_to_sun_event("ts", F.lit(51.5), F.lit(0.0)).items()]).orderBy("ts").collect()
    spring, summer = ((r["to_sunset"] - r["to_sunrise"]) / 60 for r in rows)
    assert 11.8 < spring < 12.5 and 16.3 < summer < 16.9
    assert all(r["to_dawn"] < r["to_sunrise"] < r["to_noon"] < r["to_sunset"] < r["to_dusk"] for r in rows)


def test_silhouette_rows_match_pairs(spark):
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(0, 1, (12, 2)), rng.normal(5, 1, (9, 2))]
    labels = [0] * 12 + [1] * 9
    df = spark.createDataFrame([(i, c, float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(labels, x))], "id int, cluster int, a double, b double")
    got = cluster.silhouette_rows(cluster.assemble(df, ["a", "b"], scale=False), "id").orderBy("id").toPandas()["silhouette"]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    c = np.array(labels)
    for i in range(len(x)):
        same = c == c[i]
        inner, other = d[i, same].sum() / (same.sum() - 1), d[i, ~same].mean()
        assert got[i] == pytest.approx((other - inner) / max(other, inner))


def test_kshape_separates_shapes(spark):
    t = np.linspace(0, 2 * np.pi, 24)
    rows = [(i, np.sin(t + 0.05 * i).tolist()) for i in range(6)] + [(i, np.sign(np.sin(3 * t + 0.05 * i)).tolist()) for i in range(6, 12)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    got = cluster.kshape(df, "id", "x", 2, rounds=4, seed=3).orderBy("id").toPandas()["cluster"].tolist()
    assert len(set(got[:6])) == 1 and len(set(got[6:])) == 1 and got[0] != got[6]


def test_fuzzy_names_equal_brute_force(spark):
    known = ["north harbour", "new haven", "york", "st john", "elk"]
    typed = ["North Harbor", "newhaven", "york county", "elk", "st. john", "nowhere"]
    k = spark.createDataFrame([("s", n) for n in known], "state string, name string")
    n = spark.createDataFrame([("s", x) for x in typed], "state string, name string")
    got = {r["name"]: r["matched"] for r in joins.match_names(n, k, "state", "name").collect()}
    assert got == {"North Harbor": "north harbour", "newhaven": "new haven", "york county": "york", "elk": "elk", "st. john": "st john", "nowhere": "nowhere"}


def test_dice_of_empty_samples(spark):
    none = spark.createDataFrame([], "sample int, i int")
    some = spark.createDataFrame([(1, 4), (1, 5)], "sample int, i int")
    samples = spark.createDataFrame([(1,), (2,)], "sample int")
    got = {r["sample"]: r["dice"] for r in evaluate.dice_binary(some, none, "sample", ["i"], samples).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_hinge_fit_recovers_break(spark):
    x = np.arange(-10, 30, 0.5)
    y = np.where(x < 12, 24 - 2 * x, 0.0)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y}))
    r = cluster.hinge_fit(df, ["k"], "x", "y").first()
    assert r["slope"] == pytest.approx(-2, abs=0.1) and 10 < r["t"] < 14


def test_hinge_gap_equals_counted_break_points(spark):
    """The arithmetic gap puts every row where counting the break points puts it, rows on a break point included."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(-20, 40, 400), np.arange(-20, 41, 0.3), [-20.0, 40.0]])
    y = np.where(x < 10, 20 - 2 * x, 0.0) + rng.normal(0, 0.1, len(x))
    pdf = pd.DataFrame({"k": 1, "x": x, "y": y})
    got = cluster.hinge_fit(spark.createDataFrame(pdf), ["k"], "x", "y").first()
    a, z = x.min() + 3, x.max() - 3
    best = None
    for i in range(20):
        t = a + (z - a) / 20 * i
        low = x < t
        slope, intercept = np.polyfit(x[low], y[low], 1)
        rmse = round(float(np.sqrt((((y - slope * x - intercept)[low] ** 2).sum() + (y[~low] ** 2).sum()) / len(x))), 9)
        if best is None or rmse < best[0]:
            best = rmse, t, slope, intercept
    assert np.allclose([got.rmse, got.t, got.slope, got.intercept], best, atol=1e-6)


def test_range_work_keeps_years_apart(spark):
    """The same weeks of two years, flat in the second: its rises count as own months."""
    from gridstrata.operators import profile

    ts = list(pd.date_range("2023-03-06", periods=14 * 24, freq="h")) + list(pd.date_range("2024-03-04", periods=14 * 24, freq="h"))
    v = [10.0 if t.year == 2023 and t.hour >= 8 else 1.0 for t in ts]
    pdf = pd.DataFrame({"k": 1, "ts": ts, "v": v})
    df = spark.createDataFrame(pdf).repartition(2)
    one = df.where("year(ts) = 2023")
    both = profile.robust_increment(df, "k", "ts", "v", 3600, "hour", [5]).first()
    alone = profile.robust_increment(one, "k", "ts", "v", 3600, "hour", [5]).first()
    assert alone.increment_hour_5 > 0 and abs(both.increment_hour_5 - alone.increment_hour_5 / 2) < 1e-9
