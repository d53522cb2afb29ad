"""Greedy interval matches against a plain loop, on chains; interval joins of very long intervals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridstrata.operators import evaluate, joins, matching

COLUMNS = "name string, start timestamp, stop timestamp, id long"


def sides(spark, truths, preds):
    def frame(rows):
        df = spark.createDataFrame([(n, int(a), int(z), i) for n, a, z, i in rows], "name string, a long, z long, id long")
        return df.select("name", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("z").alias("stop"), "id")

    return frame(truths), frame(preds)


def loop(truths, preds, scale):
    out = {}
    for name in {r[0] for r in truths + preds}:
        t = sorted((a, z, i) for n, a, z, i in truths if n == name and a < z)
        p = sorted((a, z, i) for n, a, z, i in preds if n == name and a < z)
        free, made = set(range(len(p))), []
        near = sorted(free, key=lambda k: p[k])
        for a, z, _ in t:
            best, pick = 0.0, None
            for k in near:
                inter = min(z, p[k][1]) - max(a, p[k][0])
                if k in free and inter > 0 and inter / (z - a + p[k][1] - p[k][0] - inter) > best:
                    best, pick = inter / (z - a + p[k][1] - p[k][0] - inter), k
            if pick is not None:
                free.remove(pick)
                inter = min(z, p[pick][1]) - max(a, p[pick][0])
                gap = p[pick][0] - a
                made.append((inter, z - a + p[pick][1] - p[pick][0] - inter, math.exp(-abs(gap) / scale / (5 if gap > 0 else 10))))
        n, nt, np_ = len(made), sum(r[0] == name for r in truths), sum(r[0] == name for r in preds)
        iou = sum(m[0] for m in made) / sum(m[1] for m in made) if made else 0
        start = sum(m[2] for m in made) / n if made else 0
        recall, precision = n / nt if nt else 0, n / np_ if np_ else 0
        f = 1.25 * precision * recall / (0.25 * precision + recall) if precision + recall else 0
        out[name] = (iou, start, recall, precision, f, (iou + 2 * start + 3 * f) / 6)
    return out


def check(spark, truths, preds, scale=10.0):
    got = {r.name: tuple(r)[1:] for r in evaluate.interval_score(*sides(spark, truths, preds), "name", scale).collect()}
    want = loop(truths, preds, scale)
    assert set(got) == set(want)
    for name in want:
        assert got[name] == pytest.approx(want[name], abs=1e-9), name
    return got


def test_golden_cases(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    same = [("perfect", 10 * i, 10 * i + 5, i) for i in range(5)]
    truths = same + [("apart", 0, 5, 1), ("empty", 3, 3, 1), ("only truth", 1, 2, 1), ("mixed", 0, 10, 1), ("mixed", 5, 15, 2), ("mixed", 5, 15, 3)]
    preds = [(n, a, z, i + 50) for n, a, z, i in same] + [("apart", 7, 9, 1), ("empty", 3, 3, 2), ("only pred", 1, 2, 1), ("mixed", 4, 14, 1), ("mixed", 4, 14, 2), ("mixed", 12, 30, 3)]
    got = check(spark, truths, preds)
    assert got["perfect"][-1] == pytest.approx(1.0) and got["apart"][-1] == 0.0 and got["only truth"][-1] == 0.0
    mean = evaluate.mean_interval_score(evaluate.interval_score(*sides(spark, truths, preds), "name", 10.0)).first()
    assert mean.n_names == len(got) and mean.score == pytest.approx(sum(g[-1] for g in got.values()) / len(got))


def test_random_intervals_with_ties(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(4)
    make = lambda n, base: [(rng.choice("ab"), s, s + rng.randrange(0, 30), base + i) for i in range(n) for s in [rng.randrange(0, 900)]]
    check(spark, make(700, 0), make(600, 5000))


def test_a_chain_of_ten_thousand_overlaps(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = 10_000
    truths = [("chain", 10 * i, 10 * i + 11, i) for i in range(n)]
    preds = [("chain", 10 * i + 1, 10 * i + 12, i) for i in range(n)]
    got = {r.name: r for r in evaluate.interval_score(*sides(spark, truths, preds), "name", 1.0).collect()}
    assert got["chain"].recall == got["chain"].precision == 1.0 and got["chain"].iou == pytest.approx(10 / 12)


def test_a_cascade_through_all_blocks(spark, tmp_path):
    """Every truth wants the partner of the one before it most, so each choice hangs on all choices before."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = 600
    pairs = [("k", i, i, p, float(g)) for i in range(n) for p, g in ((i - 1, 2), (i, 1)) if p >= 0]
    df = spark.createDataFrame(pairs, "name string, t_id long, t_order long, p_id long, gain double").withColumns({"p_order": F.col("p_id"), "place": F.col("t_order")})
    got = {r.t_id: r.p_id for r in matching.greedy(df, ["name"], "place", block=100).collect()}
    taken, want = set(), {}
    for i in range(n):
        want[i] = next(p for p in ((i - 1, i) if i else (0,)) if p not in taken)
        taken.add(want[i])
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_very_long_intervals_are_in_two_bins(spark, how):
    day = 86400
    spans = [(1, 0, 50 * 365 * day), (2, 10 * day, 10 * day), (3, 5, 86405), (4, 0, 20 * 365 * day), (5, None, 7), (6, 9, 3), (7, 400_000_000, 400_000_001), (7, 400_000_000, 400_000_001)]
    stamps = [0, 5, 86405, 10 * day, 365 * day, 49 * 365 * day, 60 * 365 * day, 400_000_001, None]
    a = spark.createDataFrame(spans, "i int, a long, z long").select("i", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("z").alias("z"), F.lit(None).cast("string").alias("note"))
    b = spark.createDataFrame([(t,) for t in stamps], "t long").select(F.timestamp_seconds("t").alias("t"))
    a, b = a.withColumn("k", F.lit(1)), b.withColumn("k", F.lit(1))
    got = joins.range_join(a, b, ["k"], "a", "z", "t", day, how)
    rows = sorted((r.i, None if r.t is None else int(r.t.timestamp())) for r in got.where("t IS NOT NULL").collect())
    assert rows == sorted((i, t) for i, x, z in spans for t in stamps if x is not None and t is not None and x <= t <= z)
    if how == "left":
        assert sorted(r.i for r in got.where("t IS NULL").collect()) == [5, 6]
    level = joins._length_class(F.col("a"), F.col("z"), day)
    ends = [joins._bin(F.col(c), level, day) for c in ("a", "z")]
    assert a.where("z >= a").select((ends[1] - ends[0]).alias("d")).agg(F.max("d")).first()[0] <= 1


def test_left_join_of_intervals_is_one_join(spark):
    day = 86400
    a = spark.createDataFrame([(1, 0, 3 * day), (1, 5 * day, 6 * day), (2, 0, day)], "k int, a long, z long").select("k", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("z").alias("z"))
    b = spark.createDataFrame([(1, 2 * day), (1, 3 * day)], "k int, t long").select("k", F.timestamp_seconds("t").alias("t"))
    got = joins.range_join(a, b, ["k"], "a", "z", "t", day, "left")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.k, r.t is not None) for r in got.collect()) == [(1, False), (1, True), (1, True), (2, False)]
