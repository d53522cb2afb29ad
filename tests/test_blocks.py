"""Block windows, carries, running totals, sessions, quantiles and ranks against plain pandas, with one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridstrata.operators import outages, ranks, windows
from gridstrata.operators.blocks import DAY, HOUR, carry, over_blocks, running
from gridstrata.operators.lags import reach, shift


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    parts = []
    for key, n in ((1, 400), (2, 7), (3, 1)):
        ts = pd.date_range("2024-01-01", periods=n, freq="h")
        parts.append(pd.DataFrame({"k": key, "ts": ts, "x": rng.integers(0, 50, n).astype(float)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame(series)


def back(df):
    return df.toPandas().sort_values(["k", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("lag", [1, -1, 5, -30])
def test_lag_crosses_blocks(frame, series, lag):
    out = over_blocks(frame, ["k"], "ts", lambda w: {"y": shift("x", lag, w)}, width=12 * HOUR, **reach([lag], HOUR))
    want = series.groupby("k")["x"].shift(lag)
    pd.testing.assert_series_equal(back(out)["y"], want, check_names=False)


def test_rolling_is_null_until_full(frame, series):
    out = back(windows.rolling_stats(frame, ["k"], "ts", "x", HOUR, (7,), ("mean", "std", "median")))
    roll = series.groupby("k")["x"].rolling(7)
    for name in ("mean", "std", "median"):
        want = getattr(roll, name)().reset_index(drop=True)
        pd.testing.assert_series_equal(out[f"{name}_7"], want, check_names=False)


def test_ewm(frame, series):
    want = series.groupby("k")["x"].transform(lambda s: s.ewm(alpha=0.2, adjust=True).mean())
    out = back(windows.ewm(frame, ["k"], "ts", "x", HOUR, 0.2))
    np.testing.assert_allclose(out["ewm"], want, rtol=1e-9)


@pytest.mark.parametrize("ahead", [False, True])
def test_carry(frame, series, ahead):
    out = back(carry(frame, ["k"], "ts", {"y": F.when(F.col("x") > 45, F.col("x"))}, ahead=ahead, width=DAY))
    marked = series["x"].where(series["x"] > 45)
    filled = marked.groupby(series["k"]).bfill() if ahead else marked.groupby(series["k"]).ffill()
    pd.testing.assert_series_equal(out["y"], filled, check_names=False)


def test_running(frame, series):
    out = back(running(frame, ["k"], "ts", {"y": F.col("x")}, width=DAY))
    np.testing.assert_allclose(out["y"], series.groupby("k")["x"].cumsum())


def test_runs(frame, series):
    out = back(windows.runs(frame, ["k"], "ts", "x", HOUR))
    want, run, prev = [], 0, {}
    for k, x in zip(series["k"], series["x"]):
        run = run + 1 if k in prev and x > prev[k] else 0
        prev[k] = x
        want.append(run)
    assert out["n_rises"].tolist() == want


def test_sessions_at_exact_gap(spark):
    at = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 17:59:59", "2024-01-02 11:59:59", "2024-02-20 00:00:00", "2024-02-20 01:00:00"])
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "ts": at, "v": [1.0, 2.0, 3.0, 4.0, 5.0]}))
    out = outages.sessions(df, ["k"], "ts", "v", 18 * HOUR, width=DAY).orderBy("session").toPandas()
    assert out["total"].tolist() == [3.0, 3.0, 9.0]
    assert out["first_value"].tolist() == [1.0, 3.0, 4.0]


@pytest.mark.parametrize("n", [1, 2, 9, 30001])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 3)
    pdf = pd.DataFrame({"k": 5, "x": x})
    probs = {"a": 0.0, "b": 0.03, "c": 0.5, "d": 0.97, "e": 1.0}
    got = ranks.exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", probs).first()
    np.testing.assert_allclose([got[c] for c in probs], np.quantile(x, list(probs.values())))


def test_exact_quantiles_null_and_constant(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (1, 2.0), (2, None)], "k int, x double")
    assert [tuple(r) for r in ranks.exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()] == [(1, 2.0)]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_value_ranks(spark, keys):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 5000), "x": rng.integers(0, 900, 5000)})
    got = ranks.value_ranks(spark.createDataFrame(pdf), keys, "x").toPandas()
    groups = pdf.groupby("k") if keys else [(0, pdf)]
    want = 0
    for k, g in groups:
        mine = got[got["k"] == k] if keys else got
        lower = np.sort(g["x"].to_numpy())
        assert (mine["below"].to_numpy() == np.searchsorted(lower, mine["x"].to_numpy())).all()
        assert (mine["total"] == len(g)).all()
        want += g["x"].nunique()
    assert len(got) == want
