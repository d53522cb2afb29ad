"""Streams equal their batch form, and rows behind the watermark are dropped."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridstrata.streaming import feeds

SCHEMA = "k long, ts timestamp, v double"


@pytest.fixture
def feed(spark, tmp_path):
    """Three files read one per batch; the last has a row far behind the watermark of the first.

    Rows are held against the watermark of the batch before, hence the file in between.
    """
    first = [(1, "2024-01-01 00:10", 1.0), (1, "2024-01-01 00:50", 5.0), (2, "2024-01-01 09:30", 2.0)]
    second = [(2, "2024-01-01 10:10", 7.0)]
    third = [(1, "2024-01-01 00:55", 99.0), (2, "2024-01-03 10:10", 3.0)]
    for i, rows in enumerate((first, second, third)):
        pdf = pd.DataFrame(rows, columns=["k", "ts", "v"]).assign(ts=lambda d: pd.to_datetime(d["ts"]))
        spark.createDataFrame(pdf).select(F.col("k").cast("long"), "ts", "v").coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    for i in range(3):
        part = next((tmp_path / f"part{i}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.parquet").write_bytes(part.read_bytes())
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return feeds.file_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)


def test_late_row_is_dropped(feed):
    out = feeds.run_to_end(feeds.hourly_max(feed, "k", "ts", "v"), "t").toPandas()
    got = {(r.k, r.hour.hour): r.peak for r in out.itertuples()}
    assert got == {(1, 0): 5.0, (2, 9): 2.0, (2, 10): 7.0}


def test_sessions_drop_late_row_and_close(feed):
    out = feeds.run_to_end(feeds.outage_sessions(feed, "k", "ts", "v"), "t").orderBy("k").toPandas()
    assert out["total"].tolist()[-1] == 9.0 and out["n"].tolist()[-1] == 2


def test_sliding_sum(feed):
    out = feeds.run_to_end(feeds.rolling_cost(feed, "k", "ts", "v"), "t")
    best = out.where("k = 2").groupBy("k").agg(F.max("cost")).first()[1]
    assert best == 9.0


def held_and_closed(spark, df, name):
    """Rows in the state after the first batch, and all rows of the sink."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress[0]["stateOperators"][0]["numRowsTotal"], spark.table(name)


def test_sliding_sums_hold_panes_and_take_late_rows_as_windows_do(spark, tmp_path):
    """Three files, one per batch: null and NaN values, null and large keys, windows over slices, rows partly and wholly late."""
    big = 2**60 + 1
    first = [(k, f"2024-01-{1 + i // 4:02d} {i % 4 * 6:02d}:{7 * i % 60:02d}", i + 0.25) for k in (1, big, None) for i in range(40)]
    first += [(1, "2024-01-03 05:10", None), (2, "2024-01-03 05:10", None), (3, "2024-01-03 06:00", float("nan")), (3, "2024-01-03 08:00", 1.0)]
    first += [(1, f"2024-01-04 {i // 4:02d}:{i % 4 * 15:02d}", 1.0 + i) for i in range(96)]
    second = [(2, "2024-01-10 19:00", 4.0), (1, "2024-01-10 19:20", 5.0)]
    third = [(1, "2024-01-10 15:10", 64.0), (2, "2024-01-10 16:40", 32.0), (1, "2024-01-05 00:00", 128.0), (None, "2024-01-12 00:00", 1.0)]
    for i, rows in enumerate((first, second, third)):
        df = spark.createDataFrame(rows, "k long, t string, v double").select("k", F.col("t").cast("timestamp").alias("ts"), "v")
        df.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        to = tmp_path / "in" / f"{i}.parquet"
        to.write_bytes(next((tmp_path / f"part{i}").glob("*.parquet")).read_bytes())
        os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))
    feed = feeds.file_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
    plain = feed.withWatermark("ts", "1 hour").groupBy("k", F.window("ts", "4 hours", "15 minutes").alias("w")).agg(F.sum("v").alias("cost"))
    many, want = held_and_closed(spark, plain.select("k", F.col("w.start").alias("start"), "cost"), "plain")
    few, got = held_and_closed(spark, feeds.rolling_cost(feed, "k", "ts", "v"), "panes")
    rows = lambda df: sorted(map(str, df.select("k", "start", "cost").collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 2000
    assert few <= 5 < 1000 < many


def test_sliding_sums_are_made_in_slices(monkeypatch):
    held = pd.DataFrame({"entity": [1] * 50 + [2] * 7, "pane": [*range(0, 100, 2), *range(7)], "total": 1.0, "known": True})
    want = pd.concat(feeds._windows(held, 16, 3, 5, 90), ignore_index=True)
    monkeypatch.setattr(feeds, "SLICE", 4)
    got = pd.concat(feeds._windows(held, 16, 3, 5, 90), ignore_index=True)
    assert got.equals(want)
    brute = {(e, s): float(((held.entity == e) & (held.pane >= s) & (held.pane < s + 16)).sum()) for e in (1, 2) for s in range(-15, 100, 3) if 5 < s + 16 <= 90}
    assert {(r.entity, r.start): r.total for r in got.itertuples()} == {k: v for k, v in brute.items() if v}


def test_dedup_and_enrich(spark, feed):
    static = spark.createDataFrame([(1, "a")], "k long, name string")
    rows = feeds.enrich(feeds.first_per_key(feed.withColumn("d", F.to_date("ts")), ["k", "d"], "ts"), static, ["k"])
    out = feeds.run_to_end(rows, "t").toPandas()
    assert sorted(zip(out["k"], out["d"].astype(str))) == [(1, "2024-01-01"), (2, "2024-01-01"), (2, "2024-01-03")]
    assert out[out["k"] == 2]["name"].isna().all()
