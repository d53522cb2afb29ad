"""Complete axes reach as far as the data, whatever their dates."""

from pyspark.sql import functions as F

from gridstrata.functions import arrays
from gridstrata.operators import outages, peaks
from gridstrata.operators.resample import spine_fill

HOUR, DAY = 3600, 86400


def stamps(spark, rows, *names):
    schema = "k string, " + ", ".join(f"{n} string" for n in names if n != "v") + (", v double" if "v" in names else "")
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({n: F.to_timestamp(n) for n in names if n != "v"})


def test_spine_fill_keeps_readings_of_other_years(spark):
    rows = [("a", "2023-12-31 22:00:00", 1.0), ("b", "2024-02-01 03:00:00", 2.0), ("a", "2023-12-31 22:00:00", 4.0), ("a", None, 9.0)]
    got = spine_fill(stamps(spark, rows, "ts", "v"), ["k"], "ts", "v", "1 hour")
    assert got.count() == 2 * (31 * 24 + 6)
    assert {(r.k, str(r.ts), r.v) for r in got.where("v > 0").collect()} == {("a", "2023-12-31 22:00:00", 5.0), ("b", "2024-02-01 03:00:00", 2.0)}


def test_spine_fill_with_given_ends(spark):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-03 00:00:00", 2.0)]
    got = spine_fill(stamps(spark, rows, "ts", "v"), ["k"], "ts", "v", "1 hour", "2024-01-02 00:00:00", "2024-01-03 00:00:00")
    assert (got.count(), got.agg(F.sum("v")).first()[0]) == (25, 2.0)
    half = spine_fill(stamps(spark, rows, "ts", "v"), ["k"], "ts", "v", "1 hour", end="2024-01-02 00:00:00")
    assert (half.count(), half.agg(F.sum("v")).first()[0]) == (25, 1.0)


def test_spine_fill_of_nothing(spark):
    assert spine_fill(stamps(spark, [], "ts", "v"), ["k"], "ts", "v", "1 hour").count() == 0


def test_spine_fill_between_steps_and_without_keys(spark):
    rows = [("a", "2024-01-01 00:20:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), (None, "2024-01-02 02:20:00", None), (None, "2024-01-02 02:20:00", 4.0), ("c", None, 1.0)]
    got = spine_fill(stamps(spark, rows, "ts", "v"), ["k"], "ts", "v", "1 hour").collect()
    assert len(got) == 3 * 27 + 1 and {(r.k, str(r.ts)) for r in got if r.k != "c" and str(r.ts)[14:16] != "20"} == {("a", "2024-01-01 00:50:00")}
    assert sorted((str(r.k), str(r.ts), r.v) for r in got if r.v) == [
        ("None", "2024-01-02 02:20:00", 4.0), ("a", "2024-01-01 00:20:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0)]


def test_spine_fill_is_dealt_out(spark):
    """The axis of many keys is made by all tasks, however few bytes its keys have, and is in no aggregation."""
    df = spark.range(400).select(F.col("id").cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit(1.0).alias("v"))
    got = spine_fill(df, ["k"], "ts", "v", "1 hour")
    per_task = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 400 * 400 and len(per_task) == 4 and max(per_task) < 400 * 400 / 2


def test_counts_and_labels_of_any_year(spark):
    rows = [("a", "1980-01-01 05:00:00", "1980-01-03 01:00:00"), ("b", "2030-06-01 00:00:00", "2030-06-01 07:00:00")]
    df = stamps(spark, rows, "s", "e")
    counts = outages.count_active(df, "k", "s", "e", ["a", "b"], DAY).orderBy("ts").collect()
    assert (str(counts[0].ts)[:10], str(counts[-1].ts)[:10]) == ("1980-01-01", "2030-06-01")
    assert (sum(r.a for r in counts), sum(r.b for r in counts)) == (3, 1)
    labels = peaks.interval_labels(df, ["k"], "s", "e", HOUR)
    assert {r.k: r.n for r in labels.groupBy("k").agg(F.sum("label").alias("n")).collect()} == {"a": 44, "b": 7}


def test_sixteen_quarter_hours(spark, small):
    from gridstrata.plans.base import quarters
    from gridstrata.plans.moving import party

    rows = quarters(spark, small)
    got = {(r.bldg_id, r.ts): r.cost for r in party(rows, 16, 900).collect()}
    pdf = rows.toPandas().sort_values(["bldg_id", "ts"])
    one = pdf[pdf.bldg_id == pdf.bldg_id.iloc[0]]
    hour = (one.ts - one.ts.dt.normalize()).dt.total_seconds().sub(900).mod(DAY) // HOUR
    cost = (one.energy * 0.3 + 0.5) * hour.isin([18, 19, 20, 21]).map({True: 0.35, False: 0.2})
    want = [cost.iloc[i : i + 16].sum() for i in range(len(cost))]
    assert all(abs(got[(b, t.to_pydatetime())] - w) < 1e-9 for b, t, w in zip(one.bldg_id, one.ts, want))


def test_softmax_covers_every_position(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(64)).cast("array<double>").alias("v"))
    p = df.select(arrays.softmax_blocks("v", [(i, 16) for i in range(0, 64, 16)]).alias("p")).first().p
    assert len(p) == 64 and all(abs(sum(p[i : i + 16]) - 1) < 1e-12 for i in range(0, 64, 16))
