"""Streaming operators run over the events file; each equals its batch form on what the watermark has closed."""

from pyspark.sql import functions as F

from gridstrata.plans.base import r6
from gridstrata.plans.registry import query
from gridstrata.sources import SCHEMAS, table
from gridstrata.streaming import feeds

CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def events(spark, sf):
    return feeds.file_stream(spark, sf, SCHEMAS["events"], "events.parquet")


@query(
    "stream_hourly_max",
    f"SELECT user_id, date_trunc('hour', ts) AS hour, max(value) AS peak FROM events GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= {CLOSED}",
)
def stream_hourly_max(spark, sf):
    return feeds.run_to_end(feeds.hourly_max(events(spark, sf), "user_id", "ts", "value"), "hourly-max")


@query(
    "stream_rolling_cost",
    f"""WITH w AS (SELECT user_id, value, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * unnest(range(16)) AS INTEGER)) AS start FROM events)
        SELECT user_id, start, round(sum(value), 6) AS cost FROM w WHERE start + INTERVAL 4 HOUR <= {CLOSED} GROUP BY 1, 2""",
)
def stream_rolling_cost(spark, sf):
    out = feeds.run_to_end(feeds.rolling_cost(events(spark, sf), "user_id", "ts", "value"), "rolling-cost")
    return out.withColumn("cost", r6("cost"))


@query(
    "stream_outage_sessions",
    """WITH e AS (SELECT user_id, ts, value, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 64800000000 THEN 0 ELSE 1 END AS f
         FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
       SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, min(ts) AS start, max(ts) AS last FROM s GROUP BY user_id, session
       HAVING epoch_us(max(ts)) + 64799999999 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events WHERE event_type = 'error')""",
)
def stream_outage_sessions(spark, sf):
    errors = events(spark, sf).where("event_type = 'error'")
    out = feeds.run_to_end(feeds.outage_sessions(errors, "user_id", "ts", "value"), "sessions")
    return out.withColumn("total", r6("total"))


@query("stream_dedup", "SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events")
def stream_dedup(spark, sf):
    rows = events(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    out = feeds.run_to_end(feeds.first_per_key(rows, ["user_id", "hour"], "ts"), "dedup")
    return out.select("user_id", "hour")


@query(
    "stream_enrich_static",
    "SELECT event_id, user_id, value, coalesce(c_mktsegment, 'Unknown') AS segment FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'",
)
def stream_enrich_static(spark, sf):
    static = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    rows = events(spark, sf).where("event_type = 'purchase'").select("event_id", "user_id", "value")
    out = feeds.run_to_end(feeds.enrich(rows, static, ["user_id"]), "enrich")
    return out.select("event_id", "user_id", "value", F.coalesce("segment", F.lit("Unknown")).alias("segment"))
