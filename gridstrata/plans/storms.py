"""Outage sessions, storm episodes, event counts and other sums."""

from pyspark.sql import functions as F

from gridstrata.operators import outages
from gridstrata.operators.blocks import HOUR, over_blocks
from gridstrata.operators.ranks import exact_quantiles, most_frequent
from gridstrata.operators.resample import ends, spine
from gridstrata.plans.base import HOURS, grid, long, r6, readings, storms, with_
from gridstrata.plans.profiles import rounded
from gridstrata.plans.registry import query
from gridstrata.sources import table

KINDS = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query(
    "agg_sessions",
    """WITH e AS (SELECT user_id, ts, value, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 64800000000 THEN 0 ELSE 1 END AS f
         FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM e)
       SELECT user_id, session, count(*) AS n, round(sum(value), 6) AS total, arg_min(value, {'a': ts, 'b': event_id}) AS first_value, min(ts) AS start,
         max(ts) + INTERVAL 15 MINUTE AS stop, round((epoch_us(max(ts)) + 900000000 - epoch_us(min(ts))) / 86400000000.0, 6) AS duration_days,
         round(sum(value) / ((epoch_us(max(ts)) + 900000000 - epoch_us(min(ts))) / 86400000000.0), 4) AS total_per_day FROM s GROUP BY 1, 2""",
)
def agg_sessions(spark, sf):
    errors = table(spark, sf, "events").where("event_type = 'error'")
    out = outages.sessions(errors, ["user_id"], "ts", "value", 18 * HOUR, ties=["event_id"])
    return out.withColumns(
        {"total": r6("total"), "duration_days": r6("duration_days"), "total_per_day": r6("total_per_day", 4)}
    )


@query(
    "agg_episode_sets",
    with_(
        "storms",
        f="""SELECT episode, count(*) AS n_events, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, min(begin_ts) AS begin_ts, max(end_ts) AS end_ts,
             arg_min('part ' || part, {'a': event_no, 'b': 'part ' || part}) AS story FROM storms GROUP BY 1""",
    )
    + """SELECT DISTINCT s.episode, s.county, n_events, kinds, story, f.begin_ts, f.end_ts,
         round(CASE WHEN f.end_ts = f.begin_ts THEN 0.01 ELSE (epoch(f.end_ts) - epoch(f.begin_ts)) / 3600 END, 6) AS storm_hours
       FROM storms s JOIN f ON f.episode = s.episode""",
)
def agg_episode_sets(spark, sf):
    rows = storms(spark, sf).withColumn("story", F.concat(F.lit("part "), F.col("part").cast("string")))
    out = outages.episodes(rows, "episode", "county", "begin_ts", "end_ts", "kind", "story", "event_no")
    return rounded(out, ["episode", "county"])


@query(
    "agg_episode_summary",
    """SELECT l_orderkey, arg_min(l_quantity, {'a': l_shipdate, 'b': l_linenumber, 'c': l_quantity}) AS first, arg_max(l_quantity, {'a': l_shipdate, 'b': l_linenumber, 'c': l_quantity}) AS last,
       sum(l_quantity) AS total, max(l_quantity) AS peak, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""",
)
def agg_episode_summary(spark, sf):
    out = outages.episode_summary(table(spark, sf, "lineitem"), ["l_orderkey"], "l_shipdate", "l_quantity", ["l_linenumber", "l_quantity"])
    return rounded(out, ["l_orderkey"])


SEVERITY = """SELECT kind, count(DISTINCT episode) AS n_episodes, round(sum(damage), 2) AS property_sum, round(avg(damage), 6) AS property_mean, max(damage) AS property_max,
    round(sum(crops), 2) AS crops_sum, round(avg(crops), 6) AS crops_mean, max(crops) AS crops_max,
    CASE WHEN (avg(damage) >= 20000)::INT + (max(damage) >= 1e6)::INT + (avg(crops) >= 20000)::INT + (max(crops) >= 1e6)::INT >= 2 THEN 2
         WHEN (avg(damage) > 5000)::INT + (max(damage) > 5e5)::INT + (avg(crops) > 5000)::INT + (max(crops) > 5e5)::INT >= 1 THEN 1 ELSE 0 END AS severity
    FROM t GROUP BY 1"""
TYPED = """SELECT l_orderkey AS episode, p_type AS kind, l_extendedprice AS damage, CASE WHEN l_tax > 0.04 THEN l_extendedprice / 7 ELSE 0 END AS crops
    FROM lineitem JOIN part ON p_partkey = l_partkey"""


@query(
    "agg_event_type_severity",
    with_(t=TYPED, s=SEVERITY)
    + """SELECT * REPLACE (CAST(severity AS BIGINT) AS severity), CASE WHEN kind = 'Flood' THEN 'Flood' WHEN severity = 2 THEN 'Other_severe'
         WHEN severity = 1 THEN 'Other_moderate' ELSE 'Other_light' END AS simplified FROM s""",
)
def agg_event_type_severity(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    crops = F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice") / 7).otherwise(0.0)
    rows = lines.select(
        F.col("l_orderkey").alias("episode"), F.col("p_type").alias("kind"), F.col("l_extendedprice").alias("damage"), crops.alias("crops")
    )
    out = outages.type_severity(rows, "kind", "episode", {"property": "damage", "crops": "crops"})
    out = out.withColumn("simplified", outages.simplified_type("kind", "severity"))
    return rounded(out.withColumns({c: r6(c, 2) for c in ("property_sum", "crops_sum")}), [])


@query("agg_hourly_max", "SELECT user_id, date_trunc('hour', ts) AS hour, max(value) AS peak FROM events GROUP BY 1, 2")
def agg_hourly_max(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.max("value").alias("peak"))


@query("agg_hourly_sum", "SELECT user_id, date_trunc('hour', ts) AS hour, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def agg_hourly_sum(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(r6(F.sum("value")).alias("total"))


@query(
    "agg_grouper_mean",
    f"""WITH h AS ({HOURS}),
       m AS (SELECT date_trunc('hour', ts) AS ts, avg(value / 0.97) AS m FROM events WHERE event_type = 'error' GROUP BY 1)
       SELECT h.ts, coalesce(round(m, 6), 0.0) AS mean FROM h LEFT JOIN m ON m.ts = h.ts""",
)
def agg_grouper_mean(spark, sf):
    events = table(spark, sf, "events")
    errors = events.where("event_type = 'error'")
    means = errors.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg(F.col("value") / 0.97).alias("m"))
    axis = spine(spark.range(1).select("id"), *ends(events, F.date_trunc("hour", "ts")), "1 hour").drop("id")
    return axis.join(means, "ts", "left").select("ts", F.coalesce(r6("m"), F.lit(0.0)).alias("mean"))


@query(
    "agg_state_sum_roll",
    with_("grid", s="SELECT bldg_id % 25 AS state, ts, sum(energy) AS energy FROM grid GROUP BY ALL")
    + "SELECT state, ts, round(energy, 6) AS energy, " + ", ".join(
        f"round({f}(energy) OVER (PARTITION BY state ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS {f}_{n}"
        for n in (6, 24) for f in ("max", "avg", "sum"))
    + " FROM s",
)
def agg_state_sum_roll(spark, sf):
    states = grid(spark, sf).groupBy((F.col("bldg_id") % 25).alias("state"), "ts").agg(F.sum("energy").alias("energy"))
    fns = {"max": F.max, "avg": F.avg, "sum": F.sum}
    roll = lambda w: {f"{f}_{n}": fn("energy").over(w.rowsBetween(1 - n, 0)) for n in (6, 24) for f, fn in fns.items()}
    return rounded(over_blocks(states, ["state"], "ts", roll, before=24 * HOUR), ["state"])


@query(
    "agg_events_by_type_wide",
    with_("storms") + "SELECT county, date_trunc('day', begin_ts) AS day, " + ", ".join(f'count(*) FILTER (kind = \'{k}\') AS "{k}"' for k in KINDS)
    + ", max(damage) AS peak FROM storms GROUP BY 1, 2",
)
def agg_events_by_type_wide(spark, sf):
    rows = storms(spark, sf).withColumn("day", F.date_trunc("day", "begin_ts"))
    return rows.groupBy("county", "day").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], F.max("damage").alias("peak")
    )


@query(
    "agg_event_count_spine",
    with_(
        "storms", e="SELECT kind, time_bucket(INTERVAL 6 HOUR, begin_ts) AS b, time_bucket(INTERVAL 6 HOUR, end_ts) AS e FROM storms",
        h="SELECT unnest(generate_series(min(b), max(e), INTERVAL 6 HOUR)) AS ts FROM e",
        x="SELECT kind, unnest(generate_series(b, e, INTERVAL 6 HOUR)) AS ts FROM e",
        n="SELECT ts, " + ", ".join(f'count(*) FILTER (kind = \'{k}\') AS "{k}"' for k in KINDS) + " FROM x GROUP BY 1",
    )
    + "SELECT h.ts, " + ", ".join(f'coalesce("{k}", 0) AS "{k}"' for k in KINDS) + " FROM h LEFT JOIN n ON n.ts = h.ts",
)
def agg_event_count_spine(spark, sf):
    return outages.count_active(storms(spark, sf), "kind", "begin_ts", "end_ts", KINDS, 6 * HOUR)


@query(
    "agg_outage_state_power",
    """SELECT ts, sum(customers) AS customers FROM (SELECT date_trunc('hour', ts) AS ts, CAST(floor(value) AS BIGINT) AS customers FROM events
       WHERE user_id % 25 = 7 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') GROUP BY 1""".replace("sum(customers)", "CAST(sum(customers) AS BIGINT)"),
)
def agg_outage_state_power(spark, sf):
    first, last = (F.to_timestamp(F.lit(d)) for d in ("2024-01-05", "2024-01-20"))
    rows = table(spark, sf, "events").where((F.col("ts") >= first) & (F.col("ts") < last) & (F.col("user_id") % 25 == 7))
    return rows.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(F.floor("value")).alias("customers"))


@query(
    "agg_cluster_summary",
    with_(
        "readings", c="SELECT *, bldg_id % 5 AS cluster, hour(ts) AS h FROM readings",
        f="SELECT cluster, h, count(*) AS c FROM c GROUP BY ALL", m="SELECT cluster, max(c) AS top FROM f GROUP BY 1",
        t="SELECT count(*) AS t FROM readings",
    )
    + """SELECT c.cluster, count(*) AS n, round(count(*) / any_value(t), 6) AS share, round(sum(energy), 4) AS total, round(avg(energy), 6) AS mean,
         round(quantile_cont(energy, 0.5), 6) AS median, any_value(x.h) AS mode_hour FROM c, t,
         (SELECT f.cluster, min(h) AS h FROM f JOIN m ON m.cluster = f.cluster AND c = top GROUP BY 1) x WHERE x.cluster = c.cluster GROUP BY 1""",
)
def agg_cluster_summary(spark, sf):
    rows = readings(spark, sf).withColumns({"cluster": F.col("bldg_id") % 5, "h": F.hour("ts")})
    stats = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("energy").alias("total"), F.avg("energy").alias("mean"))
    size = rows.agg(F.count(F.lit(1)).alias("t"))
    mode = most_frequent(rows, ["cluster"], "h", "mode_hour").select("cluster", long("mode_hour").alias("mode_hour"))
    out = stats.join(exact_quantiles(rows, ["cluster"], "energy", {"median": 0.5}), "cluster").join(mode, "cluster")
    return out.select(
        "cluster", "n", r6(F.col("n") / size.scalar()).alias("share"), r6("total", 4).alias("total"), r6("mean").alias("mean"),
        r6("median").alias("median"), "mode_hour",
    )


@query(
    "agg_tag_lists",
    """SELECT tag, CAST(event_id // 1000 AS BIGINT) AS part, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM (
       SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS tag, event_id FROM events) GROUP BY 1, 2""",
)
def agg_tag_lists(spark, sf):
    tag = F.from_json("props", "map<string,string>")["k"]
    rows = table(spark, sf, "events").select(tag.alias("tag"), "event_id", F.floor(F.col("event_id") / 1000).alias("part"))
    # A list never spans more than 1000 ids, however frequent its tag is.
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: i.cast("string")), ",")
    return rows.groupBy("tag", "part").agg(ids.alias("ids"))


@query(
    "agg_global_moments",
    "SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1",
)
def agg_global_moments(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), r6(F.avg("l_extendedprice"), 4).alias("mean"),
        r6(F.stddev_pop("l_extendedprice"), 4).alias("std"),
    )


@query("agg_count_distinct_days", "SELECT user_id, count(DISTINCT date_trunc('day', ts)) AS n_days FROM events GROUP BY 1")
def agg_count_distinct_days(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct(F.date_trunc("day", "ts")).alias("n_days"))


@query("agg_nunique", "SELECT source, count(DISTINCT lang) AS n_lang, count(DISTINCT n_chars) AS n_sizes FROM documents GROUP BY 1")
def agg_nunique(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count_distinct("lang").alias("n_lang"), F.count_distinct("n_chars").alias("n_sizes")
    )
