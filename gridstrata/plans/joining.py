"""Joins."""

from pyspark.sql import functions as F

from gridstrata.functions import calendar as cal
from gridstrata.functions import geo
from gridstrata.operators import joins
from gridstrata.operators.blocks import DAY, carry
from gridstrata.operators.resample import ends, spine
from gridstrata.operators.ranks import with_group_stats
from gridstrata.plans.base import HOURS, grid, hourly, long, points, r6, readings, stations, storms, with_
from gridstrata.plans.profiles import rounded
from gridstrata.plans.registry import query
from gridstrata.sources import table


@query(
    "join_inner_multi",
    with_("hourly", w="SELECT date_trunc('hour', ts) AS ts, max(value) AS temp FROM events WHERE event_type = 'view' GROUP BY 1")
    + """SELECT h.bldg_id, h.ts, round(h.energy, 6) AS energy, w.temp, c.c_nationkey AS nation FROM hourly h JOIN w ON w.ts = h.ts
         JOIN customer c ON c.c_custkey = h.bldg_id""",
)
def join_inner_multi(spark, sf):
    views = table(spark, sf, "events").where("event_type = 'view'")
    weather = views.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.max("value").alias("temp"))
    meta = table(spark, sf, "customer").select(F.col("c_custkey").alias("bldg_id"), F.col("c_nationkey").alias("nation"))
    out = hourly(spark, sf).join(weather, "ts").join(meta, "bldg_id")
    return out.select("bldg_id", "ts", r6("energy").alias("energy"), "temp", "nation")


@query(
    "join_state_dim",
    """SELECT c_custkey, n_name, r_name, CAST(CASE WHEN n_nationkey < 10 THEN 0 ELSE 1 END AS BIGINT) AS state_group FROM customer
       JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def join_state_dim(spark, sf):
    dim = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = table(spark, sf, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"))
    group = F.when(F.col("n_nationkey") < 10, 0).otherwise(1)
    return out.select("c_custkey", "n_name", "r_name", long(group).alias("state_group"))


@query(
    "join_semi_anti",
    """SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') THEN 'hit' ELSE 'miss' END AS side
       FROM orders""",
)
def join_semi_anti(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey")
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    hit = keys.join(lines, "o_orderkey", "left_semi").withColumn("side", F.lit("hit"))
    return hit.unionByName(keys.join(lines, "o_orderkey", "left_anti").withColumn("side", F.lit("miss")))


@query(
    "join_min_back",
    with_("grid", m="SELECT *, date_trunc('day', ts) AS d, min(energy) OVER (PARTITION BY bldg_id, date_trunc('day', ts)) AS lo FROM grid")
    + "SELECT bldg_id, ts, round(energy, 6) AS energy FROM m WHERE energy = lo",
)
def join_min_back(spark, sf):
    rows = grid(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    low = with_group_stats(rows, ["bldg_id", "day"], _lo=F.min("energy"))
    return low.where(F.col("energy") == F.col("_lo")).select("bldg_id", "ts", r6("energy").alias("energy"))


@query(
    "join_interval_cause",
    with_("storms", o="SELECT o_custkey AS county, o_orderkey AS outage, o_orderdate AS start FROM orders")
    + """SELECT s.episode, s.event_no, s.part, s.county, coalesce(o.outage, -1) AS outage, CAST(CASE WHEN o.outage IS NULL THEN 0 ELSE 1 END AS BIGINT) AS caused,
         coalesce((epoch(o.start) - epoch(s.begin_ts)) / 86400, -1) AS days FROM storms s
       LEFT JOIN o ON o.county = s.county AND o.start >= s.begin_ts AND o.start <= s.end_ts + INTERVAL 1 DAY""",
)
def join_interval_cause(spark, sf):
    outs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("county"), F.col("o_orderkey").alias("outage"), F.col("o_orderdate").alias("start")
    )
    ids = ["episode", "event_no", "part", "county"]
    found = joins.storm_causes(storms(spark, sf), outs, "county", "begin_ts", "end_ts", "start")
    days = (F.unix_timestamp("start") - F.unix_timestamp("begin_ts")) / DAY
    return found.select(
        *ids, F.coalesce("outage", F.lit(-1)).alias("outage"), long("caused").alias("caused"), F.coalesce(days, F.lit(-1.0)).alias("days")
    )


@query(
    "join_hourly_inside_interval",
    """WITH s AS (SELECT event_id, ts AS b, ts + to_seconds(CAST(floor(value * 60) AS INTEGER)) AS e FROM events),
       h AS (SELECT event_id, unnest(generate_series(date_trunc('hour', b), CASE WHEN date_trunc('hour', e) = e THEN e ELSE date_trunc('hour', e) + INTERVAL 1 HOUR END, INTERVAL 1 HOUR)) AS hour FROM s)
       SELECT event_id, hour FROM h""",
)
def join_hourly_inside_interval(spark, sf):
    stop = F.timestamp_add("SECOND", F.floor(F.col("value") * 60).cast("int"), F.col("ts"))
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("b"), stop.alias("e"))
    return joins.hours_inside(rows, "b", "e").select("event_id", "hour")


@query(
    "join_lookback_window",
    with_("storms", o="SELECT o_custkey AS county, o_orderkey AS outage, o_orderdate AS start FROM orders")
    + """SELECT o.outage, count(*) AS n_hours, min((epoch(o.start) - epoch(s.begin_ts)) / 3600) AS nearest,
         count(*) FILTER ((epoch(o.start) - epoch(s.begin_ts)) / 3600 <= 24) AS n_close
       FROM o JOIN storms s ON s.county = o.county AND s.begin_ts BETWEEN o.start - INTERVAL 10 DAY AND o.start GROUP BY 1""",
)
def join_lookback_window(spark, sf):
    outs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("county"), F.col("o_orderkey").alias("outage"), F.col("o_orderdate").alias("start")
    )
    outs = outs.withColumn("from", F.timestamp_add("DAY", F.lit(-10), F.col("start")))
    weather = storms(spark, sf).select("county", "begin_ts")
    pairs = joins.range_join(outs, weather, ["county"], "from", "start", "begin_ts", width=10 * DAY)
    hours = (F.unix_timestamp("start") - F.unix_timestamp("begin_ts")) / 3600
    return pairs.groupBy("outage").agg(
        F.count(F.lit(1)).alias("n_hours"), F.min(hours).alias("nearest"), F.count_if(hours <= 24).alias("n_close")
    )


@query(
    "cross_join_grid",
    with_("hourly", k="SELECT DISTINCT bldg_id FROM hourly", h=HOURS)
    + "SELECT k.bldg_id, h.ts, coalesce(round(e.energy, 6), -1.0) AS energy FROM k CROSS JOIN h LEFT JOIN hourly e ON e.bldg_id = k.bldg_id AND e.ts = h.ts",
)
def cross_join_grid(spark, sf):
    rows = hourly(spark, sf)
    axis = spine(table(spark, sf, "events").select(F.col("user_id").alias("bldg_id")).distinct(), *ends(rows, "ts"), "1 hour")
    return axis.join(rows, ["bldg_id", "ts"], "left").select("bldg_id", "ts", F.coalesce(r6("energy"), F.lit(-1.0)).alias("energy"))


@query(
    "join_nearest",
    with_("points", "stations", d="SELECT pid, sid, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) AS d2 FROM points p, stations s")
    + "SELECT pid, arg_min(sid, {'a': d2, 'b': sid}) AS sid, round(min(d2), 6) AS d2 FROM d GROUP BY 1",
)
def join_nearest(spark, sf):
    near = joins.nearest(points(spark, sf).select("pid", "x", "y"), "pid", stations(spark, sf), "sid", "x", "y", cell=4.0)
    return near.select("pid", "sid", r6("d2").alias("d2"))


GEO = """SELECT s_suppkey AS county, 25 + ((s_suppkey * 53) % 241) / 10.0 AS lat, -120 + ((s_suppkey * 29) % 553) / 10.0 AS lon FROM supplier"""


@query(
    "join_radius_haversine",
    with_(
        g=GEO,
        p="""SELECT a.county, b.county AS other FROM g a, g b WHERE 2 * 6371 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
             + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 300""",
        f="SELECT l_suppkey AS county, date_trunc('month', l_shipdate) AS month, sum(l_quantity) AS q FROM lineitem GROUP BY ALL",
    )
    + "SELECT p.county, f.month, round(avg(CASE WHEN q >= 200 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM p JOIN f ON f.county = p.other GROUP BY 1, 2",
)
def join_radius_haversine(spark, sf):
    places = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("county"), (25 + ((F.col("s_suppkey") * 53) % 241) / 10.0).alias("lat"),
        (-120 + ((F.col("s_suppkey") * 29) % 553) / 10.0).alias("lon"),
    )
    facts = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("other"), F.date_trunc("month", "l_shipdate").alias("month")
    ).agg(F.sum("l_quantity").alias("q"))
    high = facts.select("other", "month", F.when(F.col("q") >= 200, 1).otherwise(0).cast("tinyint").alias("high"))
    others = places.withColumnRenamed("county", "other")
    near = joins.within_km(places, others, "lat", "lon", 300.0, facts=high, on="other", by="month", total="high")
    return near.groupBy("county", "month").agg(r6(F.sum("total") / F.sum("n")).alias("share"), F.sum("n").alias("n"))


RING = """SELECT n_nationkey AS zone, [{'x': cx - 9, 'y': cy - 5}, {'x': cx + 3, 'y': cy - 9}, {'x': cx + 9, 'y': cy + 2}, {'x': cx, 'y': cy + 1}, {'x': cx - 2, 'y': cy + 9}] AS ring
    FROM (SELECT n_nationkey, (n_nationkey % 5) * 20 + 10.5 AS cx, (n_nationkey // 5) * 20 + 10.5 AS cy FROM nation)"""
EDGES = """SELECT zone, unnest(ring) AS a, unnest(list_concat(ring[2:], ring[1:1])) AS b FROM ring"""
INSIDE = """SELECT p.pid, e.zone FROM points p JOIN edges e ON (e.a.y > p.y) <> (e.b.y > p.y) AND p.x < (e.b.x - e.a.x) * (p.y - e.a.y) / (e.b.y - e.a.y) + e.a.x
    GROUP BY 1, 2 HAVING count(*) % 2 = 1"""


def zones(spark, sf):
    """A five-cornered, not convex zone per nation."""
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("zone"), ((F.col("n_nationkey") % 5) * 20 + F.lit(10.5).cast("double")).alias("cx"),
        (F.floor(F.col("n_nationkey") / 5) * 20 + F.lit(10.5).cast("double")).alias("cy"),
    )
    corners = ((-9, -5), (3, -9), (9, 2), (0, 1), (-2, 9))
    ring = F.array(*[F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y")) for dx, dy in corners])
    return n.select("zone", ring.alias("ring"))


@query("join_point_in_polygon", with_("points", ring=RING, edges=EDGES) + INSIDE)
def join_point_in_polygon(spark, sf):
    return joins.points_in_polygons(points(spark, sf), zones(spark, sf), "x", "y", "ring", cell=10.0).select("pid", "zone")


@query(
    "join_distance_validity",
    with_("points", "stations", s="""SELECT pid, sid, sqrt(pow(p.x - least(greatest(p.x, s.x), s.x + 2), 2) + pow(p.y - s.y, 2)) AS d FROM points p JOIN stations s ON p.pid % 100 = s.sid % 100""")
    + "SELECT pid, sid, round(d, 6) AS d FROM s WHERE d < 20",
)
def join_distance_validity(spark, sf):
    p = points(spark, sf).withColumn("k", F.col("pid") % 100)
    s = stations(spark, sf).select("sid", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("sid") % 100).alias("k"))
    d = geo.segment_distance("x", "y", "ax", "ay", F.col("ax") + 2, "ay")
    return p.join(s, "k").withColumn("d", d).where(F.col("d") < 20).select("pid", "sid", r6("d").alias("d"))


@query(
    "join_fuzzy_name",
    """WITH n AS (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'e', 'i') WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' ii' ELSE p_name END AS name FROM part),
       k AS (SELECT DISTINCT p_brand, lower(p_name) AS k FROM part),
       r AS (SELECT n.p_brand, lower(n.name) AS a, k, 1 - levenshtein(lower(n.name), k) / greatest(length(n.name), length(k)) AS ratio FROM n JOIN k ON k.p_brand = n.p_brand),
       b AS (SELECT p_brand, a, arg_min(k, {'x': -ratio, 'y': k}) AS k, max(ratio) AS ratio FROM r WHERE contains(a, k) OR contains(k, a) OR ratio > 0.8 GROUP BY 1, 2)
       SELECT p_partkey, n.p_brand, name, coalesce(b.k, lower(name)) AS matched, round(b.ratio, 6) AS ratio FROM n LEFT JOIN b ON b.p_brand = n.p_brand AND b.a = lower(name)""",
)
def join_fuzzy_name(spark, sf):
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    typed = (
        F.when(kind == 0, F.replace(name, F.lit("e"), F.lit("i"))).when(kind == 1, F.upper(name))
        .when(kind == 2, F.concat(name, F.lit(" ii"))).otherwise(name)
    )
    names = table(spark, sf, "part").select("p_partkey", "p_brand", typed.alias("name"))
    known = table(spark, sf, "part").select("p_brand", name.alias("name"))
    return rounded(joins.match_names(names, known, "p_brand", "name"), ["p_partkey"])


@query(
    "asof_prev_next",
    with_("grid", h="SELECT bldg_id, ts, CASE WHEN strftime(ts, '%m-%d') IN ('01-01', '01-15') THEN ts END AS h FROM grid")
    + """SELECT bldg_id, ts, coalesce(CAST(floor((epoch(ts) - epoch(last_value(h IGNORE NULLS) OVER (PARTITION BY bldg_id ORDER BY ts))) / 86400) AS BIGINT), -1) AS days_from,
         coalesce(CAST(floor((epoch(first_value(h IGNORE NULLS) OVER (PARTITION BY bldg_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - epoch(ts)) / 86400) AS BIGINT), -1) AS days_to
       FROM h""",
)
def asof_prev_next(spark, sf):
    mark = {"_h": F.when(cal.is_holiday("ts"), F.col("ts"))}
    back = carry(grid(spark, sf), ["bldg_id"], "ts", mark).withColumnRenamed("_h", "p")
    both = carry(back, ["bldg_id"], "ts", mark, ahead=True).withColumnRenamed("_h", "n")
    now = F.unix_timestamp("ts")
    days = lambda c: F.coalesce(F.floor(c / DAY), F.lit(-1))
    return both.select(
        "bldg_id", "ts", days(now - F.unix_timestamp("p")).alias("days_from"), days(F.unix_timestamp("n") - now).alias("days_to")
    )


@query(
    "join_holiday_calendar",
    with_("readings", c="SELECT n_nationkey AS state, lpad(CAST(1 + n_nationkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + n_nationkey AS VARCHAR), 2, '0') AS day FROM nation")
    + """SELECT r.bldg_id, r.ts, r.energy, CAST(strftime(ts, '%m-%d') IN ('01-01', '01-15', '02-19', '05-28', '07-04', '09-03', '10-08', '11-11', '11-12', '11-22', '12-25') AS BIGINT) AS national,
         CAST(c.day IS NOT NULL AS BIGINT) AS state_day FROM readings r LEFT JOIN c ON c.state = r.bldg_id % 25 AND c.day = strftime(ts, '%m-%d')""",
)
def join_holiday_calendar(spark, sf):
    n = F.col("n_nationkey")
    day = F.concat_ws("-", F.lpad((1 + n % 12).cast("string"), 2, "0"), F.lpad((1 + n).cast("string"), 2, "0"))
    days = table(spark, sf, "nation").select(n.cast("bigint").alias("state"), day.alias("day"), F.lit(1).alias("state_day"))
    rows = readings(spark, sf).withColumns({"state": F.col("bldg_id") % 25, "day": cal.mm_dd("ts")})
    out = rows.join(days, ["state", "day"], "left")
    return out.select(
        "bldg_id", "ts", "energy", long(cal.is_holiday("ts")).alias("national"), long(F.coalesce("state_day", F.lit(0))).alias("state_day")
    )
