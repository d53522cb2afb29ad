"""Scalar, date, string and array functions."""

from pyspark.sql import functions as F

from gridstrata.functions import arrays, parse, tariff, text
from gridstrata.functions import calendar as cal
from gridstrata.operators import encode
from gridstrata.operators.blocks import HOUR
from gridstrata.operators.ranks import value_ranks
from gridstrata.plans.base import DIMENSIONS, grid, long, r6, readings, with_
from gridstrata.plans.moving import STOP, TOKENS
from gridstrata.plans.profiles import rounded
from gridstrata.plans.registry import query
from gridstrata.sources import table


@query(
    "fn_calendar",
    with_("readings")
    + """SELECT bldg_id, ts, energy, year(ts) AS year, month(ts) AS month, day(ts) AS day, week(ts) AS week, isodow(ts) - 1 AS weekday, hour(ts) AS hour,
         minute(ts) AS minute, strftime(ts, '%m-%d') AS period, strftime(ts, '%H:%M') AS hour_minute,
         CAST(epoch(ts) - epoch(TIMESTAMP '2018-01-01') AS BIGINT) AS seconds, CAST(isodow(ts) >= 6 AS BIGINT) AS weekend FROM readings""",
)
def fn_calendar(spark, sf):
    t = F.col("ts")
    cols = {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "week": F.weekofyear(t), "weekday": F.weekday(t),
        "hour": F.hour(t), "minute": F.minute(t), "period": cal.mm_dd(t), "hour_minute": cal.hh_mm(t),
        "seconds": cal.seconds_since(t), "weekend": cal.is_weekend(t),
    }
    return rounded(readings(spark, sf).withColumns(cols), ["bldg_id", "energy"])


@query(
    "fn_calendar_edges",
    """SELECT o_orderkey, quarter(o_orderdate) AS quarter, CAST(day(o_orderdate) = 1 AS BIGINT) AS month_start, CAST(o_orderdate::DATE = last_day(o_orderdate) AS BIGINT) AS month_end,
       CAST(o_orderdate::DATE = date_trunc('quarter', o_orderdate)::DATE AS BIGINT) AS quarter_start, CAST(o_orderdate::DATE = date_trunc('year', o_orderdate)::DATE AS BIGINT) AS year_start,
       CAST(strftime(o_orderdate, '%m-%d') = '12-31' AS BIGINT) AS year_end, day(last_day(o_orderdate)) AS days_in_month, CAST(day(o_orderdate) <= 15 AS BIGINT) AS first_half FROM orders""",
)
def fn_calendar_edges(spark, sf):
    t = F.col("o_orderdate")
    d = t.cast("date")
    cols = {
        "quarter": F.quarter(t), "month_start": F.dayofmonth(t) == 1, "month_end": d == F.last_day(t),
        "quarter_start": d == F.trunc(t, "quarter"), "year_start": d == F.trunc(t, "year"), "year_end": cal.mm_dd(t) == "12-31",
        "days_in_month": F.dayofmonth(F.last_day(t)), "first_half": F.dayofmonth(t) <= 15,
    }
    return rounded(table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in cols.items()]), [])


@query(
    "fn_season",
    """SELECT o_orderkey, CASE WHEN m IN (12, 1, 2) THEN 'Winter' WHEN m IN (3, 4, 5) THEN 'Spring' WHEN m IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS name,
       CAST(CASE WHEN m IN (12, 1, 2) THEN 0 WHEN m IN (6, 7, 8) THEN 1 ELSE 2 END AS BIGINT) AS tempered,
       CAST(CASE WHEN s <= 6480000 THEN 0 WHEN s <= 10368000 THEN 1 WHEN s <= 15552000 THEN 2 WHEN s <= 22032000 THEN 3 WHEN s <= 27216000 THEN 4 ELSE 0 END AS BIGINT) AS code
       FROM (SELECT o_orderkey, month(o_orderdate) AS m, epoch(o_orderdate) - epoch(date_trunc('year', o_orderdate)) AS s FROM orders)""",
)
def fn_season(spark, sf):
    t = F.col("o_orderdate")
    seconds = F.unix_timestamp(t) - F.unix_timestamp(F.date_trunc("year", t))
    return table(spark, sf, "orders").select(
        "o_orderkey", cal.season_name(F.month(t)).alias("name"), long(cal.season_cold_hot_mild(F.month(t))).alias("tempered"),
        long(cal.season_by_seconds(seconds)).alias("code"),
    )


@query(
    "fn_day_period",
    """SELECT event_id, CASE WHEN h BETWEEN 1 AND 6 THEN 'night' WHEN h BETWEEN 7 AND 11 THEN 'morning' WHEN h BETWEEN 11 AND 14 THEN 'noon' WHEN h BETWEEN 14 AND 19 THEN 'afternoon' ELSE 'evening' END AS period,
       CASE WHEN h = 0 OR h >= 22 THEN '22_24' WHEN h <= 6 THEN '1_6' WHEN h <= 8 THEN '7_8' WHEN h <= 11 THEN '9_11' WHEN h <= 14 THEN '12_14' WHEN h <= 18 THEN '15_18' ELSE '19_21' END AS band,
       CASE WHEN h >= 5 AND h < 12 THEN 'Morning' WHEN h BETWEEN 12 AND 15 THEN 'Afternoon' WHEN h > 15 AND h <= 19 THEN 'Evening' ELSE 'Night' END AS part,
       CAST(CASE WHEN h IN (13, 14, 15) THEN 1 WHEN h BETWEEN 16 AND 19 THEN 2 ELSE 0 END AS BIGINT) AS tou FROM (SELECT event_id, hour(ts) AS h FROM events)""",
)
def fn_day_period(spark, sf):
    h = F.hour("ts")
    return table(spark, sf, "events").select(
        "event_id", cal.day_period(h).alias("period"), cal.hour_band(h).alias("band"), cal.time_of_day(h).alias("part"),
        long(cal.time_of_use(h)).alias("tou"),
    )


@query(
    "fn_holiday_flag",
    "SELECT o_orderkey, CAST(strftime(o_orderdate, '%m-%d') IN ('01-01', '01-15', '02-19', '05-28', '07-04', '09-03', '10-08', '11-11', '11-12', '11-22', '12-25') AS BIGINT) AS holiday FROM orders",
)
def fn_holiday_flag(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", long(cal.is_holiday("o_orderdate").cast("int")).alias("holiday"))


@query(
    "fn_cyclic",
    "SELECT event_id, " + ", ".join(
        f"round({f}({e} * 2 * pi() / {p}), 6) + 0.0 AS {n}_{f}" for n, e, p in (("hour", "hour(ts)", 24), ("weekday", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12), ("week", "week(ts)", 52)) for f in ("sin", "cos"))
    + " FROM events",
)
def fn_cyclic(spark, sf):
    parts = {"hour": (F.hour("ts"), 24), "weekday": (F.weekday("ts"), 7), "month": (F.month("ts"), 12), "week": (F.weekofyear("ts"), 52)}
    cols = [(r6(c) + 0.0).alias(f"{n}_{k}") for n, (x, p) in parts.items() for k, c in cal.cyclic(x, p).items()]
    return table(spark, sf, "events").select("event_id", *cols)


@query("fn_week_of_month", "SELECT o_orderkey, (day(o_orderdate) + 6) // 7 AS week FROM orders")
def fn_week_of_month(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", long(cal.week_of_month("o_orderdate")).alias("week"))


@query(
    "fn_tariff",
    """SELECT event_id, CASE WHEN hour(ts - INTERVAL 15 MINUTE) IN (18, 19, 20, 21) THEN 0.35 ELSE 0.2 END::DOUBLE AS price, round(value * 0.3 + 0.5, 6) AS load FROM events""",
)
def fn_tariff(spark, sf):
    hour = F.hour(F.col("ts") - F.expr("INTERVAL 15 MINUTES"))
    return table(spark, sf, "events").select("event_id", tariff.price(hour).alias("price"), r6(tariff.party_load("value")).alias("load"))


@query("fn_tz", "SELECT event_id, timezone('America/New_York', ts) AT TIME ZONE 'UTC' AS utc FROM events")
def fn_tz(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_utc_timestamp("ts", "America/New_York").alias("utc"))


SUN = {
    "a": """SELECT event_id, 2 * pi() / 365.0::DOUBLE * (dayofyear(ts) - 1) AS a, radians((user_id % 60 - 10)::DOUBLE) AS phi, -((user_id * 7) % 120)::DOUBLE AS lon,
        hour(ts) * 60 + minute(ts) + second(ts) / 60.0::DOUBLE AS now FROM events""",
    "s": """SELECT *, 0.006918::DOUBLE - 0.399912 * cos(a) + 0.070257 * sin(a) - 0.006758 * cos(2 * a) + 0.000907 * sin(2 * a) AS decl,
        229.18::DOUBLE * (0.000075 + 0.001868 * cos(a) - 0.032077 * sin(a) - 0.014615 * cos(2 * a) - 0.040849 * sin(2 * a)) AS equation FROM a""",
    "c": """SELECT *, 720 - 4 * lon - equation AS noon, (sin(radians(-0.833::DOUBLE)) - sin(phi) * sin(decl)) / (cos(phi) * cos(decl)) AS x1,
        (sin(radians(-6.0::DOUBLE)) - sin(phi) * sin(decl)) / (cos(phi) * cos(decl)) AS x2 FROM s""",
    "d": """SELECT *, CASE WHEN abs(x1) <= 1 THEN 4 * degrees(acos(x1)) END AS rise, CASE WHEN abs(x2) <= 1 THEN 4 * degrees(acos(x2)) END AS twilight FROM c""",
}


@query(
    "fn_time_to_event",
    with_(**SUN)
    + """SELECT event_id, round(noon - twilight - now, 4) AS to_dawn, round(noon - rise - now, 4) AS to_sunrise, round(noon - now, 4) AS to_noon,
         round(noon + rise - now, 4) AS to_sunset, round(noon + twilight - now, 4) AS to_dusk FROM d""",
)
def fn_time_to_event(spark, sf):
    lat, lon = F.col("user_id") % 60 - 10, -((F.col("user_id") * 7) % 120).cast("double")
    sun = cal.minutes_to_sun_event("ts", lat.cast("double"), lon)
    return table(spark, sf, "events").select("event_id", *[r6(c, 4).alias(n) for n, c in sun.items()])


@query(
    "fn_keyword_counts",
    "SELECT doc_id, " + ", ".join(
        f"CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w IN ({', '.join(repr(x) for x in ws)}))) AS BIGINT) AS {n}" for n, ws in text.KEYWORDS.items())
    + " FROM documents",
)
def fn_keyword_counts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", *[long(text.keyword_count("text", ws)).alias(n) for n, ws in text.KEYWORDS.items()]
    )


@query(
    "fn_word_tokens",
    f"SELECT doc_id, CAST(len(list_filter({TOKENS}, lambda w: w NOT IN ({STOP}))) AS BIGINT) AS n, coalesce(list_filter({TOKENS}, lambda w: w NOT IN ({STOP}))[1], '') AS first FROM documents",
)
def fn_word_tokens(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", text.content_words("text").alias("w"))
    return words.select("doc_id", long(F.size("w")).alias("n"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first"))


@query(
    "fn_regex_clean",
    """SELECT p_partkey, regexp_replace(p_name || p_brand, '[^A-Za-z]', '', 'g') AS letters,
       CASE WHEN p_partkey % 2 = 0 THEN 'MAG_' || p_size ELSE 'topo_' || p_size || '.tif' END AS band FROM part""",
)
def fn_regex_clean(spark, sf):
    size = F.col("p_size").cast("string")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("north_MAG_"), size, F.lit(".tif"))).otherwise(
        F.concat(F.lit("topo_"), size, F.lit(".tif"))
    )
    return table(spark, sf, "part").select(
        "p_partkey", parse.letters_only(F.concat("p_name", "p_brand")).alias("letters"), parse.band_name(path).alias("band")
    )


@query("fn_category_index", "SELECT p_brand, p_type, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_brand, p_type, p_brand || p_type AS v FROM part)")
def fn_category_index(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_type", F.concat("p_brand", "p_type").alias("v")).distinct()
    return rows.join(encode.category_index(rows, "v"), "v").drop("v")


@query(
    "fn_bin_equal_width",
    """SELECT o_orderkey, CAST(greatest(least(ceil((o_totalprice - lo) / (hi - lo) * 200), 200) - 1, 0) AS BIGINT) AS bin FROM orders,
       (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""",
)
def fn_bin_equal_width(spark, sf):
    return encode.equal_width_bins(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 200).drop("o_totalprice")


@query(
    "fn_target_encoding",
    with_("readings", r="SELECT *, hour(ts) * 4 + minute(ts) // 15 AS slot FROM readings", m="SELECT slot, avg(energy) AS m FROM r WHERE energy >= 30 GROUP BY 1")
    + "SELECT bldg_id, ts, round(energy, 6) AS energy, CASE WHEN energy >= 30 THEN round(m, 6) ELSE 0.0 END AS encoded FROM r LEFT JOIN m USING (slot)",
)
def fn_target_encoding(spark, sf):
    rows = readings(spark, sf).withColumn("slot", cal.quarter_of_day("ts"))
    out = encode.target_encoding(rows, "slot", "energy", F.col("energy") >= 30)
    return rounded(out.drop("slot"), ["bldg_id"])


@query(
    "fn_sample_weights",
    "SELECT event_id, CASE WHEN value - 5 < 0 THEN 4.0 WHEN value - 5 < 5 THEN 3.0 WHEN value - 5 < 10 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM events",
)
def fn_sample_weights(spark, sf):
    return table(spark, sf, "events").select("event_id", tariff.temperature_weight(F.col("value") - 5).alias("weight"))


@query(
    "fn_standardise",
    with_("readings", x="SELECT *, greatest(energy - 5, 0) AS x FROM readings")
    + """SELECT bldg_id, ts, round(energy, 6) AS energy, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) AS z,
         round((energy - 5) / max(energy - 5) OVER (PARTITION BY bldg_id, year(ts)), 6) AS scaled FROM x WINDOW w AS (PARTITION BY bldg_id)""",
)
def fn_standardise(spark, sf):
    rows = readings(spark, sf).withColumns({"x": F.col("energy") - 5, "year": F.year("ts")})
    out = encode.max_normalise(encode.standardise(rows, ["bldg_id"], "x"), ["bldg_id", "year"], "x")
    return rounded(out.select("bldg_id", "ts", "energy", "z", "scaled"), ["bldg_id"])


@query(
    "fn_clip_percentile",
    with_("readings", q="SELECT bldg_id, quantile_cont(energy, 0.02) AS lo, quantile_cont(energy, 0.98) AS hi FROM readings GROUP BY 1")
    + "SELECT bldg_id, ts, round(energy, 6) AS energy, round((least(greatest(energy, lo), hi) - lo) / (hi - lo) * 255, 6) AS scaled FROM readings JOIN q USING (bldg_id)",
)
def fn_clip_percentile(spark, sf):
    return rounded(encode.clip_scale(readings(spark, sf), ["bldg_id"], "energy", 0.02, 0.98), ["bldg_id"])


@query(
    "fn_reshape_week_matrix",
    with_(
        "grid", w="SELECT DISTINCT bldg_id, date_trunc('week', ts)::TIMESTAMP AS week FROM grid",
        s="SELECT *, CAST(unnest(range(168)) AS BIGINT) AS slot FROM w",
        g="SELECT bldg_id, date_trunc('week', ts)::TIMESTAMP AS week, (isodow(ts) - 1) * 24 + hour(ts) AS slot, energy FROM grid",
    )
    + "SELECT bldg_id, week, slot, coalesce(round(energy, 6), 0.0) AS energy FROM s LEFT JOIN g USING (bldg_id, week, slot)",
)
def fn_reshape_week_matrix(spark, sf):
    m = encode.week_matrix(grid(spark, sf), ["bldg_id"], "ts", "energy", 168, HOUR)
    cells = m.select("bldg_id", "week", F.posexplode("values").alias("slot", "energy"))
    return cells.select("bldg_id", "week", long("slot").alias("slot"), r6("energy").alias("energy"))


WHOLE = f"SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range({DIMENSIONS})) AS i FROM embeddings"
LIMITS = (0.05, 0.1, 0.15, 0.2) * (DIMENSIONS // 4)


@query(
    "fn_array_threshold_argmax",
    f"""WITH f AS ({WHOLE}), o AS (SELECT *, greatest(v - ([0.05, 0.1, 0.15, 0.2])[i % 4 + 1], 0) AS o FROM f),
        b AS (SELECT vec_id, max(o) AS top, arg_min(i, {{'a': -o, 'b': i}}) AS over_i, arg_min(i, {{'a': -v, 'b': i}}) AS plain_i FROM o GROUP BY 1)
        SELECT vec_id, CASE WHEN top > 0 THEN over_i ELSE plain_i END AS label FROM b""",
)
def fn_array_threshold_argmax(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", long(arrays.threshold_argmax("v", list(LIMITS))).alias("label"))


@query(
    "fn_softmax_by_block",
    f"""WITH f AS ({WHOLE}), e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id, i // 16)) AS e FROM f)
        SELECT vec_id, i AS pos, round(e / sum(e) OVER (PARTITION BY vec_id, i // 16), 6) AS p FROM e""",
)
def fn_softmax_by_block(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    soft = rows.select("vec_id", arrays.softmax_blocks("v", [(i, 16) for i in range(0, DIMENSIONS, 16)]).alias("p"))
    out = soft.select("vec_id", F.posexplode("p").alias("pos", "p"))
    return out.select("vec_id", long("pos").alias("pos"), r6("p").alias("p"))


@query(
    "fn_ensemble_mode",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest([l_orderkey % 3, l_partkey % 3, l_suppkey % 3]) AS v FROM lineitem),
       c AS (SELECT l_orderkey, l_linenumber, l_partkey, v, count(*) AS n FROM v GROUP BY ALL)
       SELECT l_orderkey, l_linenumber, l_partkey, arg_min(v, {'a': -n, 'b': v}) AS vote FROM c GROUP BY 1, 2, 3""",
)
def fn_ensemble_mode(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = table(spark, sf, "lineitem").select(*keys, *[(F.col(c) % 3).alias(f"m_{c}") for c in ("l_orderkey", "l_partkey", "l_suppkey")])
    return encode.majority(rows, keys, ["m_l_orderkey", "m_l_partkey", "m_l_suppkey"])


@query(
    "fn_ensemble_mean",
    "SELECT label, i AS pos, round(avg(v), 6) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(len(embedding))) AS BIGINT) AS i FROM embeddings) GROUP BY 1, 2",
)
def fn_ensemble_mean(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("label", v.alias("v"))
    return rounded(encode.mean_of_arrays(rows, ["label"], "v"), ["label"])


@query(
    "fn_quantile_groups",
    """SELECT o_totalprice, any_value(CAST(floor((r - 1) * 10 / t) AS BIGINT)) AS decile FROM (
       SELECT o_totalprice, rank() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS t FROM orders) GROUP BY 1""",
)
def fn_quantile_groups(spark, sf):
    ranks = value_ranks(table(spark, sf, "orders").select("o_totalprice"), [], "o_totalprice")
    return ranks.select("o_totalprice", F.floor(F.col("below") * 10 / F.col("total")).alias("decile"))
