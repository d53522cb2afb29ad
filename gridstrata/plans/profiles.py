"""Load-profile aggregations."""

from pyspark.sql import functions as F

from gridstrata.functions import calendar as cal
from gridstrata.operators import profile
from gridstrata.operators.blocks import HOUR
from gridstrata.operators.lags import threshold_counts
from gridstrata.operators.ranks import exact_quantiles
from gridstrata.plans.base import grid, long, r6, readings, with_
from gridstrata.plans.registry import query
from gridstrata.sources import table

SEASONS, WEEKDAYS, HOURS, MONTHS = range(3), range(7), range(24), range(1, 13)
BUCKETS = {"season": SEASONS, "tou": range(3), "weekend": (0, 1), "holiday": (0, 1), "month": MONTHS, "hour": HOURS}


def rounded(df, keys, digits=6):
    """Doubles rounded, integers widened, keys left as they are."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if f.name not in keys and kind == "double":
            c = F.round(c, digits)
        elif f.name not in keys and kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind == "boolean":
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def profile_sql(stats, buckets, value="energy"):
    fn = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}
    return ", ".join(
        f"round({fn[s]}({value}) FILTER ({b} = {v}), 6) AS {s}_{b}_{v}" for b, vs in buckets.items() for v in vs for s in stats
    )


@query(
    "agg_conditional_profile",
    with_("readings", "cal") + f"SELECT bldg_id, {profile_sql(('mean', 'max', 'min', 'sum'), BUCKETS)} FROM cal GROUP BY 1",
)
def agg_conditional_profile(spark, sf):
    df = profile.with_calendar(readings(spark, sf))
    return rounded(profile.conditional_profile(df, ["bldg_id"], "energy", BUCKETS, ("mean", "max", "min", "sum")), ["bldg_id"])


@query(
    "join_feature_tables",
    with_(
        "readings", "cal",
        a=f"SELECT bldg_id, {profile_sql(('mean',), {'season': SEASONS, 'hour': HOURS})} FROM cal GROUP BY 1",
        b="SELECT bldg_id, round(stddev_samp(energy), 6) AS std, round(max(energy), 6) AS peak FROM cal GROUP BY 1",
        c="SELECT bldg_id, count(DISTINCT day) AS n_days FROM cal GROUP BY 1",
    )
    + "SELECT a.*, b.std, b.peak, c.n_days FROM a LEFT JOIN b USING (bldg_id) LEFT JOIN c USING (bldg_id)",
)
def join_feature_tables(spark, sf):
    df = profile.with_calendar(readings(spark, sf))
    a = profile.conditional_profile(df, ["bldg_id"], "energy", {"season": SEASONS, "hour": HOURS}, ("mean",))
    b = df.groupBy("bldg_id").agg(F.stddev_samp("energy").alias("std"), F.max("energy").alias("peak"))
    c = df.groupBy("bldg_id").agg(F.count_distinct("day").alias("n_days"))
    return rounded(a.join(b, "bldg_id", "left").join(c, "bldg_id", "left"), ["bldg_id"])


@query(
    "agg_long_profile",
    with_("readings", "cal")
    + " UNION ALL ".join(
        f"""SELECT bldg_id, '{b}' AS kind, CAST({b} AS VARCHAR) AS bucket, count(energy) AS n,
            round(avg(energy), 6) AS mean, round(max(energy), 6) AS max FROM cal GROUP BY ALL"""
        for b in ("season", "month", "weekday", "hour")
    ),
)
def agg_long_profile(spark, sf):
    df = profile.with_calendar(readings(spark, sf))
    out = profile.long_profile(df, ["bldg_id"], "energy", ["season", "month", "weekday", "hour"], ("mean", "max"))
    return rounded(out, ["bldg_id"])


def _pivot_sql(bucket, values, suffix):
    fn = {"mean": "avg(energy)", "median": "quantile_cont(energy, 0.5)", "max": "max(energy)", "min": "min(energy)", "std": "stddev_samp(energy)"}
    return ", ".join(f'round({e} FILTER ({bucket} = {v}), 6) AS "{n}_{v}_{suffix}"' for v in values for n, e in fn.items())


@query("agg_pivot_profile", with_("readings", "cal") + f"SELECT bldg_id, {_pivot_sql('weekday', WEEKDAYS, 'wd')} FROM cal GROUP BY 1")
def agg_pivot_profile(spark, sf):
    df = profile.with_calendar(readings(spark, sf))
    return rounded(profile.pivot_profile(df, ["bldg_id"], "energy", "weekday", WEEKDAYS, "wd"), ["bldg_id"])


SLOTS = [f"{h:02d}:{m:02d}" for h in range(24) for m in (0, 15, 30, 45)]


@query(
    "agg_quarter_profile_scaled",
    with_("readings", p="SELECT bldg_id, max(energy) AS peak FROM readings GROUP BY 1")
    + "SELECT bldg_id, "
    + ", ".join(f"round(coalesce(avg(energy) FILTER (strftime(ts, '%H:%M') = '{s}') / any_value(peak), 0), 6) AS \"{s}\"" for s in SLOTS)
    + " FROM readings JOIN p USING (bldg_id) WHERE isodow(ts) < 6 GROUP BY 1",
)
def agg_quarter_profile_scaled(spark, sf):
    return rounded(profile.quarter_profile_scaled(readings(spark, sf), "bldg_id", "ts", "energy", SLOTS), ["bldg_id"])


@query(
    "agg_ratio_to_state",
    with_("readings", s="SELECT *, bldg_id % 25 AS state FROM readings", g="SELECT state, avg(energy) AS g FROM s GROUP BY 1")
    + """SELECT bldg_id, state, round(kurtosis_pop(energy), 6) AS kurt, round(avg(energy) / any_value(g), 6) AS mean_ratio,
         round(max(energy) / any_value(g), 6) AS max_ratio, round(min(energy) / any_value(g), 6) AS min_ratio,
         round(stddev_samp(energy) / any_value(g), 6) AS std_ratio FROM s JOIN g USING (state) GROUP BY 1, 2""",
)
def agg_ratio_to_state(spark, sf):
    df = readings(spark, sf).withColumn("state", F.col("bldg_id") % 25)
    return rounded(profile.ratio_to_group(df, "bldg_id", "state", "energy"), ["bldg_id"])


NAMES = {"Winter": "12, 1, 2", "Spring": "3, 4, 5", "Summer": "6, 7, 8", "Autumn": "9, 10, 11"}


@query(
    "agg_season_hour_pivot",
    with_("readings", "cal")
    + "SELECT bldg_id, "
    + ", ".join(f'round(4 * avg(energy) FILTER (month IN ({m}) AND hour = {h}), 6) AS "{n}_{h}"' for n, m in NAMES.items() for h in HOURS)
    + " FROM cal GROUP BY 1",
)
def agg_season_hour_pivot(spark, sf):
    return rounded(profile.season_hour_pivot(readings(spark, sf), "bldg_id", "ts", "energy"), ["bldg_id"])


@query(
    "agg_daily_argmax_hours",
    with_("grid", "gcal", m="SELECT *, max(energy) OVER w AS hi, min(energy) OVER w AS lo FROM gcal WINDOW w AS (PARTITION BY bldg_id, day)")
    + "SELECT bldg_id, "
    + ", ".join(
        f"""round(count(DISTINCT day) FILTER (hour = {h} AND energy = hi) / 365.0, 6) AS max_hour_{h},
            round(count(DISTINCT day) FILTER (hour = {h} AND energy = lo) / 365.0, 6) AS min_hour_{h}"""
        for h in HOURS
    )
    + " FROM m GROUP BY 1",
)
def agg_daily_argmax_hours(spark, sf):
    df = profile.with_calendar(grid(spark, sf))
    return rounded(profile.extreme_slots(df, ["bldg_id"], ["day"], "hour", "energy", HOURS, 365.0), ["bldg_id"])


@query(
    "agg_diff_to_day_stats",
    with_("grid", "gcal", m="SELECT *, avg(energy) OVER w AS av, max(energy) OVER w AS hi, min(energy) OVER w AS lo FROM gcal WINDOW w AS (PARTITION BY bldg_id, day)")
    + """SELECT bldg_id, hour, round(avg(energy - av), 6) AS vs_mean, round(avg(energy - lo), 6) AS vs_min,
         round(avg(energy - hi), 6) AS vs_max FROM m GROUP BY 1, 2""",
)
def agg_diff_to_day_stats(spark, sf):
    df = profile.with_calendar(grid(spark, sf))
    return rounded(profile.diff_to_period(df, ["bldg_id"], ["day"], "hour", "energy"), ["bldg_id"])


@query(
    "agg_weekly_argmax_days",
    with_("grid", "gcal", m="SELECT *, max(energy) OVER w AS hi, min(energy) OVER w AS lo FROM gcal WINDOW w AS (PARTITION BY bldg_id, week)")
    + "SELECT bldg_id, "
    + ", ".join(
        f"""round(count(DISTINCT week) FILTER (weekday = {d} AND energy = hi) / 53.0, 6) AS max_weekday_{d},
            round(count(DISTINCT week) FILTER (weekday = {d} AND energy = lo) / 53.0, 6) AS min_weekday_{d}"""
        for d in WEEKDAYS
    )
    + " FROM m GROUP BY 1",
)
def agg_weekly_argmax_days(spark, sf):
    df = profile.with_calendar(grid(spark, sf))
    return rounded(profile.extreme_slots(df, ["bldg_id"], ["week"], "weekday", "energy", WEEKDAYS, 53.0), ["bldg_id"])


DROP = {
    "p": """SELECT *, CASE WHEN count(energy) OVER w = 4 THEN avg(energy) OVER w END AS past FROM grid
            WINDOW w AS (PARTITION BY bldg_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    "d": """SELECT bldg_id, ts, round(lead(past, 5) OVER (PARTITION BY bldg_id ORDER BY ts) - past, 9) AS drop,
            date_trunc('month', ts) AS month, date_trunc('week', ts) AS week, date_trunc('day', ts) AS day, hour(ts) AS hour,
            isodow(ts) - 1 AS weekday FROM p""",
}


@query(
    "agg_past_future_diff",
    with_("grid", **DROP)
    + """SELECT bldg_id, day, arg_min(ts, {'a': -drop, 'b': ts}) FILTER (hour BETWEEN 3 AND 13 AND drop IS NOT NULL) AS time_begin,
         arg_max(ts, {'a': -drop, 'b': ts}) FILTER (hour >= 6 AND drop IS NOT NULL) AS time_end,
         round(max(drop) FILTER (hour BETWEEN 3 AND 13), 6) AS drop_begin, round(min(drop) FILTER (hour >= 6), 6) AS drop_end
       FROM d GROUP BY 1, 2""",
)
def agg_past_future_diff(spark, sf):
    diff = profile.past_future_diff(grid(spark, sf), ["bldg_id"], "ts", "energy", HOUR).withColumn("drop", F.round("drop", 9))
    diff = diff.withColumns({"day": F.date_trunc("day", "ts"), "hour": F.hour("ts")})
    begin, end = F.col("hour").between(3, 13), F.col("hour") >= 6
    edges = profile.day_edges(diff, ["bldg_id"], "ts", begin, end)
    return diff.groupBy("bldg_id", "day").agg(
        *[c.alias(n) for n, c in edges.items()],
        r6(F.max(F.when(begin, F.col("drop")))).alias("drop_begin"), r6(F.min(F.when(end, F.col("drop")))).alias("drop_end"),
    )


@query(
    "agg_robust_increment",
    with_(
        "grid", **DROP,
        w="SELECT bldg_id, month, week, weekday, max(drop) AS inc, min(drop) AS dec FROM d GROUP BY ALL",
        m="SELECT bldg_id, month, weekday, min(inc) AS inc, max(dec) AS dec FROM w GROUP BY ALL",
    )
    + "SELECT bldg_id, "
    + ", ".join(
        f"""round(avg(inc) FILTER (weekday = {d}), 6) AS increment_weekday_{d},
            round(avg(dec) FILTER (weekday = {d}), 6) AS decrement_weekday_{d}"""
        for d in WEEKDAYS
    )
    + " FROM m GROUP BY 1",
)
def agg_robust_increment(spark, sf):
    out = profile.robust_increment(grid(spark, sf), "bldg_id", "ts", "energy", HOUR, "weekday", WEEKDAYS)
    return rounded(out, ["bldg_id"])


@query(
    "agg_range_work",
    with_(
        "grid", p=DROP["p"], d=DROP["d"].replace("round(", "(").replace(", 9)", ")"),
        e="""SELECT bldg_id, month, week, day, arg_min(ts, {'a': -drop, 'b': ts}) FILTER (hour BETWEEN 3 AND 13 AND drop IS NOT NULL) AS b,
             arg_max(ts, {'a': -drop, 'b': ts}) FILTER (hour >= 6 AND drop IS NOT NULL) AS f FROM d GROUP BY ALL""",
        w="SELECT bldg_id, month, week, max(CAST(trunc((epoch(f) - epoch(b)) / 3600) AS BIGINT)) AS r FROM e GROUP BY ALL",
        m="SELECT bldg_id, month, min(r) AS r FROM w GROUP BY ALL",
    )
    + "SELECT bldg_id, round(avg(r), 6) AS range_work FROM m GROUP BY 1",
)
def agg_range_work(spark, sf):
    begin, end = F.col("hour").between(3, 13), F.col("hour") >= 6
    return rounded(profile.range_work(grid(spark, sf), "bldg_id", "ts", "energy", HOUR, begin, end), ["bldg_id"])


GROUPS = [f"{s}_{w}" for s in SEASONS for w in (0, 1)]


@query(
    "agg_multi_stat_groups",
    with_("readings", "cal")
    + "SELECT bldg_id, "
    + ", ".join(
        f"""coalesce(round({e} FILTER (season = {g[0]} AND weekend = {g[2]}), 6), -1) AS "{g}_{n}" """
        for g in GROUPS
        for n, e in (("mean", "avg(energy)"), ("sum", "sum(energy)"), ("std", "stddev_samp(energy)"), ("max", "max(energy)"))
    )
    + " FROM cal GROUP BY 1",
)
def agg_multi_stat_groups(spark, sf):
    from gridstrata.operators.reshape import flatten_groups

    df = profile.with_calendar(readings(spark, sf))
    stats = {"mean": F.avg("energy"), "sum": F.sum("energy"), "std": F.stddev_samp("energy"), "max": F.max("energy")}
    wide = flatten_groups(df, ["bldg_id"], ["season", "weekend"], stats, GROUPS)
    return rounded(wide, ["bldg_id"]).na.fill(-1.0)


@query(
    "agg_season_ratios",
    with_("readings", "cal", s="""SELECT bldg_id, avg(energy) FILTER (season = 0) AS cold, avg(energy) FILTER (season = 1) AS hot,
        avg(energy) FILTER (season = 2) AS mild, avg(energy) FILTER (weekend = 1) AS we, avg(energy) FILTER (weekend = 0) AS wd FROM cal GROUP BY 1""")
    + """SELECT bldg_id, round(cold / hot, 6) AS cold_hot, round(cold / mild, 6) AS cold_mild, round((hot - mild) / mild, 6) AS hot_step,
         round(we / wd, 6) AS weekend_weekday FROM s""",
)
def agg_season_ratios(spark, sf):
    df = profile.with_calendar(readings(spark, sf))
    s = profile.conditional_profile(df, ["bldg_id"], "energy", {"season": SEASONS, "weekend": (0, 1)}, ("mean",))
    cold, hot, mild = (F.col(f"mean_season_{i}") for i in SEASONS)
    return s.select(
        "bldg_id", r6(F.try_divide(cold, hot)).alias("cold_hot"), r6(F.try_divide(cold, mild)).alias("cold_mild"),
        r6(F.try_divide(hot - mild, mild)).alias("hot_step"),
        r6(F.try_divide("mean_weekend_1", "mean_weekend_0")).alias("weekend_weekday"),
    )


@query(
    "agg_max_of_mins",
    with_(
        "readings", "cal",
        d="SELECT bldg_id, month, day, min(energy) AS mn, max(energy) AS mx FROM cal GROUP BY ALL",
        p="SELECT bldg_id, month, max(mn) AS a, min(mx) AS b FROM d GROUP BY ALL",
        s="SELECT bldg_id, stddev_samp(mn) AS min_std, stddev_samp(mx) AS max_std FROM d GROUP BY 1",
    )
    + """SELECT bldg_id, round(max(a), 6) AS max_of_mins_max, round(min(a), 6) AS max_of_mins_min, round(max(b), 6) AS min_of_maxs_max,
         round(min(b), 6) AS min_of_maxs_min, arg_min(month, {'x': -a, 'y': month}) AS max_of_mins_max_at,
         arg_min(month, {'x': a, 'y': month}) AS max_of_mins_min_at, arg_min(month, {'x': -b, 'y': month}) AS min_of_maxs_max_at,
         arg_min(month, {'x': b, 'y': month}) AS min_of_maxs_min_at, round(any_value(min_std), 6) AS min_std,
         round(any_value(max_std), 6) AS max_std FROM p JOIN s USING (bldg_id) GROUP BY 1""",
)
def agg_max_of_mins(spark, sf):
    df = profile.with_calendar(readings(spark, sf))
    return rounded(profile.extremes_of_days(df, ["bldg_id"], "month", "ts", "energy"), ["bldg_id"])


@query(
    "agg_amplitude",
    with_("readings", "cal", p="SELECT bldg_id, week, max(energy) - min(energy) AS amp, min(energy) AS mn FROM cal GROUP BY ALL")
    + """SELECT bldg_id, round(avg(amp), 6) AS amp_mean, round(avg(amp / mn), 6) AS share_mean, round(stddev_pop(amp / mn), 6) AS share_std,
         arg_min(week, {'x': -(amp / mn), 'y': week}) AS max_at, arg_min(week, {'x': amp / mn, 'y': week}) AS min_at FROM p GROUP BY 1""",
)
def agg_amplitude(spark, sf):
    df = profile.with_calendar(readings(spark, sf))
    return rounded(profile.amplitude(df, ["bldg_id"], "week", "energy"), ["bldg_id"])


@query(
    "agg_value_counts",
    with_(
        q="SELECT l_suppkey AS bldg_id, month(l_shipdate) AS month, l_quantity AS energy FROM lineitem",
        f="SELECT bldg_id, month, energy, count(*) AS c FROM q GROUP BY ALL",
        m="SELECT bldg_id, month, max(c) AS top FROM f GROUP BY ALL",
    )
    + """SELECT bldg_id, month, min(energy) FILTER (c = top) AS most_seen, max(c) AS most_seen_times,
         count(*) FILTER (c = top) AS most_seen_ties, round(quantile_cont(c, 0.1), 6) AS q10, round(quantile_cont(c, 0.9), 6) AS q90
       FROM f JOIN m USING (bldg_id, month) GROUP BY ALL""",
)
def agg_value_counts(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("bldg_id"), F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("energy")
    )
    out = profile.value_counts(df, ["bldg_id", "month"], "energy", {"q10": 0.1, "q90": 0.9})
    return rounded(out, ["bldg_id", "most_seen"])


LAGS = {f"{way}_{n}": k * sign for n, k in {"1": 1, "2": 2, "3": 3, "4": 4, "8": 8, "week": 168, "month": 672}.items() for way, sign in (("last", 1), ("next", -1))}
# 2 % to 10 % in steps of 2, then to 100 % in steps of 5.
THRESHOLDS = [2, 4, 6, 8, 10, *range(15, 101, 5)]


@query(
    "agg_threshold_counts",
    with_("grid", l="SELECT bldg_id, unnest([" + ", ".join(f"'{n}'" for n in LAGS) + "]) AS lag, unnest(["
          + ", ".join(f"(energy - {'lag' if k > 0 else 'lead'}(energy, {abs(k)}) OVER w) / nullif(energy, 0)" for k in LAGS.values())
          + "]) AS pct FROM grid WINDOW w AS (PARTITION BY bldg_id ORDER BY ts)")
    + "SELECT bldg_id, lag, " + ", ".join(
        f"count(*) FILTER (pct > {t / 100}) AS gt_{t}, count(*) FILTER (pct < -{t / 100}) AS lt_{t}" for t in THRESHOLDS)
    + " FROM l GROUP BY 1, 2",
)
def agg_threshold_counts(spark, sf):
    return threshold_counts(grid(spark, sf), ["bldg_id"], "ts", "energy", LAGS, HOUR, THRESHOLDS)


@query(
    "agg_ramp_stats",
    with_("grid", d="SELECT bldg_id, energy - lag(energy) OVER (PARTITION BY bldg_id ORDER BY ts) AS d FROM grid")
    + """SELECT bldg_id, round(avg(CASE WHEN d > 0 THEN d ELSE 0 END), 6) AS up_mean, round(stddev_samp(CASE WHEN d > 0 THEN d ELSE 0 END), 6) AS up_std,
         round(avg(CASE WHEN d < 0 THEN -d ELSE 0 END), 6) AS down_mean, round(stddev_samp(CASE WHEN d < 0 THEN -d ELSE 0 END), 6) AS down_std
       FROM d WHERE d IS NOT NULL GROUP BY 1""",
)
def agg_ramp_stats(spark, sf):
    return rounded(profile.ramp_stats(grid(spark, sf), ["bldg_id"], "ts", "energy", HOUR), ["bldg_id"])


MARKS = (0, 20, 100, 200, 300)


@query(
    "agg_load_duration",
    with_("readings", r="""SELECT *, row_number() OVER (PARTITION BY bldg_id ORDER BY energy) AS up,
          row_number() OVER (PARTITION BY bldg_id ORDER BY energy DESC) AS dn, sum(energy) OVER (PARTITION BY bldg_id) AS t FROM readings""")
    + "SELECT bldg_id, " + ", ".join(
        f"""CASE WHEN count(*) > {m} THEN round(sum(energy) FILTER (up <= {m + 1}) / any_value(t), 6) END AS load_{m},
            CASE WHEN count(*) > {m} THEN round(sum(energy) FILTER (dn <= {m + 1}) / any_value(t), 6) END AS unload_{m}""" for m in MARKS)
    + " FROM r GROUP BY 1",
)
def agg_load_duration(spark, sf):
    return rounded(profile.load_duration(readings(spark, sf), ["bldg_id"], "energy", MARKS), ["bldg_id"])


@query(
    "agg_overall_stats",
    with_("readings", "cal")
    + """SELECT bldg_id, round(max(energy) - min(energy), 6) AS range, round(stddev_samp(energy), 6) AS std,
         round(var_samp(energy), 6) AS variance, round(skewness(energy), 6) AS skew, round(kurtosis(energy), 6) AS kurt,
         round(max(energy) / avg(energy), 6) AS peak_to_average, arg_min(hour, {'a': -energy, 'b': ts}) AS peak_hour,
         round(avg(energy) FILTER (weekend = 1), 6) AS weekend_mean, round(avg(energy) FILTER (weekend = 0), 6) AS weekday_mean,
         round(avg(energy) FILTER (season = 0), 6) AS winter_mean, round(avg(energy) FILTER (season = 1), 6) AS summer_mean
       FROM cal GROUP BY 1""",
)
def agg_overall_stats(spark, sf):
    return rounded(profile.overall_stats(readings(spark, sf), ["bldg_id"], "ts", "energy"), ["bldg_id"])


@query(
    "agg_period_quantiles",
    with_("readings", "cal")
    + """SELECT bldg_id, season, weekend, round(avg(energy), 6) AS mean, round(stddev_samp(energy), 6) AS std, round(max(energy), 6) AS max,
         round(min(energy), 6) AS min, round(quantile_cont(energy, 0.25), 6) AS q25, round(quantile_cont(energy, 0.75), 6) AS q75
       FROM cal GROUP BY 1, 2, 3""",
)
def agg_period_quantiles(spark, sf):
    df = profile.with_calendar(readings(spark, sf))
    keys = ["bldg_id", "season", "weekend"]
    stats = df.groupBy(*keys).agg(*[profile.STATS[s]("energy").alias(s) for s in ("mean", "std", "max", "min")])
    return rounded(stats.join(exact_quantiles(df, keys, "energy", {"q25": 0.25, "q75": 0.75}), keys), ["bldg_id"])


PCTS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@query(
    "agg_distribution_190",
    with_(
        "readings", "cal",
        t="SELECT bldg_id, sum(energy) AS total, avg(energy) AS mean, quantile_cont(energy, 0.5) AS med, count(*) AS n FROM readings GROUP BY 1",
        r="SELECT bldg_id, energy, row_number() OVER (PARTITION BY bldg_id ORDER BY energy) AS rn FROM readings",
        a="SELECT bldg_id, " + ", ".join(f"round(quantile_cont(energy, {p}), 6) AS {n}" for n, p in PCTS.items())
        + """, round(quantile_cont(energy, 0.99) - quantile_cont(energy, 0.01) / quantile_cont(energy, 0.5), 6) AS spread
             FROM readings GROUP BY 1""",
        b="""SELECT bldg_id, round(exp(avg(ln(energy))), 6) AS geometric_mean, round(-sum(energy / total * ln(energy / total)), 6) AS entropy,
             round(avg(abs(energy - mean)), 6) AS mean_abs_dev, round(avg(energy) / max(energy), 6) AS mean_to_peak,
             round(quantile_cont(abs(energy - med), 0.5), 6) AS median_abs_dev FROM readings JOIN t USING (bldg_id) GROUP BY 1""",
        c="""SELECT bldg_id, round(avg(energy), 6) AS trimmed_mean, round(max(energy) - min(energy), 6) AS trimmed_range
             FROM r JOIN t USING (bldg_id) WHERE rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1) GROUP BY 1""",
        dd="SELECT bldg_id, date_trunc('day', ts) AS p, sum(energy) AS s FROM readings GROUP BY ALL",
        d="SELECT bldg_id, " + ", ".join(f"round(quantile_cont(s, {p}), 6) AS day_{n}" for n, p in PCTS.items()) + " FROM dd GROUP BY 1",
        mm="SELECT bldg_id, date_trunc('month', ts) AS p, sum(energy) AS s FROM readings GROUP BY ALL",
        m="SELECT bldg_id, " + ", ".join(f"round(quantile_cont(s, {p}), 6) AS month_{n}" for n, p in PCTS.items()) + " FROM mm GROUP BY 1",
        k="""SELECT bldg_id, k.kind, k.bucket, sum(energy) AS s FROM (SELECT *, unnest([{'kind': 'hour', 'bucket': CAST(hour AS VARCHAR)},
             {'kind': 'weekday', 'bucket': CAST(weekday AS VARCHAR)}, {'kind': 'month', 'bucket': CAST(month AS VARCHAR)},
             {'kind': 'season', 'bucket': CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Spring'
               WHEN month IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END},
             {'kind': 'week_of_month', 'bucket': CAST((day(ts) + 6) // 7 AS VARCHAR)}]) AS k FROM cal) GROUP BY ALL""",
        e="SELECT bldg_id, " + ", ".join(
            f"""arg_min(bucket, {{'a': -round(s, 6), 'b': bucket}}) FILTER (kind = '{n}') AS peak_{n},
                round(max(s) FILTER (kind = '{n}'), 6) AS peak_{n}_sum""" for n in ("hour", "weekday", "month", "season", "week_of_month"))
        + " FROM k GROUP BY 1",
    )
    + "SELECT * FROM a JOIN b USING (bldg_id) JOIN c USING (bldg_id) JOIN d USING (bldg_id) JOIN m USING (bldg_id) JOIN e USING (bldg_id)",
)
def agg_distribution_190(spark, sf):
    df, key = readings(spark, sf), ["bldg_id"]
    quant = exact_quantiles(df, key, "energy", {**PCTS, "_a": 0.01, "_z": 0.99})
    quant = quant.withColumn("spread", F.col("_z") - F.col("_a") / F.col("p50")).drop("_a", "_z")
    parts = [
        profile.shape_stats(df, key, "energy"), profile.median_abs_dev(df, key, "energy"), profile.trimmed(df, key, "energy"),
        profile.period_sum_quantiles(df, key, "ts", "energy", "day", PCTS),
        profile.period_sum_quantiles(df, key, "ts", "energy", "month", PCTS),
        profile.calendar_peaks(df, key, "ts", "energy"),
    ]
    for p in parts:
        quant = quant.join(p, key)
    return rounded(quant, key)


@query(
    "agg_quarter_hour_outliers",
    with_(
        "readings",
        s="""SELECT bldg_id, hour(ts) * 4 + minute(ts) // 15 AS slot, isodow(ts) >= 6 AS we, avg(energy) AS m FROM readings GROUP BY ALL""",
        q="""SELECT bldg_id, quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.75) AS q3, avg(m) AS slot_mean, stddev_samp(m) AS slot_std,
             max(m) AS slot_max, min(m) AS slot_min FROM s GROUP BY 1""",
    )
    + """SELECT bldg_id, round(q1, 6) AS q1, round(q3, 6) AS q3, round(slot_mean, 6) AS slot_mean, round(slot_std, 6) AS slot_std,
         round(slot_max, 6) AS slot_max, round(slot_min, 6) AS slot_min, count(*) FILTER (m > q3 + 0.5 * (q3 - q1)) AS n_high,
         count(*) FILTER (m < q1 - 0.5 * (q3 - q1)) AS n_low FROM s JOIN q USING (bldg_id) GROUP BY ALL""",
)
def agg_quarter_hour_outliers(spark, sf):
    return rounded(profile.slot_outliers(readings(spark, sf), "bldg_id", "ts", "energy"), ["bldg_id"])


@query(
    "agg_week_time_profile",
    with_(
        "grid", m="SELECT bldg_id, (isodow(ts) - 1) * 24 + hour(ts) AS slot, avg(energy) AS m FROM grid GROUP BY ALL",
        z="SELECT bldg_id, slot, (m - avg(m) OVER w) / stddev_pop(m) OVER w AS z FROM m WINDOW w AS (PARTITION BY bldg_id)",
    )
    + """SELECT slot, round(quantile_cont(z, 0.1), 6) AS d10, round(quantile_cont(z, 0.5), 6) AS d50, round(quantile_cont(z, 0.9), 6) AS d90
       FROM z GROUP BY 1""",
)
def agg_week_time_profile(spark, sf):
    z = profile.week_time_profile(grid(spark, sf), "bldg_id", "ts", "energy")
    return rounded(exact_quantiles(z, ["slot"], "z", {"d10": 0.1, "d50": 0.5, "d90": 0.9}), [])


@query(
    "agg_weekday_weekend_ratio",
    with_("readings") + """SELECT bldg_id, round(avg(energy) FILTER (isodow(ts) < 6) / avg(energy) FILTER (isodow(ts) >= 6), 6) AS ratio
    FROM readings GROUP BY 1""",
)
def agg_weekday_weekend_ratio(spark, sf):
    we = cal.is_weekend("ts")
    mean = lambda c: F.avg(F.when(c, F.col("energy")))
    return readings(spark, sf).groupBy("bldg_id").agg(r6(F.try_divide(mean(~we), mean(we))).alias("ratio"))


@query(
    "agg_rollup_load",
    with_("readings", "cal")
    + """SELECT coalesce(season, -1) AS season, coalesce(month, -1) AS month, coalesce(weekday, -1) AS weekday, round(sum(energy), 4) AS total, count(*) AS n, CAST(grouping_id(season, month, weekday) AS BIGINT) AS level
       FROM cal GROUP BY ROLLUP (season, month, weekday)""",
)
def agg_rollup_load(spark, sf):
    df = profile.with_calendar(readings(spark, sf))
    return df.rollup("season", "month", "weekday").agg(
        r6(F.sum("energy"), 4).alias("total"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")
    ).select(*[F.coalesce(long(c), F.lit(-1)).alias(c) for c in ("season", "month", "weekday")], "total", "n", "level")
