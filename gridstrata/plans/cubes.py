"""Profiles over many calendar groupings at once, from one read of the readings."""

from pyspark.sql import functions as F

from gridstrata.functions import calendar as cal
from gridstrata.operators import cube
from gridstrata.operators.blocks import HOUR, over_blocks
from gridstrata.operators.resample import spread
from gridstrata.plans.base import grid, r6, readings, with_
from gridstrata.plans.registry import query

KEY = ["bldg_id"]

# ---- thirteen groupings, several measures ---------------------------------------------------------------------------

# Columns are made when a query runs, as they need a session.


def _hour():
    return F.col("hour")


def _day():
    return F.col("day")


#: Parts of a bucket's name: the column of day and hour, and the same over the view's stamp.
PARTS = {
    "hour": (lambda: _hour(), "hour(ts)"),
    "week": (lambda: F.weekofyear(_day()), "week(ts)"),
    "dayofweek": (lambda: F.weekday(_day()), "isodow(ts) - 1"),
    "is_holiday": (lambda: cal.is_holiday(_day()).cast("int"), "holiday"),
    "is_weekend": (lambda: cal.is_weekend(_day()).cast("int"), "weekend"),
    "hour_period": (
        lambda: cal.hour_band(_hour()),
        "CASE WHEN hour(ts) = 0 THEN '22_24' " + " ".join(f"WHEN hour(ts) BETWEEN {a} AND {z} THEN '{a}_{z}'" for a, z in cal.HOUR_BANDS) + " END"),
    "day_period": (
        lambda: cal.day_period(_hour()),
        "CASE WHEN hour(ts) BETWEEN 1 AND 6 THEN 'night' WHEN hour(ts) BETWEEN 7 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 14 THEN 'noon' "
        "WHEN hour(ts) BETWEEN 15 AND 19 THEN 'afternoon' ELSE 'evening' END"),
    "season": (
        lambda: cal.season_by_seconds(F.unix_timestamp(_day()) + _hour() * 3600 - F.unix_timestamp(F.date_trunc("year", _day()))),
        "CASE " + " ".join(
            f"WHEN epoch(ts) - epoch(date_trunc('year', ts)) BETWEEN {int(a * 2592000)} AND {int(z * 2592000)} THEN {c}" for c, a, z in cal.SEASON_BANDS) + " ELSE 0 END"),
    "month": (lambda: F.month(_day()), "month(ts)"),
    "year": (lambda: F.lit("all"), "'all'"),
}
SIMPLE = [
    ("hour",), ("week",), ("dayofweek", "day_period"), ("is_holiday",), ("is_weekend", "hour_period"), ("is_weekend", "day_period"), ("season",),
    ("season", "is_weekend", "hour_period")]
COMPLETE = [("month", "is_weekend"), ("year",), ("is_weekend", "month", "day_period"), ("season", "is_weekend"), ("season", "is_weekend", "day_period")]


def bucket(parts, made=False):
    """Name of a bucket; ``made``: the parts are columns already."""
    return F.concat_ws("_", *[F.concat(F.lit(p), (F.col(p) if made else PARTS[p][0]()).cast("string")) for p in parts])


def bucket_sql(parts):
    return " || '_' || ".join(f"'{p}' || CAST({PARTS[p][1]} AS VARCHAR)" for p in parts)


MEASURES = {"energy": ("mean", "sum", "std", "min", "max"), "diff": ("mean", "sum", "std", "min", "max"), "rising": ("mean",)}
_SQL = {"mean": "avg", "sum": "sum", "std": "stddev_samp", "min": "min", "max": "max"}
_STATS = ", ".join(f"coalesce(round({_SQL[s]}({m}), 6), -1) AS {m}_{s}" for m, stats in MEASURES.items() for s in stats)
_IQR = "round(quantile_cont(energy, 0.75) - quantile_cont(energy, 0.25), 6) AS iqr_75_25, round(quantile_cont(energy, 0.9) - quantile_cont(energy, 0.1), 6) AS iqr_90_10"


@query(
    "agg_multi_stat_cube",
    with_(
        "grid", "gcal", d="SELECT *, energy - lag(energy) OVER (PARTITION BY bldg_id ORDER BY ts) AS diff FROM gcal",
        m="SELECT *, CASE WHEN diff > 0 THEN 1.0::DOUBLE WHEN diff IS NOT NULL THEN 0.0::DOUBLE END AS rising FROM d")
    + " UNION ALL ".join(
        f"""SELECT bldg_id, '{'_'.join(g)}' AS "grouping", {bucket_sql(g)} AS bucket, count(*) AS n, {_STATS}, """
        + (_IQR if g in COMPLETE else "NULL::DOUBLE AS iqr_75_25, NULL::DOUBLE AS iqr_90_10") + " FROM m GROUP BY ALL"
        for g in SIMPLE + COMPLETE),
)
def agg_multi_stat_cube(spark, sf):
    """Thirteen groupings of three measures, long; a statistic that a bucket has not is −1, ranges only of the complete groupings."""
    df = over_blocks(grid(spark, sf), KEY, "ts", lambda w: {"diff": F.col("energy") - F.lag("energy").over(w)}, before=HOUR)
    df = df.withColumn("rising", (F.col("diff") > 0).cast("double"))
    # a building has one row for each hour of the axis, so its rows fit one task
    df = spread(df, *KEY)
    states = cube.cells(df, KEY, "ts", list(MEASURES))
    # weeks and holidays are cut from the cells; the other groupings share a level of parts that repeat from week to week
    apart = [g for g in SIMPLE + COMPLETE if set(g) & {"week", "is_holiday"}]
    shared = [g for g in SIMPLE + COMPLETE if g not in apart]
    level = cube.coarser(states, KEY, {p: PARTS[p][0]() for p in dict.fromkeys(p for g in shared for p in g)}, list(MEASURES))
    long = cube.roll_up(level, KEY, {"_".join(g): bucket(g, made=True) for g in shared}, list(MEASURES))
    long = long.unionByName(cube.roll_up(states, KEY, {"_".join(g): bucket(g) for g in apart}, list(MEASURES)))
    by = [*KEY, "grouping", "bucket"]
    ranged = cube.quantiles(
        cube.by_bucket(cube.single(df, KEY, "ts", "energy"), KEY, {"_".join(g): bucket(g) for g in COMPLETE}), by,
        {"q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9}, whole=True)
    stats = [F.coalesce(r6(cube.statistic(m, s)), F.lit(-1.0)).alias(f"{m}_{s}") for m, names in MEASURES.items() for s in names]
    return long.join(ranged, by, "left").select(
        *by, F.col("rows").alias("n"), *stats, r6(F.col("q75") - F.col("q25")).alias("iqr_75_25"), r6(F.col("q90") - F.col("q10")).alias("iqr_90_10"))


# ---- one wide row of bucket products, medians and daily consumption --------------------------------------------------

SEASONS, WEEKDAYS, HOURS, MONTHS, SLOTS = range(3), range(7), range(24), range(1, 13), range(3)
_W = {
    "season": (lambda: cal.season_cold_hot_mild(F.month(_day())), SEASONS), "month": (lambda: F.month(_day()), MONTHS), "weekday": (lambda: F.weekday(_day()), WEEKDAYS), "hour": (lambda: _hour(), HOURS),
    "tou": (lambda: cal.time_of_use(_hour()), SLOTS), "weekend": (lambda: cal.is_weekend(_day()).cast("int"), (0, 1)), "holiday": (lambda: cal.is_holiday(_day()).cast("int"), (1,))}
#: Column prefix: statistic, and the buckets it is taken over.
WIDE = {
    "total": ("sum", [("season",), ("month",), ("weekday",), ("hour",), ()]),
    "mean": ("mean", [
        ("holiday", "tou"), ("season", "tou"), ("month", "tou"), ("season", "weekend"), ("month", "weekend"), ("season", "hour"), ("season", "weekday"),
        ("month", "weekday"), ("month",)]),
    "max": ("max", [("month",)]), "min": ("min", [("month",)]), "median": ("median", [("month",)]),
    "daily": ("daily", [("season",), ("month",), ("holiday",)])}


def _products(dims):
    if not dims:
        return [()]
    return [(v, *rest) for v in _W[dims[0]][1] for rest in _products(dims[1:])]


def _wide_name(prefix, dims, values):
    return "_".join([prefix, *(f"{d}_{v}" for d, v in zip(dims, values))]) if dims else f"{prefix}_ever"


def _wide_sql():
    fn = {"sum": "sum(energy)", "mean": "avg(energy)", "max": "max(energy)", "min": "min(energy)", "median": "quantile_cont(energy, 0.5)", "daily": "avg(daily)"}
    out = []
    for prefix, (stat, groups) in WIDE.items():
        for dims in groups:
            for values in _products(dims):
                where = f" FILTER ({' AND '.join(f'{d} = {v}' for d, v in zip(dims, values))})" if dims else ""
                out.append(f"round({fn[stat]}{where}, 6) AS {_wide_name(prefix, dims, values)}")
    return ", ".join(out)


@query(
    "agg_profile_products",
    with_("readings", "cal", w="SELECT *, sum(energy) OVER (PARTITION BY bldg_id, day) AS daily FROM cal") + f"SELECT bldg_id, {_wide_sql()} FROM w GROUP BY 1",
)
def agg_profile_products(spark, sf):
    """One row per building: totals, means, extremes and medians over buckets and their products, and means of daily sums."""
    return cube.by_key(readings(spark, sf), KEY, _profile_products)


def _profile_products(rows, whole):
    states = cube.cells(rows, KEY, "ts", ["energy"], "energy")
    if whole:
        counted = cube.single(rows, KEY, "ts", "energy")
    else:
        counted = states = cube.written(states, "cells")

    def label(dims):
        return F.concat_ws("_", *[F.concat(F.lit(f"{d}_"), _W[d][0]().cast("string")) for d in dims]) if dims else F.lit("ever")

    wanted = {}  # grouping -> the prefixes made of it
    for prefix, (stat, groups) in WIDE.items():
        for dims in groups:
            wanted.setdefault(dims, []).append((prefix, stat))
    plain = {"-".join(d): label(d) for d in wanted}
    long = cube.roll_up(states, KEY, plain, ["energy"])
    medians = cube.quantiles(cube.by_bucket(counted, KEY, {"month": label(("month",))}), [*KEY, "grouping", "bucket"], {"median": 0.5}, whole)
    days = states.groupBy(*KEY, "day").agg(F.sum("rows").alias("rows"), F.sum("s_energy").alias("s"))
    days = days.withColumn("_e", F.explode(cube.entries({"-".join(d): label(d) for d in WIDE["daily"][1]})))
    daily = days.groupBy(*KEY, F.col("_e.grouping").alias("grouping"), F.col("_e.bucket").alias("bucket")).agg(
        (F.sum(F.col("rows") * F.col("s")) / F.sum("rows")).alias("v"))
    values = None
    for dims, made in wanted.items():
        for prefix, stat in made:
            if stat in ("sum", "mean", "max", "min"):
                entry = F.when(F.col("grouping") == "-".join(dims), F.array(F.struct(F.lit(prefix).alias("p"), cube.statistic("energy", stat).alias("v"))))
                values = [*(values or []), F.coalesce(entry, F.array().cast("array<struct<p:string,v:double>>"))]
    made = long.select(*KEY, "bucket", F.inline(F.flatten(F.array(*values))))
    made = made.unionByName(medians.select(*KEY, "bucket", F.lit("median").alias("p"), F.col("median").alias("v")))
    made = made.unionByName(daily.select(*KEY, "bucket", F.lit("daily").alias("p"), "v"))
    names = [_wide_name(prefix, dims, v) for prefix, (_, groups) in WIDE.items() for dims in groups for v in _products(dims)]
    named = made.select(*KEY, F.concat_ws("_", "p", "bucket").alias("name"), r6("v").alias("v"))
    return named.groupBy(*KEY).pivot("name", names).agg(F.first("v"))


# ---- distributions ---------------------------------------------------------------------------------------------------

PROBS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p100": 1.0}
SEASON_SQL = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring' WHEN month(ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"
TIME_SQL = "CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 15 THEN 'Afternoon' WHEN hour(ts) BETWEEN 16 AND 19 THEN 'Evening' ELSE 'Night' END"
#: Sums whose distribution is asked for: the periods that make one sum, as columns of day and hour and over the view.
SUMS = {
    "hour_sum": (lambda: [_day(), _hour()], "date_trunc('day', ts), hour(ts)"),
    "day_sum": (lambda: [_day()], "date_trunc('day', ts)"),
    "week_sum": (lambda: [F.date_trunc("month", _day()), cal.week_of_month(_day())], "date_trunc('month', ts), (day(ts) + 6) // 7"),
    "month_sum": (lambda: [F.date_trunc("month", _day())], "date_trunc('month', ts)")}


@query(
    "agg_distribution_groups",
    with_(
        "readings",
        v=f"""SELECT bldg_id, 'all' AS "grouping", '' AS bucket, energy AS x FROM readings UNION ALL SELECT bldg_id, 'season', {SEASON_SQL}, energy FROM readings
              UNION ALL SELECT bldg_id, 'time_of_day', {TIME_SQL}, energy FROM readings"""
        + "".join(f" UNION ALL SELECT bldg_id, '{n}', '', s FROM (SELECT bldg_id, sum(energy) AS s FROM readings GROUP BY bldg_id, {p})" for n, (_, p) in SUMS.items())
        + f" UNION ALL SELECT bldg_id, 'time_of_day_sum', t, s FROM (SELECT bldg_id, {TIME_SQL} AS t, sum(energy) AS s FROM readings GROUP BY bldg_id, date_trunc('day', ts), t)",
        t="""SELECT bldg_id, "grouping", bucket, sum(x) AS total, avg(x) AS mean, quantile_cont(x, 0.5) AS med, count(*) AS n FROM v GROUP BY ALL""",
        r="""SELECT *, row_number() OVER (PARTITION BY bldg_id, "grouping", bucket ORDER BY x) AS rn FROM v JOIN t USING (bldg_id, "grouping", bucket)""")
    + """SELECT bldg_id, "grouping", bucket, """ + ", ".join(f"round(quantile_cont(x, {p}), 6) AS {n}" for n, p in PROBS.items())
    + """, round(avg(x) FILTER (rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)), 6) AS trimmed_mean,
         round(max(x) FILTER (rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)) - min(x) FILTER (rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)), 6) AS trimmed_range,
         round(avg(abs(x - mean)), 6) AS mean_abs_dev, round(avg(x) / max(x), 6) AS mean_to_peak, round(-sum(x / total * ln(x / total)), 6) AS entropy,
         round(exp(avg(ln(x))), 6) AS geometric_mean, round(quantile_cont(abs(x - med), 0.5), 6) AS median_abs_dev FROM r GROUP BY ALL""",
)
def agg_distribution_groups(spark, sf):
    """Quantiles, trimmed and absolute deviations, entropy and geometric mean of readings and of sums per period, long."""
    out = cube.by_key(readings(spark, sf), KEY, _distribution_groups)
    names = [c for c in out.columns if c not in (*KEY, "grouping", "bucket")]
    return out.select(*KEY, "grouping", "bucket", *[r6(c).alias(c) for c in names])


def _distribution_groups(rows, whole):
    by, one = [*KEY, "grouping", "bucket"], F.lit(1).cast("bigint").alias("c")
    season, part = cal.season_name(F.month(_day())), cal.time_of_day(_hour())
    values = {"all": F.lit(""), "season": season, "time_of_day": part}
    if whole:
        single = cube.single(rows, KEY, "ts", "energy")
        groups = cube.ordered(cube.by_bucket(single, KEY, values), by)
        # each reading goes to the sums of all its periods at once; a period is known by its parts
        entries = [F.struct(F.lit(n).alias("grouping"), F.lit("").alias("bucket"), F.array(*[p.cast("string") for p in made()]).alias("_p")) for n, (made, _) in SUMS.items()]
        entries.append(F.struct(F.lit("time_of_day_sum").alias("grouping"), part.alias("bucket"), F.array(_day().cast("string")).alias("_p")))
        sums = single.select(*KEY, "x", F.inline(F.array(*entries))).groupBy(*by, "_p").agg(F.sum("x").alias("x"))
        return cube.ordered_distribution(groups.unionByName(cube.ordered(sums, by)), by, PROBS)
    states = cube.written(cube.cells(rows, KEY, "ts", ["energy"], "energy"), "cells")
    values = cube.by_bucket(states, KEY, values)
    hours = states.groupBy(*KEY, "day", "hour").agg(F.sum("s_energy").alias("s"))
    for name, (periods, _) in SUMS.items():
        sums = hours.groupBy(*KEY, *[p.alias(f"_p{i}") for i, p in enumerate(periods())]).agg(F.sum("s").alias("x"))
        values = values.unionByName(sums.select(*KEY, F.lit(name).alias("grouping"), F.lit("").alias("bucket"), "x", one))
    parts = hours.groupBy(*KEY, "day", part.alias("bucket")).agg(F.sum("s").alias("x"))
    values = values.unionByName(parts.select(*KEY, F.lit("time_of_day_sum").alias("grouping"), "bucket", "x", one))
    return cube.distribution(cube.written(values, "values"), by, PROBS)


#: Kinds of calendar buckets: column of day and hour, text over the view, and within which other bucket the peak is sought.
KINDS = {
    "hour": (lambda: _hour().cast("string"), "CAST(hour(ts) AS VARCHAR)"),
    "time_of_day": (lambda: cal.time_of_day(_hour()), TIME_SQL),
    "day": (lambda: F.date_format(_day(), "yyyy-MM-dd"), "strftime(ts, '%Y-%m-%d')"),
    "weekday": (lambda: F.weekday(_day()).cast("string"), "CAST(isodow(ts) - 1 AS VARCHAR)"),
    "week_of_month": (lambda: cal.week_of_month(_day()).cast("string"), "CAST((day(ts) + 6) // 7 AS VARCHAR)"),
    "month": (lambda: F.month(_day()).cast("string"), "CAST(month(ts) AS VARCHAR)"),
    "season": (lambda: cal.season_name(F.month(_day())), SEASON_SQL)}
WITHIN = [(k, "") for k in KINDS] + [("hour", "season"), ("time_of_day", "season"), ("weekday", "season"), ("hour", "weekday"), ("time_of_day", "weekday")]


@query(
    "agg_calendar_extremes",
    with_(
        "readings",
        s=" UNION ALL ".join(
            f"""SELECT bldg_id, '{k}' AS kind, '{w}' AS within, {KINDS[w][1] if w else "''"} AS part, {KINDS[k][1]} AS bucket, round(sum(energy), 6) AS s FROM readings GROUP BY ALL"""
            for k, w in WITHIN))
    + """SELECT bldg_id, kind, within, part, arg_min(bucket, {'a': -s, 'b': bucket}) AS peak, max(s) AS peak_sum, arg_min(bucket, {'a': s, 'b': bucket}) AS valley,
         min(s) AS valley_sum, round(max(s) - min(s), 6) AS range, count(*) AS n_buckets FROM s GROUP BY ALL""",
)
def agg_calendar_extremes(spark, sf):
    """Bucket of the largest and smallest sum for each kind of calendar bucket, overall and within seasons and weekdays."""
    return cube.by_key(readings(spark, sf), KEY, _calendar_extremes)


def _calendar_extremes(rows, whole):
    states = cube.cells(rows, KEY, "ts", ["energy"])
    entries = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(w).alias("within"), (KINDS[w][0]() if w else F.lit("")).alias("part"), KINDS[k][0]().alias("bucket")) for k, w in WITHIN])
    sums = states.withColumn("_e", F.explode(entries)).groupBy(*KEY, "_e.kind", "_e.within", "_e.part", "_e.bucket").agg(r6(F.sum("s_energy")).alias("s"))
    return sums.groupBy(*KEY, "kind", "within", "part").agg(
        F.min_by("bucket", F.struct(-F.col("s"), F.col("bucket"))).alias("peak"), F.max("s").alias("peak_sum"),
        F.min_by("bucket", F.struct("s", "bucket")).alias("valley"), F.min("s").alias("valley_sum"), r6(F.max("s") - F.min("s")).alias("range"),
        F.count(F.lit(1)).alias("n_buckets"))


SHAPES = {"hour": (lambda: _hour(), "hour(ts)"), "day": (lambda: F.date_format(_day(), "yyyy-MM-dd"), "date_trunc('day', ts)"), "week": (lambda: F.weekofyear(_day()), "week(ts)"), "month": (lambda: F.month(_day()), "month(ts)")}


@query(
    "agg_bucket_shapes",
    with_(
        "readings",
        b=" UNION ALL ".join(
            f"""SELECT bldg_id, '{n}' AS kind, quantile_cont(energy, 0.5) AS med, max(energy) AS mx, CASE WHEN count(*) > 2 THEN skewness(energy) END AS skew FROM readings GROUP BY bldg_id, {e}"""
            for n, (_, e) in SHAPES.items()))
    + """SELECT bldg_id, kind, round(quantile_cont(med, 0.5), 6) AS median, round(quantile_cont(mx / med, 0.5), 6) AS max_to_median, round(quantile_cont(skew, 0.5), 6) AS skewness
         FROM b GROUP BY ALL""",
)
def agg_bucket_shapes(spark, sf):
    """Median over the buckets of a calendar kind of each bucket's median, maximum ÷ median, and skewness."""
    return cube.by_key(readings(spark, sf), KEY, _bucket_shapes)


def _bucket_shapes(rows, whole):
    if whole:
        counted = cube.single(rows, KEY, "ts", "energy")
    else:
        counted = cube.written(cube.cells(rows, KEY, "ts", ["energy"], "energy"), "cells")
    made = cube.shapes(cube.by_bucket(counted, KEY, {n: e() for n, (e, _) in SHAPES.items()}), [*KEY, "grouping", "bucket"], whole)
    # a building has one row for each bucket of the calendar, so the exact aggregate is small
    return made.groupBy(*KEY, F.col("grouping").alias("kind")).agg(
        r6(F.percentile("med", 0.5)).alias("median"), r6(F.percentile(F.try_divide("hi", "med"), 0.5)).alias("max_to_median"), r6(F.percentile("skew", 0.5)).alias("skewness"))
