"""Load profiles: conditional, long and pivoted aggregates of meter series per building.

Everything that compares a value with its day or week first sums to hours (24 per day) or weekdays (7 per week); the
windows that follow hold at most that many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.functions import calendar as cal
from gridstrata.operators.blocks import over_blocks
from gridstrata.operators.ranks import attach, exact_quantiles, most_frequent, value_ranks, with_group_stats

STATS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(cal.base_columns(ts))


def bias_skew(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2) * F.skewness(x))


def bias_kurtosis(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * F.kurtosis(x) + 6))


def conditional_profile(
    df: DataFrame, keys: Sequence[str], value: str, buckets: dict[str, Sequence], stats: Sequence[str]
) -> DataFrame:
    """Statistics of the rows that fall in each bucket value, one column per bucket value and statistic.

    The rows are first summed up to one cell per combination of buckets (a year of quarter hours has about a
    seventeenth as many cells as rows), so the wide list of conditions is evaluated on cells. Wide lists stay under
    about 200 aggregates per pass; the passes are joined on the key.
    """
    cells = df
    if "std" in stats:
        parts = {s: (lambda hit, s=s: STATS[s](F.when(hit, F.col(value)))) for s in stats}
    else:
        cells = df.groupBy(*keys, *buckets).agg(
            F.sum(value).alias("_s"), F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
        )
        whole = {
            "mean": lambda hit: F.try_divide(F.sum(F.when(hit, F.col("_s"))), F.sum(F.when(hit, F.col("_n")))),
            "sum": lambda hit: F.sum(F.when(hit, F.col("_s"))),
            "min": lambda hit: F.min(F.when(hit, F.col("_lo"))),
            "max": lambda hit: F.max(F.when(hit, F.col("_hi"))),
        }
        parts = {s: whole[s] for s in stats}
    columns = [
        parts[s](F.col(bucket) == v).alias(f"{s}_{bucket}_{v}") for bucket, values in buckets.items() for v in values for s in stats
    ]
    passes = [cells.groupBy(*keys).agg(*columns[i : i + 200]) for i in range(0, len(columns), 200)]
    out = passes[0]
    for p in passes[1:]:
        out = out.join(p, list(keys))
    return out


def long_profile(df: DataFrame, keys: Sequence[str], value: str, buckets: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Rows (key, bucket kind, bucket, statistics) by grouping sets."""
    cast = df.withColumns({b: F.col(b).cast("string") for b in buckets})
    sets = [[F.col(k) for k in keys] + [F.col(b)] for b in buckets]
    cols = [F.col(c) for c in (*keys, *buckets)]
    grouped = cast.groupingSets(sets, *cols).agg(
        F.count(value).alias("n"), *[STATS[s](value).alias(s) for s in stats], F.grouping_id().alias("_g")
    )
    width = len(buckets)
    kind = None
    for i, b in enumerate(buckets):
        mask = (2**width - 1) - 2 ** (width - 1 - i)
        kind = F.when(F.col("_g") == mask, b) if kind is None else kind.when(F.col("_g") == mask, b)
    picked = None
    for i, b in enumerate(buckets):
        mask = (2**width - 1) - 2 ** (width - 1 - i)
        picked = F.when(F.col("_g") == mask, F.col(b)) if picked is None else picked.when(F.col("_g") == mask, F.col(b))
    return grouped.select(*keys, kind.alias("kind"), picked.alias("bucket"), "n", *stats)


def pivot_profile(df: DataFrame, keys: Sequence[str], value: str, bucket: str, values: Sequence, suffix: str) -> DataFrame:
    """Mean, median, max, min and standard deviation per bucket, one column each."""
    medians = exact_quantiles(df, [*keys, bucket], value, {"median": 0.5})
    stats = df.groupBy(*keys, bucket).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.stddev_samp(value).alias("std"),
    )
    joined = stats.join(medians, [*keys, bucket])
    names = ("mean", "median", "max", "min", "std")
    wide = [
        F.max(F.when(F.col(bucket) == v, F.col(n))).alias(f"{n}_{v}_{suffix}") for v in values for n in names
    ]
    return joined.groupBy(*keys).agg(*wide)


def quarter_profile_scaled(df: DataFrame, key: str, ts: str, value: str, slots: Sequence[str]) -> DataFrame:
    """Working-day mean per (hour, minute) slot ÷ the building's maximum, missing slots 0."""
    work = df.where(~cal.is_weekend(ts)).withColumn("slot", cal.hh_mm(ts))
    means = work.groupBy(key, "slot").agg(F.avg(value).alias("_m"))
    peak = df.groupBy(key).agg(F.max(value).alias("_peak"))
    wide = means.join(peak, key).groupBy(key).pivot("slot", list(slots)).agg(F.first(F.col("_m") / F.col("_peak")))
    return wide.na.fill(0.0, list(slots))


def ratio_to_group(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Building statistics ÷ the mean of all rows of its group (state)."""
    by_group = df.groupBy(group).agg(F.avg(value).alias("_g"))
    by_key = df.groupBy(key, group).agg(
        *[STATS[s](value).alias(s) for s in ("mean", "max", "min", "std")], F.kurtosis(value).alias("kurt")
    )
    joined = by_key.join(by_group, group)
    return joined.select(key, group, "kurt", *[(F.col(s) / F.col("_g")).alias(f"{s}_ratio") for s in ("mean", "max", "min", "std")])


def season_hour_pivot(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Four times the mean by season and hour, one column per season and hour."""
    labelled = df.withColumns({"s": cal.season_name(F.month(ts)), "h": F.hour(ts)})
    grouped = labelled.groupBy(key, "s", "h").agg((4 * F.avg(value)).alias("v"))
    wide = [
        F.max(F.when((F.col("s") == s) & (F.col("h") == h), F.col("v"))).alias(f"{s}_{h}")
        for s in ("Winter", "Spring", "Summer", "Autumn")
        for h in range(24)
    ]
    return grouped.groupBy(key).agg(*wide)


def _by_slot(df: DataFrame, keys: Sequence[str], period: Sequence[str], slot: str, value: str) -> DataFrame:
    """Sums and extremes per (key, period, slot) with those of the whole period attached."""
    slots = df.groupBy(*keys, *period, slot).agg(
        F.sum(value).alias("s"), F.count(value).alias("n"), F.max(value).alias("mx"), F.min(value).alias("mn")
    )
    w = Window.partitionBy(*keys, *period)
    return slots.withColumns(
        {
            "p_mean": F.sum("s").over(w) / F.sum("n").over(w),
            "p_max": F.max("mx").over(w),
            "p_min": F.min("mn").over(w),
        }
    )


def extreme_slots(
    df: DataFrame, keys: Sequence[str], period: Sequence[str], slot: str, value: str, slots: Sequence, divisor: float
) -> DataFrame:
    """How often each slot attains the maximum (minimum) of its period, ÷ the number of periods."""
    marked = _by_slot(df, keys, period, slot, value)
    columns = []
    for v in slots:
        here = F.col(slot) == v
        for n, hit in (("max", F.col("mx") == F.col("p_max")), ("min", F.col("mn") == F.col("p_min"))):
            columns.append((F.count_if(here & hit) / divisor).alias(f"{n}_{slot}_{v}"))
    return marked.groupBy(*keys).agg(*columns)


def diff_to_period(df: DataFrame, keys: Sequence[str], period: Sequence[str], slot: str, value: str) -> DataFrame:
    """Mean of value − (mean, minimum, maximum of its period) by slot."""
    marked = _by_slot(df, keys, period, slot, value)
    n = F.sum("n")
    return marked.groupBy(*keys, slot).agg(
        *[((F.sum("s") - F.sum(F.col("n") * F.col(p))) / n).alias(name)
          for name, p in (("vs_mean", "p_mean"), ("vs_min", "p_min"), ("vs_max", "p_max"))]
    )


def past_future_diff(df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int, rows: int = 4) -> DataFrame:
    """``drop``: trailing mean of ``rows`` rows, ``rows + 1`` rows ahead, minus the trailing mean now."""

    def trailing(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        return {"_past": F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))}

    def difference(w):
        return {"drop": F.lead("_past", rows + 1).over(w) - F.col("_past")}

    out = over_blocks(df, keys, ts, [trailing, difference], before=rows * step, after=(rows + 1) * step)
    return out.drop("_past")


def day_edges(df: DataFrame, keys: Sequence[str], ts: str, begin: Column, end: Column) -> dict[str, Column]:
    """First stamp of the largest rise inside ``begin`` rows, last stamp of the largest drop inside ``end`` rows."""
    has = F.col("drop").isNotNull()
    rise = F.when(begin & has, F.struct(-F.col("drop"), F.col(ts)))
    fall = F.when(end & has, F.struct(-F.col("drop"), F.col(ts)))
    return {"time_begin": F.min_by(ts, rise), "time_end": F.max_by(ts, fall)}


def range_work(df: DataFrame, key: str, ts: str, value: str, step: int, begin: Column, end: Column) -> DataFrame:
    """Working range in hours: largest per week, smallest of those per month, mean over the months."""
    diff = past_future_diff(df, [key], ts, value, step)
    cols = {"month": F.date_trunc("month", ts), "week": F.date_trunc("week", ts), "day": F.date_trunc("day", ts), "hour": F.hour(ts)}
    days = diff.withColumns(cols).groupBy(key, "month", "week", "day").agg(
        *[c.alias(n) for n, c in day_edges(diff, [key], ts, begin, end).items()]
    )
    hours = ((F.unix_timestamp("time_end") - F.unix_timestamp("time_begin")) / 3600).cast("bigint")
    days = days.withColumn("range", hours)
    weeks = days.groupBy(key, "month", "week").agg(F.max("range").alias("range"))
    months = weeks.groupBy(key, "month").agg(F.min("range").alias("range"))
    return months.groupBy(key).agg(F.avg("range").alias("range_work"))


def robust_increment(df: DataFrame, key: str, ts: str, value: str, step: int, by: str, values: Sequence) -> DataFrame:
    """Largest rise per week, smallest of those per month, mean over months; mirrored for drops; one column per bucket."""
    diff = past_future_diff(df, [key], ts, value, step)
    diff = diff.withColumns({"month": F.date_trunc("month", ts), "week": F.date_trunc("week", ts), "b": F.weekday(ts) if by == "weekday" else F.hour(ts)})
    weeks = diff.groupBy(key, "month", "week", "b").agg(F.max("drop").alias("inc"), F.min("drop").alias("dec"))
    months = weeks.groupBy(key, "month", "b").agg(F.min("inc").alias("inc"), F.max("dec").alias("dec"))
    mean = [
        F.avg(F.when(F.col("b") == v, F.col(n))).alias(f"{long}_{by}_{v}")
        for v in values
        for n, long in (("inc", "increment"), ("dec", "decrement"))
    ]
    return months.groupBy(key).agg(*mean)


def extremes_of_days(df: DataFrame, keys: Sequence[str], bucket: str, ts: str, value: str) -> DataFrame:
    """Largest daily minimum and smallest daily maximum per bucket, with the extremes over the buckets."""
    days = df.groupBy(*keys, bucket, F.date_trunc("day", ts).alias("_d")).agg(F.min(value).alias("mn"), F.max(value).alias("mx"))
    per = days.groupBy(*keys, bucket).agg(F.max("mn").alias("max_of_mins"), F.min("mx").alias("min_of_maxs"))
    at = F.col(bucket)

    def where(col: str, best) -> Column:
        first = F.struct(-F.col(col) if best is max else F.col(col), at)
        return F.min_by(at, first)

    overall = per.groupBy(*keys).agg(
        F.max("max_of_mins").alias("max_of_mins_max"), F.min("max_of_mins").alias("max_of_mins_min"),
        F.max("min_of_maxs").alias("min_of_maxs_max"), F.min("min_of_maxs").alias("min_of_maxs_min"),
        where("max_of_mins", max).alias("max_of_mins_max_at"), where("max_of_mins", min).alias("max_of_mins_min_at"),
        where("min_of_maxs", max).alias("min_of_maxs_max_at"), where("min_of_maxs", min).alias("min_of_maxs_min_at"),
    )
    spread = days.groupBy(*keys).agg(F.stddev_samp("mn").alias("min_std"), F.stddev_samp("mx").alias("max_std"))
    return overall.join(spread, list(keys))


def amplitude(df: DataFrame, keys: Sequence[str], bucket: str, value: str) -> DataFrame:
    """Amplitude ÷ minimum per bucket: mean, population deviation and the buckets of the extremes."""
    per = df.groupBy(*keys, bucket).agg((F.max(value) - F.min(value)).alias("amp"), F.min(value).alias("mn"))
    per = per.withColumn("share", F.try_divide("amp", "mn"))
    return per.groupBy(*keys).agg(
        F.avg("amp").alias("amp_mean"), F.avg("share").alias("share_mean"), F.stddev_pop("share").alias("share_std"),
        F.min_by(bucket, F.struct(-F.col("share"), F.col(bucket))).alias("max_at"),
        F.min_by(bucket, F.struct("share", bucket)).alias("min_at"),
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Most frequent value, its count and ties, quantiles of the counts, values seen at least k times."""
    best = most_frequent(df, keys, value, "most_seen")
    freq = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    quant = exact_quantiles(freq, keys, "c", probs)
    return best.join(quant, list(keys))


def ramp_stats(df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int) -> DataFrame:
    moved = over_blocks(df, keys, ts, lambda w: {"_d": F.col(value) - F.lag(value).over(w)}, before=step)
    up, down = F.greatest("_d", F.lit(0.0)), F.abs(F.least("_d", F.lit(0.0)))
    known = F.col("_d").isNotNull()
    up, down = F.when(known, up), F.when(known, down)
    return moved.groupBy(*keys).agg(
        F.avg(up).alias("up_mean"), F.stddev_samp(up).alias("up_std"),
        F.avg(down).alias("down_mean"), F.stddev_samp(down).alias("down_std"),
    )


def load_duration(df: DataFrame, keys: Sequence[str], value: str, marks: Sequence[int]) -> DataFrame:
    """Share of the total carried by the lowest (highest) values up to each rank; keeps marks[-1] + 1 rows per key.

    The rank filter is a group limit: every task keeps only its best rows before the shuffle.
    """
    out = df.groupBy(*keys).agg(F.sum(value).alias("_total"), F.count(value).alias("_n"))
    for name, order in (("load", F.col(value).asc()), ("unload", F.col(value).desc())):
        w = Window.partitionBy(*keys).orderBy(order)
        top = df.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w))
        top = top.where(F.col("_rn") <= max(marks) + 1)
        sums = top.groupBy(*keys).agg(
            *[F.sum(F.when(F.col("_rn") <= m + 1, F.col(value))).alias(f"{name}_{m}") for m in marks]
        )
        out = out.join(sums, list(keys))
    share = [
        F.when(F.col("_n") > m, F.col(f"{name}_{m}") / F.col("_total")).alias(f"{name}_{m}")
        for name in ("load", "unload")
        for m in marks
    ]
    return out.select(*keys, *share)


def overall_stats(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    labelled = df.withColumns({"_h": F.hour(ts), "_we": cal.is_weekend(ts), "_m": F.month(ts)})
    stats = labelled.groupBy(*keys).agg(
        (F.max(value) - F.min(value)).alias("range"), F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("variance"), bias_skew(value).alias("skew"), bias_kurtosis(value).alias("kurt"),
        (F.max(value) / F.avg(value)).alias("peak_to_average"),
        F.min_by("_h", F.struct(-F.col(value), F.col(ts))).alias("peak_hour"),
        F.avg(F.when(F.col("_we"), F.col(value))).alias("weekend_mean"),
        F.avg(F.when(~F.col("_we"), F.col(value))).alias("weekday_mean"),
        F.avg(F.when(F.col("_m").isin(12, 1, 2), F.col(value))).alias("winter_mean"),
        F.avg(F.when(F.col("_m").isin(6, 7, 8), F.col(value))).alias("summer_mean"),
    )
    return stats


def trimmed(df: DataFrame, keys: Sequence[str], value: str, cut: float = 0.1) -> DataFrame:
    """Mean and range after ``int(cut · n)`` rows are dropped at both ends; ranks from counted values, not a sort."""
    ranks = value_ranks(df.select(*keys, value), keys, value)
    k = F.floor(F.col("total") * cut)
    kept = F.least(F.col("below") + F.col("freq"), F.col("total") - k) - F.greatest(F.col("below"), k)
    ranks = ranks.withColumn("_kept", F.greatest(kept, F.lit(0)))
    alive = F.when(F.col("_kept") > 0, F.col(value))
    return ranks.groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col("_kept")) / F.sum("_kept")).alias("trimmed_mean"),
        (F.max(alive) - F.min(alive)).alias("trimmed_range"),
    )


def median_abs_dev(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    rows = df.select(*keys, value)
    med = exact_quantiles(rows, keys, value, {"_med": 0.5})
    away = attach(rows, keys, med).withColumn("_a", F.abs(F.col(value) - F.col("_med")))
    return exact_quantiles(away, keys, "_a", {"median_abs_dev": 0.5})


def shape_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Geometric mean of the non-zero values, entropy of the shares, mean absolute deviation, mean ÷ peak."""
    joined = with_group_stats(df.select(*keys, value), keys, _total=F.sum(value), _mean=F.avg(value))
    share = F.col(value) / F.col("_total")
    return joined.groupBy(*keys).agg(
        F.exp(F.avg(F.when(F.col(value) > 0, F.ln(value)))).alias("geometric_mean"),
        (-F.sum(F.when(share > 0, share * F.ln(share)))).alias("entropy"),
        F.avg(F.abs(F.col(value) - F.col("_mean"))).alias("mean_abs_dev"),
        (F.avg(value) / F.max(value)).alias("mean_to_peak"),
    )


def calendar_peaks(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Hour, weekday, month, season and week of month with the largest sum (the smallest label of several)."""
    t = F.col(ts)
    base = df.groupBy(*keys, F.hour(t).alias("hour"), F.date_trunc("day", t).alias("_d")).agg(F.sum(value).alias("_s"))
    day = F.col("_d")
    kinds = {
        "hour": F.col("hour").cast("string"), "weekday": F.weekday(day).cast("string"),
        "month": F.month(day).cast("string"), "season": cal.season_name(F.month(day)),
        "week_of_month": cal.week_of_month(day).cast("string"),
    }
    entries = F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("bucket")) for n, c in kinds.items()])
    long = base.withColumn("_e", F.explode(entries)).groupBy(*keys, "_e.kind", "_e.bucket").agg(F.sum("_s").alias("_s"))
    best = F.struct(-F.round("_s", 6), F.col("bucket"))
    return long.groupBy(*keys).agg(
        *[F.min_by("bucket", F.when(F.col("kind") == n, best)).alias(f"peak_{n}") for n in kinds],
        *[F.max(F.when(F.col("kind") == n, F.col("_s"))).alias(f"peak_{n}_sum") for n in kinds],
    )


def period_sum_quantiles(df: DataFrame, keys: Sequence[str], ts: str, value: str, period: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles of sums per calendar period; a key has one row per period, so the exact aggregate is small."""
    sums = df.groupBy(*keys, F.date_trunc(period, ts).alias("_p")).agg(F.sum(value).alias("_s"))
    return sums.groupBy(*keys).agg(*[F.percentile("_s", p).alias(f"{period}_{n}") for n, p in probs.items()])


def slot_outliers(df: DataFrame, key: str, ts: str, value: str, fence: float = 0.5) -> DataFrame:
    """Mean per quarter of day × weekend, then how many of those (≤ 192) lie beyond quartile ± fence · IQR."""
    slots = df.groupBy(key, cal.quarter_of_day(ts).alias("slot"), cal.is_weekend(ts).alias("we")).agg(F.avg(value).alias("m"))
    quart = slots.groupBy(key).agg(
        F.percentile("m", 0.25).alias("q1"), F.percentile("m", 0.75).alias("q3"), F.avg("m").alias("slot_mean"),
        F.stddev_samp("m").alias("slot_std"), F.max("m").alias("slot_max"), F.min("m").alias("slot_min"),
    )
    iqr = F.col("q3") - F.col("q1")
    joined = slots.join(quart, key)
    names = ("q1", "q3", "slot_mean", "slot_std", "slot_max", "slot_min")
    return joined.groupBy(key, *names).agg(
        F.count_if(F.col("m") > F.col("q3") + fence * iqr).alias("n_high"),
        F.count_if(F.col("m") < F.col("q1") - fence * iqr).alias("n_low"),
    )


def week_time_profile(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Mean by hour of the week, standardised per building (population deviation); 168 rows per building."""
    slot = (F.weekday(ts) * 24 + F.hour(ts)).alias("slot")
    means = df.groupBy(key, slot).agg(F.avg(value).alias("m"))
    w = Window.partitionBy(key)
    return means.select(key, "slot", ((F.col("m") - F.avg("m").over(w)) / F.stddev_pop("m").over(w)).alias("z"))
