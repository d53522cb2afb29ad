"""Rolling, centred and smoothing windows over regular series.

Rolling columns are null until the window is full unless ``min_periods`` is 1, as in the usual data-frame libraries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.functions.arrays import let
from gridstrata.operators.blocks import DAY, carry, over_blocks, running
from gridstrata.operators.lags import shift
from gridstrata.operators.ranks import attach

ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "var": F.var_samp, "sum": F.sum}


def _middle(values: Column) -> Column:
    """Median of a short array."""
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(values, low) + F.get(values, high)) / 2)


def rolling(column: str, stat: str, rows: int, w, min_periods: int | None = None) -> Column:
    frame = w.rowsBetween(-(rows - 1), 0)
    if stat == "median":  # the engine has no framed median; a frame is a short list
        value = let(F.array_sort(F.collect_list(column).over(frame)), _middle)
    else:
        value = ROLLING[stat](column).over(frame)
    return F.when(F.count(column).over(frame) >= (rows if min_periods is None else min_periods), value)


def rolling_stats(
    df: DataFrame, keys: Sequence[str], ts: str, column: str, step: int, windows: Sequence[int], stats: Sequence[str],
    min_periods: int | None = None,
) -> DataFrame:
    def build(w):
        return {f"{s}_{n}": rolling(column, s, n, w, min_periods) for n in windows for s in stats}

    return over_blocks(df, keys, ts, build, before=max(windows) * step)


def lag_grid(
    df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], step: int, depth: int = 10
) -> DataFrame:
    """Lags 1…depth of each column, deltas to now and between neighbouring lags; rows without full history dropped."""

    def lags(w):
        return {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, depth + 1)}

    out = over_blocks(df, keys, ts, lags, before=depth * step)
    out = out.na.drop(subset=[f"{c}_lag{depth}" for c in columns])
    deltas = {}
    for c in columns:
        for k in range(1, depth + 1):
            deltas[f"{c}_delta{k}"] = F.col(c) - F.col(f"{c}_lag{k}")
            if k > 1:
                deltas[f"{c}_step{k}"] = F.col(f"{c}_lag{k - 1}") - F.col(f"{c}_lag{k}")
    return out.withColumns(deltas)


def runs(df: DataFrame, keys: Sequence[str], ts: str, column: str, step: int) -> DataFrame:
    """Length of the current run of rises and of falls: the distance to the last row that was not one."""
    moved = over_blocks(df, keys, ts, lambda w: {"_d": F.col(column) - F.lag(column).over(w)}, before=step)
    rise, fall = F.coalesce(F.col("_d") > 0, F.lit(False)), F.coalesce(F.col("_d") < 0, F.lit(False))
    marks = {"_r": F.when(~rise, F.col(ts)), "_f": F.when(~fall, F.col(ts))}
    out = carry(moved, keys, ts, marks)
    now = F.unix_timestamp(ts)
    return out.withColumns(
        {n: ((now - F.unix_timestamp(c)) / step).cast("bigint") for n, c in (("n_rises", "_r"), ("n_falls", "_f"))}
    ).drop("_d", "_r", "_f")


def peak_flags(df: DataFrame, keys: Sequence[str], ts: str, column: str, step: int, percents: Sequence[int]) -> DataFrame:
    """Smooth, sharp, rising, falling and single-sample peaks against both neighbours, per threshold."""

    def build(w):
        x = F.col(column)
        return {
            "_last": F.try_divide(x - F.lag(column).over(w), x), "_next": F.try_divide(x - F.lead(column).over(w), x)
        }

    out = over_blocks(df, keys, ts, build, before=step, after=step)
    last, nxt = F.col("_last"), F.col("_next")
    flags = {}
    for p in percents:
        t = p / 100
        tests = {
            "smooth": (F.abs(last) <= t) & (F.abs(nxt) <= t), "peak": (F.abs(last) >= t) & (F.abs(nxt) >= t),
            "increase": (last >= t) & (nxt >= t), "decrease": (last <= -t) & (nxt <= -t),
            "ascent": (last >= t) & (nxt <= -t), "descent": (last <= -t) & (nxt >= t),
        }
        flags.update({f"{n}_{p}": F.coalesce(c, F.lit(False)).cast("bigint") for n, c in tests.items()})
    return out.withColumns(flags).drop("_last", "_next")


def centered_max_mean(df: DataFrame, keys: Sequence[str], ts: str, column: str, step: int, floor: float = 10.0) -> DataFrame:
    """Centred 3-row maximum, then its centred 3-row mean; the raw value at the ends; 0 where all is below the floor."""

    def top(w):
        frame = w.rowsBetween(-1, 1)
        return {"_m": F.when(F.count(column).over(frame) == 3, F.max(column).over(frame))}

    def smooth(w):
        frame = w.rowsBetween(-1, 1)
        return {"_e": F.when(F.count("_m").over(frame) == 3, F.avg("_m").over(frame))}

    out = over_blocks(df, keys, ts, [top, smooth], before=2 * step, after=2 * step)
    value = F.coalesce("_e", F.col(column))
    return out.withColumn(
        "envelop", F.when((F.col(column) < floor) & (value < floor), 0.0).otherwise(value)
    ).drop("_m", "_e")


def _edges(df: DataFrame, keys: Sequence[str], ts: str, step: int) -> DataFrame:
    """Rows before and after each row in its regular series."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    now = F.unix_timestamp(ts)
    return attach(df, keys, ends).withColumns(
        {
            "_before": ((now - F.unix_timestamp("_a")) / step).cast("int"),
            "_after": ((F.unix_timestamp("_z") - now) / step).cast("int"),
        }
    ).drop("_a", "_z")


def centered_average(df: DataFrame, keys: Sequence[str], ts: str, column: str, step: int, half: int) -> DataFrame:
    """Centred mean of 2·half + 1 rows; towards the ends the window shrinks on both sides alike."""
    rows = _edges(df, keys, ts, step)
    out = over_blocks(
        rows, keys, ts, lambda w: {"_l": F.collect_list(column).over(w.rowsBetween(-half, half))},
        before=half * step, after=half * step,
    )
    k = F.least("_before", "_after", F.lit(half))
    part = F.slice("_l", F.least("_before", F.lit(half)) - k + 1, 2 * k + 1)
    mean = F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v) / (2 * k + 1)
    return out.withColumn("centered", mean).drop("_l", "_before", "_after")


def seasonal_smooth(df: DataFrame, keys: Sequence[str], ts: str, column: str, slots: int) -> DataFrame:
    """Mean of ``slots`` rows within the day, the day's first and last value repeated beyond its ends.

    A day has a fixed number of slots, so the windows here are small.
    """
    half = slots // 2
    work = df.withColumn("_day", F.date_trunc("day", ts))
    day = Window.partitionBy(*keys, "_day")
    order = day.orderBy(ts)
    pos, n = F.row_number().over(order), F.count(F.lit(1)).over(day)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.greatest(F.lit(half) - (pos - 1), F.lit(0)) * F.first(column).over(whole)
    tail = F.greatest(F.lit(half) - (n - pos), F.lit(0)) * F.last(column).over(whole)
    inner = F.sum(column).over(order.rowsBetween(-half, half))
    return work.withColumn("smooth", (inner + head + tail) / (2 * half + 1)).drop("_day")


def _quadratic_weight(at: int, x: int) -> float:
    """Weight of the sample at x in −3…3 in the value at ``at`` of the least-squares parabola through 7 samples."""
    return 1 / 7 + at * x / 28 + (at * at - 4) * (x * x - 4) / 84


def savgol7(df: DataFrame, keys: Sequence[str], ts: str, column: str, step: int) -> DataFrame:
    """Seven-point parabola smoothing; the first and last three rows are read off the end parabolas."""
    rows = _edges(df, keys, ts, step)

    def build(w):
        def fit(at: int) -> Column:
            terms = [shift(column, at - x, w) * F.lit(_quadratic_weight(at, x)) for x in range(-3, 4)]
            return sum(terms[1:], terms[0])

        out = None
        for p in range(3):
            near_start, near_end = F.col("_before") == p, F.col("_after") == p
            out = F.when(near_start, fit(p - 3)) if out is None else out.when(near_start, fit(p - 3))
            out = out.when(near_end, fit(3 - p))
        return {"savgol": out.otherwise(fit(0))}

    return over_blocks(rows, keys, ts, build, before=6 * step, after=6 * step).drop("_before", "_after")


def ewm(df: DataFrame, keys: Sequence[str], ts: str, column: str, step: int, alpha: float = 0.2) -> DataFrame:
    """Exponentially weighted mean with bias adjustment.

    Within a block the weighted sums are prefix sums of value · r^−position; rows whose weight fell below 1e-16 are
    left behind by the halo. Block and halo together keep r^−position inside the range of a double, whatever alpha is;
    alpha 1 gives the values themselves.
    """
    r = 1 - alpha
    if r <= 1e-16:
        return df.withColumn("ewm", F.col(column).cast("double"))
    depth = 1
    while r**depth >= 1e-16:
        depth += 1

    def position(w):
        return {"_pos": F.row_number().over(w).cast("double")}

    def mean(w):
        frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        grow = F.pow(F.lit(1 / r), F.col("_pos"))
        return {"ewm": F.sum(F.col(column) * grow).over(frame) / F.sum(grow).over(frame)}

    width = max(1, min(500, int(300 / -math.log10(r)) - depth))
    return over_blocks(df, keys, ts, [position, mean], before=depth * step, width=width * step).drop("_pos")


def relative_change(column: str, lag: Column) -> Column:
    return (F.col(column) - lag) / (lag + F.lit(1e-10))


def rolling_trend(df: DataFrame, keys: Sequence[str], ts: str, column: str, step: int, rows: int) -> DataFrame:
    """Mean relative change over the last rows."""
    first = lambda w: {"_c": relative_change(column, F.lag(column).over(w))}
    second = lambda w: {f"trend_{rows}": rolling("_c", "mean", rows, w)}
    return over_blocks(df, keys, ts, [first, second], before=(rows + 1) * step).drop("_c")


def exog_lags(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], step: int) -> DataFrame:
    """Lags 4…12 of each column; of its lags 1…3 rolling mean and trend (4, 8), difference, ratio, difference-ratio."""
    near, far = (1, 2, 3), range(4, 13)

    def lagged(w):
        out = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in far}
        out.update({f"_{c}_{k}": F.lag(c, k).over(w) for c in columns for k in near})
        return out

    def changes(w):
        return {f"_{c}_{k}_r": relative_change(f"_{c}_{k}", F.lag(f"_{c}_{k}").over(w)) for c in columns for k in near}

    def derived(w):
        out = {}
        for c in columns:
            for k in near:
                x = f"_{c}_{k}"
                for rows in (4, 8):
                    out[f"{c}_lag{k}_mean{rows}"] = rolling(x, "mean", rows, w)
                    out[f"{c}_lag{k}_trend{rows}"] = rolling(f"{x}_r", "mean", rows, w)
                for o in (1, 2):
                    s = F.lag(x, o).over(w)
                    out[f"{c}_lag{k}_diff{o}"] = F.col(x) - s
                    out[f"{c}_lag{k}_ratio{o}"] = F.try_divide(F.col(x), s)
                    out[f"{c}_lag{k}_diffratio{o}"] = F.col(x) - F.try_divide(s, F.col(x))
        return out

    out = over_blocks(df, keys, ts, [lagged, changes, derived], before=13 * step)
    return out.drop(*[f"_{c}_{k}{e}" for c in columns for k in near for e in ("", "_r")])


def distance_to_event(df: DataFrame, keys: Sequence[str], ts: str, hit: Column, step: int) -> DataFrame:
    """Rows since the last and until the next hit of the same series; −1 where there is none."""
    mark = {"_at": F.when(hit, F.col(ts))}
    back = carry(df, keys, ts, mark).withColumnRenamed("_at", "_last")
    both = carry(back, keys, ts, mark, ahead=True).withColumnRenamed("_at", "_next")
    now = F.unix_timestamp(ts)
    none = F.lit(-1).cast("bigint")
    return both.withColumns(
        {
            "since_last": F.coalesce(((now - F.unix_timestamp("_last")) / step).cast("bigint"), none),
            "until_next": F.coalesce(((F.unix_timestamp("_next") - now) / step).cast("bigint"), none),
        }
    ).drop("_last", "_next")


def row_index(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str] = ()) -> DataFrame:
    out = running(df, keys, ts, {"row_index": F.lit(1)}, width=7 * DAY, ties=ties)
    return out.withColumn("row_index", F.col("row_index") - 1)
