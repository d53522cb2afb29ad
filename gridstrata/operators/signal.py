"""Resampling, disaggregation, spectra, opening hours and curve shapes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.functions import calendar as cal
from gridstrata.functions.arrays import let, total
from gridstrata.operators.blocks import carry, over_blocks


def interpolate_linear(df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int) -> DataFrame:
    """Known points to a regular axis of ``step`` seconds by straight lines between neighbours.

    Each known row makes the stamps up to the next known row, so no join with a complete axis is needed.
    """
    nxt = carry(df, keys, ts, {"_n": F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))}, ahead=True, current=False)
    a, b = F.unix_timestamp(ts), F.unix_timestamp("_n.t")
    stop = F.coalesce(b - step, a)
    out = nxt.withColumn("_s", F.explode(F.sequence(a, F.greatest(a, stop), F.lit(step).cast("bigint"))))
    share = (F.col("_s") - a) / (b - a)
    line = F.when(F.col("_n").isNull(), F.col(value)).otherwise(F.col(value) + (F.col("_n.v") - F.col(value)) * share)
    return out.select(*keys, F.timestamp_seconds("_s").alias(ts), line.alias(value))


def disaggregate_hour(df: DataFrame, keys: Sequence[str], ts: str, value: str, shape: str) -> DataFrame:
    """Hour totals to four quarters: equal, linear towards the next hour, or halving the step; the sum is kept.

    The last hour of a series takes its slope from the hour before.
    """
    def near(w):
        return {"_p": F.lag(value).over(w), "_n": F.lead(value).over(w)}

    rows = over_blocks(df, keys, ts, near, before=3600, after=3600)
    last = F.col("_n").isNull() & F.col("_p").isNotNull()
    a = F.when(last, F.col("_p")).otherwise(F.col(value))
    b = F.when(last, F.col(value)).otherwise(F.coalesce("_n", value))
    # How far each quarter has moved from this hour to the next.
    moves = {"equal": (0, 0, 0, 0), "linear": (0, 1 / 4, 2 / 4, 3 / 4), "halving": (0, 4 / 8, 6 / 8, 7 / 8)}[shape]
    raw = F.array(*[a - (a - b) * m for m in moves])
    rows = rows.withColumn("_r", raw).withColumn("_t", total("_r"))
    parts = rows.select(*keys, ts, value, "_t", F.posexplode("_r").alias("_i", "_q"))
    quarter = F.when(F.col("_t") != 0, F.col("_q") * F.col(value) / F.col("_t")).otherwise(F.col(value) / 4)
    return parts.select(*keys, F.timestamp_add("MINUTE", F.col("_i") * 15, F.col(ts)).alias(ts), quarter.alias(value))


def dft_profile(df: DataFrame, keys: Sequence[str], bucket: str, value: Column, terms: int) -> DataFrame:
    """Magnitudes of the first DFT terms of the profile over a calendar bucket; −1 where the profile is shorter.

    The profile has one row per bucket (24 hours, 7 weekdays, …), so its windows are small.
    """
    prof = df.groupBy(*keys, bucket).agg(value.alias("_x"))
    w = Window.partitionBy(*keys)
    prof = prof.withColumns({"_j": F.row_number().over(w.orderBy(bucket)) - 1, "_n": F.count(F.lit(1)).over(w)})
    angle = lambda k: F.col("_j") * (2 * F.pi() * k) / F.col("_n")
    cols = []
    for k in range(terms):
        re, im = F.sum(F.col("_x") * F.cos(angle(k))), F.sum(F.col("_x") * F.sin(angle(k)))
        cols.append(F.when(F.max("_n") > k, F.sqrt(re * re + im * im)).otherwise(F.lit(-1.0)).alias(f"fft_{k + 1}"))
    return prof.groupBy(*keys).agg(F.max("_n").alias("length"), *cols)


def spectral_flatness(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Geometric ÷ arithmetic mean of the one-sided power spectrum of each series.

    The series must be on a complete regular axis: a group then has one row per stamp of the axis, however many raw
    readings the key had.
    """

    def flatness(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ts)[value].to_numpy(float)
        power = np.abs(np.fft.rfft(x)) ** 2
        arithmetic = power.mean()
        ratio = float(np.exp(np.log(np.maximum(power, 1e-300)).mean()) / arithmetic) if arithmetic > 0 else None
        return pd.DataFrame({key: [pdf[key].iloc[0]], "flatness": [ratio]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ts, value).groupBy(key).applyInPandas(flatness, f"{key} {kind}, flatness double")


def stft_power(df: DataFrame, key: str, trace: str, window: int, hop: int = 1) -> DataFrame:
    """Short-time power spectrum of each trace row with a Hann window: one row per trace, time and frequency bin."""
    taper = np.hanning(window)

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, x in zip(pdf[key], pdf[trace]):
                x = np.asarray(x, float)
                if len(x) < window:
                    continue
                frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
                power = np.abs(np.fft.rfft(frames * taper, axis=1)) ** 2
                n, m = power.shape
                yield pd.DataFrame(
                    {key: k, "time": np.repeat(np.arange(n) * hop, m), "freq": np.tile(np.arange(m), n), "power": power.ravel()}
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, trace).mapInPandas(spectra, f"{key} {kind}, time bigint, freq bigint, power double")


# Months whose working days are looked at together for opening hours.
SEASON_GROUPS = {
    "middle": (3, 5, 10),
    "winter": (11, 12, 1, 2),
    "summer": (6, 7, 8),
    "all_year": (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12),
}


def opening_hours(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Opening and closing quarter per season group on working Mondays to Thursdays, and operating-hour estimates.

    Opening is the quarter of the largest mean rise between 03:00 and 12:45 (over one quarter, and over one hour),
    closing that of the largest mean fall between 14:00 and 23:45.
    """

    def moves(w):
        x = F.col(value)
        return {
            "_d": x - F.lag(value).over(w), "_up": x - F.lag(value, 4).over(w),
            "_down": F.lead(value, 3).over(w) - F.lag(value).over(w),
        }

    rows = over_blocks(df, [key], ts, moves, before=3600, after=3600)
    rows = rows.where(~cal.is_holiday(ts) & F.weekday(ts).between(0, 3)).withColumn("_q", cal.quarter_of_day(ts))
    groups = F.array_compact(F.array(*[F.when(F.month(ts).isin(*ms), F.lit(n)) for n, ms in SEASON_GROUPS.items()]))
    slots = rows.withColumn("season", F.explode(groups)).groupBy(key, "season", "_q").agg(
        *[F.round(F.avg(c), 9).alias(c) for c in ("_d", "_up", "_down")]
    )
    early, late = F.col("_q").between(12, 51), F.col("_q").between(56, 95)

    def best(col: str, inside: Column, sign: int) -> Column:
        return F.min_by("_q", F.when(inside & F.col(col).isNotNull(), F.struct(F.col(col) * sign, F.col("_q"))))

    out = slots.groupBy(key, "season").agg(
        best("_d", early, -1).alias("opening_1"), best("_up", early, -1).alias("opening_2"),
        best("_d", late, 1).alias("closing_1"), best("_down", late, 1).alias("closing_2"),
    )
    o1, o2, c1, c2 = (F.col(c) for c in ("opening_1", "opening_2", "closing_1", "closing_2"))
    return out.withColumns(
        {
            "hours_1": (c1 - o1) / 4, "hours_2": (c2 - o2) / 4, "hours_3": ((c1 + c2) / 2 - (o1 + o2) / 2) / 4,
            "hours_min": (F.least(c1, c2) - F.greatest(o1, o2)) / 4, "hours_max": (F.greatest(c1, c2) - F.least(o1, o2)) / 4,
        }
    )


def profile_extrema(df: DataFrame, key: str, ts: str, value: str, step: int, slot: Column, slots: int) -> DataFrame:
    """Slots of the smallest and the largest entry of daily profile curves and their circular distance."""
    rows = over_blocks(df, [key], ts, lambda w: {"_d": F.col(value) - F.lag(value).over(w)}, before=step)
    curves = rows.groupBy(key, slot.alias("_q")).agg(
        F.sum(value).alias("energy_sum"), F.stddev_samp(value).alias("energy_std"), F.min(value).alias("energy_min"),
        F.max(value).alias("energy_max"), F.sum("_d").alias("diff_sum"), F.stddev_samp("_d").alias("diff_std"),
    )
    names = ("energy_sum", "energy_std", "energy_min", "energy_max", "diff_sum", "diff_std")
    curves = curves.withColumns({n: F.round(n, 9) for n in names})
    aggs = []
    for n in names:
        aggs.append(F.min_by("_q", F.struct(n, "_q")).alias(f"argmin_{n}"))
        aggs.append(F.min_by("_q", F.struct(-F.col(n), F.col("_q"))).alias(f"argmax_{n}"))
    out = curves.groupBy(key).agg(*aggs)
    for n in names:
        d = F.col(f"argmax_{n}") - F.col(f"argmin_{n}")
        out = out.withColumn(f"between_{n}", F.when(d < 0, d + slots).otherwise(d))
    return out


def polyfit_matrix(n: int, degree: int) -> np.ndarray:
    """Row k times the n curve values is the k-th least-squares coefficient, highest power first."""
    return np.linalg.pinv(np.vander(np.arange(n, dtype=float), degree + 1))


def curve_polynomial(df: DataFrame, key: str, slot: Column, value: Column, slots: int, degree: int = 5) -> DataFrame:
    """Coefficients of the polynomial through the standardised daily curve, and where the fitted curve turns.

    The slots are fixed, so the least-squares solution is one constant matrix and each coefficient a weighted sum.
    """
    curve = df.groupBy(key, slot.alias("_q")).agg(value.alias("_y"))
    w = Window.partitionBy(key)
    curve = curve.withColumn("_z", (F.col("_y") - F.avg("_y").over(w)) / F.stddev_samp("_y").over(w))
    p = polyfit_matrix(slots, degree)
    weight = lambda k: F.element_at(F.array(*[F.lit(float(x)) for x in p[k]]), F.col("_q") + 1)
    fit = curve.groupBy(key).agg(*[F.sum(F.col("_z") * weight(k)).alias(f"coef_{k + 1}") for k in range(degree + 1)])
    xs = np.linspace(0, slots - 1 + 5, slots)

    def at(x: float) -> Column:
        terms = [F.col(f"coef_{k + 1}") * F.lit(float(x ** (degree - k))) for k in range(degree + 1)]
        return sum(terms[1:], terms[0])

    bends = F.array(*[F.signum(at(xs[i + 2]) - 2 * at(xs[i + 1]) + at(xs[i])) for i in range(slots - 2)])
    fit = fit.withColumn("_s", bends)

    def turning(s: Column) -> Column:
        here = F.sequence(F.lit(1), F.lit(slots - 3))
        return F.filter(here, lambda i: (F.get(s, i) != F.get(s, i - 1)) & (F.get(s, i - 1) != 0))

    fit = fit.withColumn("_t", let(F.col("_s"), turning))
    n = F.size("_t")
    spread = F.when(n > 1, F.array_max("_t") - F.array_min("_t")).otherwise(-1)
    first = [F.coalesce(F.get("_t", F.lit(i)), F.lit(-1)).alias(f"turn_{i + 1}") for i in range(4)]
    return fit.select(
        key, *[f"coef_{k + 1}" for k in range(degree + 1)], n.alias("n_turns"), spread.alias("turn_spread"), *first
    )


def month_thresholds(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Rows flagged as big (low) against the smallest monthly maximum (largest minimum) of the season's working days."""
    # Months of each season.
    seasons = {"winter": (1, 2, 12), "summer": (7, 8, 9), "middle": (5, 6, 11)}
    months = df.where(~cal.is_weekend(ts)).groupBy(key, F.month(ts).alias("_m")).agg(
        F.max(value).alias("_hi"), F.min(value).alias("_lo")
    )
    limits = months.groupBy(key).agg(
        *[F.min(F.when(F.col("_m").isin(*ms), F.col("_hi"))).alias(f"_big_{n}") for n, ms in seasons.items()],
        *[F.max(F.when(F.col("_m").isin(*ms), F.col("_lo"))).alias(f"_low_{n}") for n, ms in seasons.items()],
    )
    out = df.join(limits, key)
    no = F.lit(False)
    flags = {f"big_{n}": F.coalesce(F.col(value) >= F.col(f"_big_{n}"), no).cast("bigint") for n in seasons}
    flags |= {f"low_{n}": F.coalesce(F.col(value) <= F.col(f"_low_{n}"), no).cast("bigint") for n in seasons}
    return out.withColumns(flags).drop(*[f"_{k}_{n}" for k in ("big", "low") for n in seasons])


def series_summary(df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int, lags: Sequence[int] = (1, 24)) -> DataFrame:
    """Energy, changes, crossings, longest run above the mean, autocorrelations and complexity of each series."""
    x = F.col(value)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count(value).alias("_n"))
    rows = df.join(stats, list(keys))

    def moved(w):
        out = {f"_l{k}": F.lag(value, k).over(w) for k in lags}
        out["_prev"] = F.lag(value).over(w)
        return out

    rows = over_blocks(rows, keys, ts, moved, before=max(lags) * step)
    above = x > F.col("_m")
    rows = carry(rows, keys, ts, {"_stop": F.when(~above, F.col(ts))})
    first = df.groupBy(*keys).agg(F.min(ts).alias("_first"))
    rows = rows.join(first, list(keys))
    start = F.coalesce(F.unix_timestamp("_stop"), F.unix_timestamp("_first") - step)
    strike = F.when(above, (F.unix_timestamp(ts) - start) / step).otherwise(0)
    d = x - F.col("_prev")
    crossing = above != (F.col("_prev") > F.col("_m"))
    corr = [
        F.try_divide(F.avg((x - F.col("_m")) * (F.col(f"_l{k}") - F.col("_m"))), F.max("_v")).alias(f"autocorrelation_{k}")
        for k in lags
    ]
    return rows.groupBy(*keys).agg(
        F.sum(x * x).alias("abs_energy"), F.sum(F.abs(d)).alias("abs_changes"), F.avg(F.abs(d)).alias("mean_abs_change"),
        F.count_if(above).alias("n_above_mean"), F.max(strike).cast("bigint").alias("longest_strike"),
        F.sqrt(F.sum(d * d)).alias("complexity"), F.count_if(crossing).alias("n_crossings"), *corr,
    )
