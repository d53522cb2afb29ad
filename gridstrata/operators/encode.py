"""Codes, bins, scaling and small model-side transforms of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.operators.ranks import attach, exact_quantiles, with_group_stats


def category_index(df: DataFrame, column: str) -> DataFrame:
    """Map table value → position among the sorted distinct values, counted by two-letter prefixes."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_p", F.substring(column, 1, 2))
    # One row per two-letter prefix: the window without partitions stays small.
    sizes = values.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return values.withColumn("_i", inside).join(sizes, "_p").select(column, (F.col("_b") + F.col("_i")).alias("code"))


def equal_width_bins(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    """Code 0…bins−1 of right-closed bins of one width; the smallest value is in the first."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    out = attach(df, [], ends)
    share = (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins
    code = F.greatest(F.least(F.ceil(share), F.lit(bins)) - 1, F.lit(0))
    return out.withColumn(name, code).drop("_lo", "_hi")


def target_encoding(df: DataFrame, slot: str, target: str, gate: Column, name: str = "encoded") -> DataFrame:
    """Mean target per slot over the gated rows, joined back to them; 0 for the others."""
    means = df.where(gate).groupBy(slot).agg(F.avg(target).alias("_m"))
    out = df.join(means, slot, "left")
    return out.withColumn(name, F.when(gate, F.col("_m")).otherwise(0.0)).drop("_m")


def standardise(df: DataFrame, keys: Sequence[str], column: str, name: str = "z") -> DataFrame:
    """(x − mean) ÷ sample deviation per key, negative values cut to 0 first."""
    clipped = df.withColumn("_x", F.greatest(F.col(column), F.lit(0.0)))
    out = with_group_stats(clipped, keys, _m=F.avg("_x"), _s=F.stddev_samp("_x"))
    return out.withColumn(name, (F.col("_x") - F.col("_m")) / F.col("_s")).drop("_x", "_m", "_s")


def max_normalise(df: DataFrame, keys: Sequence[str], column: str, name: str = "scaled") -> DataFrame:
    return with_group_stats(df, keys, _hi=F.max(column)).withColumn(name, F.col(column) / F.col("_hi")).drop("_hi")


def clip_scale(df: DataFrame, keys: Sequence[str], column: str, low: float, high: float, name: str = "scaled") -> DataFrame:
    """Cut to two percentiles of the volume and scale to 0…255."""
    ends = exact_quantiles(df, keys, column, {"_lo": low, "_hi": high})
    x = F.least(F.greatest(F.col(column), F.col("_lo")), F.col("_hi"))
    scaled = (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255
    return attach(df, keys, ends).withColumn(name, scaled).drop("_lo", "_hi")


def week_matrix(df: DataFrame, keys: Sequence[str], ts: str, value: str, slots: int, step: int) -> DataFrame:
    """One array of ``slots`` values per key and week, zeros where a slot is missing; a row of the week matrix."""
    monday = F.date_trunc("week", ts)
    at = ((F.unix_timestamp(ts) - F.unix_timestamp(monday)) / step).cast("int")
    pairs = df.groupBy(*keys, monday.alias("week"), at.alias("_i")).agg(F.sum(value).alias("_v"))
    # At most ``slots`` entries per key and week.
    rows = pairs.groupBy(*keys, "week").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    return rows.select(*keys, "week", filled.alias("values"))


def majority(df: DataFrame, keys: Sequence[str], votes: Sequence[str], name: str = "vote") -> DataFrame:
    """Most frequent of the vote columns per row, the smallest of several."""
    long = df.select(*keys, F.explode(F.array(*votes)).alias("_v"))
    counts = long.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias("_b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("_b.v").alias(name))


def mean_of_arrays(df: DataFrame, keys: Sequence[str], arr: str) -> DataFrame:
    """Element-wise mean of the arrays of a group, one row per position."""
    rows = df.select(*keys, F.posexplode(arr).alias("pos", "_v"))
    return rows.groupBy(*keys, "pos").agg(F.avg("_v").alias("mean"))
