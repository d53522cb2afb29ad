"""Cleaning: types, constants, nulls, duplicates, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstrata.operators.blocks import DAY, over_blocks
from gridstrata.operators.ranks import attach

_INTEGERS = (
    (T.ByteType(), -(2**7), 2**7 - 1),
    (T.ShortType(), -(2**15), 2**15 - 1),
    (T.IntegerType(), -(2**31), 2**31 - 1),
)


def narrowest_types(df: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """Narrowest integer type that holds each column; one pass, one row to the driver."""
    row = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ).first()
    out = {}
    for c in columns:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        fits = (t for t, a, b in _INTEGERS if lo is not None and a <= lo and hi <= b)
        out[c] = next(fits, T.LongType())
    return out


def downcast(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in narrowest_types(df, columns).items()})


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value (min = max; null counts as a value); one pass."""
    aggs = []
    for c in df.columns:
        same = (F.min(c).eqNullSafe(F.max(c))) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1))))
        aggs.append(same.alias(c))
    row = df.agg(*aggs).first()
    return [c for c in df.columns if row[c]]


def null_columns(df: DataFrame) -> list[str]:
    row = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c]]


def frequent_values(df: DataFrame, key: str, value: str, at_least: int) -> DataFrame:
    """Values seen at least so often for one key."""
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def replace_inf(df: DataFrame, columns: Sequence[str], limit: float = 10000.0) -> DataFrame:
    inf = float("inf")

    def fix(c: str) -> Column:
        x = F.col(c)
        return F.when(x == F.lit(inf), limit).when(x == F.lit(-inf), -limit).otherwise(x)

    return df.withColumns({c: fix(c) for c in columns})


def impute_neighbours(df: DataFrame, keys: Sequence[str], ts: str, column: str, step: int) -> DataFrame:
    """Null → mean of the previous and the next value of the regular series (one of them at gaps), else 0."""

    def build(w):
        before, after = F.lag(column).over(w), F.lead(column).over(w)
        mean = F.coalesce((before + after) / 2, before, after, F.lit(0.0))
        return {f"_{column}": F.coalesce(F.col(column), mean)}

    out = over_blocks(df, keys, ts, build, before=step, after=step, width=30 * DAY)
    return out.drop(column).withColumnRenamed(f"_{column}", column)


def impute_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Zeros and nulls → mean of the other values of the group."""
    cleared = df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in columns})
    means = cleared.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    filled = attach(cleared, keys, means).withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns})
    return filled.drop(*[f"_m_{c}" for c in columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order`` (ties by the remaining columns); combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(c) for c in ranked if c not in keys])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def signature(columns: Sequence[str], digits: int = 3) -> Column:
    """Rounded values as one text, nulls kept as ``null``."""
    parts = [F.coalesce(F.format_string(f"%.{digits}f", F.round(c, digits)), F.lit("null")) for c in columns]
    return F.concat_ws(", ", *parts)


def drop_seen_signatures(new: DataFrame, base: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Rows of ``new`` whose signature is not in ``base``, one per signature (the smallest key)."""
    sig = signature(columns)
    seen = base.select(sig.alias("_sig")).distinct()
    fresh = new.withColumn("_sig", sig).join(seen, "_sig", "left_anti")
    return first_per_key(fresh, ["_sig"], [key]).drop("_sig")


def frequent_days(
    df: DataFrame, keys: Sequence[str], ts: str, count: str, at_least: int = 5, hours: float = 1.0, step_hours: float = 0.25
) -> DataFrame:
    """Days with at least ``hours`` of counts ≥ ``at_least``, then the number of such days per key."""
    big = df.where(F.col(count) >= at_least)
    days = big.groupBy(*keys, F.date_trunc("day", ts).alias("day")).agg((F.count(F.lit(1)) * step_hours).alias("hours"))
    return days.where(F.col("hours") >= hours).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"))
