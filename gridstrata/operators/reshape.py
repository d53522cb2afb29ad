"""Unions, set operations, pivots and explodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    return a.select(*shared).unionByName(b.select(*shared))


def union_fill(a: DataFrame, b: DataFrame, as_text: Sequence[str] = ()) -> DataFrame:
    """All columns of both, null where a side has none; listed columns are cast to text first."""

    def text(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c).cast("string") for c in as_text if c in df.columns})

    return text(a).unionByName(text(b), allowMissingColumns=True)


def keys_missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def keys_shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot(df: DataFrame, ids: Sequence[str], name: str, value: Column, values: Sequence, prefix: str = "") -> DataFrame:
    """Long → wide by conditional aggregation over a known value list (no extra pass to find it)."""
    wide = df.groupBy(*ids).pivot(name, list(values)).agg(value)
    return wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values}) if prefix else wide


def flatten_groups(df: DataFrame, ids: Sequence[str], parts: Sequence[str], stats: dict[str, Column], values: Sequence[str]) -> DataFrame:
    """(group × statistic) to one row per id; columns are named ``group_parts_statistic``."""
    label = F.concat_ws("_", *[F.col(p).cast("string") for p in parts])
    named = df.withColumn("_g", label).groupBy(*ids).pivot("_g", list(values))
    return named.agg(*[c.alias(n) for n, c in stats.items()])


def rename_with(df: DataFrame, mapping: dict[str, str], suffix: str = "") -> DataFrame:
    return df.select(*[F.col(a).alias(b + (suffix if a != df.columns[0] else "")) for a, b in mapping.items()])


def slice_menu(samples: DataFrame, axes: dict[str, int]) -> DataFrame:
    """One row per sample, axis and slice index."""
    entries = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(n).alias("n")) for a, n in axes.items()])
    per_axis = samples.withColumn("_a", F.explode(entries))
    return per_axis.select(
        *samples.columns, F.col("_a.axis").alias("axis"), F.explode(F.sequence(F.lit(0), F.col("_a.n") - 1)).alias("idx")
    )
