"""Lags, leads and what is counted on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gridstrata.operators.blocks import over_blocks


def shift(column: str | Column, rows: int, w: WindowSpec) -> Column:
    """The value ``rows`` rows ago (ahead, where negative)."""
    return F.lag(column, rows).over(w) if rows >= 0 else F.lead(column, -rows).over(w)


def reach(lags: Sequence[int], step: int) -> dict[str, int]:
    return {"before": max([*lags, 0]) * step, "after": max([*(-k for k in lags), 0]) * step}


def lag_features(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, lags: dict[str, int], step: int
) -> DataFrame:
    """Difference, absolute difference and share of the value for each lag; all lags share one sort."""

    def build(w):
        return {f"diff_{n}": F.col(value) - shift(value, k, w) for n, k in lags.items()}

    out = over_blocks(df, keys, ts, build, **reach(list(lags.values()), step))
    more = {}
    for n in lags:
        d = F.col(f"diff_{n}")
        more[f"abs_{n}"] = F.abs(d)
        more[f"pct_{n}"] = F.try_divide(d, F.col(value))
    return out.withColumns(more)


def threshold_counts(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, lags: dict[str, int], step: int, percents: Sequence[int]
) -> DataFrame:
    """How many relative changes exceed +t % (fall below −t %), one row per key and lag."""

    def build(w):
        return {f"_p_{n}": F.try_divide(F.col(value) - shift(value, k, w), F.col(value)) for n, k in lags.items()}

    moved = over_blocks(df, keys, ts, build, **reach(list(lags.values()), step))
    entries = F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"_p_{n}").alias("pct")) for n in lags])
    rows = moved.select(*keys, F.inline(entries))
    counts = []
    for t in percents:
        counts.append(F.count_if(F.col("pct") > t / 100).alias(f"gt_{t}"))
        counts.append(F.count_if(F.col("pct") < -t / 100).alias(f"lt_{t}"))
    return rows.groupBy(*keys, "lag").agg(*counts)
