"""Best rows of a table or of a group. Per-group limits are cut in every task before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extremes(df: DataFrame, key: str, score: str, k: int = 3) -> DataFrame:
    """The k highest and the k lowest rows by score."""
    high = df.orderBy(F.col(score).desc(), key).limit(k).withColumn("end", F.lit("high"))
    low = df.orderBy(F.col(score).asc(), key).limit(k).withColumn("end", F.lit("low"))
    return high.unionByName(low)


def head_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def cheapest(df: DataFrame, keys: Sequence[str], ts: str, cost: str) -> DataFrame:
    """Start of the cheapest window per key, the earliest of several."""
    best = F.min(F.struct(cost, ts)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col(f"_b.{ts}").alias(ts), F.col(f"_b.{cost}").alias(cost))


def best_in_horizon(df: DataFrame, keys: Sequence[str], ts: str, cost: str, days: int = 11) -> DataFrame:
    """For each date the cheapest window in the next days, only where all those days are there.

    The best of each day is found first and then offered to the dates whose horizon holds that day.
    """
    daily = df.groupBy(*keys, F.to_date(ts).alias("_d")).agg(F.min(F.struct(cost, ts)).alias("_b"))
    offers = daily.withColumn("date", F.explode(F.sequence(F.date_sub("_d", days - 1), F.col("_d"))))
    best = offers.groupBy(*keys, "date").agg(F.min("_b").alias("_b"), F.count(F.lit(1)).alias("_n"))
    best = best.where(F.col("_n") == days)
    return best.select(*keys, "date", F.col(f"_b.{ts}").alias("plan_ts"), F.col(f"_b.{cost}").alias("plan_cost"))


def frequent_words(df: DataFrame, words: Column, k: int) -> DataFrame:
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "word").limit(k)


def row_of_max(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row with the largest score per key, the smallest ``ties`` of several."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct((-F.col(score)).alias("s"), *ties)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, "_b.*")
