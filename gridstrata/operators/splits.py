"""Splits and folds. Ranks come from counted hash values, so a class of any size is dealt out by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.operators.ranks import attach, value_ranks

# Fixed values of the id hash: multiplier, modulus (a prime, so ids below it never collide).
HASH_FACTOR = 48271
HASH_PRIME = 2147483647


def id_hash(col: str | Column, seed: int = 0) -> Column:
    """Whole number in 0…2^31−2 that looks random in the id; plain arithmetic, the same in any engine."""
    c = F.col(col) if isinstance(col, str) else col
    return ((c % HASH_PRIME) * HASH_FACTOR + seed * 69621) % HASH_PRIME


def uniform(col: str | Column, seed: int = 0) -> Column:
    return id_hash(col, seed) / float(HASH_PRIME)


def random_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0, name: str = "split") -> DataFrame:
    """Split ids by hash; all rows of an id go to the same side."""
    u, edge, out = uniform(key, seed), 0.0, None
    for split, share in list(shares.items())[:-1]:
        edge += share
        hit = u < edge
        out = F.when(hit, split) if out is None else out.when(hit, split)
    return df.withColumn(name, out.otherwise(list(shares)[-1]))


def kfold(df: DataFrame, key: str, k: int, classes: Sequence[str] = (), seed: int = 0, name: str = "fold") -> DataFrame:
    """Fold 0…k−1 per id, equal in size (to one) within each class."""
    ids = df.select(*classes, key).distinct().withColumn("_h", id_hash(key, seed))
    ranks = value_ranks(ids, list(classes), "_h").select(*classes, "_h", (F.col("below") % k).alias(name))
    return ids.join(ranks, [*classes, "_h"]).select(key, *classes, name)


def rarest_label(df: DataFrame, key: str, labels: Column, name: str = "rarest") -> DataFrame:
    """The label of each row that is least frequent in the table (the smallest of several)."""
    rows = df.select(key, F.explode(labels).alias("_l"))
    counts = rows.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
    best = rows.join(counts, "_l").groupBy(key).agg(F.min(F.struct("_n", "_l")).alias("_b"))
    return best.select(key, F.col("_b._l").alias(name))


def membership_text(fold: Column, k: int) -> Column:
    """``'t, v, t, …'``: v where the row's fold is validated, t where it trains."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == fold, "v").otherwise("t"))
    return F.array_join(marks, ", ")


def temporal_out_of_time(df: DataFrame, key: str, ts: str, train_share: float = 0.8, oot_share: float = 0.15) -> DataFrame:
    """Flags of episodes that end before the train cut date, and of those that end after the out-of-time cut date.

    The cut dates come from cumulative shares of episodes by day; the windows run over days, not over rows.
    """
    spans = df.groupBy(key).agg(F.min(F.date_trunc("day", ts)).alias("first"), F.max(F.date_trunc("day", ts)).alias("last"))
    count = spans.agg(F.count(F.lit(1)).alias("n"))

    def shares(c: str) -> DataFrame:
        days = spans.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return days.select(c, (upto / count.scalar()).alias("_s"))

    train_cut = shares("last").where(F.col("_s") < train_share).agg(F.max("last").alias("train_cut"))
    oot_cut = shares("first").where(F.col("_s") > 1 - oot_share).agg(F.min("first").alias("oot_cut"))
    out = attach(attach(spans, [], train_cut), [], oot_cut)
    no = F.lit(False)
    return out.select(
        key, F.coalesce(F.col("last") < F.col("train_cut"), no).cast("bigint").alias("train"),
        F.coalesce(F.col("last") > F.col("oot_cut"), no).cast("bigint").alias("oot"),
    )


def rolling_origins(df: DataFrame, ts: str, value: str, start: str, stop: str, step_days: int, horizon_days: int) -> DataFrame:
    """Per origin date the rows and mean up to it (train) and in the horizon after it (test).

    Rows are summed to days before the days are offered to the origins they serve.
    """
    days = df.groupBy(F.to_date(ts).alias("_d")).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    origins = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(stop)), F.expr(f"INTERVAL {step_days} DAYS"))
    offers = days.withColumn("origin", F.explode(origins))
    train = F.col("_d") <= F.col("origin")
    test = (F.col("_d") > F.col("origin")) & (F.col("_d") <= F.date_add("origin", horizon_days))

    def over(hit: Column, c: str) -> Column:
        return F.sum(F.when(hit, F.col(c)))

    return offers.groupBy("origin").agg(
        over(train, "_n").alias("n_train"), (over(train, "_s") / over(train, "_n")).alias("train_mean"),
        over(test, "_n").alias("n_test"), (over(test, "_s") / over(test, "_n")).alias("test_mean"),
    )


def draw_labels(ids: DataFrame, key: str, observed: DataFrame, label: str, seed: int = 0) -> DataFrame:
    """A label for each id with the observed frequencies. The share table has one entry per label."""
    counts = observed.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("t"))
    steps = F.aggregate(
        "t", F.expr("named_struct('sum', 0L, 'out', cast(array() as array<struct<upto: bigint, label: string>>))"),
        lambda acc, e: F.struct(
            (acc["sum"] + e["n"]).alias("sum"),
            F.concat(acc["out"], F.array(F.struct((acc["sum"] + e["n"]).alias("upto"), e["label"].cast("string").alias("label")))).alias("out"),
        ),
    )
    table = table.select(steps.alias("s"))
    drawn = attach(ids, [], table)
    want = F.floor(uniform(key, seed) * F.col("s.sum"))
    return drawn.select(*ids.columns, F.filter("s.out", lambda e: e["upto"] > want)[0]["label"].alias(label))
