"""Exact ranks and quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task, and a rank window sorts the group in one task.
Here a mergeable sketch first says where in the value range to look; only that narrow band is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10000


def attach(df: DataFrame, keys: Sequence[str], facts: DataFrame) -> DataFrame:
    """Join one row per key to the rows; without keys the single row comes in as scalar subqueries."""
    if keys:
        return df.join(facts, list(keys))
    return df.select("*", *[facts.select(c).scalar().alias(c) for c in facts.columns])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``probs``, one row per key."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    margin = 4.0 / ACCURACY
    names = list(probs)
    marks = [min(1.0, max(0.0, p + s)) for p in probs.values() for s in (-margin, margin)]
    sketch = rows.groupBy(*keys).agg(
        F.count("_x").alias("_n"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
        F.percentile_approx("_x", marks, ACCURACY).alias("_q"),
    )
    small = F.col("_n") <= ACCURACY
    bands = [
        F.struct(
            F.lit(i).alias("i"),
            ((F.col("_n") - 1) * F.lit(float(p))).alias("h"),
            F.when(small, F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
            F.when(small, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
        )
        for i, p in enumerate(probs.values())
    ]
    sketch = sketch.select(*keys, F.array(*bands).alias("_bands"))
    # Rows below the band collapse to one counted row; rows above it are not needed.
    near = attach(rows, keys, sketch).select(*keys, "_x", F.explode("_bands").alias("_b"))
    near = near.where(F.col("_x") <= F.col("_b.hi")).select(
        *keys,
        F.col("_b.i").alias("_i"),
        F.col("_b.h").alias("_h"),
        F.when(F.col("_x") >= F.col("_b.lo"), F.col("_x")).alias("_v"),
    )
    freq = near.groupBy(*keys, "_i", "_h", "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())
    ranked = freq.withColumn("_to", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_from", F.col("_to") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    low, part = F.floor("_h"), F.col("_h") - F.floor("_h")
    picked = ranked.groupBy(*keys, "_i").agg(
        at(low).alias("_a"), at(low + 1).alias("_z"), F.max(part).alias("_f")
    )
    result = F.when(F.col("_f") > 0, F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).otherwise(F.col("_a"))
    picked = picked.select(*keys, "_i", result.alias("_r"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_r"))).alias(n) for i, n in enumerate(names)])


def _edges_below(edges: Column, value: Column, buckets: int) -> Column:
    """Number of sorted edges below the value, by halving steps (``buckets`` is a power of two)."""
    steps = [1 << i for i in reversed(range((buckets - 1).bit_length()))]

    def move(at: Column, step: Column) -> Column:
        return at + F.when(F.get(edges, at + step - 1) < value, step).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), move)


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None, buckets: int = 256
) -> DataFrame:
    """One row per key and distinct value: ``freq``, ``below`` (rows with a smaller value), ``total`` rows of the key.

    ``sums`` adds further measures summed per value (``x``) and over the smaller values (``x_below``). The value range
    is cut in buckets by sketched quantiles, so a key is ranked by many tasks.
    """
    keys = list(keys)
    measures = {"freq": F.lit(1), **(sums or {})}
    rows = df.where(F.col(value).isNotNull())
    freq = rows.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    cuts = [i / buckets for i in range(1, buckets)]
    edges = rows.groupBy(*keys).agg(
        F.percentile_approx(value, cuts, ACCURACY).alias("_edges"), F.count(F.lit(1)).alias("total")
    )
    cut = attach(freq, keys, edges).withColumn("_bucket", _edges_below(F.col("_edges"), F.col(value), buckets)).drop("_edges")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_b_{n}") for n in measures])
    # At most ``buckets`` rows per key.
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_bucket", *[F.sum(f"_b_{n}").over(across).alias(f"_p_{n}") for n in measures])
    out = cut.withColumns({f"_i_{n}": F.sum(n).over(inside) for n in measures}).join(blocks, [*keys, "_bucket"])
    named = {"freq": "below", **{n: f"{n}_below" for n in (sums or {})}}
    zero = F.lit(0)
    out = out.withColumns(
        {named[n]: F.coalesce(F.col(f"_i_{n}"), zero) + F.coalesce(F.col(f"_p_{n}"), zero) for n in measures}
    )
    return out.drop("_bucket", *[p + n for n in measures for p in ("_i_", "_p_")])


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value (the smallest of several), its count and how many values share it."""
    freq = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    by_count = freq.groupBy(*keys, "_c").agg(F.min(value).alias("_v"), F.count(F.lit(1)).alias("_ties"))
    best = by_count.groupBy(*keys).agg(F.max_by(F.struct("_v", "_c", "_ties"), "_c").alias("_m"))
    return best.select(
        *keys, F.col("_m._v").alias(name), F.col("_m._c").alias(f"{name}_times"), F.col("_m._ties").alias(f"{name}_ties")
    )


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Group statistics joined back to the rows: partial aggregation and a join, no window over the group."""
    return attach(df, keys, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]))
