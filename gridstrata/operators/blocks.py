"""Windows over long series without putting one series into one task.

A series key may hold a large part of all rows, so no window here is partitioned by the key alone. Time is cut in
blocks; a row is copied into the neighbouring blocks whose frames reach it (``over_blocks``), or, where the reach has
no limit, each block is summed up to one row and the block rows are combined (``carry``, ``running``). On a regular
axis a (key, block) pair holds at most ``width / step`` rows plus the halo; there is one block row per key and block
of calendar time, so the second level stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR

Build = Callable[[WindowSpec], dict[str, Column]]


def block_no(ts: str | Column, width: int) -> Column:
    seconds = F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)
    return F.floor(seconds / F.lit(width)).cast("bigint")


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    stages: Build | Sequence[Build],
    before: int = 0,
    after: int = 0,
    width: int = 30 * DAY,
    ties: Sequence[str] = (),
    by_seconds: bool = False,
) -> DataFrame:
    """Window columns whose frames reach ``before`` seconds back and ``after`` seconds ahead.

    The axis must be regular (one row per step), so that a row frame has a known reach in time. Each stage gets the
    window spec and returns columns; a later stage may use those of an earlier one, the reach is that of all together.
    With ``by_seconds`` the spec is ordered by epoch seconds for frames in time, which need no regular axis.
    """
    if callable(stages):
        stages = [stages]
    seconds = F.unix_timestamp(ts)
    first = F.floor((seconds - after) / width).cast("bigint")
    last = F.floor((seconds + before) / width).cast("bigint")
    own = block_no(ts, width)
    if before or after:
        halo = df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_home", F.col("_block") == own)
    else:
        halo = df.withColumn("_block", own).withColumn("_home", F.lit(True))
    order = [seconds] if by_seconds else [ts, *ties]
    spec = Window.partitionBy(*keys, "_block").orderBy(*order)
    for build in stages:
        halo = halo.withColumns(build(spec))
    return halo.where("_home").drop("_block", "_home")


def carry(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: dict[str, Column],
    ahead: bool = False,
    current: bool = True,
    width: int = 30 * DAY,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Last non-null of each value before the row, at any distance (``ahead``: the next one after it)."""
    work = df.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_block", block_no(ts, width))
    order = [F.col(c).desc() if ahead else F.col(c).asc() for c in (ts, *ties)]
    stop = 0 if current else -1
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    position = F.struct(ts, *ties)
    pick = F.min_by if ahead else F.max_by
    blocks = work.groupBy(*keys, "_block").agg(
        *[pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_b_{n}") for n in values]
    )
    edge = F.col("_block").desc() if ahead else F.col("_block").asc()
    across = Window.partitionBy(*keys).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, "_block", *[F.last(f"_b_{n}", ignorenulls=True).over(across).alias(f"_p_{n}") for n in values]
    )
    work = work.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    joined = work.join(blocks, [*keys, "_block"], "left")
    joined = joined.withColumns({n: F.coalesce(f"_i_{n}", f"_p_{n}") for n in values})
    drop = ["_block", *[p + n for n in values for p in ("_v_", "_i_", "_p_")]]
    return joined.drop(*drop)


def running(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    sums: dict[str, Column],
    width: int = 30 * DAY,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Running totals up to and with the row: within the block, plus the total of the earlier blocks."""
    work = df.withColumns({f"_v_{n}": v for n, v in sums.items()}).withColumn("_block", block_no(ts, width))
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    blocks = work.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums])
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", *[F.sum(f"_b_{n}").over(across).alias(f"_p_{n}") for n in sums])
    work = work.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    joined = work.join(blocks, [*keys, "_block"], "left")
    joined = joined.withColumns(
        {n: F.coalesce(F.col(f"_i_{n}"), F.lit(0)) + F.coalesce(F.col(f"_p_{n}"), F.lit(0)) for n in sums}
    )
    return joined.drop("_block", *[p + n for n in sums for p in ("_v_", "_i_", "_p_")])
